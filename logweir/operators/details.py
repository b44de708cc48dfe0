"""Per-entry outputs: JSON rows and the plain-text detail block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir import fixed
from logweir.functions.json import extract_json, normalize_json, with_json
from logweir.functions.json_walk import hide_exception, json_blocks, json_fields
from logweir.functions.text import request_label
from logweir.functions.times import full_timestamp, shift_hours


def blocks_of_entries(entries: DataFrame, text: str = "message") -> DataFrame:
    """``file, line_number, block_no, char_offset, json``: every JSON block of a text."""
    found = entries.select("file", "line_number", json_blocks(F.col(text)).alias("blocks"))
    return found.select(
        "file", "line_number", F.posexplode("blocks").alias("block_no", "block")
    ).select("file", "line_number", "block_no", "block.char_offset", "block.json")


def fields_of_entries(
    entries: DataFrame, json: Column, show_exception: bool = False
) -> DataFrame:
    """One row per JSON field and, for texts of several lines, per line of it."""
    walked = entries.select(
        "file", "line_number", json_fields(json, show_exception).alias("fields")
    )
    one = walked.select(
        "file", "line_number", F.posexplode("fields").alias("field_no", "field")
    )
    lines = F.split("field.value", "\n")
    # A final line end does not start another line.
    shown = F.when(
        F.endswith("field.value", F.lit("\n")), F.slice(lines, F.lit(1), F.size(lines) - 1)
    ).otherwise(lines)
    return one.select(
        "file", "line_number", "field_no", "field.path", "field.key",
        F.posexplode(shown).alias("text_line", "text"),
    )


def detail_block(head: Column, json: Column, extra: Column, hours: int) -> Column:
    """Detail text of an entry from the pieces of its message and its continuation text."""
    label = fixed.DETAIL_LABELS
    time = full_timestamp(shift_hours(F.col("ts_local"), hours))
    note = fixed.SHIFT_NOTE % hours if hours else ""
    return F.concat_ws(
        "\n",
        F.concat(F.lit(label["time"]), time, F.lit(note)),
        F.concat(F.lit(label["level"]), "level"),
        F.concat(F.lit(label["request"]), request_label(F.col("request_id"))),
        F.concat(F.lit(label["component"]), "component"),
        F.concat(F.lit(label["line"]), F.col("line_number").cast("string")),
        F.lit(""),
        # concat_ws leaves nulls out, so each part is there only when it applies.
        F.when(json.isNull() & (F.col("message") != ""), F.col("message")),
        F.when(head != "", F.concat(head, F.lit("\n"))),
        F.when(json.isNotNull(), F.concat(F.lit(label["json"] + "\n\n"), json)),
        F.when(extra.isNotNull(), F.concat(F.lit("\n" + label["extra"] + "\n\n"), extra)),
    )


def detail_text(hours: int = 0, show_exception: bool = False) -> Column:
    """Detail text of an entry; JSON is compact, see ``normalize_json``."""
    head, json = extract_json(F.col("message"))
    extra = normalize_json(F.col("extra_data"))
    if not show_exception:
        json, extra = hide_exception(json), hide_exception(extra)
    return detail_block(head, json, extra, hours)


def with_detail(entries: DataFrame, hours: int = 0, show_exception: bool = False) -> DataFrame:
    """``file, line_number, detail``: ``detail_text`` made step by step, JSON parsed once."""
    parsed = with_json(entries).withColumn("extra", normalize_json(F.col("extra_data")))
    if not show_exception:
        for name in ("json", "extra"):
            parsed = parsed.withColumn(name, hide_exception(F.col(name)))
    block = detail_block(F.col("json_head"), F.col("json"), F.col("extra"), hours)
    return parsed.select("file", "line_number", block.alias("detail"))

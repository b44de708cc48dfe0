"""Headers and multi-line entries from numbered lines.

``headers`` is a scan, a filter and a projection: no shuffle. All filters, counts and
summaries need only this. ``assemble`` adds the continuation lines with one exchange: a
line travels to the block of its header, so every entry is whole inside one
``(file, owner_no)`` group, however many blocks it spans, and window and aggregate share
that partitioning. A group is one scan split plus the tail of its last entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.functions.header import clean_line, header_columns, is_blank, is_header

HEADER_FIELDS = [
    "file", "line_number", "ts", "ts_local", "tz_offset_min", "level", "severity",
    "request_id", "component", "message",
]
ENTRY_FIELDS = [
    "file", "line_number", "end_line", "ts", "ts_local", "tz_offset_min", "level", "severity",
    "request_id", "component", "message", "extra_data",
]


def headers(lines: DataFrame, *carry: str) -> DataFrame:
    """One row per entry with the fields of its header line; ``carry`` keeps columns."""
    text = lines.withColumn("value", clean_line("value"))
    return text.where(is_header("value")).select(
        "file", "line_number", *header_columns("value"), *carry
    )


def assemble(lines: DataFrame, partitions: int | None = None) -> DataFrame:
    """Entries with their continuation text.

    Blank lines at both ends of the continuation are dropped, inner ones are kept. Lines
    before the first header of a file belong to no entry. ``end_line`` is the last line
    up to the next header.
    """
    owned = lines.where(F.col("owner_no").isNotNull()).select(
        "file", "owner_no", "line_number", clean_line("value").alias("value")
    )
    owned = owned.withColumn("is_head", is_header("value"))
    if partitions:
        owned = owned.repartition(partitions, "file", "owner_no")
    so_far = (
        Window.partitionBy("file", "owner_no")
        .orderBy("line_number")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    head_line = F.max(F.when(F.col("is_head"), F.col("line_number"))).over(so_far)
    tail = ~F.col("is_head")
    written = tail & ~is_blank("value")
    grouped = (
        owned.withColumn("head_line", head_line)
        .where(F.col("head_line").isNotNull())
        .groupBy("file", "owner_no", "head_line")
        .agg(
            F.max(F.when(F.col("is_head"), F.col("value"))).alias("head"),
            F.max("line_number").alias("end_line"),
            F.min(F.when(written, F.col("line_number"))).alias("first_text"),
            F.max(F.when(written, F.col("line_number"))).alias("last_text"),
            F.sort_array(
                F.collect_list(F.when(tail, F.struct("line_number", "value")))
            ).alias("tail"),
        )
    )
    text = F.slice(
        F.col("tail"),
        (F.col("first_text") - F.col("head_line")).cast("int"),
        (F.col("last_text") - F.col("first_text") + 1).cast("int"),
    )
    extra = F.when(
        F.col("first_text").isNotNull(),
        F.array_join(F.transform(text, lambda line: line["value"]), "\n"),
    )
    return grouped.select(
        "file",
        F.col("head_line").alias("line_number"),
        "end_line",
        *header_columns("head"),
        extra.alias("extra_data"),
    )

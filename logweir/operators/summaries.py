"""Counts and summaries (A1-A8). Every group-by here is combined map-side first."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir import fixed
from logweir.functions.header import clean_line, header_columns, is_header
from logweir.functions.text import cut_bytes, message_prefix, size_label
from logweir.operators.filters import LogFilter


def filter_label(where: LogFilter, matched: Column, total: Column) -> Column:
    """Description of the active filter with its counts; empty when none is set."""
    def text(*pieces: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in pieces])

    if where.request_id is not None:
        return text(" [Request-Fokus: ", where.request_id, " — ", matched.cast("string"), " Einträge]")
    if where.message_prefix is not None:
        prefix = F.lit(where.message_prefix)
        fits = F.octet_length(prefix) <= 40
        short = F.when(fits, prefix).otherwise(F.concat(cut_bytes(prefix, 40), F.lit("…")))
        return text(' [Gleiche: "', short, '" — ', matched.cast("string"), " Einträge]")
    if not where.is_active:
        return F.lit("")
    parts = [where.date_label()] if where.date_label() else []
    if where.min_level is not None or where.search_text is not None:
        parts.append(fixed.OTHER_FILTER_LABEL)
    shown = f": {', '.join(parts)}" if parts else ""
    return text(
        f" [Filter{shown} — ", matched.cast("string"), " von ", total.cast("string"), " Einträgen]"
    )


def query_summary(headers: DataFrame, where: LogFilter, catalog: DataFrame) -> DataFrame:
    """Per file: entries, matching entries, size and the title texts (A1)."""
    counts = headers.groupBy("file").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(where.to_column()).alias("matched")
    )
    joined = catalog.select(F.col("name").alias("file"), "size_bytes").join(counts, "file", "left")
    total = F.coalesce("total", F.lit(0))
    matched = F.coalesce("matched", F.lit(0))
    title = F.concat(
        "file", F.lit(" ("), size_label(F.col("size_bytes")), F.lit(", "),
        total.cast("string"), F.lit(" Einträge)"), filter_label(where, matched, total),
    )
    return joined.select(
        "file", "size_bytes", total.alias("total"), matched.alias("matched"), title.alias("title")
    )


def delete_preview(headers: DataFrame, choices: dict[str, Column]) -> DataFrame:
    """Entries per file that each named delete choice would remove (A2)."""
    return headers.groupBy("file").agg(
        *[F.count_if(choice).alias(name) for name, choice in choices.items()],
        F.count(F.lit(1)).alias("whole_file"),
    )


def last_timestamp(headers: DataFrame) -> DataFrame:
    """Time of the last header line of each file, not the largest time (A3).

    ``headers`` carries either ``line_number`` or the scan order ``place``.
    """
    order = "line_number" if "line_number" in headers.columns else "place"
    return headers.groupBy("file").agg(F.max_by("ts", order).alias("last_ts"))


def tail_timestamp(texts: DataFrame) -> DataFrame:
    """``file, last_ts, found, cut_off`` from the last bytes of each log (A3): the time of the
    last header in them, whether there is one, and whether the log goes back further.

    The first line of a text that does not start where its part does is cut, so it is no header
    that counts.
    """
    lines = texts.select(
        "file", "part_no", "part", "is_whole", F.posexplode(F.split("text", "\n")).alias("at", "line")
    ).withColumn("line", clean_line("line"))
    counts = is_header("line") & ((F.col("at") > 0) | F.col("is_whole"))
    typed = lines.select(
        "file", "is_whole", counts.alias("counts"), F.struct("part_no", "part", "at").alias("place"),
        *header_columns("line"),
    )
    return typed.groupBy("file").agg(
        F.max_by(F.when(F.col("counts"), F.col("ts")), F.when(F.col("counts"), F.col("place")))
        .alias("last_ts"),
        F.bool_or("counts").alias("found"),
        (~F.bool_and("is_whole")).alias("cut_off"),
    )


def is_recent(last_ts: Column, now: Column) -> Column:
    """Last header at most a day old. No header is not recent, a future one is (A4)."""
    return F.coalesce(last_ts >= now - F.make_dt_interval(F.lit(1)), F.lit(False))


def with_recency(
    catalog: DataFrame, last: DataFrame, now: dt.datetime | Column | None = None
) -> DataFrame:
    """Catalog with ``last_ts`` and ``is_recent``; an empty file is never recent."""
    if now is None:
        now = F.current_timestamp()
    elif isinstance(now, dt.datetime):
        now = F.lit(now)
    named = last.withColumnRenamed("file", "name")
    return catalog.join(named, "name", "left").select(
        *catalog.columns,
        "last_ts",
        (~F.col("is_empty") & is_recent(F.col("last_ts"), now)).alias("is_recent"),
    )


def request_summary(headers: DataFrame) -> DataFrame:
    """Entries, first and last line and worst severity per file and request (A5)."""
    return (
        headers.where(F.col("request_id").isNotNull())
        .groupBy("file", "request_id")
        .agg(
            F.count(F.lit(1)).alias("entries"),
            F.min("line_number").alias("first_line"),
            F.max("line_number").alias("last_line"),
            F.min("severity").alias("worst_severity"),
        )
    )


def template_summary(headers: DataFrame) -> DataFrame:
    """Entries per message template."""
    prefix = message_prefix(F.col("message")).alias("message_prefix")
    return headers.groupBy(prefix).agg(F.count(F.lit(1)).alias("entries"))


def level_summary(headers: DataFrame) -> DataFrame:
    """Entries at each level and at or above it (A7); at most eight rows are windowed."""
    counts = headers.groupBy("level", "severity").agg(F.count(F.lit(1)).alias("entries"))
    upward = Window.orderBy("severity").rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("at_or_above", F.sum("entries").over(upward))

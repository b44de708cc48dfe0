"""Order, pages, positions and neighbours.

Positions and neighbours inside a file are found in two levels: rows are grouped by line
ranges of fixed length, and only one summary row per range goes through a per-file window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.operators.numbering import broadcast_if_small
from logweir.plans.session import new_folder

RANGE_LINES = 1 << 17
ORDER = ["file", "line_number"]


def in_file_order(entries: DataFrame) -> DataFrame:
    return entries.orderBy(*ORDER)


def head(entries: DataFrame, n: int) -> DataFrame:
    return entries.orderBy(*ORDER).limit(n)


def tail(entries: DataFrame, n: int) -> DataFrame:
    """The last ``n`` entries, newest first."""
    return entries.orderBy(*[F.desc(c) for c in ORDER]).limit(n)


def tail_per_file(entries: DataFrame, n: int) -> DataFrame:
    """The last ``n`` entries of every file, found by the counts of line ranges: whatever ``n``
    is, no log is sorted, and ranges before the last entries go before anything is shuffled."""
    first = F.col("total") - n + 1
    return _placed(entries, first, F.col("total")).drop("position", "total")


def _ranges() -> Column:
    return F.floor(F.col("line_number") / RANGE_LINES).cast("bigint")


def _placed(entries: DataFrame, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """Entries with position and total; with bounds, only those between two positions.

    Bounds are written on ``total``. Ranges without a wanted position are left out before
    anything but their counts is shuffled.
    """
    ranged = entries.withColumn("_range", _ranges())
    counts = ranged.groupBy("file", "_range").agg(F.count(F.lit(1)).alias("_n"))
    by_file = Window.partitionBy("file")
    before = by_file.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "file",
        "_range",
        "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(by_file).alias("total"),
    )
    if low is not None and high is not None:
        offsets = offsets.where((F.col("_before") < high) & (F.col("_before") + F.col("_n") >= low))
        # The wanted ranges are counted: where they are few, all others go in the scan itself.
        folder = new_folder(entries.sparkSession, "ranges")
        offsets.write.parquet(folder)
        offsets = entries.sparkSession.read.parquet(folder)
        offsets = broadcast_if_small(offsets, offsets.count())
    inner = Window.partitionBy("file", "_range").orderBy("line_number")
    placed = ranged.join(offsets, ["file", "_range"]).withColumn(
        "position", F.col("_before") + F.row_number().over(inner)
    )
    if low is not None and high is not None:
        placed = placed.where(F.col("position").between(low, high))
    return placed.select(*entries.columns, "position", "total")


def with_position(entries: DataFrame) -> DataFrame:
    """Adds 1-based ``position`` in its file and ``total`` entries of that file."""
    return _placed(entries)


def page(entries: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) of every file, clamped to its first and last page."""
    last = F.floor((F.col("total") - 1) / size)
    first = F.least(F.lit(max(number, 0)), last) * size + 1
    return _placed(entries, first, first + size - 1)


def between_positions(entries: DataFrame, one: int, other: int) -> DataFrame:
    """Entries from one marked position to the other, both included, in any order."""
    return _placed(entries, F.lit(min(one, other)), F.lit(max(one, other)))


def lines_at(entries: DataFrame, one: int, other: int) -> DataFrame:
    """First and last line per file of a marked range, the bounds for a range delete."""
    marked = between_positions(entries, one, other)
    return marked.groupBy("file").agg(
        F.min("line_number").alias("first_line"), F.max("line_number").alias("last_line")
    )


def with_neighbours(entries: DataFrame) -> DataFrame:
    """Adds the lines of the previous and next entry of the same file."""
    ranged = entries.withColumn("_range", _ranges())
    ends = ranged.groupBy("file", "_range").agg(
        F.min("line_number").alias("_first"), F.max("line_number").alias("_last")
    )
    by_range = Window.partitionBy("file").orderBy("_range")
    outer = ends.select(
        "file",
        "_range",
        F.lag("_last").over(by_range).alias("_previous_range"),
        F.lead("_first").over(by_range).alias("_next_range"),
    )
    inner = Window.partitionBy("file", "_range").orderBy("line_number")
    own = ranged.withColumn("_previous", F.lag("line_number").over(inner)).withColumn(
        "_next", F.lead("line_number").over(inner)
    )
    return own.join(outer, ["file", "_range"]).select(
        *entries.columns,
        F.coalesce("_previous", "_previous_range").alias("previous_line"),
        F.coalesce("_next", "_next_range").alias("next_line"),
    )


def new_entries(seen: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries whose line was not seen before."""
    return entries.join(seen, ORDER, "left_anti")

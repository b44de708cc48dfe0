"""Deleting entries.

Every delete is a predicate on header lines. A pass over the headers finds the logs that hold
a doomed entry; only these are read again, and written without it. All other logs are handed on
where they are. The verdict of a header is carried to its lines while they stream by (see
``carry``), so no join on entries is needed, and nothing is shuffled but what is written.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.operators.carry import decided
from logweir.operators.filters import LogFilter
from logweir.operators.numbering import broadcast_if_small
from logweir.plans import session
from logweir.sources.sinks import keep_emptied, write_logs

if TYPE_CHECKING:
    from logweir.plans.logset import LogSet


def one_entry(file: str, line_number: int) -> Column:
    """The entry whose header is on this line (D3)."""
    return (F.col("file") == file) & (F.col("line_number") == line_number)


def position_range(file: str, where: LogFilter | None, first_line: int, last_line: int) -> Column:
    """Matching entries between two lines, as ``lines_at`` finds them for positions."""
    inside = (F.col("file") == file) & F.col("line_number").between(first_line, last_line)
    return inside & where.to_column() if where else inside


def by_filter(where: LogFilter) -> Column:
    """All entries a filter shows (D5); an idle filter must not empty the log."""
    if not where.is_active:
        raise ValueError("deleting by filter needs an active filter")
    return where.to_column()


def whole_file(file: str) -> Column:
    """Every entry of a log; with ``drop_orphans`` the log becomes empty."""
    return F.col("file") == file


def touched_logs(log: LogSet, doomed: Column, drop_orphans: Column | None = None) -> list[str]:
    """Names of the logs that lose a line: one row per log, as the listing already is."""
    found = log.headers().where(doomed).select("file")
    if drop_orphans is not None:
        found = found.unionByName(log.index.select("file").where(drop_orphans))
    return [r["file"] for r in found.distinct().collect()]


def surviving_lines(log: LogSet, doomed: Column, drop_orphans: Column | None = None) -> DataFrame:
    """``file, block_no, line_number, value`` of the lines that stay.

    Lines before the first header stay, unless ``drop_orphans`` holds for their file.
    """
    kept = decided(log, doomed, keep=False, orphan=drop_orphans)
    return kept.select("file", "block_no", "line_number", "value")


def in_blocks_order(log: LogSet, lines: DataFrame) -> DataFrame:
    """Lines dealt to tasks by file and block, so that part order is line order. The bounds come
    from the bytes in the index: no text is read to find them."""
    by_file = Window.partitionBy("file")
    upto = by_file.orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    blocks = log.index.select(
        "file", "block_no", F.coalesce(F.sum("n_bytes").over(upto), F.lit(0)).alias("before"))
    files = log.index.groupBy("file").agg(F.sum("n_bytes").alias("n_bytes"))
    # One row per log.
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select(
        "file", F.coalesce(F.sum("n_bytes").over(earlier), F.lit(0)).alias("start"))
    width = max(log.size[1] // session.TASK_BYTES + 1, 1)
    task = F.least(F.floor((F.col("start") + F.col("before")) / session.TASK_BYTES), F.lit(width - 1))
    places = blocks.join(starts, "file").select("file", "block_no", task.cast("int").alias("task"))
    placed = lines.join(broadcast_if_small(places, log.blocks), ["file", "block_no"])
    return placed.repartitionById(width, "task").drop("task")


def rewrite(log: LogSet, doomed: Column, folder: str, drop_orphans: Column | None = None) -> list[str]:
    """Write the logs that lose a line to a new folder and name them; a log that lost every
    line stays as an empty file."""
    names = touched_logs(log, doomed, drop_orphans)
    if names:
        part = log.only(names)
        kept = in_blocks_order(part, surviving_lines(part, doomed, drop_orphans))
        write_logs(kept, folder)
        keep_emptied(log.spark, names, folder)
    return names

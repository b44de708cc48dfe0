"""``LogSet``: the logs of one folder, file or table as lazy DataFrames."""

from __future__ import annotations

import contextlib
import datetime as dt
from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions.header import clean_line, is_header
from logweir.operators import assemble as asm
from logweir.operators import delete, summaries
from logweir.operators.carry import decided
from logweir.operators.filters import LogFilter
from logweir.operators.numbering import block_index, number_lines, text_size
from logweir.plans.session import configure, new_folder, shuffle_width
from logweir.sources import files
from logweir.sources.storage import readable


class LogSet:
    """Lines, headers and entries over raw lines.

    ``numbered`` says that positions are line numbers already; ``whole`` that no log is
    cut into blocks, so that nothing has to be carried from block to block.

    ``source`` is where the logs are; ``rewritten`` are the places of those that ``source`` leaves
    out, because deletes have written them anew. A log is in one place only.

    The block index is built by one scan on first use and kept as a small table in the
    shared folder, so later jobs read the text once and survive a lost executor.
    """

    def __init__(
        self,
        spark: SparkSession,
        raw: DataFrame,
        numbered: bool = False,
        whole: bool = False,
        source: files.LogPath | None = None,
        rewritten: tuple[files.LogPath, ...] = (),
    ) -> None:
        self.spark = configure(spark)
        self.raw = raw
        self.numbered = numbered
        self.whole = whole
        self.source = source
        self.rewritten = rewritten

    # ------------------------------------------------------------------ index and lines

    @cached_property
    def index(self) -> DataFrame:
        folder = new_folder(self.spark, "block-index")
        block_index(self.raw, self.numbered).write.parquet(folder)
        return self.spark.read.parquet(folder)

    @cached_property
    def size(self) -> tuple[int, int]:
        """(blocks, bytes of text)."""
        return text_size(self.index)

    @property
    def blocks(self) -> int:
        return self.size[0]

    @property
    def partitions(self) -> int | None:
        """Shuffle width for all text of the logs."""
        return None if self.whole else shuffle_width(self.spark, self.size[1])

    def lines(self) -> DataFrame:
        """``file, line_number, value, block_no, owner_no`` of every line."""
        if self.whole:
            one = F.lit(1).cast("bigint")
            return self.raw.select(
                "file", F.col("pos").alias("line_number"), "value", one.alias("block_no"),
                one.alias("owner_no"),
            )
        return number_lines(self.raw, self.index, self.blocks)

    # --------------------------------------------------------------- headers and entries

    def headers(self, where: LogFilter | None = None) -> DataFrame:
        """Header fields of all (matching) entries; one scan, no shuffle."""
        return self._heads(where).select(*asm.HEADER_FIELDS)

    def _heads(self, where: LogFilter | None) -> DataFrame:
        heads = asm.headers(self.lines(), "block_no", "owner_no")
        return heads.where(where.to_column()) if where else heads

    def unnumbered_headers(self, where: LogFilter | None = None) -> DataFrame:
        """Header fields without line numbers, for counts: needs no index at all."""
        text = self.raw.withColumn("value", clean_line("value"))
        order = F.struct("part_no", "part", "block", "pos").alias("place")
        heads = text.where(is_header("value")).select(
            "file", order, *asm.header_columns("value")
        )
        return heads.where(where.to_column()) if where else heads

    def entries(self, where: LogFilter | None = None) -> DataFrame:
        """Whole entries. A filter is decided on header lines, and lines of other entries are
        left out while they are scanned, before any text is shuffled."""
        if where is None or not where.is_active:
            return asm.assemble(self.lines(), self.partitions)
        if self.whole:
            wanted = self._heads(where).select("file", "owner_no").distinct()
            kept = self.lines().join(wanted, ["file", "owner_no"], "left_semi")
            return asm.assemble(kept, self.partitions).where(where.to_column())
        return asm.assemble(decided(self, where.to_column(), keep=True), self.partitions)

    def row_counts(self) -> DataFrame:
        """Lines read per file, from the index alone."""
        return self.index.groupBy("file").agg(F.sum("n_lines").alias("lines_read"))

    # ------------------------------------------------------------------------- catalog

    @property
    def sources(self) -> list[files.LogPath]:
        return [self.source, *self.rewritten] if self.source is not None else []

    def catalog(self, now: dt.datetime | Column | None = None, exact: bool = False) -> DataFrame:
        """Logs of the folder with size, last header time and recency.

        The last header is looked for in the last 64 KiB of each log, so the catalog of a big
        folder reads little. Logs whose last entry is longer are scanned; so are all logs on
        storage without byte access for tasks, or with ``exact``. The answer is the same.
        """
        if self.source is None:
            raise ValueError("a catalog needs logs that come from files")
        catalogs, lasts = [], []
        for source in self.sources:
            parts = files.list_parts(self.spark, source)
            catalogs.append(files.file_catalog(source, parts))
            lasts += self._last_times(source, parts, exact)
        found = reduce(DataFrame.unionByName, catalogs)
        return summaries.with_recency(found, reduce(DataFrame.unionByName, lasts), now)

    def _last_times(self, source: files.LogPath, parts: DataFrame, exact: bool) -> list[DataFrame]:
        """Times of the last headers of the logs of a listing."""
        if exact or not readable(source.folder):
            names = {r["file"] for r in parts.select("file").distinct().collect()}
            looked = []
        else:
            folder = new_folder(self.spark, "last-headers")
            texts = files.tail_texts(parts, source.in_parts)
            summaries.tail_timestamp(texts).write.parquet(folder)
            seen = self.spark.read.parquet(folder)
            looked = [seen.where("found").select("file", "last_ts")]
            names = {r["file"] for r in seen.where("NOT found AND cut_off").collect()}
        if names:
            log = files_of(self.spark, replace(source, name=None, only=frozenset(names)))
            looked.append(summaries.last_timestamp(log.unnumbered_headers()))
        return looked or [self.spark.createDataFrame([], "file string, last_ts timestamp")]

    # -------------------------------------------------------------------------- deletes

    def only(self, names: list[str]) -> LogSet:
        """The same logs, these alone; they are the only ones scanned."""
        if self.source is None:
            raw = self.raw.where(F.col("file").isin(*names))
            return LogSet(self.spark, raw, self.numbered, self.whole)
        chosen = frozenset(names)
        parts = [(p, frozenset(n for n in chosen if p.takes(n) and p.name in (None, n)))
                 for p in self.sources]
        raws = [files.scan_lines(self.spark, replace(p, only=c)) for p, c in parts if c]
        return LogSet(self.spark, reduce(DataFrame.unionByName, raws))

    def without(self, doomed: Column, drop_orphans: Column | None = None) -> DataFrame:
        """``file, line_number, value`` of the lines that stay when the entries with ``doomed``
        headers go (D2). Logs without such a header are only scanned."""
        fields = ["file", "line_number", "value"]
        names = delete.touched_logs(self, doomed, drop_orphans)
        if not names:
            return self.lines().select(*fields)
        kept = delete.surviving_lines(self.only(names), doomed, drop_orphans).select(*fields)
        rest = self.lines().where(~F.col("file").isin(*names)).select(*fields)
        return rest.unionByName(kept)

    def rewrite(self, doomed: Column, folder: str, drop_orphans: Column | None = None) -> LogSet:
        """Write the logs that lose lines to a new folder, and open them there together with
        all other logs where they are (S7, D6). The result takes further deletes; nothing that
        an earlier state reads is changed."""
        if self.source is None:
            raise ValueError("only logs that come from files are rewritten")
        folder = files.qualified(self.spark, folder)
        names = frozenset(delete.rewrite(self, doomed, folder, drop_orphans))
        if not names:
            return self
        places = [replace(p, without=p.without | names) for p in self.sources]
        rewritten = [p for p in places[1:] if p.only - p.without]
        new = files.LogPath(folder, None, True, only=names)
        return files_of(self.spark, places[0], (*rewritten, new))


def files_of(
    spark: SparkSession, source: files.LogPath, rewritten: tuple[files.LogPath, ...] = ()
) -> LogSet:
    """The logs of a place, and of others for those that were rewritten."""
    raws = []
    for place in (source, *rewritten):
        with contextlib.suppress(files.NoLogsFound):
            raws.append(files.scan_lines(spark, place))
    if not raws:
        raise files.NoLogsFound(f"no log files in {source.folder}")
    raw = reduce(DataFrame.unionByName, raws)
    return LogSet(spark, raw, source=source, rewritten=rewritten)


def open_logs(spark: SparkSession, path: str | None = None) -> LogSet:
    """Open a folder of logs or one log (S5). Raises when there is nothing to open."""
    configure(spark)
    return files_of(spark, files.resolve_path(spark, path))


def logs_of_text(df: DataFrame, key: str, text: str) -> LogSet:
    """Parse logs held in a table column, one log per row."""
    raw = files.lines_of_text(df, key, text)
    return LogSet(df.sparkSession, raw, numbered=True, whole=True)


def logs_of_lines(df: DataFrame) -> LogSet:
    """Logs from a table of numbered lines ``file, line_number, value``."""
    return LogSet(df.sparkSession, files.lines_of_table(df), numbered=True)

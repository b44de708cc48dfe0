"""Text log scan, file catalog and path resolution.

Two layouts are read. A plain folder holds ``x.log`` and ``x.log.suffix`` files, each one
log. A rewritten folder (see ``sinks``) holds ``file=x.log/part-*``; the parts of one log
follow each other in part order, so a big log is written by many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir import fixed
from logweir.functions.text import size_label
from logweir.plans.session import configure
from logweir.sources.storage import (
    Child, is_log, kind_of, list_children, literal, qualified, read_range,
)

PARTS_SCHEMA = "value string, file string"


class NoLogsFound(FileNotFoundError):
    """The path does not exist or holds no log file."""


class MixedLayouts(ValueError):
    """A folder holds plain logs beside logs in parts; reading one kind would lose the other."""


@dataclass(frozen=True)
class LogPath:
    """Where the logs are: the folder, the one picked log if any, and the layout. The folder
    is qualified, so that tasks and the driver mean the same place."""

    folder: str
    name: str | None
    in_parts: bool
    # Only these logs, or all but these (they have been rewritten elsewhere).
    only: frozenset[str] | None = None
    without: frozenset[str] = frozenset()

    def takes(self, file: str) -> bool:
        return file not in self.without and (self.only is None or file in self.only)

    def wanted(self, file: Column) -> Column:
        """``takes`` and the picked name as a predicate."""
        found = F.lit(True)
        if self.name is not None:
            found = found & (file == self.name)
        if self.only is not None:
            found = found & file.isin(*sorted(self.only))
        return found & ~file.isin(*sorted(self.without)) if self.without else found


def _decoded(uri: Column) -> Column:
    """Metadata paths are percent-encoded; a plus sign in them stands for itself."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def resolve_path(spark: SparkSession, path: str | None = None) -> LogPath:
    """A folder means all its logs, a file means that log, None the default folder.

    A folder is in parts when it has ``file=...`` folders. Names of files never decide, and
    plain logs beside such folders are refused.
    """
    place = path or fixed.DEFAULT_LOG_DIR
    whole = qualified(spark, place)
    kind = kind_of(spark, whole)
    if kind is None:
        raise NoLogsFound(f"path not found: {place}")
    parent, _, name = whole.rpartition("/")
    if kind == "file":
        return LogPath(parent, name, False)
    if name.startswith("file="):
        return LogPath(parent, unquote(name[len("file="):]), True)
    children = list_children(spark, whole)
    in_parts = any(c.is_folder and c.name.startswith("file=") for c in children)
    if in_parts and any(not c.is_folder and is_log(c.name) for c in children):
        raise MixedLayouts(f"{whole} holds plain logs beside logs in parts")
    return LogPath(whole, None, in_parts)


def _scan_files(reader, paths: list[str]):
    """Reads exactly these files: names are no patterns, folders above them no columns."""
    return reader.option("recursiveFileLookup", "true").text([literal(p) for p in paths])


def scan_lines(spark: SparkSession, logs: LogPath) -> DataFrame:
    """Raw lines ``file, part_no, part, block, pos, value`` of all logs or the picked one.

    The position is taken on the scan itself, where the lines of a split follow each other.
    Only names are filtered before that, so no line is lost between two positions. A plain
    folder is read by the list of its logs, the same that the catalog shows.
    """
    configure(spark)
    reader = spark.read.option("lineSep", "\n")
    meta = [
        F.col("_metadata.file_path").alias("part"),
        F.col("_metadata.file_block_start").alias("block"),
    ]
    if logs.in_parts:
        reader = reader.option("basePath", logs.folder).schema(PARTS_SCHEMA)
        file = F.coalesce("file", F.lit(""))
        lines = reader.text(f"{literal(logs.folder)}/file=*").where(logs.wanted(file))
        number = F.regexp_extract("_metadata.file_name", r"\Apart-([0-9]+)", 1)
        chosen = lines.select(
            file.alias("file"),
            F.coalesce(number.try_cast("bigint"), F.lit(0)).alias("part_no"),
            *meta,
            "value",
        )
    else:
        if logs.name is None:
            paths = [f"{logs.folder}/{c.name}" for c in _plain_logs(spark, logs)]
        else:
            paths = [f"{logs.folder}/{logs.name}"] if logs.takes(logs.name) else []
        if not paths:
            raise NoLogsFound(f"no log files in {logs.folder}")
        chosen = _scan_files(reader, paths).select(
            _decoded(F.col("_metadata.file_name")).alias("file"),
            F.lit(0).cast("bigint").alias("part_no"), *meta, "value",
        )
    return chosen.withColumn("pos", F.monotonically_increasing_id())


def _plain_logs(spark: SparkSession, logs: LogPath) -> list[Child]:
    return [
        c for c in list_children(spark, logs.folder)
        if not c.is_folder and is_log(c.name) and logs.takes(c.name)
    ]


LISTING_SCHEMA = "file string, part_no bigint, part string, length bigint"


def list_parts(spark: SparkSession, logs: LogPath) -> DataFrame:
    """``file, part_no, part, length`` of every part of every log; a plain log is one part.

    Listed by the driver through Hadoop's file system, as Spark lists what it scans; its file
    sources alone would leave out files of zero bytes, which a catalog has to show.
    """
    rows = []
    if logs.in_parts:
        for child in list_children(spark, logs.folder, below="file=*"):
            folder, _, name = child.path.rpartition("/")
            number = re.match(r"part-([0-9]+)", name)
            log = unquote(folder.rpartition("/")[2][len("file="):])
            if logs.takes(log):
                rows.append((log, int(number[1]) if number else 0, child.path, child.length))
    else:
        rows = [(c.name, 0, c.path, c.length) for c in _plain_logs(spark, logs)]
    return spark.createDataFrame(rows, LISTING_SCHEMA)


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Small rows that each stand for reading a file: over all cores, not one partition."""
    width = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(width, key)


def file_catalog(logs: LogPath, parts: DataFrame) -> DataFrame:
    """``path, name, size_bytes, size_label, is_empty`` of every log of a listing.

    Picking one file still lists its siblings. File content is not read. Sort with
    ``orderBy("path")`` where an order is wanted.
    """
    if logs.in_parts:
        sized = parts.groupBy("file").agg(F.sum("length").alias("size_bytes"))
        path = F.concat(F.lit(logs.folder + "/file="), "file")
    else:
        sized = parts.withColumnRenamed("length", "size_bytes")
        path = F.col("part")
    return sized.select(
        path.alias("path"),
        F.col("file").alias("name"),
        "size_bytes",
        size_label(F.col("size_bytes")).alias("size_label"),
        (F.col("size_bytes") == 0).alias("is_empty"),
    )


def lines_of_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Raw lines of logs held in a table column, one log per row.

    The empty piece behind a final line end is not a line.
    """
    pieces = F.split(F.col(text), "\n")
    lines = F.when(F.endswith(F.col(text), F.lit("\n")) | (F.col(text) == ""),
                   F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)
    return df.select(
        F.col(key).cast("string").alias("file"),
        F.lit(0).cast("bigint").alias("part_no"),
        F.lit(0).cast("bigint").alias("block"),
        F.posexplode(lines).alias("at", "value"),
    ).select(
        "file",
        "part_no",
        F.col("file").alias("part"),
        "block",
        (F.col("at") + 1).cast("bigint").alias("pos"),
        "value",
    )


def lines_of_table(df: DataFrame, lines_per_block: int = 1 << 17) -> DataFrame:
    """Raw lines from a table ``file, line_number, value`` that is already numbered."""
    return df.select(
        "file",
        F.lit(0).cast("bigint").alias("part_no"),
        F.col("file").alias("part"),
        F.floor(F.col("line_number") / lines_per_block).cast("bigint").alias("block"),
        F.col("line_number").cast("bigint").alias("pos"),
        "value",
    )


def tail_texts(parts: DataFrame, in_parts: bool, tail_bytes: int = fixed.TAIL_BYTES) -> DataFrame:
    """Last bytes of every log of a listing as ``file, part_no, part, text, is_whole``; nothing
    else is read. ``is_whole`` says that the text starts where its part does.

    A log in parts gives the ends of as many of its last parts as reach ``tail_bytes``.
    """
    later = (
        Window.partitionBy("file")
        .orderBy(F.desc("part_no"), F.desc("part"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    room = F.lit(tail_bytes) - F.coalesce(F.sum("length").over(later), F.lit(0))
    # A plain log is one part, so the window over its parts is not needed.
    parts = parts.withColumn("room", room if in_parts else F.lit(tail_bytes))
    ends = parts.where((F.col("room") > 0) & (F.col("length") > 0))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, whole = [], []
            for uri, length, room in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4))):
                start = max(length - room, 0)
                texts.append(read_range(uri, start, length - start).decode("utf-8", "replace"))
                whole.append(start == 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(texts, pa.string()), pa.array(whole, pa.bool_())],
                names=["file", "part_no", "part", "text", "is_whole"],
            )

    return spread(ends, "part").mapInArrow(
        read, "file string, part_no bigint, part string, text string, is_whole boolean"
    )

"""Log folders rendered from tables, for checks and benchmarks.

No table holds log text, so each log set is written out from typed columns. The queries
then run the real scan and parser on it, while the oracle works on the typed columns.

events         one header line per event, JSON in the message, 4096 lines per log
documents      one log per language; header, two blank lines, the text, a blank line
conversations  one log; header per turn, then the text of the turn
crashes        one log per language; header and one JSON line with an ``exception``
dirty          the events with broken headers, odd zones, CRLF ends and broken JSON in turn
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir import fixed
from logweir.operators.numbering import broadcast_if_small
from logweir.plans.logset import LogSet, open_logs
from logweir.plans.session import new_folder
from logweir.sources.files import spread
from logweir.sources.sinks import in_line_order, write_logs
from logweir.sources.storage import list_folder_times, locate, stored_bytes

EVENTS_PER_LOG = 4096
EVENT_LEVELS = {
    "error": "ERROR", "signup": "WARNING", "purchase": "NOTICE", "view": "INFO",
    "click": "DEBUG",
}
ROLE_LEVELS = {"user": "INFO", "assistant": "NOTICE", "system": "DEBUG"}


def _choose(column: Column, choices: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in choices.items() for x in pair])[column]


def header_line(
    ts: Column, zone: Column, level: Column, request: Column, component: Column, message: Column
) -> Column:
    """Header text of typed fields; ``ts`` is the wall clock, cut to seconds."""
    day = F.element_at(F.array(*[F.lit(d) for d in fixed.WEEKDAYS]), F.weekday(ts) + 1)
    month = F.element_at(F.array(*[F.lit(m) for m in fixed.MONTHS]), F.month(ts))
    iso = ts.cast("string")  # yyyy-MM-dd HH:mm:ss...
    return F.concat(
        day, F.lit(", "), F.substring(iso, 9, 2), F.lit(" "), month, F.lit(" "),
        F.substring(iso, 1, 4), F.lit(" "), F.substring(iso, 12, 8), F.lit(" "), zone,
        F.lit(" ["), level, F.lit('] request="'), request, F.lit('" component="'), component,
        F.lit('": '), message,
    )


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, line_number, value`` of the events logs."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    zones = F.array(F.lit("+0000"), F.lit("+0200"), F.lit("-0530"))
    cents = F.round(F.col("value") * 100).cast("bigint").cast("string")
    value = header_line(
        F.col("ts"),
        F.element_at(zones, (F.col("event_id") % 3 + 1).cast("int")),
        _choose(F.col("event_type"), EVENT_LEVELS),
        F.when(F.col("event_id") % 50 == 0, "").otherwise(
            F.concat(F.lit("u"), F.col("user_id").cast("string"))
        ),
        F.concat(F.lit("App."), "event_type", F.lit(".Service")),
        F.concat("event_type", F.lit(" amount "), cents, F.lit(" - "), "props"),
    )
    number = F.floor(F.col("event_id") / EVENTS_PER_LOG).cast("string")
    return e.select(
        F.concat(F.lit("events.log."), number).alias("file"),
        (F.col("event_id") % EVENTS_PER_LOG + 1).alias("line_number"),
        value.alias("value"),
    )


def dirty_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the events logs, eight kinds in turn. Kinds 1 to 3 are no headers, so each
    log starts with lines that belong to no entry."""
    value = F.col("value")
    days = [F.lit(d) for d in fixed.WEEKDAYS]
    place = F.array_position(F.array(*days), F.substring(value, 1, 3)).cast("int")
    next_day = F.element_at(F.array(*days[1:], days[0]), place)
    kinds = [
        F.concat(value, F.lit("\r")),
        F.concat(next_day, F.substring(value, 4, 1 << 20)),
        F.concat(F.substring(value, 1, 5), F.lit("31 Feb"), F.substring(value, 12, 1 << 20)),
        F.regexp_replace(value, r" \[[A-Z]+\] request=", " [VERBOSE] request="),
        F.concat(F.substring(value, 1, 26), F.lit("+2300"), F.substring(value, 32, 1 << 20)),
        F.concat(F.upper(F.substring(value, 1, 11)), F.substring(value, 12, 1 << 20)),
        F.concat(value, F.lit(" {oops")),
        value,
    ]
    kind = (F.col("line_number") % 8).cast("int")
    dirty = kinds[-1]
    for number, made in enumerate(kinds[:-1]):
        dirty = F.when(kind == number, made).otherwise(dirty)
    return event_lines(spark, sf_dir).withColumn("value", dirty)


def _document_header(message: Column) -> Column:
    start = F.lit("2024-03-01").cast("timestamp_ntz")
    doc = F.col("doc_id")
    return header_line(
        start + F.make_dt_interval(mins=doc),
        F.lit("+0100"),
        F.element_at(F.array(*[F.lit(x) for x in fixed.LEVELS]), (doc % 8 + 1).cast("int")),
        F.concat(F.lit("d"), F.floor(doc / 5).cast("string")),
        F.concat(F.lit("Docs."), "source"),
        message,
    )


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, line_number, value``: one row with all lines per document, in doc_id order."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    message = F.concat(
        F.lit("document "), F.col("doc_id").cast("string"), F.lit(' - {"lang":"'), "lang",
        F.lit('","n":'), F.col("n_chars").cast("string"), F.lit("}"),
    )
    return d.select(
        F.concat(F.lit("documents-"), "lang", F.lit(".log")).alias("file"),
        F.col("doc_id").alias("line_number"),
        F.concat(_document_header(message), F.lit("\n\n  \n"), "text", F.lit("\n")).alias("value"),
    )


def crash_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    payload = F.to_json(
        F.struct(
            F.col("text").alias("exception"),
            F.struct("doc_id", F.array("lang", "source").alias("tags")).alias("meta"),
        )
    )
    return d.select(
        F.concat(F.lit("crashes-"), "lang", F.lit(".log")).alias("file"),
        F.col("doc_id").alias("line_number"),
        F.concat(_document_header(F.lit("Uncaught failure")), F.lit("\n"), payload).alias("value"),
    )


def conversation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    start = F.lit("2024-05-01").cast("timestamp_ntz")
    turn = F.col("turn").cast("string")
    head = header_line(
        start + F.make_dt_interval(mins=F.col("conv_id"), secs=F.col("turn")),
        F.lit("-0500"),
        _choose(F.col("role"), ROLE_LEVELS),
        F.concat(F.lit("c"), F.col("conv_id").cast("string")),
        F.concat(F.lit("Chat."), "role"),
        F.concat("role", F.lit(" turn "), turn),
    )
    return c.select(
        F.lit("conversations.log").alias("file"),
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("line_number"),
        F.concat(head, F.lit("\n"), "text").alias("value"),
    )


TEXTS = {
    "events": event_lines,
    "documents": document_texts,
    "conversations": conversation_texts,
    "crashes": crash_texts,
    "dirty": dirty_lines,
}


TABLES = {
    "events": "events", "documents": "documents", "conversations": "conversations",
    "crashes": "documents", "dirty": "events",
}
# Bytes of a table, as it is stored, that a task sorts and writes as log text.
RENDER_BYTES = 8 * 1024 * 1024

_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The rendered texts as a stored table ``file, line_number, value``, made once."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        folder = new_folder(spark, f"texts-{name}")
        TEXTS[name](spark, sf_dir).write.parquet(folder)
        _TABLES[key] = spark.read.parquet(folder)
    return _TABLES[key]


# Lines of a chunk: a published log is dealt to tasks by whole chunks.
CHUNK_LINES = 1 << 13
# Text that a task publishes.
PUBLISH_BYTES = 32 * 1024 * 1024


def publish(lines: DataFrame, folder: str) -> None:
    """Put logs ``file, line_number, value`` into a folder as plain files, as a log writer
    would. A file appears whole, so a repeated task only writes the same bytes again.

    Where a log is one file that takes writes at any place, many tasks write it: the lines are
    scanned for the bytes of each chunk of line numbers, and a task then writes its chunks at
    their places. Other storage has no such writes; there one task writes a log, line by line.
    """
    files, root = locate(folder)
    if not isinstance(files, pafs.LocalFileSystem):
        return _publish_by_log(lines, folder)
    placed, sizes = in_places(lines)
    _run(placed.mapInArrow(_write_places(root), "done boolean"))
    _run(spread(sizes, "file").mapInArrow(_show(root), "done boolean"))


def in_places(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines ``file, place, value`` dealt to tasks by PUBLISH_BYTES, in line order, with the byte at
    which their chunk starts in its log; and ``file, size`` of the logs."""
    chunked = lines.select(
        "file", F.floor(F.col("line_number") / CHUNK_LINES).alias("chunk"), "line_number",
        F.col("value").cast("binary").alias("value"))
    kept = new_folder(lines.sparkSession, "chunks")
    chunked.groupBy("file", "chunk").agg(
        F.sum(F.octet_length("value") + 1).alias("n_bytes")).write.parquet(kept)
    chunks = lines.sparkSession.read.parquet(kept)
    sizes = chunks.groupBy("file").agg(F.sum("n_bytes").alias("size"))
    # One row per log.
    starts = sizes.withColumn("start", F.coalesce(F.sum("size").over(
        Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.coalesce(F.sum("n_bytes").over(Window.partitionBy("file").orderBy("chunk").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    placed = chunks.withColumn("place", place).join(starts, "file").select(
        "file", "chunk", "place",
        F.floor((F.col("start") + F.col("place")) / PUBLISH_BYTES).cast("int").alias("task"))
    total = chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    dealt = chunked.join(broadcast_if_small(placed, total[0]), ["file", "chunk"]).repartitionById(
        total[1] // PUBLISH_BYTES + 1, "task").sortWithinPartitions("file", "line_number")
    return dealt.select("file", "place", "value"), sizes


def _run(rows: DataFrame) -> None:
    rows.write.format("noop").mode("overwrite").save()


def _write_places(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes values into hidden files from their chunk's place on."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(root, exist_ok=True)
        at, out = None, None
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("file", "place", "value")))
            for (file, place), run in groupby(rows, key=lambda row: row[:2]):
                if at is None or at[0] != file:
                    if out is not None:
                        out.close()
                    out = open(os.open(f"{root}/.{file}", os.O_WRONLY | os.O_CREAT, 0o666), "wb")
                if at != (file, place):
                    out.seek(place)
                out.writelines(row[2] + b"\n" for row in run)
                at = file, place
        if out is not None:
            out.close()
        yield from ()

    return write


def _show(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Gives the hidden files their names. What an earlier try left behind their end goes."""

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hidden, name = f"{root}/.{row['file']}", f"{root}/{row['file']}"
                if os.path.exists(hidden):  # else a repeated task
                    os.truncate(hidden, row["size"])
                    os.replace(hidden, name)
        yield from ()

    return show


def _publish_by_log(lines: DataFrame, folder: str) -> None:
    """The same by one task a log."""
    root = locate(folder)[1]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = locate(folder)
        files.create_dir(root, recursive=True)
        name, out = None, None
        for batch in batches:
            for file, value in zip(*(batch.column(c).to_pylist() for c in ("file", "value"))):
                if file != name:
                    if out is not None:
                        out.close()
                        files.move(f"{root}/.{name}", f"{root}/{name}")
                    name, out = file, files.open_output_stream(f"{root}/.{file}")
                out.write(value.encode() + b"\n")
        if out is not None:
            out.close()
            files.move(f"{root}/.{name}", f"{root}/{name}")
        yield from ()

    ordered = lines.repartition("file").sortWithinPartitions("file", "line_number")
    ordered.select("file", "value").mapInArrow(write, "done boolean").write.format("noop").mode(
        "overwrite"
    ).save()


def take_away(folder: str, name: str) -> None:
    """A log is gone, as between two steps of a rotation."""
    files, root = locate(folder)
    files.create_dir(f"{root}-away", recursive=True)
    files.move(f"{root}/{name}", f"{root}-away/{name}")


def rename_all(folder: str, suffix: str) -> None:
    files, root = locate(folder)
    for name, *_ in list_folder_times(folder):
        files.move(f"{root}/{name}", f"{root}/{name}{suffix}")


def render(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Write one log set into the shared folder and give its path. The texts go straight into the
    logs: one shuffle, and nothing is stored on the way."""
    folder = new_folder(spark, f"rendered-{name}")
    stored = stored_bytes(spark, f"{sf_dir}/{TABLES[name]}.parquet")
    width = -(-stored // RENDER_BYTES)
    # The session's width, which AQE may narrow, where that makes tasks small enough.
    wide = width > int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_logs(in_line_order(TEXTS[name](spark, sf_dir), width if wide else None), folder)
    return folder


_OPENED: dict[tuple[str, str, str], LogSet] = {}


def rendered(spark: SparkSession, sf_dir: str, name: str) -> LogSet:
    """The log set of one run, written and indexed once per application and table folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _OPENED:
        _OPENED[key] = open_logs(spark, render(spark, sf_dir, name))
    return _OPENED[key]


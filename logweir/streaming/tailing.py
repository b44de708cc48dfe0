"""Incremental parsing of growing logs.

Each micro-batch is a small log of its own: the lines of the still open entries plus the
appended lines, numbered on from the lines read before. It goes through the same block index
and assembly as a whole log, so one busy log is spread over many tasks.

A batch writes three tables: the lines that ``arrived``, their ``index`` with the state of their
logs, and its ``changes``: entries, appended lines of open entries, and one row for each log of
the batch. State is what the changes since the last snapshot say over it, the newest row of a
log first. Every ``SNAPSHOT_EVERY`` batches a snapshot takes up the changes since the last one,
and working tables that nothing needs any more go. Every table of a batch is overwritten when
the batch is repeated after a failure.

An entry is shown before it is closed: it is given out as open and given out again, whole,
when it has grown. ``current_entries`` keeps the last state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from logweir import fixed
from logweir.functions.header import clean_line, is_header
from logweir.operators.assemble import assemble
from logweir.operators.filters import LogFilter
from logweir.operators.numbering import block_index, broadcast_if_small, number_lines
from logweir.plans.logset import LogSet
from logweir.plans.session import configure, shuffle_width
from logweir.sources import files
from logweir.sources.storage import (
    delete_folder, kind_of, list_children, qualified, read_range, read_text, write_text)
from logweir.sources.tail import TailSource, advanced, new_log

FILES_SCHEMA = (
    "file string, generation int, lines_read bigint, open_line bigint, open_is_new boolean, "
    "last_epoch bigint"
)
LINES_SCHEMA = "file string, generation int, line_number bigint, value string"
# State of a log before a batch, and what the batch makes of it.
LOG_COLUMNS = [
    "file", "state_of", "generation", "generation_before", "lines_before", "open_before",
    "open_is_new", "lines_read", "last_head",
]
SNAPSHOT_EVERY = 32

EachBatch = Callable[[DataFrame, int], None]


class Tail:
    """Output folder of one tail: where each batch leaves its tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str, epoch: int) -> str:
        return f"{self.folder}/{name}/epoch={epoch}"

    def save(self, df: DataFrame, name: str, epoch: int) -> DataFrame:
        path = self.table(name, epoch)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    # ---------------------------------------------------------------------------- state

    def _save_kinds(self, name: str, epoch: int, kinds: dict[str, DataFrame]) -> None:
        """Rows of several kinds, each a struct of its own, in one job."""
        rows = [
            df.select(*[
                (F.struct(*df.columns) if k == kind else F.lit(None).cast(other.schema)).alias(k)
                for k, other in kinds.items()], F.lit(kind).alias("kind"))
            for kind, df in kinds.items()]
        reduce(DataFrame.unionByName, rows).write.mode("overwrite").partitionBy("kind").parquet(
            self.table(name, epoch))

    def _kind(self, kind: str, schema, places: list[str]) -> DataFrame:
        """The rows of one kind in some tables of changes and snapshots."""
        paths = [f"{p}/kind={kind}" for p in places]
        paths = [p for p in paths if kind_of(self.spark, p)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        text = schema if isinstance(schema, str) else schema.simpleString()[7:-1]
        return self.spark.read.schema(f"{kind} struct<{_struct(text)}>").parquet(*paths).select(
            f"{kind}.*")

    def _state_places(self, epoch: int) -> list[str]:
        """Tables that hold the state before a batch: the last snapshot, the changes since."""
        snapshot = (epoch // SNAPSHOT_EVERY) * SNAPSHOT_EVERY - 1
        return [self.table("snapshots", snapshot)] + [
            self.table("changes", e) for e in range(snapshot + 1, epoch)]

    def _files_before(self, epoch: int) -> DataFrame:
        return self._kind("file", FILES_SCHEMA, self._state_places(epoch))

    def _lines_before(self, epoch: int) -> DataFrame:
        return self._kind("line", LINES_SCHEMA, self._state_places(epoch))

    # ------------------------------------------------------------------------ one batch

    def step(self, batch: DataFrame, epoch: int) -> DataFrame:
        """Entries that are new or have grown, written and given back."""
        rows = self.save(batch, "arrived", epoch)
        arrived = rows.where(F.col("value").isNotNull()).select(
            "file", F.lit(0).cast("bigint").alias("part_no"), F.col("file").alias("part"),
            "block", "pos", "value",
        )
        placed = self.save(self._placed(rows, block_index(arrived), epoch), "index", epoch)
        index = placed.where(F.col("block").isNotNull())
        total = placed.agg(
            F.count("block").alias("blocks"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("size"),
            F.count_distinct("file").alias("logs")).first()
        # One row per log of the batch, counted before it is broadcast: a busy log's lines
        # must not be shuffled by their log.
        logs = broadcast_if_small(placed.select(*LOG_COLUMNS).distinct(), total["logs"])

        lines = self._lines(number_lines(arrived, index, total["blocks"]), logs, epoch)
        entries = assemble(
            lines.select("file", "line_number", "value", "owner_no"),
            shuffle_width(self.spark, total["size"]))
        now = placed.select(*LOG_COLUMNS).distinct().select(
            "file", "generation", "lines_read", F.col("last_head").alias("open_line"),
            F.when(F.col("last_head") == F.col("open_before"), F.col("open_is_new"))
            .otherwise(F.col("lines_before").isNotNull() & F.col("last_head").isNotNull())
            .alias("open_is_new"),
            F.lit(epoch).cast("bigint").alias("last_epoch"),
        )
        # Lines of an open entry are written once, and again only under a new name.
        open_lines = lines.join(logs, "file").where(
            (F.col("line_number") >= F.col("last_head"))
            & (~F.col("held") | (F.col("file") != F.col("state_of")))
        ).select("file", "generation", "line_number", "value")
        marked = self._marked(entries, logs).withColumn("epoch", F.lit(epoch).cast("bigint"))
        self._save_kinds("changes", epoch, {"entry": marked, "line": open_lines, "file": now})
        if (epoch + 1) % SNAPSHOT_EVERY == 0:
            self._snapshot(epoch, marked.schema)
        self._forget(epoch)
        return self._kind("entry", marked.schema, [self.table("changes", epoch)]).drop("epoch")

    def _placed(self, rows: DataFrame, index: DataFrame, epoch: int) -> DataFrame:
        """The block index with the state of each block's log: what was read before it and where
        it ends now. A log without a line has one row. After a reset nothing was read before,
        and the log begins a new generation."""
        touched = rows.groupBy("file").agg(
            F.bool_or("reset").alias("reset"), F.coalesce(F.max("was"), "file").alias("state_of"))
        known = _newest(self._files_before(epoch)).drop("last_epoch")
        log = Window.partitionBy("file")
        read = index.withColumns({
            "log_lines": F.sum("n_lines").over(log),
            "log_head": F.max(F.col("last_head_pos") + F.col("shift")).over(log)})
        joined = touched.join(known.withColumnRenamed("file", "state_of"), "state_of", "left").join(
            read, "file", "left")
        begins = F.col("reset") | F.col("generation").isNull()
        kept = {"generation_before": "generation", "lines_before": "lines_read",
                "open_before": "open_line", "open_is_new": "open_is_new"}
        base = joined.select(
            "file", "state_of",
            (F.coalesce("generation", F.lit(0)) + begins.cast("int")).alias("generation"),
            *[F.when(~F.col("reset"), F.col(old)).alias(new) for new, old in kept.items()],
            "log_lines", "log_head", *[c for c in index.columns if c != "file"])
        before = F.coalesce("lines_before", F.lit(0))
        return base.withColumns({
            "lines_read": before + F.coalesce("log_lines", F.lit(0)),
            "last_head": F.coalesce(F.col("log_head") + before, F.col("open_before")),
        }).drop("log_lines", "log_head")

    def _lines(self, numbered: DataFrame, logs: DataFrame, epoch: int) -> DataFrame:
        """Lines of the open entries as block 0 of their log, then the appended lines; ``held``
        tells them apart. Lines before the first header of the batch belong to the open entry,
        if there is one."""
        to_open = F.when(F.col("open_before").isNotNull(), F.lit(0).cast("bigint"))
        appended = numbered.join(logs, "file").select(
            "file",
            (F.col("line_number") + F.coalesce("lines_before", F.lit(0))).alias("line_number"),
            "value",
            F.coalesce("owner_no", to_open).alias("owner_no"),
            F.lit(False).alias("held"),
        )
        # Lines held under a former name go on under the new one.
        old = self._lines_before(epoch).withColumnsRenamed(
            {"file": "state_of", "generation": "generation_before"})
        held = old.join(logs, ["state_of", "generation_before"]).where(
            F.col("line_number") >= F.col("open_before")).select(
            "file", "line_number", "value", F.lit(0).cast("bigint").alias("owner_no"),
            F.lit(True).alias("held"))
        return held.unionByName(appended)

    def _marked(self, entries: DataFrame, logs: DataFrame) -> DataFrame:
        """Entries of this batch with the marks of T4. The first look at a log and the look
        after a rotation mark nothing as new."""
        appended = F.col("line_number") > F.col("lines_before")
        is_new = F.when(F.col("line_number") == F.col("open_before"), F.col("open_is_new")).otherwise(
            F.coalesce(appended, F.lit(False))
        )
        return entries.join(logs, "file").select(
            *entries.columns,
            "generation",
            is_new.alias("is_new"),
            (F.col("line_number") == F.col("last_head")).alias("is_open"),
        )

    def _snapshot(self, epoch: int, entry) -> None:
        """The state after a batch in one table, with the entries given out since the last one
        that a later batch has not replaced."""
        newest = _newest(self._files_before(epoch).unionByName(
            self._kind("file", FILES_SCHEMA, [self.table("changes", epoch)])))
        lines = self._lines_before(epoch).unionByName(
            self._kind("line", LINES_SCHEMA, [self.table("changes", epoch)]))
        open_now = newest.select("file", "generation", "open_line")
        held = lines.join(open_now, ["file", "generation"]).where("line_number >= open_line")
        window = [p for p in self._state_places(epoch) if "/changes/" in p]
        entries = _alive(self._kind("entry", entry, [*window, self.table("changes", epoch)]), newest)
        self._save_kinds("snapshots", epoch, {
            "entry": entries, "line": held.drop("open_line"), "file": newest})

    def _forget(self, epoch: int) -> None:
        """Drop tables of batches that can no longer be repeated: working tables two batches
        later, changes when a snapshot has taken them up."""
        for name in ("arrived", "index"):
            if epoch >= 2:
                delete_folder(self.spark, self.table(name, epoch - 2))
        if epoch % SNAPSHOT_EVERY == 1 and epoch > SNAPSHOT_EVERY:
            for old in range(epoch - 1 - SNAPSHOT_EVERY, epoch - 1):
                delete_folder(self.spark, self.table("changes", old))

    # ------------------------------------------------------------------------ beginning

    def bind(self, checkpoint: str, start: LogSet | None) -> str | None:
        """Ties this folder to one checkpoint; gives the file of the offsets to go on from.

        A folder that holds the batches of another checkpoint, or whose checkpoint has been
        emptied, is refused: its line numbers and open entries would not fit the offsets.
        """
        checkpoint = qualified(self.spark, checkpoint)
        mark = f"{self.folder}/_checkpoint.json"
        seed = f"{self.folder}/_start.json"
        offsets = [c for c in list_children(self.spark, f"{checkpoint}/offsets") if c.name.isdigit()]
        bound = json.loads(read_text(mark))["checkpoint"] if kind_of(self.spark, mark) else None
        if bound not in (None, checkpoint):
            raise ValueError(f"{self.folder} goes on from {bound}, not from {checkpoint}")
        if bool(offsets) != (kind_of(self.spark, self.table("arrived", 0).rpartition("/")[0]) is not None):
            if not offsets:
                raise ValueError(f"{self.folder} holds batches that {checkpoint} does not know")
            if bound is None:
                raise ValueError(f"{checkpoint} has batches that {self.folder} does not hold")
        if bound is None:
            if start is not None:
                write_text(self.spark, seed, json.dumps(self._seed(start)))
            write_text(self.spark, mark, json.dumps({"checkpoint": checkpoint}))
        if offsets:
            return max(offsets, key=lambda c: int(c.name)).path
        return seed if kind_of(self.spark, seed) else None

    def _seed(self, log: LogSet) -> dict:
        """State of a tail that goes on behind a batch load: the snapshot before the first batch,
        and the offsets.

        The block index is the byte directory: from it come the lines read and the byte range
        from the split with the last header to the end. Only these ranges are read, one task a
        log. A last line without its end is left to the tail.
        """
        if log.source is None or log.source.in_parts or log.rewritten:
            raise ValueError("a tail goes on behind plain logs that were opened as files")
        in_log = Window.partitionBy("file")
        blocks = F.max("block_no").over(in_log)
        # A header in the last line may not be whole yet.
        alone = (F.col("n_heads") == 1) & (F.col("last_head_pos") == F.col("last_pos"))
        with_head = (F.col("n_heads") > 0) & ~(alone & (F.col("block_no") == F.col("blocks")))
        last_block = F.max(F.when(with_head, F.col("block_no"))).over(in_log)
        ranges = log.index.withColumn("blocks", blocks).withColumn(
            "from_no", F.coalesce(last_block, F.col("blocks"))).groupBy("file").agg(
            F.max("part").alias("uri"),
            F.min(F.when(F.col("block_no") >= F.col("from_no"), F.col("first_byte"))).alias("first"),
            F.sum(F.when(F.col("block_no") < F.col("from_no"), F.col("n_lines")).otherwise(0)).alias("lines"),
            F.sum("n_bytes").alias("end"))
        read = self.save(
            files.spread(ranges, "file").mapInArrow(
                _read_ends, "file string, uri string, lines bigint, offset string, text binary"),
            "seed", -1)
        text = F.decode(F.col("text"), "utf-8")
        lines = read.select("file", "lines", F.posexplode(F.split(text, "\n")).alias("at", "value")).join(
            read.select("file", (F.size(F.split(text, "\n")) - 1).alias("whole")), "file").where(
            F.col("at") < F.col("whole")).select(
            "file", (F.col("lines") + F.col("at") + 1).alias("line_number"), "value")
        heads = lines.withColumn("text", clean_line("value")).where(is_header("text")).groupBy("file").agg(
            F.max("line_number").alias("open_line"))
        counted = read.select(
            "file", F.lit(1).alias("generation"),
            (F.col("lines") + F.size(F.split(text, "\n")) - 1).alias("lines_read"))
        state = counted.join(heads, "file", "left").select(
            "file", "generation", "lines_read", "open_line", F.lit(False).alias("open_is_new"),
            F.lit(-1).cast("bigint").alias("last_epoch"))
        held = lines.join(heads, "file").where("line_number >= open_line").select(
            "file", F.lit(1).alias("generation"), "line_number", "value")
        self._save_kinds("snapshots", -1, {"line": held, "file": state})
        return {r["file"]: json.loads(r["offset"]) for r in read.select("file", "offset").collect()}

    # ----------------------------------------------------------------------- last state

    def _last_epoch(self) -> int:
        """The last batch whose changes are whole."""
        done = [int(c.name[len("epoch="):]) for c in list_children(self.spark, f"{self.folder}/changes")
                if kind_of(self.spark, f"{c.path}/_SUCCESS")]
        return max(done, default=-1)

    def latest_files(self) -> DataFrame:
        """One row per log as of the last finished batch."""
        return _newest(self._files_before(self._last_epoch() + 1))

    def given_out(self) -> DataFrame:
        """Every entry as often as a batch gave it out, with its ``epoch``; snapshots keep the
        last state alone."""
        last = self._last_epoch()
        here = [p for p in self._state_places(last + 1) if "/changes/" in p]
        older = [c.path for c in list_children(self.spark, f"{self.folder}/snapshots")]
        found = [p for p in (*older, *here) if kind_of(self.spark, f"{p}/kind=entry")]
        if not found:
            schema = assemble(self.spark.createDataFrame(
                [], "file string, line_number bigint, value string, owner_no bigint"), None)
            return schema.withColumns({
                "generation": F.lit(1), "is_new": F.lit(False), "is_open": F.lit(False),
                "epoch": F.lit(0).cast("bigint")})
        return self.spark.read.parquet(*[f"{p}/kind=entry" for p in found]).select("entry.*")

    def current_entries(self, where: LogFilter | None = None) -> DataFrame:
        """Entries of the current generation of every log, each in its last state.

        A closed entry was given out as closed exactly once; an open one counts only in
        the last batch that touched its log. So no entries have to be compared.
        """
        shown = _alive(self.given_out(), self.latest_files()).drop("epoch")
        return shown.where(where.to_column()) if where else shown


def _struct(columns: str) -> str:
    """``a int, b string`` as the inside of a struct type."""
    if ":" in columns:
        return columns
    return ", ".join(c.strip().replace(" ", ": ", 1) for c in columns.split(","))


def _newest(states: DataFrame) -> DataFrame:
    """The newest row of each log."""
    fields = [c for c in states.columns if c != "file"]
    newest = states.groupBy("file").agg(F.max_by(F.struct(*fields), "last_epoch").alias("s"))
    return newest.select("file", "s.*")


def _alive(entries: DataFrame, state: DataFrame) -> DataFrame:
    """Entries of the current generation, those that were open only from their log's last batch."""
    last = state.select("file", "generation", "last_epoch")
    last = broadcast_if_small(last, last.count())
    return entries.join(last, ["file", "generation"]).where(
        ~F.col("is_open") | (F.col("epoch") == F.col("last_epoch"))).select(*entries.columns)


def _read_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The end of each log from a byte on, up to its last line end, and its offset there."""
    schema = pa.schema([("file", pa.string()), ("uri", pa.string()), ("lines", pa.int64()),
                        ("offset", pa.string()), ("text", pa.binary())])
    for batch in batches:
        for row in batch.to_pylist():
            log = advanced(row["uri"], new_log(), row["end"], 0) | {"size": -1}
            text = read_range(row["uri"], row["first"], max(log["end"] - row["first"], 0))
            yield pa.RecordBatch.from_pylist(
                [{"file": row["file"], "uri": row["uri"], "lines": row["lines"],
                  "offset": json.dumps(log), "text": text}], schema=schema)


def tail_writer(
    spark: SparkSession,
    path: str,
    out: str,
    checkpoint: str,
    where: LogFilter | None = None,
    each: EachBatch | None = None,
    chunk_bytes: int | None = None,
    start: LogSet | None = None,
) -> DataStreamWriter:
    """Writer that follows the logs of a folder; ``each`` gets the (filtered) updates.

    ``start`` is a batch load of the folder: the first run then reads only what was appended
    since, and numbers on from it.
    """
    configure(spark)
    spark.dataSource.register(TailSource)
    tail = Tail(spark, out)
    source = spark.readStream.format("logtail").option("path", path).option(
        "tasks", str(4 * spark.sparkContext.defaultParallelism))
    if known := tail.bind(checkpoint, start):
        source = source.option("known", known)
    if chunk_bytes:
        source = source.option("chunkBytes", str(chunk_bytes))

    def run(batch: DataFrame, epoch: int) -> None:
        updates = tail.step(batch, epoch)
        if each is not None:
            each(updates.where(where.to_column()) if where else updates, epoch)

    return source.load().writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)


def follow(spark: SparkSession, path: str, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Follow for good, looking every half second (T5)."""
    writer = tail_writer(spark, path, out, checkpoint, **options)
    return writer.trigger(processingTime=fixed.POLL_INTERVAL).start()


def catch_up(spark: SparkSession, path: str, out: str, checkpoint: str, **options) -> Tail:
    """Read what has been appended since the last call, then stop."""
    writer = tail_writer(spark, path, out, checkpoint, **options)
    writer.trigger(availableNow=True).start().awaitTermination()
    return Tail(spark, out)

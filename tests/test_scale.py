"""Work is cut so that no task grows with a log, and no log costs a task."""

import pyarrow as pa
from pyspark.sql import functions as F

from logweir.functions import json_walk
from logweir.plans import queries, render, session
from logweir.sources.tail import ByteRanges, TailReader
from logweir.streaming.tailing import catch_up

from .logs import header


def _lines(spark, rows):
    return spark.createDataFrame(rows, "file string, line_number bigint, value string").repartition(3)


def test_one_log_is_published_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(render, "CHUNK_LINES", 4)
    monkeypatch.setattr(render, "PUBLISH_BYTES", 64)
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path / "kept"))
    texts = {"a.log": ["é" * (n % 7) for n in range(41)], "b.log": ["", "only\r"]}
    # Line numbers with gaps, and one that two rows share.
    rows = [(f, 3 * n, v) for f, vs in texts.items() for n, v in enumerate(vs)] + [("a.log", 120, "é" * 5)]
    placed, sizes = render.in_places(_lines(spark, rows))
    tasks = placed.where("file = 'a.log'").select(F.spark_partition_id().alias("t")).distinct()
    assert tasks.count() > 1
    for _ in range(2):  # once more over what is there, from a longer file left behind
        (tmp_path / "logs").mkdir(exist_ok=True)
        (tmp_path / "logs" / ".a.log").write_text("x" * 5000)
        render.publish(_lines(spark, rows), str(tmp_path / "logs"))
        found = {p.name: p.read_bytes() for p in (tmp_path / "logs").iterdir() if p.name[0] != "."}
        assert found == {
            "a.log": "".join(v + "\n" for v in [*texts["a.log"], "é" * 5]).encode(),
            "b.log": b"\nonly\r\n"}


def test_small_ranges_share_a_task(tmp_path):
    for log in range(30):
        (tmp_path / f"l.log.{log}").write_text("".join(f"{log} {n}\n" for n in range(log)))
    alone = TailReader(str(tmp_path), 20)
    offset = alone.latestOffset()
    ranges = alone.partitions({}, offset)
    reader = TailReader(str(tmp_path), 20, None, 6)
    groups = reader.partitions({}, offset)
    assert len(ranges) > 60 and len(groups) <= 7
    assert all(isinstance(g, ByteRanges) for g in groups)
    read = lambda parts, by: [b.to_pylist() for p in parts for b in by.read(p)]
    assert read(groups, reader) == read(ranges, alone)
    # Few ranges stay alone.
    assert TailReader(str(tmp_path), 20, None, len(ranges)).partitions({}, offset) == ranges


def test_a_tail_of_many_small_logs_runs_few_tasks(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    for log in range(60):
        (tmp_path / "logs" / f"l.log.{log}").write_text("".join(f"{header()}\n" for _ in range(3)))
    state = catch_up(spark, *[str(tmp_path / n) for n in ("logs", "out", "checkpoint")], chunk_bytes=50)
    arrived = spark.read.parquet(str(tmp_path / "out" / "arrived"))
    assert arrived.select(F.input_file_name().alias("f")).distinct().count() <= 17
    assert state.current_entries().count() == 180


def test_python_holds_a_piece_of_a_json_batch(monkeypatch):
    monkeypatch.setattr(json_walk, "PIECE_BYTES", 100)
    texts = ["x" * 30, None, "y" * 250, "", "z" * 30] * 3
    pieces = json_walk.in_pieces(json_walk.dump, pa.string())
    out = list(pieces(iter([pa.array(texts), pa.array(["w"])])))
    assert pa.chunked_array(out).to_pylist() == [json_walk.dump(t) for t in [*texts, "w"]]
    assert len(out) > 6


def test_rendering_stores_no_table_and_follows_the_bytes(spark, tmp_path, monkeypatch):
    made = spark.range(200).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("ab\n"), 5).alias("text"), F.lit("en").alias("lang"),
        F.lit("s").alias("source"), F.lit(15).cast("bigint").alias("n_chars"))
    made.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(render, "RENDER_BYTES", 100)
    log = render.rendered(spark, str(tmp_path), "documents")
    assert not [key for key in render._TABLES if key[1] == str(tmp_path)]
    assert log.raw.select("part").distinct().count() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert log.lines().count() == 200 * 10
    assert int(spark.conf.get(session.LISTING_TASKS)) < 10000


def test_lines_of_a_log_are_not_dealt_by_their_log(spark, tmp_path, monkeypatch):
    made = spark.range(2000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("ab\n"), 5).alias("text"), F.lit("en").alias("lang"),
        F.lit("s").alias("source"), F.lit(15).cast("bigint").alias("n_chars"))
    made.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(render, "RENDER_BYTES", 2000)
    monkeypatch.setattr(session, "TASK_BYTES", 50_000)  # deletes write several parts
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # sizes are only guessed from files; joins must not hang on them
    try:
        _, _, every = queries._looks(spark, str(tmp_path))
        for lines, n in ((every, 20000), (queries.delete_twice(spark, str(tmp_path)), None)):
            tasks = lines.groupBy(F.spark_partition_id().alias("task"), "file").count().collect()
            assert {r["file"] for r in tasks} == {"documents-en.log"}
            assert len(tasks) > 1
            assert n is None or sum(r["count"] for r in tasks) == n
    finally:
        spark.conf.set(limit, before)

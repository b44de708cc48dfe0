import datetime as dt

import pytest
from pyspark.sql import functions as F

from logweir import LogFilter, open_logs
from logweir.operators import delete, slices, summaries
from logweir.plans.session import shared_folder
from logweir.sources import storage
from logweir.sources.files import MixedLayouts, NoLogsFound
from logweir.plans.versions import LogVersions
from tests.logs import header, numbered, parcel, put, rows

NOW = dt.datetime(2026, 4, 3, 9, 0)
OLD = "Thu, 02 Apr 2020 12:00:00 +0200"


def stamp_of(moment):
    return moment.strftime("%a, %d %b %Y %H:%M:%S +0000")


def catalog(log, **options):
    found = log.catalog(F.lit(NOW).cast("timestamp"), **options).orderBy("path")
    return {r["name"]: (r["size_bytes"], r["size_label"], r["is_empty"], r["is_recent"]) for r in found.collect()}


def test_catalog(spark, tmp_path):
    recent = header(stamp=stamp_of(NOW - dt.timedelta(hours=3)))
    put(tmp_path, "a b+c%20.log", header(stamp=OLD) + "\n" + recent + "\n")
    put(tmp_path, "json.log.1", recent + '\n{"error":"boom"}\n\n')
    put(tmp_path, "old.log", header(stamp=OLD) + "\n")
    put(tmp_path, "disorder.log", recent + "\n" + header(stamp=OLD) + "\n")
    put(tmp_path, "future.log", header(stamp=stamp_of(NOW + dt.timedelta(days=9))))
    put(tmp_path, "empty.log", "")
    put(tmp_path, "junk.log", "just some text\nnot a log\n")
    put(tmp_path, "readme.txt", "x")
    put(tmp_path, "sub/inner.log", recent)
    put(tmp_path, "far.log", recent + "\n" + "x" * 70_000 + "\n")
    log = open_logs(spark, str(tmp_path))
    got = catalog(log)
    assert {n: r[3] for n, r in got.items()} == {
        "a b+c%20.log": True, "json.log.1": True, "old.log": False, "disorder.log": False,
        "future.log": True, "empty.log": False, "junk.log": False, "far.log": True,
    }
    assert got["empty.log"] == (0, "0 B", True, False)
    assert got["far.log"][1] == "68.4 KB"
    # Headers further than 64 KiB from the end are found as well.
    assert catalog(log, exact=True) == got
    assert {f for (f,) in rows(log.headers(), "file")} == {
        "a b+c%20.log", "json.log.1", "old.log", "disorder.log", "future.log", "far.log",
    }


def test_folders_that_look_like_partitions(spark, tmp_path):
    """A subfolder ``k=v`` neither hides the logs beside it nor is read; nor does the folder
    itself, nor a file name, make columns."""
    base = tmp_path / "dt=2024" / "x{1,2}[a]"
    put(base, "a.log", numbered(5))
    put(base, "file=x.log", numbered(2))
    put(base, "year=2024/b.log", numbered(3))
    log = open_logs(spark, str(base))
    assert sorted(rows(log.row_counts(), "file", "lines_read")) == [("a.log", 5), ("file=x.log", 2)]
    assert set(catalog(log)) == {"a.log", "file=x.log"}
    assert open_logs(spark, str(base / "file=x.log")).headers().count() == 2


def test_two_layouts_in_one_folder_are_refused(spark, tmp_path):
    put(tmp_path, "a.log", numbered(5))
    put(tmp_path, "file=b.log/part-00000.txt", numbered(1))
    with pytest.raises(MixedLayouts):
        open_logs(spark, str(tmp_path))


def test_one_place_for_driver_and_tasks(spark, tmp_path):
    """Paths without a scheme are under fs.defaultFS, for Spark and for the byte access."""
    put(tmp_path, "a.log", numbered(2))
    log = open_logs(spark, str(tmp_path))
    assert log.source.folder.startswith("file:/")
    assert shared_folder(spark).startswith("file:/")
    assert storage.readable(log.source.folder) and not storage.readable("viewfs://x/y")
    assert storage.readable("s3a://bucket/logs") and storage.readable("hdfs://name/logs")
    assert [storage.locate(u)[1] for u in ("file:/x", "file:///x", "/x")] == ["/x"] * 3
    with pytest.raises(ValueError):
        storage.locate("wasbs://x/y")


def test_deletes_touch_only_their_logs(spark, tmp_path):
    for name in ("a.log", "b.log", "c.log"):
        put(tmp_path / "in", name, numbered(4))
    log = open_logs(spark, str(tmp_path / "in"))
    doomed = delete.one_entry("b.log", 2)
    left = log.without(doomed)
    assert len(rows(left, "value")) == 11
    after = log.rewrite(doomed, str(tmp_path / "out"))
    assert [p.name for p in (tmp_path / "out").glob("file=*")] == ["file=b.log"]
    assert sorted(rows(after.row_counts(), "file", "lines_read")) == [("a.log", 4), ("b.log", 3), ("c.log", 4)]
    assert set(catalog(after)) == {"a.log", "b.log", "c.log"}
    assert log.rewrite(F.lit(False), str(tmp_path / "unused")) is log
    again = after.rewrite(doomed | delete.one_entry("a.log", 1), str(tmp_path / "more"))
    assert sorted(rows(again.row_counts(), "file", "lines_read")) == [("a.log", 3), ("b.log", 2), ("c.log", 4)]
    assert [p.folder.rpartition("/")[2] for p in again.sources] == ["in", "more"]
    assert sorted(rows(after.row_counts(), "file", "lines_read")) == [("a.log", 4), ("b.log", 3), ("c.log", 4)]
    assert set(catalog(again)) == {"a.log", "b.log", "c.log"}


def test_deletes_follow_each_other(spark, tmp_path):
    """Ten deletes in a row; whoever reads a version in between goes on seeing just that one."""
    for name in ("a.log", "b.log", "c.log"):
        put(tmp_path / "in", name, numbered(12))
    versions = LogVersions(spark, str(tmp_path / "in"), str(tmp_path / "home"))
    held = {n: [parcel(i) for i in range(1, 13)] for n in ("a.log", "b.log")}
    states = []
    for step in range(10):
        name = "ab"[step % 2] + ".log"
        state = versions.open()
        states.append((step, state, {n: list(v) for n, v in held.items()}))
        versions.delete(delete.one_entry(name, 1 + step % 3))
        del held[name][step % 3]
    assert versions.numbers() == list(range(11))
    for step, state, want in [*states[::4], (10, versions.open(), held)]:
        for log in (state, versions.open(step)):
            got = rows(log.headers(), "file", "line_number", "message")
            assert [m for f, _, m in got if f == "c.log"] == [parcel(i) for i in range(1, 13)]
            for name, messages in want.items():
                assert [(n, m) for f, n, m in got if f == name] == list(enumerate(messages, 1))
    # An unused delete makes no version; a number that is taken is refused.
    versions.delete(F.lit(False))
    with pytest.raises(FileExistsError):
        versions._publish(10, versions.places(10))
    versions.forget(keep=1)
    assert versions.numbers() == [10] and len(list((tmp_path / "home" / "deletes").iterdir())) == 2
    again = LogVersions(spark, "unused", str(tmp_path / "home")).open()
    assert again.headers().count() == 12 + 7 + 7


def test_paths(spark, tmp_path, monkeypatch):
    with pytest.raises(NoLogsFound):
        open_logs(spark, str(tmp_path / "missing"))
    with pytest.raises(NoLogsFound):
        open_logs(spark, str(tmp_path))
    put(tmp_path, "a.log", numbered(2))
    picked = put(tmp_path, "notes.txt", numbered(3))
    one = open_logs(spark, str(picked))
    assert one.headers().count() == 3
    assert [r["name"] for r in one.catalog().collect()] == ["a.log"]
    monkeypatch.setattr("logweir.fixed.DEFAULT_LOG_DIR", str(tmp_path))
    assert open_logs(spark).headers().count() == 2


def entry_texts(log):
    return rows(log.entries(), "file", "line_number", "message", "extra_data")


def test_delete_one_and_multi_line(spark, tmp_path):
    put(tmp_path / "in", "a.log", numbered(5))
    content = header(message="one") + "\n" + header(message="two") + '\n{"k":1}\n\n' + header(message="three") + "\n"
    put(tmp_path / "in", "b.log", "orphan\r\n" + content)
    log = open_logs(spark, str(tmp_path / "in"))
    doomed = delete.one_entry("a.log", 3) | delete.one_entry("b.log", 3)
    after = log.rewrite(doomed, str(tmp_path / "out"))
    assert entry_texts(after) == [
        ("a.log", 1, parcel(1), None), ("a.log", 2, parcel(2), None), ("a.log", 3, parcel(4), None),
        ("a.log", 4, parcel(5), None), ("b.log", 2, "one", None), ("b.log", 3, "three", None),
    ]
    assert rows(after.lines().where("file = 'b.log'"), "value")[0] == ("orphan\r",)


def test_delete_by_filter_and_range(spark, tmp_path):
    lines = [header(level, f"m{i}", f"r{i}") for i, level in enumerate(["INFO", "ERROR", "INFO", "ERROR", "INFO"])]
    put(tmp_path / "in", "a.log", "\n".join(lines) + "\n")
    log = open_logs(spark, str(tmp_path / "in"))
    errors = LogFilter(min_level="ERROR")
    left = log.rewrite(delete.by_filter(errors), str(tmp_path / "out"))
    assert [m for (m,) in rows(left.headers(), "message")] == ["m0", "m2", "m4"]
    with pytest.raises(ValueError):
        delete.by_filter(LogFilter())
    bounds = slices.lines_at(log.headers(), 3, 2).first()
    marked = delete.position_range("a.log", None, bounds["first_line"], bounds["last_line"])
    assert [v for (v,) in rows(log.without(marked), "value")] == [lines[0], lines[3], lines[4]]
    preview = summaries.delete_preview(log.headers(), {"marked": marked, "errors": errors.to_column()})
    assert preview.first().asDict() == {"file": "a.log", "marked": 2, "errors": 2, "whole_file": 5}


def test_delete_everything_and_truncate(spark, tmp_path):
    put(tmp_path / "in", "a'b.log", "orphan\n" + numbered(3))
    put(tmp_path / "in", "b.log", numbered(2))
    log = open_logs(spark, str(tmp_path / "in"))
    orphans = log.rewrite(F.lit(True), str(tmp_path / "orphans"))
    assert rows(orphans.lines(), "file", "value") == [("a'b.log", "orphan")]
    name = "a'b.log"
    emptied = log.rewrite(delete.whole_file(name), str(tmp_path / "out"), delete.whole_file(name))
    assert {n: c[:3] for n, c in catalog(emptied).items()} == {
        name: (0, "0 B", True), "b.log": (len(numbered(2)), f"{len(numbered(2))} B", False),
    }
    nothing = log.rewrite(F.lit(True), str(tmp_path / "none"), F.lit(True))
    assert nothing.entries().count() == 0 and all(c[2] for c in catalog(nothing).values())


@pytest.mark.parametrize("broadcast", [True, False])
def test_rewrite_over_many_splits_keeps_line_order(spark, tmp_path, monkeypatch, broadcast):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if not broadcast:
        monkeypatch.setattr("logweir.operators.numbering.BROADCAST_LIMIT_BYTES", 0)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr("logweir.plans.session.TASK_BYTES", 2000)
    text = "".join(
        header("ERROR" if i % 3 == 0 else "INFO", f"m{i}") + "\n" + f"  more {i}\n" * (i % 9) for i in range(300)
    )
    put(tmp_path / "in", "a.log", text)
    kept, keep = [], True
    for line in text.split("\n")[:-1]:
        keep = "[INFO]" in line if line.startswith("Thu") else keep
        kept += [line] if keep else []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1200")
        log = open_logs(spark, str(tmp_path / "in"))
        after = log.rewrite(F.col("level") == "ERROR", str(tmp_path / "out"))
        assert len(list((tmp_path / "out" / "file=a.log").glob("part-*"))) > 1
        assert [v for (v,) in rows(after.lines(), "value")] == kept
        one = open_logs(spark, str(tmp_path / "out" / "file=a.log"))
        assert one.row_counts().first()["lines_read"] == len(kept)
        errors = LogFilter(min_level="ERROR")
        names = ["line_number", "end_line", "message", "extra_data"]
        expected = []
        for at, line in enumerate(text.split("\n")[:-1], 1):
            if line.startswith("Thu"):
                expected.append([at, at, line.rsplit(": ", 1)[1], None, "[ERROR]" in line])
            else:
                expected[-1][1] = at
                expected[-1][3] = line if expected[-1][3] is None else expected[-1][3] + "\n" + line
        assert rows(log.entries(errors), *names) == [tuple(e[:4]) for e in expected if e[4]]
        assert ("BroadcastHashJoin" in str(log.lines()._jdf.queryExecution().executedPlan())) == broadcast
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_filter_before_assembly_gives_the_same_entries(spark, tmp_path):
    text = "".join(header("ERROR" if i % 11 == 0 else "INFO", f"m{i}") + "\n" + "x\n" * (i % 5) for i in range(90))
    put(tmp_path, "a.log", text)
    log, where = open_logs(spark, str(tmp_path)), LogFilter(min_level="ERROR")
    names = ["line_number", "end_line", "message", "extra_data"]
    assert rows(log.entries(where), *names) == rows(log.entries().where(where.to_column()), *names)


@pytest.fixture
def sliced(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(slices, "RANGE_LINES", 4)
    put(tmp_path, "a.log", "orphan\n" * 5 + "".join(header(message=f"m{i}") + "\n" + "x\n" * (i * 7 % 5) for i in range(25)))
    put(tmp_path, "b.log", numbered(3))
    return open_logs(spark, str(tmp_path)).headers()


def test_positions_pages_and_neighbours(sliced):
    every = rows(sliced, "file", "line_number")
    lines = [n for f, n in every if f == "a.log"]
    got = rows(slices.with_position(sliced), "file", "line_number", "position", "total")
    assert got == [("a.log", n, i + 1, 25) for i, n in enumerate(lines)] + [("b.log", i, i, 3) for i in (1, 2, 3)]
    near = rows(slices.with_neighbours(sliced).where("file = 'a.log'"), "previous_line", "next_line")
    assert near == list(zip([None] + lines, lines[1:] + [None]))
    assert rows(slices.page(sliced, 1, 10), "file", "line_number") == [
        ("a.log", n) for n in lines[10:20]
    ] + [("b.log", i) for i in (1, 2, 3)]
    assert [n for f, n in rows(slices.page(sliced, 99, 10), "file", "line_number") if f == "a.log"] == lines[20:]
    assert len(rows(slices.page(sliced, -5, 10), "file")) == 13
    assert [n for f, n in rows(slices.between_positions(sliced, 4, 2), "file", "line_number") if f == "a.log"] == lines[1:4]


def test_head_tail_and_new(sliced):
    every = rows(sliced, "file", "line_number")
    assert rows(slices.head(sliced, 2), "file", "line_number") == every[:2]
    assert [tuple(r) for r in slices.tail(sliced, 2).select("file", "line_number").collect()] == every[-1:-3:-1]
    assert len(rows(slices.tail_per_file(sliced, 2), "file")) == 4
    seen = sliced.where("line_number <= 3").select("file", "line_number")
    assert rows(slices.new_entries(seen, sliced), "file", "line_number") == [e for e in every if e[1] > 3]


def test_summary_titles(spark, tmp_path):
    put(tmp_path, "a.log", numbered(3) + header("ERROR", "x" * 60) + "\n")
    log = open_logs(spark, str(tmp_path))
    size = summaries.size_label(F.lit((tmp_path / "a.log").stat().st_size))
    label = spark.range(1).select(size).first()[0]

    def title(where):
        return summaries.query_summary(log.headers(), where, log.catalog()).first()["title"]

    base = f"a.log ({label}, 4 Einträge)"
    assert title(LogFilter()) == base
    assert title(LogFilter(request_id="van-2")) == base + " [Request-Fokus: van-2 — 1 Einträge]"
    assert title(LogFilter(message_prefix="x" * 60)) == base + f' [Gleiche: "{"x" * 40}…" — 1 Einträge]'
    assert title(LogFilter(min_level="ERROR").today(dt.date(2026, 4, 2))) == (
        base + " [Filter: 02.04.2026, weiterer Filter — 1 von 4 Einträgen]"
    )
    assert title(LogFilter(component_filter="ext")) == base + " [Filter — 1 von 4 Einträgen]"

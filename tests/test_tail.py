import json
import time

import pytest

from logweir import LogFilter, open_logs
from logweir.sources.storage import is_log
from logweir.sources.tail import ByteRange, TailReader, read_lines
from logweir.streaming import tailing
from logweir.streaming.tailing import catch_up, follow
from tests.logs import header, numbered, parcel, put, rows

NAMES = ["line_number", "generation", "is_new", "is_open"]


@pytest.fixture
def tail(spark, tmp_path):
    (tmp_path / "logs").mkdir()

    def look(**options):
        return catch_up(
            spark, str(tmp_path / "logs"), str(tmp_path / "out"), str(tmp_path / "checkpoint"), **options
        )

    return tmp_path / "logs", look


def test_growth_marks_new_entries(tail):
    logs, look = tail
    put(logs, "a.log", numbered(2))
    assert rows(look().current_entries(), *NAMES) == [(1, 1, False, False), (2, 1, False, True)]
    put(logs, "a.log", numbered(4))
    look()
    put(logs, "a.log", numbered(6))
    put(logs, "b.log", numbered(1))
    state = look(chunk_bytes=50)
    assert rows(state.current_entries().where("file = 'a.log'"), *NAMES) == [
        (n, 1, n > 2, n == 6) for n in range(1, 7)
    ]
    assert rows(state.current_entries().where("file = 'b.log'"), *NAMES) == [(1, 1, False, True)]
    assert look().latest_files().count() == 2
    warnings = LogFilter(search_text="PARCEL 5")
    assert rows(state.current_entries(warnings), "line_number") == [(5,)]


def test_late_continuation_and_unfinished_line(tail):
    logs, look = tail
    put(logs, "a.log", "orphan\n" + header(message="one") + "\nx\n\n")
    assert rows(look().current_entries(), "line_number", "end_line", "extra_data") == [(2, 4, "x")]
    put(logs, "a.log", "orphan\n" + header(message="one") + "\nx\n\nlate\nunfin")
    assert rows(look().current_entries(), "end_line", "extra_data", "is_new") == [(5, "x\n\nlate", False)]
    put(logs, "a.log", "orphan\n" + header(message="one") + "\nx\n\nlate\nunfinished\n" + numbered(1))
    assert rows(look().current_entries(), "line_number", "extra_data", "is_new", "is_open") == [
        (2, "x\n\nlate\nunfinished", False, False), (7, None, True, True),
    ]


def test_rotation_and_missing_file(tail):
    logs, look = tail
    path = put(logs, "a.log", numbered(10))
    look()
    put(logs, "a.log", numbered(2))
    assert rows(look().current_entries(), *NAMES) == [(1, 2, False, False), (2, 2, False, True)]
    put(logs, "a.log", "")
    assert look().current_entries().count() == 0
    put(logs, "a.log", numbered(2))
    assert rows(look().current_entries(), "generation", "is_new") == [(3, True)] * 2
    # Rotated to a larger file with another first line.
    put(logs, "a.log", numbered(9, "ERROR", start=4))
    assert rows(look().current_entries(), "generation", "level") == [(4, "ERROR")] * 9
    path.rename(logs / "a.txt")
    assert look().current_entries().count() == 9


def test_rewrite_of_the_same_size(tail):
    logs, look = tail
    put(logs, "a.log", numbered(3))
    look()
    put(logs, "a.log", numbered(3).replace(parcel(3), parcel(9)))
    assert rows(look().current_entries(), "generation", "message") == [
        (2, parcel(1)), (2, parcel(2)), (2, parcel(9)),
    ]


def test_follow_looks_every_half_second(spark, tmp_path):
    logs = tmp_path / "logs"
    put(logs, "a.log", numbered(2))
    seen = []
    query = follow(
        spark, str(logs), str(tmp_path / "out"), str(tmp_path / "checkpoint"),
        each=lambda df, epoch: seen.extend(rows(df, "line_number", "is_new")))
    try:
        def wait(until):
            end = time.monotonic() + 60
            while not until() and time.monotonic() < end:
                time.sleep(0.1)
            assert until()

        wait(lambda: (2, False) in seen)
        put(logs, "a.log", numbered(3))
        wait(lambda: (3, True) in seen)
    finally:
        query.stop()


def test_renamed_log_goes_on(tail):
    """A rotation by renaming gives nothing out twice; late lines count on."""
    logs, look = tail
    path = put(logs, "a.log", numbered(3))
    look()
    path.rename(logs / "a.log.1")
    put(logs, "a.log", numbered(1, "ERROR"))
    state = look()
    names = ["file", "line_number", "generation", "level"]
    assert rows(state.current_entries().where("level = 'ERROR'"), *names) == [("a.log", 1, 2, "ERROR")]
    put(logs, "a.log.1", numbered(3) + "late\n" + numbered(1, "WARNING"))
    got = rows(look().current_entries().where("file = 'a.log.1'"), "line_number", "extra_data", "level")
    assert got == [(3, "late", "INFO"), (5, None, "WARNING")]


def test_updates_reach_the_callback_filtered(tail):
    logs, look = tail
    seen = []
    put(logs, "a.log", numbered(3) + numbered(2, "ERROR"))
    look(where=LogFilter(min_level="ERROR"), each=lambda df, epoch: seen.append((epoch, df.count())))
    assert seen == [(0, 2)]


def two_looks(folder, change):
    """Ranges of a second look, after something was done to the folder."""
    reader = TailReader(str(folder), 1 << 20)
    first = reader.latestOffset()
    change()
    return reader, first, reader.latestOffset()


def ranges(parts):
    return [(p.file, p.was, p.reset, p.start, p.end) for p in parts]


@pytest.mark.parametrize("more", [0, 5000])
def test_new_log_with_an_old_first_line_is_read_whole(tmp_path, more):
    banner = "== service started ==\n" + numbered(more)
    old = put(tmp_path, "a.log", banner + numbered(3, start=100))

    def change():
        old.unlink()
        put(tmp_path, "c.log", banner + numbered(10, "ERROR", start=200))

    reader, first, second = two_looks(tmp_path, change)
    size = (tmp_path / "c.log").stat().st_size
    assert ranges(reader.partitions(first, second)) == [("c.log", None, True, 0, size)]
    assert set(second) == {"a.log", "c.log"}


def test_log_gone_among_logs_with_its_first_line(tmp_path):
    banner = "== service started ==\n"
    for name in "abc":
        put(tmp_path, f"{name}.log", banner + numbered(3, start=ord(name)))
    path = tmp_path / "b.log"
    text = path.read_text()
    reader, first, second = two_looks(tmp_path, path.unlink)
    assert second == first
    put(tmp_path, "b.log", text + numbered(1))
    third = reader.latestOffset()
    assert ranges(reader.partitions(second, third)) == [
        ("b.log", None, False, len(text), len(text + numbered(1)))]
    # A reader that starts anew goes on from the offsets it is given.
    path.unlink()
    again = TailReader(str(tmp_path), 1 << 20, third)
    assert again.latestOffset() == third == again.initialOffset()
    put(tmp_path, "b.log", text + numbered(2))
    fourth = again.latestOffset()
    assert [r[2:4] for r in ranges(again.partitions(third, fourth))] == [(False, len(text + numbered(1)))]


def test_touched_log_gives_nothing(tmp_path):
    import os

    path = put(tmp_path, "a.log", numbered(2000))
    reader, first, second = two_looks(tmp_path, lambda: os.utime(path, (1, 1)))
    assert second == first and reader.partitions(first, second) == []
    # The same size with other lines, before the offset and within the first links.
    for at in (-20, 50, 13_000):
        text = bytearray(path.read_bytes())
        text[at] ^= 1
        path.write_bytes(text)
        third = reader.latestOffset()
        assert [r[2:4] for r in ranges(reader.partitions(second, third))] == [(True, 0)]
        second = third


def test_names_shift_by_one(tmp_path):
    texts = {n: numbered(400, start=n) for n in range(3)}
    for n, text in texts.items():
        put(tmp_path, "a.log" + (f".{n}" if n else ""), text)

    def change():
        for n in (2, 1):
            (tmp_path / f"a.log.{n}").rename(tmp_path / f"a.log.{n + 1}")
        (tmp_path / "a.log").rename(tmp_path / "a.log.1")
        put(tmp_path, "a.log", numbered(3, "ERROR"))

    reader, first, second = two_looks(tmp_path, change)
    got = ranges(reader.partitions(first, second))
    assert [r[:3] for r in got] == [
        ("a.log", None, True), ("a.log.1", "a.log", False), ("a.log.2", "a.log.1", False),
        ("a.log.3", "a.log.2", False)]
    assert all(start == end for _, was, _, start, end in got if was)


def test_tail_behind_a_batch_load(spark, tmp_path):
    """Only what is appended after the load is given out, and the open entry when it grows."""
    whole = "orphan\n" + numbered(40) + "more\n"
    put(tmp_path / "logs", "a.log", whole + header(message="unfin"))
    put(tmp_path / "logs", "b.log", "no header\n" * 30)
    put(tmp_path / "logs", "c.log", numbered(2))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        log = open_logs(spark, str(tmp_path / "logs"))
        assert log.blocks > 5
        put(tmp_path / "logs", "a.log", whole + header(message="unfinished") + "\n" + numbered(1))
        places = [str(tmp_path / n) for n in ("logs", "out", "checkpoint")]
        state = catch_up(spark, *places, start=log)
        got = rows(state.given_out(), "file", "line_number", "message", "extra_data", "is_new")
        assert got == [("a.log", 41, parcel(40), "more", False),
                       ("a.log", 43, "unfinished", None, True), ("a.log", 44, parcel(1), None, True)]
        put(tmp_path / "logs", "b.log", "no header\n" * 30 + numbered(1))
        put(tmp_path / "logs", "c.log", numbered(2) + "late\n")
        state = catch_up(spark, *places, start=log)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = rows(state.current_entries(), "file", "line_number", "extra_data", "is_new")
    assert got[3:] == [("b.log", 31, None, True), ("c.log", 2, "late", False)]


def test_snapshots_keep_the_state(tail, monkeypatch):
    """The same state whether or not snapshots have taken up the changes; working tables go."""
    logs, look = tail
    monkeypatch.setattr(tailing, "SNAPSHOT_EVERY", 2)
    text = ""
    for n in range(5):
        text += f"late {n}\n" + (numbered(1, start=n) if n % 2 == 0 else "")
        put(logs, "a.log", text)
        state = look()
    put(logs, "b.log", numbered(1))
    state = look()
    assert rows(state.current_entries(), "file", "line_number", "extra_data", "is_open") == [
        ("a.log", 2, "late 1\nlate 2", False), ("a.log", 5, "late 3\nlate 4", False),
        ("a.log", 8, None, True), ("b.log", 1, None, True)]
    out = logs.parent / "out"
    assert {p.name for p in (out / "snapshots").iterdir()} == {f"epoch={n}" for n in (1, 3, 5)}
    assert len(list((out / "arrived").iterdir())) == 2
    assert not (out / "changes" / "epoch=0").exists()


def test_open_lines_are_written_once(tail):
    logs, look = tail
    text = header(message="open") + "\n"
    for n in range(3):
        text += "x\n" * 5
        put(logs, "a.log", text)
        state = look()
    lines = state.spark.read.parquet(str(logs.parent / "out" / "changes")).where("kind = 'line'")
    assert lines.count() == 16
    assert rows(state.current_entries(), "end_line") == [(16,)]


def test_foreign_checkpoints_are_refused(spark, tail, tmp_path):
    logs, look = tail
    put(logs, "a.log", numbered(1))
    look()
    with pytest.raises(ValueError):
        catch_up(spark, str(logs), str(tmp_path / "out"), str(tmp_path / "another"))
    with pytest.raises(ValueError):
        catch_up(spark, str(logs), str(tmp_path / "new"), str(tmp_path / "checkpoint"))


def test_offsets_without_spark(tmp_path):
    put(tmp_path, "a.log", numbered(3) + "rest")
    put(tmp_path, "note.txt", "x\n")
    reader = TailReader(str(tmp_path), 1 << 20)
    first = reader.latestOffset()
    assert list(first) == ["a.log"] and first["a.log"]["end"] == len(numbered(3))
    json.dumps(first)
    assert [(p.start, p.end, p.reset) for p in reader.partitions({}, first)] == [(0, len(numbered(3)), True)]
    assert reader.partitions(first, first) == []
    (tmp_path / "a.log").rename(tmp_path / "gone")
    assert reader.latestOffset() == first


def test_log_cut_short_after_it_was_looked_at(tmp_path):
    path = put(tmp_path, "a.log", numbered(50))
    reader = TailReader(str(tmp_path), 100)
    parts = reader.partitions({}, reader.latestOffset())
    path.write_text(numbered(1))
    assert [read_lines(p) for p in parts[1:]] == [[]] * (len(parts) - 1)
    path.write_text("")
    assert [read_lines(p) for p in parts] == [[]] * len(parts)


def test_first_lines_that_differ_late(tmp_path):
    long = "x" * 200_000
    put(tmp_path, "a.log", long + "a\n")
    reader = TailReader(str(tmp_path), 1 << 20)
    first = reader.latestOffset()
    put(tmp_path, "a.log", long + "b\nmore\n")
    second = reader.latestOffset()
    assert [p.reset for p in reader.partitions(first, second)] == [True]


def test_gone_names_leave_the_offset(tmp_path):
    put(tmp_path, "a.log", numbered(3))
    reader = TailReader(str(tmp_path), 1 << 20)
    first = reader.latestOffset()
    (tmp_path / "a.log").rename(tmp_path / "a.log.1")
    second = reader.latestOffset()
    assert set(second) == {"a.log.1"}
    parts = reader.partitions(first, second)
    assert [(p.file, p.was, p.reset, p.start == p.end) for p in parts] == [("a.log.1", "a.log", False, True)]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 40, 1000])
def test_chunks_cover_every_line_once(tmp_path, chunk):
    text = "a\n\nbb\nccc\n" + "d" * 50 + "\n\n\ne\n"
    path = put(tmp_path, "a.log", text + "open end")
    reader = TailReader(str(tmp_path), chunk)
    parts = reader.partitions({}, reader.latestOffset())
    assert [line for p in parts for line in read_lines(p)] == text.split("\n")[:-1]
    assert isinstance(parts[0], ByteRange) and str(path) == parts[0].uri


def test_names_on_the_driver():
    names = {"a.log": True, "a.log.1": True, "a.log.": False, "a.txt": False, ".logfile": False, "a.log.1.logx": False}
    assert {n: is_log(n) for n in names} == names

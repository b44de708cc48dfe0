import pytest

from logweir import logs_of_lines, logs_of_text, open_logs
from tests.logs import STAMP, header, numbered, parcel, put, rows


def parse(spark, content):
    df = spark.createDataFrame([("t", content)], "name string, content string")
    return logs_of_text(df, "name", "content").entries()


def heads(spark, lines):
    data = [("f", i + 1, line) for i, line in enumerate(lines)]
    return logs_of_lines(
        spark.createDataFrame(data, "file string, line_number bigint, value string")
    ).headers()


LEVELS = ["EMERGENCY", "ALERT", "CRITICAL", "ERROR", "WARNING", "NOTICE", "INFO", "DEBUG"]


def test_each_level_with_its_severity(spark):
    got = rows(heads(spark, [header(level) for level in LEVELS]), "level", "severity")
    assert got == [(level, i) for i, level in enumerate(LEVELS)]


def test_fields_and_empty_request(spark):
    line = header("ERROR", 'say "x": y', "043d54b20b2e8", "A.B")
    got = rows(
        heads(spark, [line, header(request="", component="")]),
        "request_id", "component", "message", "line_number",
    )
    assert got == [("043d54b20b2e8", "A.B", 'say "x": y', 1), (None, "", "msg", 2)]


def test_times_and_offsets(spark):
    stamps = [STAMP, "thu, 02 APR 2026 12:00:00 +2300", "Thu, 02 Apr 2026 12:00:00 -0530"]
    got = rows(
        heads(spark, [header(stamp=s) for s in stamps]).selectExpr(
            "file", "line_number", "cast(ts as string) ts", "cast(ts_local as string) l", "tz_offset_min"
        ),
        "ts", "l", "tz_offset_min",
    )
    assert got == [
        ("2026-04-02 10:00:02", "2026-04-02 12:00:02", 120),
        ("2026-04-01 13:00:00", "2026-04-02 12:00:00", 1380),
        ("2026-04-02 17:30:00", "2026-04-02 12:00:00", -330),
    ]


def test_the_instant_does_not_depend_on_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        # 02:30 does not exist in that zone on this day.
        line = header(stamp="Sun, 29 Mar 2026 02:30:00 +0000")
        got = heads(spark, [line]).selectExpr(
            "unix_seconds(ts) s", "cast(ts_local as string) l"
        ).first()
        assert tuple(got) == (1774751400, "2026-03-29 02:30:00")
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


@pytest.mark.parametrize(
    "line",
    [
        "this is not a log line",
        "",
        '{"json":"only"}',
        header("VERBOSE"),
        header("info"),
        header(stamp="Fri, 02 Apr 2026 12:00:02 +0200"),
        header(stamp="Tue, 31 Feb 2026 12:00:02 +0200"),
        header(stamp="Thu, 02 Apr 2026 24:00:02 +0200"),
        header(stamp="Thu, 02 Apr 2026 12:60:02 +0200"),
        header(stamp="Thu, 02 Apr 2026 12:00:02 +2400"),
        header(stamp="Thu, 02 Apr 2026 12:00:02 +0260"),
        " " + header(),
        header().replace('": msg', '":msg'),
    ],
)
def test_lines_that_are_no_header(spark, line):
    assert heads(spark, [line]).count() == 0


def test_multi_line_entries(spark):
    content = "\n".join(
        [header("ERROR", "one"), '{"error":"invalid_grant"}', "", header(message="two"), "line2", "line3", ""]
    )
    got = rows(parse(spark, content), "line_number", "end_line", "message", "extra_data")
    assert got == [(1, 3, "one", '{"error":"invalid_grant"}'), (4, 6, "two", "line2\nline3")]


def test_blank_lines_at_the_ends_go_inner_ones_stay(spark):
    content = header() + "\n\n  \n  a\n\n b\n\t\n\n"
    assert rows(parse(spark, content), "extra_data", "end_line") == [("  a\n\n b", 8)]


def test_only_blank_lines_give_no_extra(spark):
    assert rows(parse(spark, header() + "\n\n   \n"), "extra_data") == [(None,)]


def test_orphans_belong_to_no_entry(spark):
    assert parse(spark, "orphan\nmore\n").count() == 0
    got = rows(parse(spark, "orphan\n" + header()), "line_number", "extra_data")
    assert got == [(2, None)]


def test_line_offset(spark):
    df = spark.createDataFrame([("f", 11, header())], "file string, line_number bigint, value string")
    assert rows(logs_of_lines(df).headers(), "line_number") == [(11,)]


def test_crlf_and_inner_carriage_return(spark, tmp_path):
    put(tmp_path, "a.log", header(message="a\rb") + "\r\nx\r\n")
    got = rows(open_logs(spark, str(tmp_path)).entries(), "message", "extra_data")
    assert got == [("a\rb", "x")]


def test_broken_utf8_is_replaced(spark, tmp_path):
    put(tmp_path, "a.log", header(message="x").encode() + b"\xff\n" + b"\xfe\n")
    got = rows(open_logs(spark, str(tmp_path)).entries(), "message", "extra_data")
    assert got == [("x�", "�")]


def mixed_log(entries):
    """Entries with 0 to 39 continuation lines, blank lines and an orphan in front."""
    out = ["orphan"]
    for i in range(entries):
        out.append(header(LEVELS[i % 8], parcel(i), f"r{i % 7}"))
        out += [f"  line {j} of {i}" if j % 5 else "" for j in range((i * 13) % 40)]
    return "\n".join(out) + "\n"


def test_splits_do_not_change_the_entries(spark, tmp_path):
    put(tmp_path, "a.log", mixed_log(150))
    put(tmp_path, "b.log.1", mixed_log(40) + "x" * 9000 + "\n" + numbered(30))
    put(tmp_path, "c.log", "no header\n" * 900)
    names = ["file", "line_number", "end_line", "level", "request_id", "message", "extra_data"]
    whole = open_logs(spark, str(tmp_path))
    expected, lines = rows(whole.entries(), *names), rows(whole.lines(), "file", "line_number", "value")
    assert whole.blocks == 3
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        cut = open_logs(spark, str(tmp_path))
        assert cut.blocks > 20
        assert rows(cut.entries(), *names) == expected
        assert rows(cut.lines(), "file", "line_number", "value") == lines
        # A log set keeps to the splits it was indexed with, or stops.
        with pytest.raises(Exception, match="split differently"):
            whole.lines().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_entries_equal_a_plain_python_reading(spark, tmp_path):
    text = mixed_log(60)
    put(tmp_path, "a.log", text)
    expected, open_entry = [], None
    for line in text.split("\n")[:-1]:
        if " [" in line and line.endswith(tuple(parcel(i) for i in range(60))):
            open_entry = (line.rsplit(": ", 1)[1], [])
            expected.append(open_entry)
        elif open_entry:
            open_entry[1].append(line)
    plain = [(m, "\n".join(x).strip("\n") or None) for m, x in expected]
    assert rows(open_logs(spark, str(tmp_path)).entries(), "message", "extra_data") == plain

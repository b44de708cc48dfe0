import datetime as dt

import pytest
from pyspark.sql import functions as F

from logweir import LogFilter, logs_of_lines
from logweir.functions import text, times
from tests.logs import header, rows

D = dt.date
APRIL_2 = "Thu, 02 Apr 2026 12:00:00 +0200"


def shown(spark, where, *entries):
    """Numbers of the entries a filter shows; an entry is (level, message, component, request, stamp)."""
    data = [("f", i + 1, header(*e[:2], e[3], e[2], e[4])) for i, e in enumerate(entries)]
    log = logs_of_lines(spark.createDataFrame(data, "file string, line_number bigint, value string"))
    return [n for (n,) in rows(log.headers(where), "line_number")]


def entry(level="INFO", message="m", component="C", request="", stamp=APRIL_2):
    return (level, message, component, request, stamp)


def test_no_constraint_lets_all_pass(spark):
    assert shown(spark, LogFilter(), entry("DEBUG"), entry()) == [1, 2]


def test_min_level(spark):
    entries = [entry(level) for level in ("ERROR", "WARNING", "INFO", "DEBUG")]
    assert shown(spark, LogFilter(min_level="WARNING"), *entries) == [1, 2]
    with pytest.raises(ValueError):
        LogFilter(min_level="VERBOSE")


def test_search_looks_at_message_and_component_only(spark):
    entries = [
        entry(message="Invalid token received"), entry(message="No match"),
        entry(component="Vendor.TokenService"), entry(request="token"), entry(message="ÄRGER to ken"),
    ]
    assert shown(spark, LogFilter(search_text="TOKEN"), *entries) == [1, 3]
    assert shown(spark, LogFilter(search_text="ärger"), *entries) == [5]
    assert shown(spark, LogFilter(search_text="to.en"), *entries) == []


def test_component_request_and_prefix(spark):
    entries = [
        entry(component="Shop.SugarService", request="abc123", message='call - {"key":1}'),
        entry(component="Shop.Other", request="xyz999", message='other - {"key":1}'),
        entry(component="Shop.Other", message="call"),
    ]
    assert shown(spark, LogFilter(component_filter="sugar"), *entries) == [1]
    assert shown(spark, LogFilter(request_id="abc123"), *entries) == [1]
    assert shown(spark, LogFilter(request_id="ABC123"), *entries) == []
    assert shown(spark, LogFilter(message_prefix="call"), *entries) == [1, 3]


def test_dates_are_those_of_the_own_offset(spark):
    entries = [
        entry(stamp="Wed, 01 Apr 2026 23:59:59 +0200"), entry(stamp=APRIL_2),
        entry(stamp="Fri, 03 Apr 2026 00:30:00 +1400"), entry(stamp="Fri, 03 Apr 2026 23:30:00 -1100"),
    ]
    assert shown(spark, LogFilter(date_from=D(2026, 4, 2)), *entries) == [2, 3, 4]
    assert shown(spark, LogFilter(date_to=D(2026, 4, 2)), *entries) == [1, 2]
    assert shown(spark, LogFilter().between(D(2026, 4, 3), D(2026, 4, 3)), *entries) == [3, 4]


def test_fields_are_combined(spark):
    where = LogFilter(min_level="WARNING", search_text="token")
    entries = [entry("ERROR", "bad token"), entry("INFO", "bad token"), entry("ERROR", "no match")]
    assert shown(spark, where, *entries) == [1]


def test_active_and_clear():
    assert not LogFilter().is_active
    for name, value in [
        ("min_level", "ERROR"), ("search_text", "x"), ("component_filter", "x"), ("request_id", "x"),
        ("message_prefix", "x"), ("date_from", D(2026, 4, 1)), ("date_to", D(2026, 4, 1)),
    ]:
        where = LogFilter(**{name: value})
        assert where.is_active and not where.clear().is_active
    kept = LogFilter(min_level="ERROR").today(D(2026, 4, 1)).clear_dates()
    assert kept == LogFilter(min_level="ERROR")


def test_focus_without_value_changes_nothing():
    where = LogFilter(min_level="ERROR")
    assert where.same_request(None) == where and where.same_message("") == where
    assert where.same_request("r").request_id == "r" and where.same_message("p").message_prefix == "p"
    assert where.with_search("").search_text is None


def test_shortcuts():
    assert [LogFilter().with_shortcut(k).min_level for k in (1, 2, 3, 4)] == [
        "ERROR", "WARNING", "INFO", "DEBUG",
    ]


def test_quick_dates():
    assert LogFilter().today(D(2026, 4, 2)) == LogFilter().between(D(2026, 4, 2), D(2026, 4, 2))
    for day, start, end in [
        (D(2026, 3, 31), D(2026, 2, 1), D(2026, 2, 28)), (D(2026, 1, 15), D(2025, 12, 1), D(2025, 12, 31)),
        (D(2024, 3, 1), D(2024, 2, 1), D(2024, 2, 29)),
    ]:
        assert LogFilter().last_month(day) == LogFilter().between(start, end)
    for day, months, start in [
        (D(2026, 8, 31), 6, D(2026, 2, 28)), (D(2024, 2, 29), 12, D(2023, 2, 28)),
        (D(2026, 5, 15), 6, D(2025, 11, 15)),
    ]:
        assert LogFilter().last_months(months, day) == LogFilter().between(start, day)


def test_typed_range():
    assert LogFilter().date_range("02.04.2026") == LogFilter().today(D(2026, 4, 2))
    assert LogFilter().date_range("x", "2026-04-03") == LogFilter(date_to=D(2026, 4, 3))
    assert LogFilter().date_range("2026-04-02", "x") == LogFilter(date_from=D(2026, 4, 2))


def test_date_label():
    one, five = D(2026, 4, 1), D(2026, 4, 5)
    assert LogFilter().date_label() is None
    assert LogFilter().between(one, one).date_label() == "01.04.2026"
    assert LogFilter().between(one, five).date_label() == "01.04.2026 – 05.04.2026"
    assert LogFilter(date_from=one).date_label() == "ab 01.04.2026"
    assert LogFilter(date_to=five).date_label() == "bis 05.04.2026"


def values(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_typed_dates_on_columns_and_on_the_driver_agree(spark):
    texts = ["02.04.2026", "2026-04-02", "  2026-04-02 ", "2.4.2026", "31.02.2026", "not-a-date", "", "2026-04"]
    expected = [D(2026, 4, 2)] * 4 + [None] * 4
    assert values(spark, times.parse_date_column, *texts) == expected
    assert [times.parse_date_input(t) for t in texts] == expected


def test_message_split_and_prefix(spark):
    texts = [
        'crmRequest - {"key":1}', 'items - [{"id":1}]', "  trimmed  ", " wide ", 'a - [1] - {"b":2}',
        "plain",
    ]
    assert values(spark, text.message_prefix, *texts) == [
        "crmRequest", "items", "trimmed", "wide", "a - [1]", "plain",
    ]
    assert values(spark, lambda v: text.split_at_json(v)[1], *texts) == [
        ' - {"key":1}', ' - [{"id":1}]', None, None, ' - {"b":2}', None,
    ]


def test_preview_cuts_between_characters(spark):
    texts = ["short", "abcdefghijkl", "äöüäöüäöü", "€€€€€", "😀😀😀😀"]
    assert values(spark, lambda v: text.preview(v, 10), *texts) == [
        "short", "abcdefg...", "äöü...", "€€...", "😀...",
    ]


def test_log_names(spark):
    names = {
        "web.log": True, "web_31214afefa.log": True, "web_31214afefa.log.20260310163451": True,
        "nginx.log.1": True, "readme.txt": False, "web.log.": False, "notalog": False,
        ".logfile": False, "a.log.1.logx": False, "a.logx.log": True,
    }
    assert values(spark, text.is_log_name, *names) == list(names.values())


def test_size_labels(spark):
    sizes = ["500", "1024", "1536", "1048576", "2621440", "1023", "1073741824", "2304"]
    labels = ["500 B", "1.0 KB", "1.5 KB", "1.0 MB", "2.5 MB", "1023 B", "1.0 GB", "2.2 KB"]
    assert values(spark, lambda v: text.size_label(v.cast("bigint")), *sizes) == labels


def test_clock_texts_and_shift(spark):
    noon = "2026-04-02 12:00:00"

    def at(hours):
        return lambda v: times.short_timestamp(times.shift_hours(v.cast("timestamp_ntz"), hours))

    assert values(spark, at(2), noon) == ["02.04.26 14:00:00"]
    assert values(spark, at(-3), noon) == ["02.04.26 09:00:00"]
    assert values(spark, at(13), noon) == ["03.04.26 01:00:00"]
    assert values(spark, lambda v: times.full_timestamp(v.cast("timestamp_ntz")), noon) == [
        "02.04.2026, 12:00:00"
    ]
    assert (times.shift_label(13), times.shift_label(-2), times.shift_label(0)) == ("+13h", "-2h", "")

"""Registered queries: every operator run on whole rendered logs or whole tables.

Times go out as text and counts as BIGINT, so any engine's result compares equal.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions import json as js
from logweir.functions import json_walk, text, times
from logweir.operators import delete, details, slices, summaries
from logweir.operators.filters import LogFilter
from logweir.operators.numbering import broadcast_if_small
from logweir.plans.logset import LogSet, logs_of_lines, logs_of_text, open_logs
from logweir.plans.render import publish, rename_all, rendered, take_away, text_table
from logweir.plans.session import configure, new_folder
from logweir.plans.store import store_entries, stored_entries
from logweir.sources.sinks import export_text
from logweir.plans.versions import LogVersions
from logweir.streaming.tailing import catch_up

Query = Callable[[SparkSession, str], DataFrame]

JANUARY_15 = dt.date(2024, 1, 15)
CATALOG_NOW = dt.datetime(2024, 1, 31)
KEY = ["file", "line_number"]


def clock(column: str) -> Column:
    return F.col(column).cast("string")


def instant(column: str) -> Column:
    """UTC text of an instant in any session zone."""
    seconds = F.unix_seconds(column)
    return (F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)).cast("string")


def long(*columns: str) -> list[Column]:
    return [F.col(c).cast("bigint").alias(c) for c in columns]


def header_rows(heads: DataFrame) -> DataFrame:
    return heads.select(
        *KEY, instant("ts").alias("ts"), clock("ts_local").alias("ts_local"),
        *long("tz_offset_min"), "level", *long("severity"), "request_id", "component", "message",
    )


def events(spark: SparkSession, sf: str) -> LogSet:
    return rendered(spark, sf, "events")


def documents(spark: SparkSession, sf: str) -> LogSet:
    return rendered(spark, sf, "documents")


def conversations(spark: SparkSession, sf: str) -> LogSet:
    return rendered(spark, sf, "conversations")


def crashes(spark: SparkSession, sf: str) -> LogSet:
    return rendered(spark, sf, "crashes")


def of_each_log(rows: DataFrame) -> DataFrame:
    """One row per log, counted before it is broadcast: joined lines must not be shuffled by
    their log."""
    return broadcast_if_small(rows, rows.count())


# ------------------------------------------------------------------------ scan and catalog


def scan_lines(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).lines().select(*KEY, "value")


def file_catalog(spark: SparkSession, sf: str) -> DataFrame:
    now = F.lit("2024-01-31 00:00:00+00:00").cast("timestamp")
    return events(spark, sf).catalog(now).select(
        "name", "size_bytes", "size_label", "is_empty", instant("last_ts").alias("last_ts"),
        "is_recent",
    )


def log_names(spark: SparkSession, sf: str) -> DataFrame:
    endings = F.array(*[F.lit(e) for e in NAME_ENDINGS])
    names = spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id",
        F.concat("source", F.element_at(endings, (F.col("doc_id") % 8 + 1).cast("int"))).alias("name"),
    )
    return names.select("doc_id", "name", text.is_log_name(F.col("name")).alias("is_log"))


NAME_ENDINGS = [".log", ".log.20260310163451", ".txt", ".log.", "", ".logfile", ".log.1", ".log.1.logx"]


def open_one_log(spark: SparkSession, sf: str) -> DataFrame:
    folder = documents(spark, sf).source.folder
    one = open_logs(spark, f"{folder}/file=documents-en.log")
    siblings = one.catalog().select("name", "size_bytes")
    read = one.row_counts().withColumnRenamed("file", "name")
    return siblings.join(read, "name", "left").select(
        "name", "size_bytes", F.coalesce("lines_read", F.lit(0)).alias("lines_read")
    )


def line_totals(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).row_counts()


# ------------------------------------------------------------------------ parse and assemble


def parse_headers(spark: SparkSession, sf: str) -> DataFrame:
    return header_rows(events(spark, sf).headers())


def parse_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    return conversations(spark, sf).headers().select(
        *KEY, instant("ts").alias("ts"), clock("ts_local").alias("ts_local"), *long("tz_offset_min")
    )


def parse_levels(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).headers().select(*KEY, "level", *long("severity"))


def missing_requests(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).headers().where(F.col("request_id").isNull()).select(*KEY, "component")


def assemble_entries(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).entries().select(
        *KEY, "end_line", clock("ts_local").alias("ts_local"), "level", "message", "extra_data"
    )


def assemble_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return conversations(spark, sf).entries().select(
        *KEY, "end_line", "request_id", "component", "message", "extra_data"
    )


def dirty_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of logs with broken headers, odd zones, CRLF ends and broken JSON."""
    found = js.with_json(rendered(spark, sf, "dirty").entries())
    return found.select(
        *KEY, "end_line", instant("ts").alias("ts"), clock("ts_local").alias("ts_local"),
        *long("tz_offset_min"), "level", "message", "extra_data", "json")


def line_offset(spark: SparkSession, sf: str) -> DataFrame:
    """Numbering goes on after ten lines read before."""
    lines = text_table(spark, sf, "events").withColumn("line_number", F.col("line_number") + 10)
    return logs_of_lines(lines).headers().select(*KEY, "level", "message")


def parse_text(spark: SparkSession, sf: str) -> DataFrame:
    docs = text_table(spark, sf, "documents").withColumnRenamed("line_number", "doc_id")
    return logs_of_text(docs, "doc_id", "value").entries().select(
        "file", *long("line_number", "end_line"), "message", "extra_data"
    )


# ------------------------------------------------------------------------------- filters


def shown(log: LogSet, where: LogFilter) -> DataFrame:
    return log.headers(where).select(*KEY, "level", "message")


FILTERS = {
    "filter_min_level": LogFilter(min_level="warning"),
    "filter_search_text": LogFilter(search_text="PURCHASE"),
    "filter_component": LogFilter(component_filter="app.SIGN"),
    "filter_request": LogFilter(request_id="u42"),
    "filter_message_prefix": LogFilter(message_prefix="error amount 655"),
    "filter_date_from": LogFilter(date_from=JANUARY_15),
    "filter_date_to": LogFilter(date_to=dt.date(2024, 1, 9)),
    "filter_all_fields": LogFilter(
        min_level="INFO", search_text="amount 1", component_filter="service",
        date_from=dt.date(2024, 1, 5), date_to=dt.date(2024, 1, 25),
    ),
    "filter_cleared": LogFilter(min_level="ERROR", search_text="x").clear(),
    "filter_today": LogFilter().today(JANUARY_15),
    "filter_last_month": LogFilter().last_month(dt.date(2024, 2, 29)),
    "filter_last_months": LogFilter().last_months(6, dt.date(2024, 7, 20)),
    "filter_typed_dates": LogFilter().date_range(" 05.01.2024 ", "2024-01-12"),
    "filter_dates_cleared": LogFilter(min_level="ERROR").today(JANUARY_15).clear_dates(),
}


def filter_query(where: LogFilter) -> Query:
    return lambda spark, sf: shown(events(spark, sf), where)


def filter_shortcuts(spark: SparkSession, sf: str) -> DataFrame:
    counts = [
        F.count_if(LogFilter().with_shortcut(key).to_column()).alias(f"key_{key}") for key in (1, 2, 3, 4)
    ]
    return events(spark, sf).unnumbered_headers().groupBy("file").agg(*counts)


def filtered_entries(spark: SparkSession, sf: str) -> DataFrame:
    where = LogFilter(min_level="CRITICAL", component_filter="docs.src1")
    return documents(spark, sf).entries(where).select(*KEY, "end_line", "level", "extra_data")


def filtered_store(spark: SparkSession, sf: str) -> DataFrame:
    """Entries stored by day once, then read through a filter that prunes days."""
    folder = new_folder(spark, "stored-entries")
    store_entries(events(spark, sf).entries(), folder)
    where = LogFilter(min_level="WARNING").between(JANUARY_15, dt.date(2024, 1, 20))
    return stored_entries(spark, folder, where).select(*KEY, "level", "message", clock("ts_local").alias("ts_local"))


# ----------------------------------------------------------------------- scalar functions


def of_events(*columns: Column) -> Query:
    return lambda spark, sf: events(spark, sf).headers().select(*KEY, *columns)


def split_message(spark: SparkSession, sf: str) -> DataFrame:
    head, rest = text.split_at_json(F.col("message"))
    return of_events(head.alias("head"), rest.alias("rest"))(spark, sf)


def previews(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", text.preview(F.col("text"), 120).alias("preview"))


def typed_dates(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate").cast("string")
    year, month, dom = F.substring(day, 1, 4), F.substring(day, 6, 2), F.substring(day, 9, 2)
    german = F.concat_ws(".", dom, month, year)
    iso = F.concat_ws("-", year, month, dom)
    kind = F.col("o_orderkey") % 4
    typed = (
        F.when(kind == 0, german).when(kind == 1, iso)
        .when(kind == 2, F.concat(F.lit("  "), iso, F.lit("\t"))).otherwise(F.concat(iso, F.lit("x")))
    )
    return spark.read.parquet(f"{sf}/orders.parquet").select(
        "o_orderkey", times.parse_date_column(typed).cast("string").alias("day")
    )


def timestamp_formats(spark: SparkSession, sf: str) -> DataFrame:
    return of_events(
        times.short_timestamp(F.col("ts_local")).alias("short_ts"),
        times.full_timestamp(F.col("ts_local")).alias("full_ts"),
    )(spark, sf)


def shifted_times(spark: SparkSession, sf: str) -> DataFrame:
    moved = [
        times.short_timestamp(times.shift_hours(F.col("ts_local"), n)).alias(name)
        for n, name in ((13, "later"), (-3, "earlier"), (0, "same"))
    ]
    return of_events(*moved, F.lit(times.shift_label(13)).alias("label"))(spark, sf)


def entry_labels(spark: SparkSession, sf: str) -> DataFrame:
    return of_events(
        text.level_label(F.col("level")).alias("level_label"),
        text.request_label(F.col("request_id")).alias("request_label"),
    )(spark, sf)


def severity_classes(spark: SparkSession, sf: str) -> DataFrame:
    heads = documents(spark, sf).unnumbered_headers()
    return heads.groupBy(text.severity_class(F.col("level")).alias("severity_class")).agg(
        F.count(F.lit(1)).alias("entries")
    )


def size_labels(spark: SparkSession, sf: str) -> DataFrame:
    size = F.pow(F.col("n_chars").cast("double"), F.lit(2.0)).cast("bigint") * (F.col("doc_id") + 1)
    return spark.read.parquet(f"{sf}/documents.parquet").select(
        "doc_id", text.size_label(size).alias("size_label")
    )


def date_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Summary per kind of date filter, with the label of the filter."""
    heads = events(spark, sf).unnumbered_headers()
    day = LogFilter().today(JANUARY_15)
    filters = [
        day, LogFilter().between(JANUARY_15, dt.date(2024, 1, 20)),
        LogFilter(date_from=JANUARY_15), LogFilter(date_to=JANUARY_15),
    ]
    counts = heads.agg(*[F.count_if(f.to_column()).alias(f"n{i}") for i, f in enumerate(filters)])
    rows = ", ".join(f"'{f.date_label()}', n{i}" for i, f in enumerate(filters))
    return counts.select(F.expr(f"stack({len(filters)}, {rows}) AS (label, matched)"))


def detail_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return details.with_detail(events(spark, sf).entries(), hours=2)


def detail_of_crashes(spark: SparkSession, sf: str) -> DataFrame:
    return details.with_detail(crashes(spark, sf).entries())


# ------------------------------------------------------------------------------------ JSON


def message_json(spark: SparkSession, sf: str) -> DataFrame:
    found = js.with_json(events(spark, sf).headers())
    k = js.json_value(F.col("json"), "$.k", "bigint")
    return found.select(*KEY, F.col("json_head").alias("prefix"), "json", k.alias("k"))


def first_line_json(spark: SparkSession, sf: str) -> DataFrame:
    """JSON on the first line of a text of several lines that end in a bracket."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    body = F.concat(
        F.lit('load: {"doc": '), F.col("doc_id").cast("string"), F.lit("}\n"), "text", F.lit("\n[")
    )
    prefix, found = js.extract_json(body)
    return docs.select("doc_id", prefix.alias("prefix"), found.alias("json"))


def json_blocks(spark: SparkSession, sf: str) -> DataFrame:
    more = F.concat("message", F.lit(' then [1, {"a": "]"}] and {open'))
    heads = events(spark, sf).headers().withColumn("message", more)
    return details.blocks_of_entries(heads).select(*KEY, *long("block_no", "char_offset"), "json")


def normalized_json(spark: SparkSession, sf: str) -> DataFrame:
    return crashes(spark, sf).entries().select(*KEY, js.normalize_json(F.col("extra_data")).alias("json"))


def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    fields = details.fields_of_entries(crashes(spark, sf).entries(), F.col("extra_data"), True)
    return fields.select(*KEY, *long("field_no"), "path", "key", *long("text_line"), "text")


def hidden_exceptions(spark: SparkSession, sf: str) -> DataFrame:
    folded = json_walk.hide_exception(F.col("extra_data"))
    return crashes(spark, sf).entries().select(*KEY, folded.alias("json"))


def exception_values(spark: SparkSession, sf: str) -> DataFrame:
    return crashes(spark, sf).entries().select(
        *KEY, js.json_value(F.col("extra_data"), "$.exception").alias("exception")
    )


# ------------------------------------------------------------------------- order and slices

ERRORS = LogFilter(min_level="ERROR")


def file_order(spark: SparkSession, sf: str) -> DataFrame:
    return slices.in_file_order(events(spark, sf).headers()).select(*KEY, "level")


def catalog_order(spark: SparkSession, sf: str) -> DataFrame:
    ordered = documents(spark, sf).catalog().orderBy("path")
    return ordered.select("name", "size_bytes")


def tail(spark: SparkSession, sf: str) -> DataFrame:
    return slices.tail(events(spark, sf).headers(), 20).select(*KEY, "message")


def tail_per_file(spark: SparkSession, sf: str) -> DataFrame:
    return slices.tail_per_file(events(spark, sf).headers(ERRORS), 10).select(*KEY, "message")


def head(spark: SparkSession, sf: str) -> DataFrame:
    return slices.head(events(spark, sf).headers(), 20).select(*KEY, "message")


def page(spark: SparkSession, sf: str) -> DataFrame:
    return slices.page(events(spark, sf).headers(ERRORS), 3, 100).select(*KEY, "position", "total")


def positions(spark: SparkSession, sf: str) -> DataFrame:
    return slices.with_position(events(spark, sf).headers(ERRORS)).select(*KEY, "position", "total")


def marked_slice(spark: SparkSession, sf: str) -> DataFrame:
    marked = slices.between_positions(events(spark, sf).headers(ERRORS), 80, 50)
    return marked.select(*KEY, "position")


def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    near = slices.with_neighbours(conversations(spark, sf).headers())
    return near.select(
        *KEY, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("previous_line", "next_line")]
    )


# -------------------------------------------------------------------------------- summaries


def query_summary(spark: SparkSession, sf: str) -> DataFrame:
    log = events(spark, sf)
    where = LogFilter(min_level="WARNING").today(JANUARY_15)
    return summaries.query_summary(log.unnumbered_headers(), where, log.catalog())


def delete_preview(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.delete_preview(
        events(spark, sf).headers(),
        {
            "one_row": F.col("line_number") == 7,
            "marked_range": F.col("line_number").between(10, 19),
            "by_filter": ERRORS.to_column(),
        },
    )


def last_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    last = summaries.last_timestamp(events(spark, sf).unnumbered_headers())
    return last.select("file", instant("last_ts").alias("last_ts"))


def recency(spark: SparkSession, sf: str) -> DataFrame:
    last = summaries.last_timestamp(events(spark, sf).unnumbered_headers())
    now = F.lit("2024-01-20 12:00:00+00:00").cast("timestamp")
    return last.select("file", summaries.is_recent(F.col("last_ts"), now).alias("is_recent"))


def request_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = summaries.request_summary(events(spark, sf).headers())
    return found.select("file", "request_id", "entries", "first_line", "last_line", *long("worst_severity"))


def template_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.template_summary(conversations(spark, sf).unnumbered_headers())


def template_summary_events(spark: SparkSession, sf: str) -> DataFrame:
    return summaries.template_summary(events(spark, sf).unnumbered_headers())


def level_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = summaries.level_summary(documents(spark, sf).unnumbered_headers())
    return found.select("level", *long("severity", "entries", "at_or_above"))


# --------------------------------------------------------------------- differences, deletes


def new_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries not among those an earlier look (up to 15 January) had shown."""
    log = events(spark, sf)
    seen = log.headers(LogFilter(date_to=JANUARY_15)).select(*KEY)
    return slices.new_entries(seen, log.headers()).select(*KEY, "message")


def delete_one_entry(spark: SparkSession, sf: str) -> DataFrame:
    log = documents(spark, sf)
    return log.without(delete.one_entry("documents-en.log", 1)).select(*KEY, "value")


def delete_range(spark: SparkSession, sf: str) -> DataFrame:
    """Entries at positions 2 to 4 among the errors of one log."""
    log, name = documents(spark, sf), "documents-de.log"
    found = log.headers(ERRORS).where(F.col("file") == name)
    bounds = slices.lines_at(found, 4, 2).first()
    doomed = delete.position_range(name, ERRORS, bounds["first_line"], bounds["last_line"])
    return log.without(doomed).select(*KEY, "value")


def delete_by_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Rewritten and read again: line numbers are those of the new files."""
    new = new_folder(spark, "without-errors")
    after = documents(spark, sf).rewrite(delete.by_filter(ERRORS), new)
    return after.lines().select(*KEY, "value")


def delete_twice(spark: SparkSession, sf: str) -> DataFrame:
    """Three deletes, each from what the one before left; the first version is still there."""
    log = documents(spark, sf)
    versions = LogVersions(spark, log.source.folder, new_folder(spark, "versions"))
    versions.delete(delete.by_filter(LogFilter(min_level="CRITICAL")))
    versions.delete(delete.by_filter(ERRORS))
    last = versions.delete(delete.one_entry("documents-en.log", 1))
    before = versions.open(0).row_counts().select("file", F.col("lines_read").alias("lines_before"))
    return last.lines().select(*KEY, "value").join(of_each_log(before), "file")


def entries_after_delete(spark: SparkSession, sf: str) -> DataFrame:
    new = new_folder(spark, "only-errors")
    after = events(spark, sf).rewrite(F.col("severity") > 3, new)
    return after.headers().select(*KEY, "level", "message")


def truncate_log(spark: SparkSession, sf: str) -> DataFrame:
    name = "documents-fr.log"
    new = new_folder(spark, "truncated")
    after = documents(spark, sf).rewrite(delete.whole_file(name), new, delete.whole_file(name))
    return after.catalog().select("name", "size_bytes", "is_empty")


def export_details(spark: SparkSession, sf: str) -> DataFrame:
    new = new_folder(spark, "details")
    export_text(details.with_detail(conversations(spark, sf).entries()).select("detail"), new)
    return spark.read.text(new).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------------------- streaming


def _looks(spark: SparkSession, sf: str) -> tuple[str, DataFrame, DataFrame]:
    """(working folder, lines of a first look, all lines) of the documents logs; the first
    look ends in the middle of every log, mostly inside an entry."""
    log = documents(spark, sf)
    half = log.row_counts().select("file", F.floor(F.col("lines_read") / 2).alias("cut"))
    lines = log.lines().select(*KEY, "value").join(of_each_log(half), "file")
    return new_folder(spark, "tail"), lines.where(F.col("line_number") <= F.col("cut")), lines


def tail_growing(spark: SparkSession, sf: str) -> DataFrame:
    """State after two looks at growing logs: numbers, open entries and marks carry on."""
    base, first, every = _looks(spark, sf)
    publish(first, f"{base}/logs")
    catch_up(spark, f"{base}/logs", f"{base}/out", f"{base}/checkpoint")
    publish(every, f"{base}/logs")
    state = catch_up(spark, f"{base}/logs", f"{base}/out", f"{base}/checkpoint")
    return state.current_entries().select(
        *KEY, "end_line", *long("generation"), "level", "message", "extra_data", "is_new"
    )


def tail_rotated(spark: SparkSession, sf: str) -> DataFrame:
    """State after the logs were replaced by shorter ones: counted from line 1, unmarked."""
    base, first, every = _looks(spark, sf)
    publish(every, f"{base}/logs")
    catch_up(spark, f"{base}/logs", f"{base}/out", f"{base}/checkpoint")
    publish(first, f"{base}/logs")
    state = catch_up(spark, f"{base}/logs", f"{base}/out", f"{base}/checkpoint")
    return state.current_entries().select(*KEY, *long("generation"), "level", "is_new")


def _changed(base: str, sf: str, spark: SparkSession, change: Callable[[str], None]) -> DataFrame:
    """State after all logs were read, something was done to the folder, and a second look."""
    catch_up(spark, f"{base}/logs", f"{base}/out", f"{base}/checkpoint")
    change(f"{base}/logs")
    state = catch_up(spark, f"{base}/logs", f"{base}/out", f"{base}/checkpoint")
    return state.current_entries().select(*KEY, *long("generation"), "message", "is_new")


def tail_missing(spark: SparkSession, sf: str) -> DataFrame:
    """State after one log was gone at the second look: nothing is lost."""
    base, _, every = _looks(spark, sf)
    publish(every, f"{base}/logs")
    return _changed(base, sf, spark, lambda logs: take_away(logs, "documents-de.log"))


def tail_same_size(spark: SparkSession, sf: str) -> DataFrame:
    """State after logs of the same size took the place of those that were read."""
    base, _, every = _looks(spark, sf)
    publish(every, f"{base}/logs")
    header = (F.col("line_number") > 1) & F.contains("value", F.lit('] request="'))
    other = F.replace(F.col("value"), F.lit('": document '), F.lit('": DOCUMENT '))
    swapped = every.withColumn("value", F.when(header, other).otherwise(F.col("value")))
    return _changed(base, sf, spark, lambda logs: publish(swapped, logs))


def tail_renamed(spark: SparkSession, sf: str) -> DataFrame:
    """State after every log was renamed: only its open entry is given out again."""
    base, _, every = _looks(spark, sf)
    publish(every, f"{base}/logs")
    found = _changed(base, sf, spark, lambda logs: rename_all(logs, ".1"))
    return found.where(F.endswith("file", F.lit(".1")))


def _bannered(lines: DataFrame) -> DataFrame:
    """Logs whose first line is the same in all of them."""
    files = lines.select("file").distinct()
    banner = files.select("file", F.lit(0).cast("bigint").alias("line_number"),
                          F.lit("== service started ==").alias("value"))
    return banner.unionByName(lines.select(*KEY, "value"))


def tail_same_banner(spark: SparkSession, sf: str) -> DataFrame:
    """State after a log went and another with its first line and size came: read whole."""
    base, _, every = _looks(spark, sf)
    publish(_bannered(every), f"{base}/logs")
    other = F.replace(F.col("value"), F.lit('": document '), F.lit('": DOCUMENT '))
    new = every.where(F.col("file") == "documents-de.log").select(
        F.lit("documents-xx.log").alias("file"), "line_number",
        F.when(F.contains("value", F.lit('] request="')), other).otherwise(F.col("value")).alias("value"))

    def change(logs: str) -> None:
        take_away(logs, "documents-de.log")
        publish(_bannered(new), logs)

    return _changed(base, sf, spark, change)


def tail_touched(spark: SparkSession, sf: str) -> DataFrame:
    """How often entries were given out when all logs were written again as they were."""
    base, _, every = _looks(spark, sf)
    publish(every, f"{base}/logs")
    places = [f"{base}/{n}" for n in ("logs", "out", "checkpoint")]
    catch_up(spark, *places)
    publish(every, f"{base}/logs")
    given = catch_up(spark, *places).given_out()
    return given.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("times"), F.max("generation").cast("bigint").alias("generation"))


def tail_returned(spark: SparkSession, sf: str) -> DataFrame:
    """State after one of several logs with one first line was gone for a look, and grew."""
    base, first, every = _looks(spark, sf)
    publish(_bannered(first), f"{base}/logs")
    places = [f"{base}/{n}" for n in ("logs", "out", "checkpoint")]
    catch_up(spark, *places)
    take_away(places[0], "documents-de.log")
    catch_up(spark, *places)
    publish(_bannered(every), places[0])
    state = catch_up(spark, *places)
    return state.current_entries().select(
        *KEY, "end_line", *long("generation"), "message", "is_new")


def tail_from_backlog(spark: SparkSession, sf: str) -> DataFrame:
    """What a tail gives out that goes on behind a batch load of half of every log."""
    base, first, every = _looks(spark, sf)
    publish(first, f"{base}/logs")
    log = open_logs(spark, f"{base}/logs")
    log.index.count()
    publish(every, f"{base}/logs")
    state = catch_up(spark, f"{base}/logs", f"{base}/out", f"{base}/checkpoint", start=log)
    return state.given_out().select(
        *KEY, "end_line", *long("generation"), "message", "extra_data", "is_new")


def tail_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """A filter on the stream; the events arrive at once, in many chunks."""
    base = new_folder(spark, "tail")
    publish(events(spark, sf).lines().select(*KEY, "value"), f"{base}/logs")
    where = LogFilter(min_level="WARNING", search_text="amount 2")
    state = catch_up(
        spark, f"{base}/logs", f"{base}/out", f"{base}/checkpoint", where=where, chunk_bytes=100_000
    )
    return state.current_entries(where).select(*KEY, "level", "message", "is_new")


def _configured(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(configure(spark), sf_dir)

    return run


def registered() -> dict[str, Query]:
    """All queries by name."""
    plain = [
        scan_lines, file_catalog, log_names, open_one_log, line_totals, parse_headers,
        parse_timestamps, parse_levels, missing_requests, assemble_entries,
        assemble_conversations, dirty_entries, line_offset, parse_text, filter_shortcuts, filtered_entries, filtered_store,
        split_message, previews, typed_dates, timestamp_formats, shifted_times, entry_labels,
        severity_classes, size_labels, date_labels, detail_blocks, detail_of_crashes,
        message_json, first_line_json, json_blocks, normalized_json, json_fields,
        hidden_exceptions, exception_values, file_order, catalog_order, tail, tail_per_file,
        head, page, positions, marked_slice, neighbours, query_summary, delete_preview,
        last_timestamps, recency, request_summary, template_summary, template_summary_events,
        level_summary, new_entries, delete_one_entry, delete_range, delete_by_filter,
        delete_twice, entries_after_delete, truncate_log, export_details, tail_growing, tail_rotated,
        tail_filtered, tail_missing, tail_same_size, tail_renamed, tail_same_banner,
        tail_touched, tail_returned, tail_from_backlog,
    ]
    found = {q.__name__: q for q in plain}
    found |= {name: filter_query(where) for name, where in FILTERS.items()}
    return {name: _configured(query) for name, query in found.items()}

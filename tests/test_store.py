import datetime as dt

from logweir import LogFilter, open_logs
from logweir.plans.store import store_entries, stored_entries
from tests.logs import header, put, rows


def test_stored_entries_are_the_entries_and_days_are_pruned(spark, tmp_path):
    days = ["Wed, 01 Apr 2026 23:59:59 -0500", "Thu, 02 Apr 2026 00:00:00 +0900", "Fri, 03 Apr 2026 12:00:00 +0000"]
    text = "".join(header(level, stamp=d) + "\nmore\n" for d in days for level in ("ERROR", "INFO"))
    put(tmp_path / "in", "a.log", text)
    log, folder = open_logs(spark, str(tmp_path / "in")), str(tmp_path / "table")
    store_entries(log.entries(), folder)
    names = log.entries().columns
    assert rows(stored_entries(spark, folder), *names) == rows(log.entries(), *names)
    where = LogFilter(min_level="ERROR").between(dt.date(2026, 4, 2), dt.date(2026, 4, 2))
    found = stored_entries(spark, folder, where)
    assert rows(found, *names) == rows(log.entries(where), *names)
    plan = found._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("], PushedFilters")[0]
    assert "log_date" in pruned and "LessThanOrEqual(severity,3)" in plan

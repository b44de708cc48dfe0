"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the table folder (default sf0.1), BENCH_CPUS the cores. Writing and
indexing the rendered logs is timed apart from the queries that read them.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from logweir.plans.queries import registered  # noqa: E402
from logweir.plans.render import rendered  # noqa: E402

HEADLINES = [
    "scan_lines", "file_catalog", "parse_headers", "assemble_entries", "filter_all_fields",
    "filtered_entries", "request_summary", "template_summary_events", "level_summary",
    "positions", "neighbours", "message_json", "json_fields", "detail_blocks", "new_entries",
    "delete_by_filter", "tail_growing",
]


def one_tick(spark, sf_dir: str, timed) -> None:
    """One look at logs of which one has grown by a line, apart from the feed."""
    from pyspark.sql import functions as F

    from logweir.plans.render import publish
    from logweir.plans.session import new_folder
    from logweir.streaming.tailing import catch_up

    base = new_folder(spark, "bench-tail")
    lines = rendered(spark, sf_dir, "conversations").lines().select("file", "line_number", "value")
    publish(lines, f"{base}/logs")
    places = (f"{base}/logs", f"{base}/out", f"{base}/checkpoint")
    catch_up(spark, *places)
    last = lines.agg(F.max("line_number")).first()[0]
    more = lines.where(F.col("line_number") == 1).withColumn("line_number", F.lit(last + 1))
    publish(lines.unionByName(more), f"{base}/logs")
    timed("tail_one_tick", lambda: catch_up(spark, *places))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, run) -> None:
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    for name in ("events", "documents", "conversations", "crashes"):
        timed(f"write_{name}", lambda: rendered(spark, sf_dir, name))
        timed(f"index_{name}", lambda: rendered(spark, sf_dir, name).size)
    queries = registered()
    for name in HEADLINES:
        query = queries[name]
        timed(name, lambda: query(spark, sf_dir).write.format("noop").mode("overwrite").save())
    one_tick(spark, sf_dir, timed)
    result = {
        "metric": "log_analytics_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "lines": sum(rendered(spark, sf_dir, n).row_counts().agg({"lines_read": "sum"}).first()[0]
                     for n in ("events", "documents")),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()

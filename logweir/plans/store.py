"""Entries parsed once and kept as a table, for many filters over the same logs.

The table is partitioned by the day of the entry's own wall clock, the day all date filters
mean, so a date filter reads only its days; level and request filters reach the Parquet
scan. Logs are in time order, so a task writes few days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.operators.filters import LogFilter

DAY = "log_date"


def store_entries(entries: DataFrame, folder: str) -> None:
    dated = entries.withColumn(DAY, F.col("ts_local").cast("date"))
    dated.write.partitionBy(DAY).parquet(folder)


def stored_entries(spark: SparkSession, folder: str, where: LogFilter | None = None) -> DataFrame:
    """Entries of a stored table, whole or as a filter shows them."""
    found = spark.read.parquet(folder)
    if where is None:
        return found.drop(DAY)
    if where.date_from is not None:
        found = found.where(F.col(DAY) >= F.lit(where.date_from))
    if where.date_to is not None:
        found = found.where(F.col(DAY) <= F.lit(where.date_to))
    return found.where(where.clear_dates().to_column()).drop(DAY)

"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """``node`` and the smallest ``root`` of its component, for edges ``a`` - ``b`` (longs).

    Each round hangs larger neighbours, then smaller ones, under the smallest known (large
    star, small star); a long chain halves. Every round is a few hash joins over the edges and
    a stored table, and ends when a checksum of the edges stays the same. Nodes without an edge
    to another node are not listed.
    """
    now = common.saved(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(), "edges")
    before = None
    while True:
        check = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        seen = tuple(check.first())
        if seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = seen
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m")).select(
            "of", F.least("of", "m").alias("m"))
        # Large star: each larger neighbour hangs under the smallest one.
        large = now.join(least, F.col("b") == F.col("of")).select("a", F.col("m").alias("b"))
        # Small star: the smaller neighbours hang under the smallest of them.
        large = common.saved(large.distinct(), "edges")
        lowest = large.groupBy(F.col("a").alias("of")).agg(F.min("b").alias("m"))
        small = large.join(lowest, F.col("a") == F.col("of")).where("b <> m").select(
            F.col("b").alias("a"), F.col("m").alias("b"))
        now = common.saved(
            small.unionByName(lowest.select(F.col("of").alias("a"), F.col("m").alias("b")))
            .distinct(), "edges")

"""Mixing sources to target weights (operator 3).

Targets come from capped water-filling over a table of sources; documents are then taken in
whole repetitions and one seeded fractional repetition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

MAX_EPOCHS = 3
WEIGHTS = (5, 2, 1)
SEED = 20261
# Hash slices of a source; the slice in which the fraction ends is ordered row by row.
SLICES = 4096

WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: F.Column) -> F.Column:
    """Number of words, 0 for null: the places where a word starts are kept and counted."""
    marks = F.regexp_replace(text, WORD, "w")
    return F.coalesce(F.length(F.translate(marks, " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def ranked(names: DataFrame, column: str) -> DataFrame:
    """Place of each distinct name by code point, null last, from 0.

    Ranges of names are numbered apart and shifted by the ranges before them, so the table of
    names may be of any size. UTF-8 bytes sort as code points do.
    """
    ranged = common.saved(
        names.repartitionByRange(F.col(column).asc_nulls_last())
        .withColumn("range_no", F.spark_partition_id()), "mix-names")
    sizes = ranged.groupBy("range_no").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("range_no", (
        F.sum("n").over(Window.orderBy("range_no")) - F.col("n")).alias("shift"))
    inside = Window.partitionBy("range_no").orderBy(F.col(column).asc_nulls_last())
    numbered = ranged.withColumn("at", F.row_number().over(inside) - 1)
    return numbered.join(before, "range_no").withColumn("place", F.col("at") + F.col("shift")).drop(
        "range_no", "at", "shift")


def water_fill(sources: DataFrame, total: float, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to a table with ``source_size`` and ``weight``.

    Each round shares what is left by weight; sources above ``max_epochs`` times their size are
    clamped there, and the excess is shared anew until none is above. A round is one row of
    sums over the table; the shares per unit of weight only grow, so a clamped source stays
    clamped and the last share decides all. When every source is clamped the targets add up
    to less than ``total``.
    """
    cap = F.col("source_size") * F.lit(max_epochs)
    share, clamped = None, -1
    while True:
        over = F.lit(False) if share is None else F.col("weight") * F.lit(share) > cap
        sums = sources.agg(
            F.sum(F.when(over, cap)).alias("held"),
            F.sum(F.when(~over, F.col("weight"))).alias("weight"),
            F.count(F.when(over, 1)).alias("clamped"),
        ).first()
        if sums["clamped"] == clamped or not sums["weight"]:
            break
        clamped = sums["clamped"]
        share = (float(total) - float(sums["held"] or 0)) / float(sums["weight"])
    target = cap if share is None else F.least(cap, F.col("weight") * F.lit(share))
    return sources.withColumn("target", target.cast("double"))


def draw(key: F.Column) -> F.Column:
    """A seeded 52-bit number from md5, the same in every run and every engine."""
    digest = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(key.cast("string"), F.lit("?"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def mix(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
    weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS,
) -> DataFrame:
    """The rows as struct ``row`` with ``size``, ``source_size``, ``target`` and the number of
    ``copies`` in the mix.

    Sources are weighed by their order (code points, null last) with ``weights`` repeating and
    share the size of all documents, at most ``max_epochs`` times their own. A source with the
    ratio r = target / size gives every document floor(r) times and, in the order of a seeded
    hash, once more until the fraction of r is met; the row on the edge is taken when that comes
    nearer. So a source misses its target by half a document at most, and no document exceeds
    ceil(r) <= max_epochs times its size.

    Null text has size 0; a null source is a source; rows with a null or repeated key count
    each (ties of the hash go by size; equal rows are alike). An empty table gives no rows, and a
    source without words has target 0. Other columns travel inside the struct, so their names
    cannot clash. A hot source is cut into hash slices that are summed before any
    shuffle; only the slice on the edge is ordered.
    """
    full = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(key).alias("doc_id"), F.col(source).alias("source"),
        words_in(F.col(text)).alias("size"), draw(F.col(key)).alias("drawn"))
    # Sizes are kept for the sums; the rows themselves are read again and not moved.
    sized = common.saved(full.drop("row"), "mix-docs")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = common.saved(ranked(sources, "source").withColumn(
        "weight", F.get(cycle, (F.col("place") % len(weights)).cast("int"))), "mix-sources")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = (
        water_fill(weighed, total, max_epochs)
        .withColumn("whole", F.floor(ratio))
        .withColumn("wanted", F.col("target") - F.floor(ratio) * F.col("source_size"))
        .select(F.col("source").alias("of"), "source_size", "target", "whole", "wanted")
    )
    targets = common.saved(targets, "mix-targets")

    slice_no = F.shiftright(F.col("drawn"), 52 - (SLICES.bit_length() - 1))
    sliced = sized.groupBy("source", slice_no.alias("slice_no")).agg(F.sum("size").alias("slice"))
    upto = Window.partitionBy("source").orderBy("slice_no")
    # At most SLICES rows a source.
    edges = (
        sliced.withColumn("upto", F.sum("slice").over(upto))
        .join(targets, F.col("source").eqNullSafe(F.col("of")))
        .where("upto <= wanted")
        .groupBy("of").agg(F.max("slice_no").alias("full"), F.max("upto").alias("taken_before"))
        .withColumnRenamed("of", "edge_of")
    )
    bounds = targets.join(edges, F.col("of").eqNullSafe(F.col("edge_of")), "left").select(
        "of", "source_size", "target", "whole", "wanted",
        F.coalesce("full", F.lit(-1)).alias("full"),
        F.coalesce("taken_before", F.lit(0)).alias("taken_before"))
    # The first slice after the full ones that holds words ends the fraction.
    beyond = (
        sliced.join(bounds, F.col("source").eqNullSafe(F.col("of")))
        .where("slice_no > full").groupBy("of").agg(F.min("slice_no").alias("edge"))
        .withColumnRenamed("of", "beyond_of"))
    bounds = common.saved(
        bounds.join(beyond, F.col("of").eqNullSafe(F.col("beyond_of")), "left").drop("beyond_of"),
        "mix-bounds")

    placed = full.join(bounds, F.col("source").eqNullSafe(F.col("of")), "left").withColumn(
        "slice_no", slice_no)
    on_edge = placed.where(F.col("slice_no") == F.col("edge"))
    in_slice = Window.partitionBy("source").orderBy("drawn", "size", "doc_id")
    rows = in_slice.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    extra_on_edge = (
        F.col("taken_before") + F.sum("size").over(rows) - F.col("size") / 2 <= F.col("wanted")
    )
    decided = on_edge.withColumn("extra", extra_on_edge.cast("long")).unionByName(
        placed.where(F.coalesce(F.col("slice_no") != F.col("edge"), F.lit(True)))
        .withColumn("extra", (F.col("slice_no") <= F.col("full")).cast("long")))
    copies = F.col("whole") + F.when(F.col("wanted") > 0, F.col("extra")).otherwise(0)
    return decided.select(
        "row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP3_SQL = r"""
WITH docs AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('20261:' || coalesce(doc_id::VARCHAR, '?')), 1, 13))::BIGINT AS drawn
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight
  FROM docs GROUP BY source),
filling AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
    row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST) AS k
  FROM sources),
states AS (
  SELECT k, cap, weight,
    (SELECT sum(source_size) FROM sources)::DOUBLE AS total,
    coalesce(sum(cap) OVER before, 0) AS held,
    (SELECT sum(weight) FROM sources) - coalesce(sum(weight) OVER before, 0) AS left_weight
  FROM filling
  WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
share AS (
  SELECT (total - held) / left_weight AS share FROM states
  WHERE weight * (total - held) / left_weight <= cap ORDER BY k LIMIT 1),
targets AS (
  SELECT source, source_size, target, floor(ratio) AS whole,
    target - floor(ratio) * source_size AS wanted
  FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio
        FROM (SELECT *, least(cap, weight * (SELECT share FROM share)) AS target FROM filling))),
sliced AS (
  SELECT source, drawn >> 40 AS slice_no, sum(size) AS slice FROM docs GROUP BY ALL),
running AS (
  SELECT *, sum(slice) OVER (PARTITION BY source ORDER BY slice_no) AS upto FROM sliced),
full_slices AS (
  SELECT r.source, max(slice_no) AS full_no, max(upto) AS taken_before
  FROM running r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
  WHERE upto <= wanted GROUP BY r.source),
placed AS (
  SELECT d.*, t.source_size, t.target, t.whole, t.wanted, drawn >> 40 AS slice_no,
    coalesce(f.full_no, -1) AS full_no, coalesce(f.taken_before, 0) AS taken_before,
    sum(d.size) OVER (PARTITION BY d.source, drawn >> 40 ORDER BY drawn, d.size, doc_id
                      ROWS UNBOUNDED PRECEDING) AS inside
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
  LEFT JOIN full_slices f ON d.source IS NOT DISTINCT FROM f.source),
edges AS (
  SELECT source, min(slice_no) AS edge FROM placed WHERE slice_no > full_no GROUP BY source)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE
    WHEN wanted <= 0 THEN 0
    WHEN slice_no <= full_no THEN 1
    WHEN slice_no = edge AND taken_before + inside - size / 2 <= wanted THEN 1
    ELSE 0 END))::BIGINT AS taken
FROM placed p LEFT JOIN edges e ON p.source IS NOT DISTINCT FROM e.source
"""

"""Document fingerprints by a threshold-scaled sketch (operator 13), in Spark expressions alone.

A fingerprint keeps every hash of a five-word shingle below a fixed fraction of the hash space.
Two fingerprints therefore hold the same part of any shingle set, however unequal the texts, so
their common hashes estimate containment, and the union of fingerprints is that of the joined
shingle sets. The smallest hashes are kept in any case: a short text has a fingerprint too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
# Hashes are hexadecimal digits; those below this text are an eighth of all.
BELOW = "2"
DIGITS = 16
# Hashes that are kept even when they are not below it.
LEAST = 32
# Ranges of the documents' order for each partition of a shuffle.
RANGES = 4


def _with_sketch(frame: DataFrame, text: str, name: str) -> DataFrame:
    """``frame`` with the sorted sketch of a text column. One step a select, so that Spark does
    not repeat the costly expressions."""
    rest = list(frame.columns)
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")
    hashes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("_words") - (SHINGLE - 1), F.lit(1))),
        lambda i: F.substring(
            F.md5(F.array_join(F.slice("_words", i, SHINGLE), " ").cast("binary")), 1, DIGITS))
    small = F.filter("_hashes", lambda h: h < BELOW)
    kept = F.when(F.size("_small") >= LEAST, F.array_sort("_small")).otherwise(
        F.slice(F.array_sort("_hashes"), 1, LEAST))
    return (
        frame.select(*rest, words.alias("_words"))
        .select(*rest, F.when(F.size("_words") > 0, F.array_distinct(hashes)).otherwise(
            F.array().cast("array<string>")).alias("_hashes"))
        .select(*rest, "_hashes", small.alias("_small"))
        .select(*rest, kept.alias(name)))


def sketch(docs: DataFrame, text: str = "text", name: str = "sketch") -> DataFrame:
    """``docs`` with an array column: the fingerprint of each text, its hashes in order.

    Null and empty texts, and those without a word, have an empty one. Fewer than five words are
    one shingle. Equal texts have equal fingerprints. All other columns stay.
    """
    used = {"_words", "_hashes", "_small", "_body"} & set(docs.columns)
    if used or name in docs.columns:
        raise ValueError(f"columns with names of the sketch: {sorted(used | {name})}")
    body = docs.withColumn("_body", F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return _with_sketch(body, "_body", name).drop("_body")


def merged(sketches: DataFrame, by: list[str], column: str = "sketch") -> DataFrame:
    """The sketch of the joined shingle sets of each group: the union of its hashes, cut again."""
    hashes = sketches.select(*by, F.explode(column).alias("h")).distinct()
    ranked = hashes.groupBy(*by).agg(F.array_sort(F.collect_list("h")).alias("_hashes"))
    small = ranked.select(*by, "_hashes", F.filter("_hashes", lambda h: h < BELOW).alias("_small"))
    return small.select(*by, F.when(F.size("_small") >= LEAST, F.col("_small")).otherwise(
        F.slice("_hashes", 1, LEAST)).alias(column))


def _complete_to(one: Column) -> Column:
    """Up to here a sketch holds every hash of its text: everything where it has fewer than
    ``LEAST``, else what is below the fraction, or its last hash where that lies further."""
    return F.when(F.size(one) < LEAST, F.lit("g")).otherwise(
        F.greatest(F.lit(BELOW), F.element_at(one, -1)))


def likeness(one: Column, other: Column) -> Column:
    """Estimated containment of the smaller of two shingle sets in the larger: 0 to 1.

    Only the range of hashes is compared in which both sketches are whole. Equal sketches give
    1, two empty ones too; an empty one is unlike any other.
    """
    limit = F.least(_complete_to(one), _complete_to(other))
    fewest = F.least(*[F.size(F.filter(s, lambda h: h <= limit)) for s in (one, other)])
    both = F.size(F.filter(F.array_intersect(one, other), lambda h: h <= limit))
    return F.when(one == other, F.lit(1.0)).when(fewest == 0, F.lit(0.0)).otherwise(both / fewest)


def _packed(one: Column) -> Column:
    """A sketch as bytes, eight a hash, for the way through a shuffle."""
    return F.unhex(F.array_join(one, ""))


def _unpacked(packed: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.hex(packed)), F.lit(f"[0-9a-f]{{{DIGITS}}}"), F.lit(0))


def _order_key(key: Column, body: Column) -> Column:
    """A text that sorts as the ids do, null first, and rows of one id by their text's digest."""
    digits = F.lpad(F.hex(key.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.coalesce(digits, F.lit("")), F.lit(":"), F.md5(body.cast("binary")))


def _range_starts(keys: DataFrame, ranges: int) -> list[str]:
    """First keys of at most so many ranges of about equal size, in order: all that the driver
    holds of the corpus."""
    dealt = keys.repartitionByRange(ranges, "place").select(
        F.spark_partition_id().alias("range"), "place")
    return sorted(r.first for r in dealt.groupBy("range").agg(F.min("place").alias("first")).collect())


def _range_of(place: str, starts: list[str]) -> Column:
    """Number of the range (from 0) that holds a place: a search among the starts of blocks, then
    within the block."""
    side = max(1, int(len(starts) ** 0.5))
    blocks = [starts[i : i + side] for i in range(0, len(starts), side)]
    heads = F.split(F.lit(",".join(b[0] for b in blocks)), ",")
    block = F.size(F.filter(heads, lambda s: s <= F.col(place)))
    inner = F.split(F.element_at(F.split(F.lit(";".join(map(",".join, blocks))), ";"), block), ",")
    within = F.size(F.filter(inner, lambda s: s <= F.col(place)))
    return (block - 1) * side + within - 1


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``row`` (columns other than the text), ``body``, ``sketch`` and the same of the next
    document in ascending order of the key; after the last comes the first.

    Documents are dealt to ranges of the order, as many as the session's shuffle partitions ask
    for; a copy of each range's first document is added to the range before it. Rows of one key
    are ordered by their texts' digests; rows equal in both lie in one range.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    base = docs.select(
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"), F.col(f"`{key}`").alias("id"),
        F.struct(*rest).alias("row"))
    placed = base.select("row", "body", _order_key(F.col("id"), F.col("body")).alias("place"))
    width = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts = _range_starts(placed.select("place"), RANGES * width)
    if not starts:
        return base.select("row", "body", F.array().cast("array<string>").alias("sketch"),
                           F.struct("body", F.array().cast("array<string>").alias("sketch")).alias("next"))
    dealt = _with_sketch(
        placed.select("row", "body", "place", _range_of("place", starts).alias("range")),
        "body", "sketch").withColumn("sketch", _packed(F.col("sketch")))
    again = placed.join(
        F.broadcast(docs.sparkSession.createDataFrame(
            [(s, (n - 1) % len(starts)) for n, s in enumerate(starts)], "place string, range int")),
        "place").groupBy("range").agg(F.any_value("body").alias("body"))
    firsts = _with_sketch(again.select(
        F.lit(None).cast(dealt.schema["row"].dataType).alias("row"), "body",
        F.lit("g").alias("place"), "range"), "body", "sketch").withColumn(
        "sketch", _packed(F.col("sketch")))
    following = F.lead(F.struct("body", "sketch")).over(
        Window.partitionBy("range").orderBy("place"))
    pairs = dealt.unionByName(firsts).select(
        "row", "body", "sketch", "place", following.alias("next")).where(F.col("place") != "g")
    return pairs.select(
        "row", "body", _unpacked(F.col("sketch")).alias("sketch"),
        F.struct("next.body", _unpacked(F.col("next.sketch")).alias("sketch")).alias("next"))


def edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document with its edited text: the last half of its code points (rounded down) gives
    way to as many of the next document's first.

    Gives ``row``, ``n_chars``, ``edited``, both sketches, and the likeness of the document's to
    the edited text's (``near_edited``) and to the next document's (``near_next``). Null texts
    are empty; a table of one row is its own next; an empty table gives no rows; other columns
    travel inside ``row``. For repeated rows see ``with_next``.
    """
    pairs = with_next(docs, key, text).withColumn("n_chars", F.length("body").cast("long"))
    half = F.expr("cast(n_chars div 2 as int)")
    edited = F.concat(
        F.substring("body", 1, F.col("n_chars").cast("int") - half),
        F.substring("next.body", 1, half))
    changed = pairs.select("row", "n_chars", "sketch", F.col("next.sketch").alias("next_sketch"),
                           edited.alias("edited"))
    both = _with_sketch(changed, "edited", "edited_sketch")
    return both.select(
        "row", "n_chars", "edited", "sketch", "edited_sketch",
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edits(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "row.doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.array_join("sketch", "").alias("fingerprint"),
        F.array_join("edited_sketch", "").alias("edited_fingerprint"), "near_edited", "near_next")


OP13_SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS body,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) AS i FROM documents),
pairs AS (
  SELECT d.doc_id, d.body, d.i, length(d.body) AS n_chars, e.body AS next_body
  FROM docs d JOIN docs e ON e.i = d.i % (SELECT count(*) FROM docs) + 1),
edited AS (
  SELECT *, substr(body, 1, n_chars - n_chars // 2) || substr(next_body, 1, n_chars // 2) AS edited
  FROM pairs),
texts AS (
  SELECT i, 1 AS kind, body AS t FROM edited UNION ALL SELECT i, 2, edited FROM edited
  UNION ALL SELECT i, 3, next_body FROM edited),
tokens AS (SELECT i, kind, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
hashes AS (
  SELECT i, kind, list_sort(list_distinct(list_transform(
    CASE WHEN len(w) = 0 THEN [] ELSE range(1, greatest(len(w) - 3, 2)) END,
    lambda k: substr(md5(array_to_string(w[k:k + 4], ' ')), 1, 16)))) AS h FROM tokens),
kept AS (
  SELECT i, kind, CASE WHEN len(list_filter(h, lambda x: x < '2')) >= 32
    THEN list_filter(h, lambda x: x < '2') ELSE h[1:32] END AS s FROM hashes),
whole AS (
  SELECT *, CASE WHEN len(s) < 32 THEN 'g' ELSE greatest('2', s[-1]) END AS upto FROM kept),
three AS (
  SELECT a.i, a.s AS a, b.s AS b, c.s AS c, least(a.upto, b.upto) AS ab, least(a.upto, c.upto) AS ac
  FROM whole a JOIN whole b ON a.i = b.i JOIN whole c ON a.i = c.i
  WHERE a.kind = 1 AND b.kind = 2 AND c.kind = 3),
counts AS (
  SELECT *, least(len(list_filter(a, lambda x: x <= ab)), len(list_filter(b, lambda x: x <= ab))) AS n_ab,
    least(len(list_filter(a, lambda x: x <= ac)), len(list_filter(c, lambda x: x <= ac))) AS n_ac
  FROM three)
SELECT doc_id, n_chars::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
  array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
  CASE WHEN a = b THEN 1.0 WHEN n_ab = 0 THEN 0.0
    ELSE len(list_filter(list_intersect(a, b), lambda x: x <= ab))::DOUBLE / n_ab END::DOUBLE
    AS near_edited,
  CASE WHEN a = c THEN 1.0 WHEN n_ac = 0 THEN 0.0
    ELSE len(list_filter(list_intersect(a, c), lambda x: x <= ac))::DOUBLE / n_ac END::DOUBLE
    AS near_next
FROM edited JOIN counts USING (i)
"""

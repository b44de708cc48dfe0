"""Quality rules by host (operator 2).

Each document is judged by base rules; failures are counted by host, each host's failure rate
is shrunk towards a beta prior fitted to all hosts, and the verdict on the host is joined back
to its documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
# A host is dropped as a whole when its shrunk failure rate exceeds this share.
HOST_LIMIT = 0.8

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = b"\t\n\x0b\x0c\r "


def _repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(_BLANK)]
    return len(lines) - len(set(lines))


def _measure(columns: list) -> dict:
    texts, keys = columns
    chunk = common.Chunk(texts)
    buffer, limits = chunk.buffer, chunk.text_starts[:-1]
    gap = np.zeros(len(buffer), dtype=bool)
    for byte in _BLANK:
        gap |= buffer == byte
    points = ~gap & ((buffer & 0xC0) != 0x80)
    hashes, at = chunk.windows(WINDOW)
    owners = chunk.owners()
    salted = hashes ^ common.mix(owners[at].astype(np.uint64))
    order = np.argsort(salted)
    ranked = salted[order]
    twin = np.zeros(len(ranked), dtype=bool)
    if len(ranked) > 1:
        same = ranked[1:] == ranked[:-1]
        twin[1:] |= same
        twin[:-1] |= same
    words = common.covered(at[order[twin]], WINDOW, len(chunk.hashes))
    return {
        "key": keys,
        "n_words": chunk.counts,
        "word_chars": np.add.reduceat(points.astype(np.int64), limits),
        "n_symbols": np.add.reduceat(_SYMBOL[buffer].astype(np.int64), limits),
        "n_dup_lines": [_repeated_lines(t) for t in texts],
        "n_repeat_words": np.bincount(owners[words], minlength=len(texts)),
    }


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measures(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The five counts of every text with the carried columns; null text counts as empty."""
    frame = docs.select(common.as_bytes(text).alias("t"), F.struct(*carry).alias("key"))
    kind = frame.schema["key"].dataType.simpleString()
    schema = f"key {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES)
    arrow = _arrow(frame.schema["key"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from common.by_chunk(_measure, ["t", "key"], arrow)(batches)

    found = frame.mapInArrow(run, schema)
    return found.select("key.*", *MEASURES)


def _arrow(key) -> pa.Schema:
    fields = [("key", common.arrow_type(key))] + [(m, pa.int64()) for m in MEASURES]
    return pa.schema(fields)


def host_rates(judged: DataFrame, host: str, failed: str) -> DataFrame:
    """Documents, failures and shrunk failure rate of every host (null is a host too).

    The prior Beta(a, b) has the mean and variance of the hosts' rates (method of moments over
    hosts with a document; where the variance leaves no valid prior, a + b = 1). The shrunk
    rate is (failures + a) / (documents + a + b). One map-side sum per host, then one row of
    moments: nothing larger than a host table is held anywhere.
    """
    hosts = judged.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum(F.col(failed).cast("long")).alias("failures"),
    )
    rate = F.col("failures") / F.col("docs")
    moments = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"))
    strength = F.when(
        (F.col("v") > 0) & (F.col("m") * (1 - F.col("m")) > F.col("v")),
        F.col("m") * (1 - F.col("m")) / F.col("v") - 1,
    ).otherwise(F.lit(1.0))
    prior = moments.select("m", strength.alias("n")).first()
    mean, weight = F.lit(prior["m"]), F.lit(prior["n"])
    shrunk = (F.col("failures") + mean * weight) / (F.col("docs") + weight)
    return hosts.select("host", "docs", "failures", shrunk.alias("rate"))


def host_verdicts(
    docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id",
    limit: float = HOST_LIMIT,
) -> DataFrame:
    """Every document with its counts, ``base_failed`` and ``kept``.

    Null text is empty and fails. A null host is a host of its own. Repeated rows count each.
    An empty table gives no rows. Other columns of ``docs`` are not read, so their names do
    not matter. A document is kept when it passes the base rules and its host's shrunk failure
    rate is at most ``limit``.
    """
    source = docs.select(F.col(key).alias("doc_id"), F.col(host).alias("host"),
                         F.col(text).alias("body"))
    counted = measures(source, "body", ("doc_id", "host"))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")
    )
    # Kept as a table: the texts are measured once, for the hosts and for the result.
    judged = common.saved(counted.withColumn("base_failed", failed), "quality")
    bad = host_rates(judged, "host", "base_failed").select(
        F.col("host").alias("judged_host"), (F.col("rate") > limit).alias("host_failed"),
        F.col("rate").alias("host_rate"),
    )
    joined = judged.join(bad, judged["host"].eqNullSafe(bad["judged_host"]), "left")
    return joined.select(
        "doc_id", *MEASURES, "base_failed",
        (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), "host_rate",
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = host_verdicts(common.table(spark, sf_dir, "documents"))
    return found.drop("host_rate")


OP2_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS body FROM documents),
tokens AS (SELECT rid, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS w FROM docs),
windows AS (
  SELECT rid, i, list_aggregate(w[i:i + 7], 'string_agg', ' ') AS win
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM tokens)),
twice AS (
  SELECT rid, i FROM (
    SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1),
repeats AS (
  SELECT rid, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT rid, unnest(range(i, i + 8)) AS j FROM twice) GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(body, chr(10))) AS line FROM docs),
dups AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
counted AS (
  SELECT d.rid, d.doc_id, d.source, len(w) AS n_words,
    length(list_aggregate(list_concat(w, ['']), 'string_agg', '')) AS word_chars,
    length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM docs d JOIN tokens USING (rid) LEFT JOIN dups USING (rid) LEFT JOIN repeats USING (rid)),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted),
hosts AS (
  SELECT source, count(*) AS docs, sum(base_failed::INT) AS failures FROM judged GROUP BY source),
moments AS (SELECT avg(failures / docs) AS m, var_pop(failures / docs) AS v FROM hosts),
prior AS (
  SELECT m, CASE WHEN v > 0 AND m * (1 - m) > v THEN m * (1 - m) / v - 1 ELSE 1 END AS n
  FROM moments)
SELECT j.doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
  n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND (h.failures + m * n) / (h.docs + n) <= 0.8 AS kept
FROM judged j JOIN hosts h ON j.source IS NOT DISTINCT FROM h.source CROSS JOIN prior
"""

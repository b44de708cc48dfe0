"""URL filter (operator 5): rules first, then naive Bayes over segmented host and path words.

Host names are split into words by unigram Viterbi, with word counts over the text of all pages.
Rules decide what they fit; these urls are the labelled rows from which a multinomial naive
Bayes is learned that judges the rest.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

ALLOW, BLOCK = "allow", "block"
RULES = (
    (ALLOW, "org/"), (BLOCK, "example.org/es/"), (BLOCK, "example.org/en/1"),
    (ALLOW, "com/fr/"), (BLOCK, "com/de/"),
)
# Size of the word model: the most frequent words, none longer than this.
MODEL_WORDS = 30_000
LONGEST = 20
# Tokens are numbered by a hash, so the Bayes model has this many rows whatever the urls.
FEATURES = 1 << 16


def url_parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: F.Column, path: F.Column, rules=RULES) -> tuple[F.Column, F.Column]:
    """The longest rule that fits and its verdict, null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """Words of the pages' text with their counts, summed on the map side first."""
    text = F.lower(F.regexp_replace(F.col(html), r"<[^>]*>", " "))
    return (
        pages.select(F.explode(F.split(text, r"[^\p{L}]+")).alias("word"))
        .where((F.length("word") > 0) & (F.length("word") <= LONGEST))
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def frequent_words(pages: DataFrame, html: str = "html") -> dict[str, int]:
    """The MODEL_WORDS most frequent words with their counts.

    How many words there are of each count tells exactly from which count on a word can belong to
    the model. Few counts are large, so that table is small, and only the words from there
    on are ordered.
    """
    counts = common.saved(word_counts(pages, html), "url-words")
    of_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    above = Window.orderBy(F.desc("n"))
    # The most counts that can matter: each has a word at least.
    highest = of_count.orderBy(F.desc("n")).limit(MODEL_WORDS)
    least = highest.withColumn("upto", F.sum("words").over(above)).where(
        F.col("upto") - F.col("words") < MODEL_WORDS).agg(F.min("n")).first()[0] or 0
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(MODEL_WORDS)
    return {r["word"]: r["n"] for r in top.collect()}


class Segmenter:
    """Splits a name into the words with the highest product of unigram probabilities."""

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) or 1
        self.costs = {w: -math.log(n / total) for w, n in counts.items()}
        # An unseen piece costs more with every letter, so words win where they fit.
        self.unseen = math.log(total) + math.log(10)
        self.known: dict[str, list[str]] = {}

    def split(self, name: str) -> list[str]:
        found = self.known.get(name)
        if found is None:
            if len(self.known) > 1 << 16:
                self.known.clear()
            found = self.known[name] = self._viterbi(name)
        return found

    def _viterbi(self, name: str) -> list[str]:
        best = [0.0] + [math.inf] * len(name)
        back = [0] * (len(name) + 1)
        for end in range(1, len(name) + 1):
            for start in range(max(0, end - LONGEST), end):
                piece = name[start:end]
                cost = self.costs.get(piece)
                if cost is None:
                    cost = self.unseen + (end - start) * math.log(10)
                if best[start] + cost < best[end] - 1e-12:
                    best[end], back[end] = best[start] + cost, start
        words, end = [], len(name)
        while end:
            words.append(name[back[end]:end])
            end = back[end]
        return words[::-1]


_PIECES = re.compile(r"[^\W\d_]+|\d+")


def tokens(host: str, path: str, segmenter: Segmenter) -> list[str]:
    """Host and path words; a number is the number of its digits."""
    found = []
    for side, text in (("h", host), ("p", path.lower())):
        for piece in _PIECES.findall(text):
            if piece.isdigit():
                found.append(f"{side}:#{len(piece)}")
            else:
                found += [f"{side}:{w}" for w in segmenter.split(piece)]
    return found


def _features(host: str, path: str, segmenter: Segmenter) -> list[int]:
    return [zlib.crc32(t.encode()) % FEATURES for t in tokens(host, path, segmenter)]


def learn(judged: DataFrame, words) -> np.ndarray:
    """Log odds (allow against block) of each feature, and of the classes in the last row."""
    schema = pa.schema([("kind", pa.string()), ("feature", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(words.value)
        seen = {ALLOW: np.zeros(FEATURES + 1, np.int64), BLOCK: np.zeros(FEATURES + 1, np.int64)}
        for batch in batches:
            for host, path, kind in zip(*(batch.column(c).to_pylist()
                                          for c in ("host", "path", "ruled"))):
                np.add.at(seen[kind], _features(host, path, segmenter), 1)
                seen[kind][FEATURES] += 1
        for kind, counts in seen.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict(
                {"kind": [kind] * len(at), "feature": at.astype(np.int32), "n": counts[at]},
                schema=schema)

    sums = (
        judged.where("ruled IS NOT NULL").select("host", "path", "ruled")
        .mapInArrow(run, "kind string, feature int, n bigint")
        .groupBy("kind", "feature").agg(F.sum("n").alias("n")).collect())
    counts = {ALLOW: np.zeros(FEATURES + 1), BLOCK: np.zeros(FEATURES + 1)}
    for row in sums:  # at most two rows a feature
        counts[row["kind"]][row["feature"]] = row["n"]
    kinds = max(int((counts[ALLOW][:-1] + counts[BLOCK][:-1] > 0).sum()), 1)
    logs = {
        k: np.log((c[:-1] + 1) / (c[:-1].sum() + kinds)) for k, c in counts.items()}
    prior = math.log((counts[ALLOW][-1] + 1) / (counts[BLOCK][-1] + 1))
    return np.append(logs[ALLOW] - logs[BLOCK], prior)


def judge_urls(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
               rules=RULES) -> DataFrame:
    """Every page's ``host``, ``path``, ``rule``, ``verdict`` and ``log_odds``.

    The longest rule that fits decides; else naive Bayes, allow when the odds are even. A null
    url, or one without ``://``, has empty host and path and goes by the prior odds. Repeated
    rows are judged each; an empty table gives no rows. Null html adds no words. Only the three
    named columns are read. Broadcast are MODEL_WORDS words and FEATURES + 1 numbers at most.
    """
    spark = pages.sparkSession
    words = spark.sparkContext.broadcast(frequent_words(pages, html))
    named = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))
    host, path = url_parts(F.col("url"))
    parted = named.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    judged = parted.withColumns({"rule": rule, "ruled": verdict})
    model = spark.sparkContext.broadcast(learn(judged, words))
    kind = judged.schema["page_id"].dataType
    names = ["page_id", "host", "path", "rule", "ruled"]
    schema = pa.schema([("page_id", common.arrow_type(kind))] + [
        (n, pa.string()) for n in names[1:]] + [("log_odds", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter, odds = Segmenter(words.value), model.value
        for batch in batches:
            scores = [
                float(odds[_features(h, p, segmenter)].sum() + odds[FEATURES])
                for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_pydict(
                {n: batch.column(n) for n in names} | {"log_odds": scores}, schema=schema)

    scored = judged.mapInArrow(
        run, f"page_id {kind.simpleString()}, host string, path string, rule string, "
        "ruled string, log_odds double")
    learned = F.when(F.col("log_odds") >= 0, ALLOW).otherwise(BLOCK)
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"),
        "log_odds")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(common.table(spark, sf_dir, "pages"))

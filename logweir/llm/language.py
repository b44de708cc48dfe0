"""Language identification by a string kernel (operator 6).

The kernel counts the distinct n-grams two texts share (blended spectrum, presence only),
scaled by the root of both counts. Landmarks give the Nyström features, on which one kernel
ridge regression a language is fitted on the driver from a bounded sample; the landmarks are
then folded into one weight for each n-gram and language, and texts are scored by products of
presence matrices and weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

ORDERS = (1, 2, 3)
# Bounds of the sample, for one language and for all together: labelled documents, and the first
# of them as landmarks.
PER_LANGUAGE, SAMPLE = 300, 6_000
LANDMARKS, ALL_LANDMARKS = 80, 2_000
# Languages that can be told apart, the most frequent ones.
LANGUAGES = 1_000
RIDGE = 1e-3
BATCH = 64
# Numbers of a block of presence rows.
BLOCK = 1 << 22
UNKNOWN = "und"
# Pieces of this many characters are looked at together.
PIECE = 1 << 18
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def gram_codes(text: str) -> Iterator[np.ndarray]:
    """The text's n-grams with repetitions, each as its own number, in some arrays."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = points.astype(np.uint64)
    for first in range(0, len(points), PIECE):
        part = points[first : first + PIECE + max(ORDERS) - 1]
        for size in ORDERS:
            count = len(part) - size + 1
            if count <= 0:
                continue
            code = np.full(count, size, dtype=np.uint64)
            for k in range(size):
                code = code * np.uint64(0x110000) + part[k : k + count]
            yield code


def distinct(codes: Iterator[np.ndarray]) -> np.ndarray:
    """Distinct numbers of some arrays, ordered; of each array only these are held."""
    found = [np.unique(c) for c in codes]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)


class Grams:
    """Places of known n-grams: a hash table of places, with a list of those whose slot is taken."""

    def __init__(self, codes: np.ndarray):
        self.count = len(codes)
        self.shift = np.uint64(64 - max(16, (64 * self.count).bit_length()))
        slots = self._slots(codes)
        self.table = np.full(1 << (64 - int(self.shift)), self.count, dtype=np.int32)
        self.table[slots] = np.arange(self.count)
        self.codes = np.append(codes, np.uint64(0))  # no n-gram has the number 0
        self.rest = np.flatnonzero(self.table[slots] != np.arange(self.count))

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * _SPREAD) >> self.shift).astype(np.int64)

    def split(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the known n-grams, and the unknown n-grams."""
        at = self.table[self._slots(codes)]
        hit = self.codes[at] == codes
        places, unknown = at[hit], codes[~hit]
        if len(self.rest) and len(unknown):
            taken = self.codes[self.rest]  # ordered, as all codes are
            where = np.minimum(np.searchsorted(taken, unknown), len(taken) - 1)
            found = taken[where] == unknown
            places = np.concatenate((places, self.rest[where[found]]))
            unknown = unknown[~found]
        return places, unknown

    def mark(self, text: str, row: np.ndarray) -> int:
        """Marks the known n-grams in a row of zeros; how many distinct unknown ones there are."""
        unknown = []
        for codes in gram_codes(text):
            places, rest = self.split(codes)
            row[places] = 1
            unknown.append(np.unique(rest))
        return len(np.unique(np.concatenate(unknown))) if unknown else 0


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def kernel(grams: Grams, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Presence kernel of two lists of distinct n-grams, ``b`` all known: two blocks are held."""
    step = max(1, min(BATCH, BLOCK // max(grams.count, 1)))

    def block(part: list[np.ndarray]) -> np.ndarray:
        rows = np.zeros((len(part), grams.count), dtype=np.float32)
        for row, codes in zip(rows, part):
            row[grams.split(codes)[0]] = 1
        return rows

    found = np.empty((len(a), len(b)))
    sizes = [np.sqrt(np.maximum([len(c) for c in side], 1)) for side in (a, b)]
    for i in range(0, len(a), step):
        left = block(a[i : i + step])
        for j in range(0, len(b), step):
            found[i : i + step, j : j + step] = left @ block(b[j : j + step]).T
    return found / np.outer(*sizes)


def labelled_sample(docs: DataFrame) -> DataFrame:
    """At most PER_LANGUAGE documents of each learned language and about SAMPLE of all, by a hash of
    their id; ``mark`` tells the landmarks.

    Ranks are taken on ids and languages alone, with a limit before the shuffle; the texts of
    the few chosen ids follow by a join against that bounded list.
    """
    usable = docs.where(
        "doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL "
        "AND crc32(CAST(doc_id AS string)) % 4 <> 2")
    top = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    languages = [r["lang"] for r in top.collect()]
    size, marks = (max(1, min(one, total // max(len(languages), 1)))
                   for one, total in ((PER_LANGUAGE, SAMPLE), (LANDMARKS, ALL_LANDMARKS)))
    order = Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
    chosen = (
        usable.where(F.col("lang").isin(languages)).select("doc_id", "lang")
        .withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)
        .select(F.col("doc_id").alias("id"), F.col("lang").alias("of"), "place",
                (F.col("place") <= marks).alias("mark")))
    return usable.join(
        F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("of"))
    ).select("doc_id", "lang", "place", "mark", "text")


class Model(NamedTuple):
    """Languages, the landmarks' n-grams, the weight of each for each language, and what a text
    without any of them gets (the mean of each language's goals)."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    base: np.ndarray


def sampled(sample: DataFrame) -> tuple[list[str], list[np.ndarray], list[bool]]:
    """Language, distinct n-grams and landmark or not of each sampled text with a letter."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("place", pa.int32()),
                        ("mark", pa.bool_()), ("grams", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [distinct(gram_codes(t)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {n: batch.column(n) for n in ("doc_id", "lang", "place", "mark")}
                | {"grams": grams}, schema=schema)

    rows = sorted(
        sample.where(F.col("text").rlike(r"\p{L}"))
        .mapInArrow(run, "doc_id bigint, lang string, place int, mark boolean, grams binary")
        .collect(), key=lambda r: (r["lang"], r["place"], r["doc_id"], r["grams"]))
    return ([r["lang"] for r in rows], [np.frombuffer(r["grams"], np.uint64) for r in rows],
            [r["mark"] for r in rows])


def regression(
    of: list[str], between: np.ndarray, among: np.ndarray
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """One-versus-rest ridge on Nyström features: languages, a factor for each landmark, base."""
    languages = sorted(set(of))
    goal = np.array([[1.0 if r == x else -1.0 for x in languages] for r in of])
    left = between.T @ between + RIDGE * len(of) * (among + 1e-6 * np.eye(len(among)))
    base = goal.mean(axis=0)
    return languages, np.linalg.solve(left, between.T @ (goal - base)), base


def fit(sample: DataFrame) -> Model:
    """The model of a bounded sample, on the driver."""
    of, texts, marked = sampled(sample)
    marks = [t for t, mark in zip(texts, marked) if mark]
    codes = distinct(iter(marks))
    if not len(codes):
        return Model([], codes, np.zeros((0, 0), dtype=np.float32), np.zeros(0))
    grams = Grams(codes)
    languages, factors, base = regression(
        of, kernel(grams, texts, marks), kernel(grams, marks, marks))
    weights = np.zeros((grams.count, len(languages)), dtype=np.float32)
    for mark, factor in zip(marks, factors):
        weights[grams.split(mark)[0]] += (factor / np.sqrt(max(len(mark), 1))).astype(np.float32)
    return Model(languages, codes, weights, base)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds ``lang_pred``, ``score`` and ``known`` to the carried struct ``row`` of (t, row)."""
    # A plain tuple: tasks need no class to unpack it.
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model))
    kind = docs.schema["row"].dataType
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()),
                        ("known", pa.float64()), ("row", common.arrow_type(kind))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, codes, weights, base = sent.value
        grams = Grams(codes)
        step = max(1, min(BATCH, BLOCK // max(grams.count, 1)))
        seen = np.zeros((step, grams.count), dtype=np.float32)

        def work(columns: list) -> dict:
            texts, rows = [t.decode() for t in columns[0]], columns[1]
            names, scores, known = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            lettered = [i for i, t in enumerate(texts) if languages and has_letter(t)]
            for first in range(0, len(lettered), step):
                part = lettered[first : first + step]
                block = seen[: len(part)]
                block[:] = 0
                unknown = np.array([grams.mark(texts[i], row) for row, i in zip(block, part)])
                found = block.sum(axis=1)
                values = (block @ weights) / np.sqrt(found + unknown)[:, None] + base
                best = values.argmax(axis=1)
                for i, at, value, share in zip(
                        part, best, values.max(axis=1), found / (found + unknown)):
                    names[i] = languages[at]
                    scores[i] = float(np.clip((float(value) + 1) / 2, 0, 1))
                    known[i] = float(share)
            return {"lang_pred": names, "score": scores, "known": known, "row": rows}

        yield from common.by_chunk(work, ["t", "row"], schema)(batches)

    return docs.mapInArrow(
        run, f"lang_pred string, score double, known double, row {kind.simpleString()}")


def identify(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the text as ``row``, with ``lang_pred``, ``score`` and ``known``.

    The model is learned from text and ``lang`` of documents whose crc32 of the id is not 2
    modulo 4; ids only choose the sample. ``und`` with score 0 stands for null texts, texts
    without a letter, and for all when nothing is labelled. The score is the winning regression
    mapped from [-1, 1] to [0, 1]; ``known`` is the share of the text's distinct n-grams that some
    landmark holds, which does not move with the number or the sizes of the languages. Ties go to the first language by name. Texts are scored whole.
    Other columns travel inside the struct; an empty table gives no rows.
    """
    sample = labelled_sample(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), "lang"))
    model = fit(sample)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    frame = docs.select(common.as_bytes(text).alias("t"), F.struct(*rest).alias("row"))
    return predict(frame, model)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = identify(docs)
    doc_id = F.col("row.doc_id")
    held_out = F.coalesce(F.expr("crc32(CAST(row.doc_id AS string)) % 4 = 2"), F.lit(False))
    return found.select(
        doc_id.alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score")

"""Line dedup with two Bloom filters (operator 8).

A first scan builds filters of line hashes seen once and seen twice; the merged second one
tells a second scan which lines may repeat. Only those are shuffled, confirmed on their whole
digests, and given to their first document.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_POINTS = 10
# Size of one filter, fixed: 16 MB. What a fuller filter lets through is shuffled, not lost.
FILTER_BITS = 1 << 27
SEGMENT_BYTES = 1 << 16

_BLANK = b"\t\n\x0b\x0c\r "


def line_key(line: bytes) -> bytes | None:
    """The key of a line; None where it is too short to count."""
    key = line.strip(_BLANK)
    if len(key) < MIN_POINTS or (len(key) < 4 * MIN_POINTS and len(key.decode()) < MIN_POINTS):
        return None
    return key.lower()


def _keys(text: bytes) -> set[bytes]:
    found = set(map(line_key, text.split(b"\n")))
    found.discard(None)
    return found


def probes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key."""
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    mask = np.uint64(FILTER_BITS - 1)
    return (hashes & mask).astype(np.int64), ((hashes >> np.uint64(32)) & mask).astype(np.int64)


def has(bits: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    def one(at):
        return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1

    return (one(first) & one(second)).astype(bool)


def add(bits: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
    for at in (first, second):
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))


class Filters:
    """The filters of one task. Each document's keys are added once."""

    def __init__(self):
        self.once = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        self.twice = np.zeros(FILTER_BITS // 8, dtype=np.uint8)

    def see(self, documents: list[set[bytes]]) -> None:
        held: dict[bytes, int] = {}
        for keys in documents:
            for key in keys:
                held[key] = held.get(key, 0) + 1
        if not held:
            return
        first, second = probes(list(held))
        again = has(self.once, first, second)
        again |= np.fromiter(held.values(), np.int64, len(held)) > 1
        add(self.twice, first[again], second[again])
        add(self.once, first, second)

    def segments(self) -> Iterator[dict]:
        for no in range(len(self.once) // SEGMENT_BYTES):
            part = slice(no * SEGMENT_BYTES, (no + 1) * SEGMENT_BYTES)
            if self.once[part].any():
                yield {"segment": [no], "once": [zlib.compress(self.once[part].tobytes(), 1)],
                       "twice": [zlib.compress(self.twice[part].tobytes(), 1)]}


_SEGMENT = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for first, last in common.pieces(common.binary_sizes(batch.column("t"))):
            part = batch.slice(first, last - first)
            yield part, [t or b"" for t in part.column("t").to_pylist()]


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    filters = Filters()
    for _, texts in _texts(batches):
        filters.see([_keys(t) for t in texts])
    for row in filters.segments():
        yield pa.RecordBatch.from_pydict(row, schema=_SEGMENT)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ORs the tasks' segments as they stream by; bits that two tasks saw once are seen twice."""
    once: dict[int, np.ndarray] = {}
    twice: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            no = row["segment"]
            seen = np.frombuffer(zlib.decompress(row["once"]), np.uint8)
            again = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
            if no not in once:
                once[no], twice[no] = seen.copy(), again.copy()
            else:
                twice[no] |= again | (once[no] & seen)
                once[no] |= seen
    for no, bits in twice.items():
        if bits.any():
            yield pa.RecordBatch.from_pydict(
                {"segment": [no], "once": [None], "twice": [zlib.compress(bits.tobytes(), 1)]},
                schema=_SEGMENT)


def twice_filter(texts: DataFrame) -> bytes:
    """The filter of keys that two documents may hold, at most FILTER_BITS / 8 bytes."""
    schema = "segment int, once binary, twice binary"
    merged = texts.select("t").mapInArrow(_build, schema).repartition("segment").mapInArrow(
        _merge, schema)
    bits = bytearray(FILTER_BITS // 8)
    for row in merged.select("segment", "twice").toLocalIterator():
        at = row["segment"] * SEGMENT_BYTES
        bits[at : at + SEGMENT_BYTES] = zlib.decompress(row["twice"])
    return bytes(bits)


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def suspects(texts: DataFrame, filter_bits) -> DataFrame:
    """One row for each document and key that the filter lets through."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(filter_bits.value, np.uint8)
        for part, found in _texts(batches):
            ids, keys = [], []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), found):
                held = _keys(text)
                ids += [doc_id] * len(held)
                keys += held
            if keys:
                hit = np.flatnonzero(has(bits, *probes(keys)))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": [ids[i] for i in hit], "key": [_digest(keys[i]) for i in hit]},
                    schema=schema)

    return texts.where("doc_id IS NOT NULL").mapInArrow(run, "doc_id bigint, key binary")


def _kept(columns: list) -> dict:
    texts, drops, carried = columns
    kept, totals, dropped = [], [], []
    for text, drop in zip(texts, drops.to_pylist()):
        lines = text.split(b"\n")
        totals.append(len(lines))
        if drop:
            gone = set(drop)
            stay = []
            for line in lines:
                key = line_key(line)
                if key is None or _digest(key) not in gone:
                    stay.append(line)
        else:
            stay = lines
        kept.append(b"\n".join(stay))
        dropped.append(len(lines) - len(stay))
    return {"kept": kept, "n_lines": totals, "n_dropped": dropped, "row": carried}


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` as ``row`` (a struct without the text) with the ``kept`` text,
    ``n_lines`` and ``n_dropped``.

    A line's key is stripped of white space and lower-cased (A-Z). Keys of ten code points or
    more that two documents hold stay only in the document with the smallest id, there with
    all their lines. Rows that share an id are one document. A row without an id keeps all its
    lines and makes no other lose any. Null or empty text is one empty line. Other columns
    travel inside the struct, so their names cannot clash. An empty table gives no rows.

    A key that very many documents hold is one row a document in the suspects, summed on the
    map side; the join back is between two stored tables, so Spark splits a hot key.
    """
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c != text]
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), common.as_bytes(text).alias("t"))
    filter_bits = spark.sparkContext.broadcast(twice_filter(texts))
    found = common.saved(suspects(texts, filter_bits), "lines-suspects")
    confirmed = common.saved(
        found.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last").select("key", "first"), "lines-confirmed")
    drops = (
        found.join(confirmed, "key").where("doc_id > first")
        .groupBy(F.col("doc_id").alias("drop_of")).agg(F.collect_set("key").alias("drops"))
    )
    frame = docs.select(
        F.col(key).cast("long").alias("join_id"), common.as_bytes(text).alias("t"),
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))
    joined = frame.join(drops, F.col("join_id") == F.col("drop_of"), "left").select(
        "t", "drops", "row")
    kind = frame.schema["row"].dataType
    schema = pa.schema([("kept", pa.binary()), ("n_lines", pa.int64()),
                        ("n_dropped", pa.int64()), ("row", common.arrow_type(kind))])
    out = f"kept binary, n_lines bigint, n_dropped bigint, row {kind.simpleString()}"
    return joined.mapInArrow(common.by_chunk(_kept, ["t", "drops", "row"], schema), out)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped",
        F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
numbered AS (
  SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs),
keyed AS (
  SELECT *, translate(
    regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM numbered),
held AS (
  SELECT key, min(doc_id) AS first FROM keyed
  WHERE length(key) >= 10 AND doc_id IS NOT NULL
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
judged AS (
  SELECT k.*, h.first IS NOT NULL AND doc_id > h.first AS dropped
  FROM keyed k LEFT JOIN held h ON k.key = h.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY rid, doc_id
"""

"""Substring dedup by fixed-block anchors (operator 10).

Every document's non-overlapping blocks of ten words are the index; every rolling ten-word
window probes it. A repeated run of twenty words holds a whole indexed block of its other
occurrence, so the hits mark all places where a run can repeat; they are extended to maximal
repeats by comparing the twenty-word windows around them.

Documents are dealt to chunks. A chunk sends each distinct window hash once, packed by hash
range, and gets one bit for each back. So a window that a third of all documents hold costs
one entry a chunk, and no row of text is shuffled more than once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 20
BLOCK = WINDOW // 2
# Text of a chunk, and window hashes of a hash range: what one task holds as arrays.
CHUNK_BYTES = 8 * 1024 * 1024
RANGE_BYTES = 16 * 1024 * 1024

_NO_ID = np.iinfo(np.int64).max
_LOW = np.uint64(0xFFFFFFFF)


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    """Range of each hash; sorted hashes have sorted ranges."""
    return (((hashes >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order, starts of the groups of equal hashes, and their hashes."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    new = np.ones(len(ranked), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    starts = np.flatnonzero(new)
    return order, starts, ranked[starts]


class Part:
    """The documents of a chunk in the order of their ids."""

    def __init__(self, table: pa.Table):
        ids = table.column("doc_id").to_pylist()
        texts = [t or b"" for t in table.column("t").to_pylist()]
        keys = np.array([_NO_ID if i is None else i for i in ids], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ids = [ids[i] for i in order]
        self.words = common.Chunk([texts[i] for i in order])
        self.owner = self.words.owners()
        self.blocks, self.block_at = self.words.windows(BLOCK)
        self.groups = _distinct(self.blocks)

    def offsets(self, at: np.ndarray) -> np.ndarray:
        """Place in its own text of each word."""
        return at - self.words.bounds[self.owner[at]]

    def block_flags(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct block hash: is it indexed, and does it occur twice here."""
        order, starts, _ = self.groups
        indexed = self.offsets(self.block_at) % BLOCK == 0
        any_indexed = np.logical_or.reduceat(indexed[order], starts) if len(starts) else indexed
        return any_indexed, np.diff(np.append(starts, len(order))) > 1

    def candidates(self, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and starts of the twenty-word windows that hold a hit; ``hot`` is one flag
        for each distinct block hash."""
        order, starts, _ = self.groups
        hit = np.zeros(len(self.words.hashes) + 1, dtype=np.int64)
        counts = np.diff(np.append(starts, len(order)))
        hit[self.block_at[order[np.repeat(hot, counts)]] + 1] = 1
        upto = np.cumsum(hit)
        hashes, at = self.words.windows(WINDOW)
        holds = upto[at + WINDOW - BLOCK + 1] > upto[at]
        return hashes[holds], at[holds]


def _packed(hashes: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    cuts = np.searchsorted(_range_of(hashes, ranges), np.arange(ranges + 1))
    for no in range(ranges):
        if cuts[no + 1] > cuts[no]:
            yield no, slice(cuts[no], cuts[no + 1])


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(bits: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=count).astype(bool)


def _spread(rows: list[dict], hashes: np.ndarray, ranges: int) -> np.ndarray:
    """One flag for each distinct hash from the bits of the ranges."""
    found = np.zeros(len(hashes), dtype=bool)
    cuts = np.searchsorted(_range_of(hashes, ranges), np.arange(ranges + 1))
    for row in rows:
        first, last = cuts[row["range_no"]], cuts[row["range_no"] + 1]
        found[first:last] = _flags(row["bits"], last - first)
    return found


_PROBE = pa.schema([("chunk", pa.int32()), ("range_no", pa.int32()), ("marks", pa.binary()),
                    ("indexed", pa.binary()), ("twice", pa.binary())])
_PROBE_DDL = "chunk int, range_no int, marks binary, indexed binary, twice binary"
_FIRST = pa.schema([("chunk", pa.int32()), ("range_no", pa.int32()), ("hashes", pa.binary()),
                    ("docs", pa.binary()), ("of", pa.binary())])
_FIRST_DDL = "chunk int, range_no int, hashes binary, docs binary, of binary"
_BITS = pa.schema([("chunk", pa.int32()), ("kind", pa.int32()), ("range_no", pa.int32()),
                   ("bits", pa.binary())])
_BITS_DDL = "chunk int, kind int, range_no int, bits binary"
_BLOCK_BITS, _WINDOW_BITS = 0, 1


def _probes(ranges: int):
    """The distinct block hashes of a chunk, packed by range: their next 32 bits, and flags."""

    def run(table: pa.Table) -> pa.Table:
        part = Part(table)
        chunk = table.column("chunk")[0].as_py()
        hashes = part.groups[2]
        indexed, twice = part.block_flags()
        marks = (hashes & _LOW).astype("<u4")
        rows = [
            {"chunk": chunk, "range_no": no, "marks": marks[at].tobytes(),
             "indexed": _bits(indexed[at]), "twice": _bits(twice[at])}
            for no, at in _packed(hashes, ranges)
        ]
        return pa.Table.from_pylist(rows, schema=_PROBE)

    return run


def _hits(table: pa.Table) -> pa.Table:
    """Of a range: which entries occur twice or more, at least once as an indexed block."""
    rows = table.to_pylist()
    marks = [np.frombuffer(r["marks"], "<u4") for r in rows]
    sizes = np.array([len(m) for m in marks])
    indexed = np.concatenate([_flags(r["indexed"], n) for r, n in zip(rows, sizes)])
    twice = np.concatenate([_flags(r["twice"], n) for r, n in zip(rows, sizes)])
    order, starts, _ = _distinct(np.concatenate(marks))
    counts = np.diff(np.append(starts, len(order)))
    hot = (counts > 1) | np.logical_or.reduceat(twice[order], starts)
    hot &= np.logical_or.reduceat(indexed[order], starts)
    flags = np.empty(len(order), dtype=bool)
    flags[order] = np.repeat(hot, counts)
    return _answers(rows, sizes, flags, _BLOCK_BITS)


def _answers(rows: list[dict], sizes: np.ndarray, flags: np.ndarray, kind: int) -> pa.Table:
    upto = np.cumsum(sizes)
    found = []
    for row, size, end in zip(rows, sizes, upto):
        own = flags[end - size : end]
        if own.any():
            found.append({"chunk": row["chunk"], "kind": kind, "range_no": row["range_no"],
                          "bits": _bits(own)})
    return pa.Table.from_pylist(found, schema=_BITS)


def _firsts(ranges: int):
    """The distinct candidate windows of a chunk with the first document of each."""

    def run(docs: pa.Table, bits: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _FIRST.empty_table()
        part = Part(docs)
        hashes, at = part.candidates(_spread(bits.to_pylist(), part.groups[2], ranges))
        order, starts, distinct = _distinct(hashes)
        owner = part.owner[at[order[starts]]]
        chunk = docs.column("chunk")[0].as_py()
        rows = []
        for no, cut in _packed(distinct, ranges):
            held, place = np.unique(owner[cut], return_inverse=True)
            rows.append({"chunk": chunk, "range_no": no, "hashes": distinct[cut].tobytes(),
                         "docs": part.keys[held].tobytes(),
                         "of": place.astype("<u4").tobytes()})
        return pa.Table.from_pylist(rows, schema=_FIRST)

    return run


def _owners(table: pa.Table) -> pa.Table:
    """Of a range: which entries are not the earliest of their window."""
    rows = table.to_pylist()
    hashes = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
    docs = [np.frombuffer(r["docs"], np.int64)[np.frombuffer(r["of"], "<u4")] for r in rows]
    sizes = np.array([len(h) for h in hashes])
    order, starts, _ = _distinct(np.concatenate(hashes))
    keys = np.concatenate(docs)[order]
    first = np.minimum.reduceat(keys, starts)
    later = np.empty(len(order), dtype=bool)
    later[order] = keys > np.repeat(first, np.diff(np.append(starts, len(order))))
    return _answers(rows, sizes, later, _WINDOW_BITS)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
                  ("kept", pa.binary())])


def _cut(ranges: int):
    """Removes the words of windows that start earlier too."""

    def run(docs: pa.Table, bits: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _OUT.empty_table()
        part = Part(docs)
        rows = bits.to_pylist()
        hot = _spread([r for r in rows if r["kind"] == _BLOCK_BITS], part.groups[2], ranges)
        hashes, at = part.candidates(hot)
        order, starts, distinct = _distinct(hashes)
        elsewhere = _spread([r for r in rows if r["kind"] == _WINDOW_BITS], distinct, ranges)
        # Places of the first occurrence here; rows that share an id share its places.
        counts = np.diff(np.append(starts, len(order)))
        ranked = at[order]
        first = np.repeat(ranked[starts], counts) if len(starts) else ranked
        keys, offsets = part.keys[part.owner], part.offsets(np.arange(len(part.owner)))
        later = (keys[ranked] > keys[first]) | (
            (keys[ranked] == keys[first]) & (offsets[ranked] > offsets[first]))
        gone = common.covered(ranked[later | np.repeat(elsewhere, counts)], WINDOW,
                              len(part.owner))
        words = part.words
        return pa.table({
            "doc_id": part.ids, "n_words": words.counts,
            "n_removed": np.bincount(part.owner[gone], minlength=len(part.ids)),
            "kept": joined(words, ~gone),
        }, schema=_OUT)

    return run


def joined(words: common.Chunk, keep: np.ndarray) -> list[bytes]:
    """The kept words of each text, joined by one space."""
    step = np.zeros(len(words.buffer) + 2, dtype=np.int32)
    step[words.starts[keep]] += 1
    step[words.ends[keep] + 1] -= 1
    mask = np.cumsum(step[:-2]) > 0
    spaced = words.buffer.copy()
    spaced[words.ends] = 32
    upto = np.concatenate(([0], np.cumsum(mask)))[words.text_starts]
    out = spaced[mask].tobytes()
    return [out[a:b][:-1] for a, b in zip(upto[:-1], upto[1:])]


def dedup_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each document ``doc_id``, ``n_words``, ``n_removed`` and the ``kept`` words.

    A word goes when a window of twenty words over it, all in one document, also starts
    earlier: in a document with a smaller id, or earlier in the same one. Windows are judged
    on the input. Rows that share an id are one place in this order: a copy under the same id
    and start is not earlier. Rows without an id come after all others, and are alike among
    themselves. Null and empty texts have no words. Only the two named columns are read, so
    other columns cannot clash. An empty table gives no rows.
    """
    spark = docs.sparkSession
    frame = docs.select(F.col(key).cast("long").alias("doc_id"), common.as_bytes(text).alias("t"))
    total = frame.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    chunks = max(-(-total // CHUNK_BYTES), 2 * spark.sparkContext.defaultParallelism)
    ranges = max(-(-total // RANGE_BYTES), 1)
    chunk = F.pmod(F.xxhash64(F.coalesce("doc_id", F.octet_length("t"))), F.lit(chunks))
    dealt = frame.withColumn("chunk", chunk.cast("int")).repartition(chunks, "chunk")
    by_chunk = dealt.groupBy("chunk")
    probes = by_chunk.applyInArrow(_probes(ranges), _PROBE_DDL)
    hits = probes.repartition(ranges, "range_no").groupBy("range_no").applyInArrow(
        _hits, _BITS_DDL)
    firsts = by_chunk.cogroup(hits.groupBy("chunk")).applyInArrow(_firsts(ranges), _FIRST_DDL)
    owners = firsts.repartition(ranges, "range_no").groupBy("range_no").applyInArrow(
        _owners, _BITS_DDL)
    bits = hits.unionByName(owners)
    return by_chunk.cogroup(bits.groupBy("chunk")).applyInArrow(
        _cut(ranges), "doc_id bigint, n_words bigint, n_removed bigint, kept binary")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT rid, doc_id, i, list_aggregate(w[i:i + 19], 'string_agg', ' ') AS win
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 18, 1))) AS i FROM docs)),
ordered AS (
  SELECT rid, i, doc_id, min(struct_pack(d := doc_id, i := i)) OVER (PARTITION BY win) AS first
  FROM windows),
gone AS (
  SELECT DISTINCT rid, unnest(range(i, i + 20)) AS j FROM ordered
  WHERE doc_id > first.d OR (doc_id = first.d AND i > first.i)),
words AS (
  SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM docs),
kept AS (
  SELECT rid, string_agg(word, ' ' ORDER BY j) AS text
  FROM words ANTI JOIN gone USING (rid, j) GROUP BY rid),
removed AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid) LEFT JOIN removed USING (rid)
"""

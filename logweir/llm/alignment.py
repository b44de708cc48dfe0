"""Alignment of two tokenizers (operator 11).

Both tokenizers cut the same bytes, so the positions where a token of either ends cut a text
into intervals, and each interval is one link: the one token of A and the one token of B over
it. The texts are encoded once and their ids stored. A first pass over the ids counts the
linked id pairs task by task. The distinct pairs get a minimal perfect hash; the tasks' counts
become dense vectors indexed by it, which are summed as a tree. A second pass aligns the ids again
and looks up each link's count, checking the key.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .perfect import PerfectHash

# Pairs whose hash, keys, counts and marks are broadcast together: 18 bytes each, 75 MB at most.
SLICE_PAIRS = 1 << 22
# Pairs of one perfect hash, built by one task.
SHARD_PAIRS = 1 << 17
# Distinct pairs that a task holds before it hands some on.
HELD_PAIRS = 1 << 21
# Count vectors that are summed at a time.
FAN = 8

# The splitting pattern of byte-level vocabularies of this kind (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def token_bytes(vocabulary: dict[str, int]) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    from .bpe import _byte_chars

    byte_of = {c: bytes([b]) for b, c in enumerate(_byte_chars())}
    found = [b""] * (max(vocabulary.values()) + 1)
    for token, number in vocabulary.items():
        found[number] = b"".join(byte_of.get(c, c.encode()) for c in token)
    return found


class Aligner:
    """Both tokenizers, from the text of A's JSON file and the bytes of B's model."""

    def __init__(self, spec: str, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken

        a = json.loads(spec)
        if a["normalizer"] or a["pre_tokenizer"] != {
                "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True,
                "use_regex": True}:
            raise ValueError("A has to be a byte-level BPE that splits by the usual pattern")
        vocabulary, added = a["model"]["vocab"], {t["content"] for t in a["added_tokens"]}
        merged = [vocabulary["".join(m if isinstance(m, list) else m.split(" "))]
                  for m in a["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("A's ids have to follow the order of its merges")
        a_bytes = token_bytes({t: n for t, n in vocabulary.items() if t not in added})
        self.a = tiktoken.Encoding(
            "a", pat_str=PATTERN, special_tokens={},
            mergeable_ranks={t: n for n, t in enumerate(a_bytes) if t})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(self.b.get_piece_size())
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i)
            else self.b.id_to_piece(i).replace("▁", " ").encode() for i in ids]
        self.a_sizes = np.array([len(t) for t in a_bytes], dtype=np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        # Types that hold every id of A and of B.
        self.id_kinds = [np.min_scalar_type(len(n)) for n in (self.a_sizes, self.b_sizes)]
        # An id with each of the separators that may follow it.
        self.names = [f"{i}{s}" for n, seps in ((len(a_bytes), ",|"), (len(ids), ",;"))
                      for s in seps for i in range(n)]

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B of each text; none when it is empty or they do not spell a space and it."""
        plain, found = [t.decode() for t in texts], []
        for text, words, ids in zip(texts, plain, self.b.encode(plain, num_threads=1)):
            a, body = self.a.encode_to_numpy(" " + words), b" " + text
            if (text and b"".join(map(self.b_bytes.__getitem__, ids)) == body
                    and self.a_sizes[a].sum() == len(body)):
                found.append((a, np.array(ids, dtype=np.int32)))
            else:
                found.append((a[:0], np.zeros(0, np.int32)))
        return found


def _earlier(marks: np.ndarray) -> np.ndarray:
    """How many marks stand before each place."""
    return np.cumsum(marks) - marks


class Aligned:
    """Some texts, aligned from their ids: the tokens of all of them and their links, in order.

    ``links`` holds the id pair of each link, A's id in the upper half. Text i has the links
    ``link_bounds[i]:link_bounds[i + 1]``.
    """

    def __init__(self, aligner: Aligner, found: list[tuple[np.ndarray, np.ndarray]]):
        self.aligner = aligner
        self.n_a = np.array([len(a) for a, _ in found], dtype=np.int64)
        self.n_b = np.array([len(b) for _, b in found], dtype=np.int64)
        none = [np.zeros(0, np.int32)]
        self.a = np.concatenate(none + [a for a, _ in found]).astype(np.int64)
        self.b = np.concatenate(none + [b for _, b in found]).astype(np.int64)
        self.a_ends, self.b_ends = np.cumsum(aligner.a_sizes[self.a]), np.cumsum(aligner.b_sizes[self.b])
        size = int(self.a_ends[-1]) if len(self.a) else 0
        self.ends_a, self.ends_b = np.zeros(size + 1, bool), np.zeros(size + 1, bool)
        self.ends_a[self.a_ends] = True
        self.ends_b[self.b_ends] = True
        cuts = np.flatnonzero(self.ends_a | self.ends_b)
        a_of, b_of = _earlier(self.ends_a[cuts]), _earlier(self.ends_b[cuts])
        self.links = (self.a[a_of] << 32) | self.b[b_of]
        self.common = np.flatnonzero(self.ends_a & self.ends_b)
        self.a_bounds, self.b_bounds = (
            np.concatenate(([0], np.cumsum(n))) for n in (self.n_a, self.n_b))
        self.text_ends = np.concatenate(([0], self.a_ends))[self.a_bounds[1:]]
        self.link_bounds = self._upto(cuts)
        self.n_groups = np.diff(self._upto(self.common))

    def _upto(self, ends: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.searchsorted(ends, self.text_ends, side="right")))

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each text: the ids between positions where both end."""
        last_a, last_b = self.ends_b[self.a_ends], self.ends_a[self.b_ends]
        group_a, group_b = _earlier(last_a), _earlier(last_b)
        a_upto, b_upto = np.cumsum(np.bincount(group_a)), np.cumsum(np.bincount(group_b))
        b_before = np.concatenate(([0], b_upto[:-1]))
        n_a, n_b = len(self.aligner.a_sizes), len(self.aligner.b_sizes)
        codes = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        codes[np.arange(len(self.a)) + b_before[group_a]] = self.a + n_a * last_a
        codes[np.arange(len(self.b)) + a_upto[group_b]] = 2 * n_a + self.b + n_b * last_b
        bounds = (self.a_bounds + self.b_bounds).tolist()
        name = self.aligner.names.__getitem__
        return ["".join(map(name, codes[lo:hi].tolist()))[:-1]
                for lo, hi in zip(bounds, bounds[1:])]


class Tokenizers:
    """What a task needs for an ``Aligner``, which a process builds once."""

    def __init__(self, spark: SparkSession, path_a: str, path_b: str):
        with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
            self.files = spark.sparkContext.broadcast((a.read(), b.read()))
        self.key = ("aligner", path_a, path_b)

    def aligner(self) -> Aligner:
        return common.once(self.key, lambda: Aligner(*self.files.value))


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.zeros(len(every), dtype=np.int64)
    np.add.at(total, at, np.concatenate(counts))
    return every, total


def encoded(docs: DataFrame, text: str, tokenizers: Tokenizers) -> DataFrame:
    """``docs`` without the text as struct ``row``, and its ids ``a`` and ``b`` as bytes, in a table
    that both passes read: the tokenizers run once."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    frame = docs.select(common.as_bytes(text).alias("t"), F.struct(*rest).alias("row"))
    kind = frame.schema["row"].dataType
    schema = pa.schema([("row", common.arrow_type(kind)), ("a", pa.binary()), ("b", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = tokenizers.aligner()
        kinds = aligner.id_kinds

        def work(columns: list) -> dict:
            texts, rows = columns
            ids = aligner.encode(texts)
            return {"row": rows, **{
                c: [pair[i].astype(kinds[i]).tobytes() for pair in ids] for i, c in enumerate("ab")}}

        yield from common.by_chunk(work, ["t", "row"], schema)(batches)

    return common.saved(
        frame.mapInArrow(run, f"row {kind.simpleString()}, a binary, b binary"), "token-ids")


def _aligned(batch: pa.RecordBatch, aligner: Aligner) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    """Pieces of a batch of ``encoded`` rows, aligned."""
    kinds = aligner.id_kinds
    sizes = [sum(n) for n in zip(*(common.binary_sizes(batch.column(c)) for c in "ab"))]
    for first, last in common.pieces(sizes):
        part = batch.slice(first, last - first)
        ids = ([np.frombuffer(x, kind) for x in part.column(c).to_pylist()]
               for c, kind in zip("ab", kinds))
        yield part, Aligned(aligner, list(zip(*ids)))


def _task_counts(ids: DataFrame, tokenizers: Tokenizers) -> DataFrame:
    """``pair`` and ``n``: the links of each task's documents, summed within the task."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = tokenizers.aligner()
        keys, counts, held = [], [], 0

        def handed_on() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(dict(zip(schema.names, (keys[0], counts[0]))), schema)

        for batch in batches:
            for _, found in _aligned(batch, aligner):
                key, count = np.unique(found.links, return_counts=True)
                keys.append(key)
                counts.append(count)
                held += len(key)
                if held > HELD_PAIRS:
                    key, count = _summed(keys, counts)
                    keys, counts, held = [key], [count], len(key)
                    if held > HELD_PAIRS // 2:
                        yield handed_on()
                        keys, counts, held = [], [], 0
        if keys:
            key, count = _summed(keys, counts)
            keys, counts = [key], [count]
            yield handed_on()

    return ids.select("a", "b").mapInArrow(run, "pair bigint, n bigint")


def _slice_of(pairs, slices: int):
    """Slice of a pair (array or column): all pairs of one id of B share it."""
    return ((pairs & 0xFFFFFFFF) * 2654435761 >> 16) % slices


def _slice_column(slices: int) -> F.Column:
    return F.expr(f"shiftright((pair & 4294967295) * 2654435761, 16) % {slices}")


def _shard_of(pairs: np.ndarray, shards: int) -> np.ndarray:
    return ((pairs >> 32) * 2654435761 + (pairs & 0xFFFFFFFF) * 40503) % shards


def _shard_column(shards: int) -> F.Column:
    return F.expr(
        f"(shiftright(pair, 32) * 2654435761 + (pair & 4294967295) * 40503) % {shards}")


def _hashes(pairs: DataFrame, shards: int) -> DataFrame:
    """One perfect hash per shard of distinct pairs, with the pairs in hash order."""
    schema = pa.schema([("shard", pa.int64()), ("sizes", pa.binary()), ("words", pa.binary()),
                        ("pairs", pa.binary())])

    def build(group: pa.Table) -> pa.Table:
        keys = group["pair"].to_numpy()
        hashed = PerfectHash.of(keys.view(np.uint64))
        ordered = np.empty_like(keys)
        ordered[hashed.index(keys.view(np.uint64))] = keys
        return pa.table({
            "shard": group["shard"][:1], "sizes": [hashed.sizes.tobytes()],
            "words": [hashed.words.tobytes()], "pairs": [ordered.tobytes()]}, schema=schema)

    return pairs.withColumn("shard", _shard_column(shards)).groupBy("shard").applyInArrow(
        build, "shard bigint, sizes binary, words binary, pairs binary")


class PairIndex:
    """The perfect hashes of all shards; a pair's index counts through the shards."""

    def __init__(self, rows: list, shards: int):
        self.shards = shards
        self.hashes, self.starts, keys, size = {}, {}, [], 0
        for row in sorted(rows, key=lambda r: r.shard):
            key = np.frombuffer(row.pairs, np.int64)
            self.hashes[row.shard] = PerfectHash(
                np.frombuffer(row.sizes, np.int64), np.frombuffer(row.words, np.uint64))
            self.starts[row.shard] = size
            keys.append(key)
            size += len(key)
        self.keys = np.concatenate([np.zeros(0, np.int64), *keys])

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """The index of each pair, which has to be one of the keys."""
        found = np.full(len(pairs), -1, dtype=np.int64)
        shard = _shard_of(pairs, self.shards)
        for number, hashed in self.hashes.items():
            at = np.flatnonzero(shard == number) if self.shards > 1 else slice(None)
            found[at] = hashed.index(pairs[at].view(np.uint64)) + self.starts[number]
        if len(pairs) and (found.min() < 0 or (self.keys[found] != pairs).any()):
            raise ValueError("a pair is not among the counted ones: the documents have changed")
        return found


def _summed_vectors(counted: DataFrame, index: common.Sent) -> dict[int, bytes]:
    """The count vector of each shard, by its hash: one dense vector a task, summed as a tree."""
    schema = pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("vector", pa.binary())])
    kind = "shard bigint, part bigint, vector binary"

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = index.get()
        total = np.zeros(len(table.keys), dtype=np.int64)
        for batch in batches:
            at = table.find(batch.column(0).to_numpy())
            np.add.at(total, at, batch.column(1).to_numpy())
        if total.any():
            part = TaskContext.get().partitionId()
            for number, start in table.starts.items():
                size = int(np.bitwise_count(table.hashes[number].words).sum())
                yield pa.RecordBatch.from_pydict(
                    {"shard": [number], "part": [part],
                     "vector": [total[start : start + size].tobytes()]}, schema=schema)

    def add(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, 0
        for batch in group:
            for row in batch.to_pylist():
                key = (row["shard"], row["up"])
                total = total + np.frombuffer(row["vector"], np.int64)
        yield pa.RecordBatch.from_pydict(
            {"shard": [key[0]], "part": [key[1]], "vector": [total.tobytes()]}, schema=schema)

    vectors = common.saved(counted.select("pair", "n").mapInArrow(leaves, kind), "vectors")
    while (vectors.agg(F.max("part")).first()[0] or 0) > 0:
        vectors = common.saved(
            vectors.withColumn("up", F.expr(f"part div {FAN}")).groupBy("shard", "up")
            .applyInArrow(add, kind), "vectors")
    return {r.shard: r.vector for r in vectors.collect()}


class PairCounts:
    """Counts of the pairs of a slice, and whether each is the highest of its id of B."""

    def __init__(self, index: PairIndex, vectors: dict[int, bytes], slices: int, number: int):
        self.index, self.slices, self.number = index, slices, number
        self.counts = np.concatenate([np.zeros(0, np.int64), *[
            np.frombuffer(vectors[s], np.int64) for s in index.starts]])
        b_ids = index.keys & 0xFFFFFFFF
        highest = np.zeros(int(b_ids.max()) + 1 if len(b_ids) else 0, dtype=np.int64)
        np.maximum.at(highest, b_ids, self.counts)
        self.best = highest[b_ids] == self.counts

    def sums(self, links: np.ndarray, times: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """Links that are best, and the sum of counts, of each text's run of links."""
        pairs = np.unique(links)
        mine = np.ones(len(pairs), bool) if self.slices == 1 else (
            _slice_of(pairs, self.slices) == self.number)
        found, at = self.index.find(pairs[mine]), np.searchsorted(pairs, links)
        totals = []
        for values in (self.best, self.counts):
            value = np.zeros(len(pairs), dtype=np.int64)
            value[mine] = values[found]
            each = value[at] * times
            upto = np.concatenate(([0], np.cumsum(each)))
            totals.append(upto[bounds[1:]] - upto[bounds[:-1]])
        return totals


class Pairs:
    """The linked pairs of a corpus: counted rows in a table, and slices of their index."""

    def __init__(self, ids: DataFrame, tokenizers: Tokenizers):
        self.counted = common.saved(_task_counts(ids, tokenizers), "pairs")
        self.distinct = common.saved(self.counted.select("pair").distinct(), "pair-keys")
        self.slices = max(1, -(-self.distinct.count() // SLICE_PAIRS))

    def slice(self, number: int) -> common.Sent:
        """Broadcast counts of one slice, whose size ``SLICE_PAIRS`` bounds on average."""
        mine = _slice_column(self.slices) == number
        keys = self.distinct.where(mine)
        shards = max(1, -(-keys.count() // SHARD_PAIRS))
        spark = self.counted.sparkSession
        index = PairIndex(common.saved(_hashes(keys, shards), "hashes").collect(), shards)
        vectors = _summed_vectors(self.counted.where(mine), common.Sent(spark, index))
        return common.Sent(spark, PairCounts(index, vectors, self.slices, number))

    def table(self) -> DataFrame:
        """``a``, ``b`` and ``n``: how many links hold each pair."""
        return self.counted.groupBy("pair").agg(F.sum("n").alias("n")).select(
            F.expr("shiftright(pair, 32)").alias("a"), F.expr("pair & 4294967295").alias("b"), "n")


def pair_counts(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """How many links of the corpus hold each id pair, as ``a``, ``b``, ``n``."""
    tokenizers = Tokenizers(docs.sparkSession, path_a, path_b)
    return Pairs(encoded(docs, text, tokenizers), tokenizers).table()


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """``docs`` without the text as struct ``row``, with the alignment of A and B.

    ``n_a``, ``n_b``, ``n_groups`` and ``n_links`` count tokens, groups and links; ``n_best`` the
    links whose pair is counted highest among the pairs of its id of B (ties included);
    ``count_sum`` sums the pairs' counts over the links; ``groups`` lists the ids of each group.
    Texts that are null, empty or not spelt exactly by both tokenizers have zeros and ``''``.
    Repeated rows count each; an empty table gives no rows; other columns travel inside the
    struct. A text is aligned whole, in one task, and encoded once: its ids are stored. Up to ``SLICE_PAIRS`` pairs are looked up in
    the second pass; where there are more, it hands on its links, and each further slice of
    pairs is one more pass over these. All pairs of an id of B share a slice.
    """
    tokenizers = Tokenizers(docs.sparkSession, path_a, path_b)
    ids = encoded(docs, text, tokenizers)
    pairs = Pairs(ids, tokenizers)
    kind = ids.schema["row"].dataType
    more = pairs.slices > 1
    fields = [("row", common.arrow_type(kind)), *[(c, pa.int64()) for c in _COUNTS],
              ("groups", pa.string())] + [("links", pa.binary())] * more
    schema = pa.schema(fields)
    ddl = ", ".join([f"row {kind.simpleString()}", *[f"{c} bigint" for c in _COUNTS],
                     "groups string", *["links binary"] * more])
    counts = pairs.slice(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, table = tokenizers.aligner(), counts.get()
        for batch in batches:
            for part, found in _aligned(batch, aligner):
                best, total = table.sums(
                    found.links, np.ones(len(found.links), np.int64), found.link_bounds)
                held = {"links": [_packed(found.links[a:b]) for a, b in zip(
                    found.link_bounds, found.link_bounds[1:])]} if more else {}
                yield pa.RecordBatch.from_pydict(
                    {"row": part.column("row"), "n_a": found.n_a, "n_b": found.n_b,
                     "n_groups": found.n_groups, "n_links": np.diff(found.link_bounds),
                     "n_best": best, "count_sum": total, "groups": found.groups(), **held},
                    schema=schema)

    found = ids.mapInArrow(run, ddl)
    for number in range(1, pairs.slices):
        found = common.saved(found, "aligned").mapInArrow(
            _further(pairs.slice(number), schema), ddl)
    return found.drop("links")


def _packed(links: np.ndarray) -> bytes:
    """Distinct links of a text, then how often each occurs."""
    return np.concatenate(np.unique(links, return_counts=True)).astype(np.int64).tobytes()


def _further(counts: common.Sent, schema: pa.Schema):
    """A mapInArrow function that adds the sums of one more slice of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.get()
        for batch in batches:
            for first, last in common.pieces(common.binary_sizes(batch.column("links"))):
                part = batch.slice(first, last - first)
                held = [np.frombuffer(x, np.int64).reshape(2, -1)
                        for x in part.column("links").to_pylist()]
                bounds = np.concatenate(([0], np.cumsum([h.shape[1] for h in held])))
                links, times = np.concatenate(held, axis=1)
                best, total = table.sums(links, times, bounds)
                columns = dict(zip(part.schema.names, part.columns))
                columns["n_best"] = columns["n_best"].to_numpy() + best
                columns["count_sum"] = columns["count_sum"].to_numpy() + total
                yield pa.RecordBatch.from_pydict(columns, schema=schema)

    return run


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = align(
        common.table(spark, sf_dir, "documents").select("doc_id", "text"),
        public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.select("row.doc_id", *_COUNTS, digest.alias("groups_sha256"))

"""Tokenizer alignment against the tokenizers themselves and plain loops."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from logweir.llm import alignment, common
from logweir.llm.perfect import PerfectHash

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

ODD = [
    None, "", " ", "\n", "Hello, World! it's 42", " lead", "trail ", "a\x00b", "<0x41>", "▁x",
    "<|endoftext|> <s></s><unk>", "日本語 テキスト", "naïve Straße ﬁ", "🙂👩‍👩‍👧", "x" * 3000,
    "same text", "same text", "same text", "é combining", "a\x85b\x1c﻿c", " " * 50,
]


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def random_texts(count):
    rng = random.Random(5)
    alphabet = ["the ", "of ", "and", " ", "\n", "ing", "é", "漢", "🙂", "12", "…", "'s", "q", "Zx"]
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(count)]


def brute(texts, paths):
    """Every figure by loops over byte ranges."""
    a_lib = tokenizers.Tokenizer.from_file(paths[0])
    a_lib.encode_special_tokens = True
    byte_of = {c: b for b, c in enumerate(_chars())}
    b_lib = sentencepiece.SentencePieceProcessor(model_file=paths[1])
    found, counts = [], Counter()
    for text in texts:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        a_bytes = [bytes(byte_of[c] for c in a_lib.id_to_token(i)) for i in a]
        b_bytes = []
        for i in b:
            piece = b_lib.id_to_piece(i)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if b_lib.is_byte(i)
                           else piece.replace("▁", " ").encode())
        body = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != body or b"".join(b_bytes) != body:
            found.append(None)
            continue
        spans = []
        for parts in (a_bytes, b_bytes):
            at, ranges = 0, []
            for p in parts:
                ranges.append((at, at + len(p)))
                at += len(p)
            spans.append(ranges)
        links = [(a[i], b[j]) for i, (s, e) in enumerate(spans[0])
                 for j, (t, f) in enumerate(spans[1]) if s < f and t < e]
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, before = [], 0
        for end in ends:
            one = [str(a[i]) for i, (s, e) in enumerate(spans[0]) if before < e <= end]
            two = [str(b[j]) for j, (s, e) in enumerate(spans[1]) if before < e <= end]
            groups.append(",".join(one) + "|" + ",".join(two))
            before = end
        counts.update(links)
        found.append((len(a), len(b), len(ends), links, ";".join(groups)))
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if f is None else (
            *f[:3], len(f[3]), sum(counts[x] == highest[x[1]] for x in f[3]),
            sum(counts[x] for x in f[3]), f[4]) for f in found], counts


def _chars():
    from logweir.llm.bpe import _byte_chars

    return _byte_chars()


@pytest.mark.parametrize("slices", [1, 3])
def test_alignment_equals_loops(spark, paths, monkeypatch, slices):
    texts = ODD + random_texts(60)
    want, counts = brute(texts, paths)
    if slices > 1:
        monkeypatch.setattr(alignment, "SLICE_PAIRS", -(-len(counts) // slices))
        monkeypatch.setattr(alignment, "SHARD_PAIRS", 50)
        monkeypatch.setattr(alignment, "HELD_PAIRS", 100)
        monkeypatch.setattr(common, "CHUNK_BYTES", 300)
        monkeypatch.setattr(alignment, "FAN", 2)
    docs = spark.createDataFrame(
        [(i, t, "x", i) for i, t in enumerate(texts)],
        "doc_id int, text string, row string, n_a int").repartition(5)
    rows = alignment.align(docs, *paths).collect()
    got = {r.row.doc_id: tuple(r)[1:] for r in rows}
    assert len(rows) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, texts[i]
    pairs = {(r.a, r.b): r.n for r in alignment.pair_counts(docs, *paths).collect()}
    assert pairs == counts


def test_texts_are_encoded_once(spark, paths, monkeypatch, tmp_path):
    """Both passes work on stored ids; the tokenizers see each text a single time."""
    encode = alignment.Aligner.encode

    def counted(self, texts):
        with open(tmp_path / "seen", "a") as seen:
            seen.write(f"{len(texts)}\n")
        return encode(self, texts)

    monkeypatch.setattr(alignment.Aligner, "encode", counted)
    monkeypatch.setattr(common, "once", lambda key, make: make())
    texts = ["one two", None, "", "three four five", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2)
    rows = alignment.align(docs, *paths).collect()
    assert sum(r.n_links > 0 for r in rows) == 3 and len(rows) == 5
    assert sum(map(int, (tmp_path / "seen").read_text().split())) == len(texts)


def test_empty_table(spark, paths):
    docs = spark.createDataFrame([], "doc_id int, text string")
    assert alignment.align(docs, *paths).collect() == []


def test_given_documents(spark, paths):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(40)
    texts = {r.doc_id: r.text[:600] for r in docs.collect()}
    frame = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    want, _ = brute(list(texts.values()), paths)
    got = {r.row.doc_id: tuple(r)[1:] for r in alignment.align(frame, *paths).collect()}
    assert [got[i] for i in texts] == want


def test_splitting_equals_the_library(paths):
    aligner = alignment.Aligner(open(paths[0], encoding="utf-8").read(), open(paths[1], "rb").read())
    library = tokenizers.Tokenizer.from_file(paths[0])
    library.encode_special_tokens = True
    rng = random.Random(8)
    for _ in range(1500):
        text = "".join(chr(rng.choice([rng.randrange(128), rng.randrange(0xD800), 0x20,
                                       rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(15)))
        assert aligner.a.encode_ordinary(text) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("size", [0, 1, 2, 63, 64, 1000, 50000])
def test_perfect_hash(size):
    keys = np.unique(np.random.default_rng(size).integers(0, 2**40, size, dtype=np.uint64))
    hashed = PerfectHash.of(keys)
    assert sorted(hashed.index(keys).tolist()) == list(range(len(keys)))
    other = hashed.index(keys + np.uint64(2**41))
    assert ((other >= -1) & (other < max(len(keys), 1))).all()


def test_unknown_pairs_are_noticed():
    keys = np.arange(100, dtype=np.int64)

    class Row:
        shard = 0
        sizes, words, pairs = b"", b"", b""

    hashed = PerfectHash.of(keys.view(np.uint64))
    ordered = np.empty_like(keys)
    ordered[hashed.index(keys.view(np.uint64))] = keys
    Row.sizes, Row.words, Row.pairs = (x.tobytes() for x in (hashed.sizes, hashed.words, ordered))
    index = alignment.PairIndex([Row], 1)
    assert (index.keys[index.find(keys)] == keys).all()
    with pytest.raises(ValueError):
        index.find(np.array([5, 1000], dtype=np.int64))

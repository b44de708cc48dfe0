import random

import numpy as np
import pytest

from logweir.llm import bpe, common

tokenizers = pytest.importorskip("tokenizers")

TEXTS = [
    None, "", " ", "Hello, World! it's 42 o'clock", "don't   WE'LL\ntab\tend", "naïve ÉTÉ straße ﬁ",
    "<|endoftext|>a<|startoftext|> B<|endoftext|><|endoftext|>", "<|endoftext", "日本語 テキスト",
    "é combining", "ΣΑΣ ΟΔΟΣ", "İstanbul", "¼ ² ½ x²", "a\x1cb\x85c\xa0d e f",
    "🙂🙃 emoji👩‍👩‍👧", "x" * 3000, "@@@###--..''''", "﻿bom", "мир ﷺ", "'s'S's it'd", "a\x00b\x7f",
    "ͅiota ʼn ǅ ß ẞ", "12345 ٣٤ Ⅷ", "̀start", "µm ª º",
]


@pytest.fixture(scope="module")
def library():
    tok = tokenizers.Tokenizer.from_file(bpe.tokenizer_path())
    tok.no_truncation()
    tok.no_padding()
    return tok


def random_texts(count=300):
    rng = random.Random(1)
    alphabet = "abcdefthe  \n'’.,;-_0123456789éèñüßÀÇ<|>🙂漢İΣ́\x85\x1d"
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 120))) for _ in range(count)]


def test_ids_and_text_equal_the_library(spark, library):
    texts = TEXTS + random_texts()
    docs = spark.createDataFrame(
        [(i, t, "x", 1) for i, t in enumerate(texts)],
        "doc_id int, text string, row string, ids int")
    path = bpe.tokenizer_path()
    found = bpe.decode(bpe.encode(docs, path), path).select("row.doc_id", "ids", "text").collect()
    for r in found:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want, texts[r.doc_id]
        assert r.text == library.decode(want, skip_special_tokens=False)
    assert len(found) == len(texts)


def test_cuts_stand_where_no_token_spans(library):
    encoder = bpe.Encoder(open(bpe.tokenizer_path(), encoding="utf-8").read())
    words = ["qzxjkvthe", "the", "qqqq"]
    body = "".join(words).encode()
    ends = [9, 12, 16]
    cuts = encoder.cuts(body, np.array(ends)).tolist()
    assert set(ends) < set(cuts)
    for i in range(1, len(body)):
        apart = chr(body[i - 1]) + chr(body[i]) not in encoder.pairs
        assert (i in cuts) == (apart or i in ends)


def test_one_pass_gives_ids_and_text(spark, library, monkeypatch):
    monkeypatch.setattr(common, "CHUNK_BYTES", 200)
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    monkeypatch.setattr(bpe, "LEARNED", 3)
    texts = TEXTS + random_texts(80) + ["same words again"] * 5 + ["x" * 200_000 + "é" * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    found = bpe.encode(docs, bpe.tokenizer_path(), decoded=True).collect()
    assert len(found) == len(texts)
    for r in found:
        want = library.encode(texts[r.row.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == want
        assert r.text == library.decode(want, skip_special_tokens=False)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    path = bpe.tokenizer_path()
    assert bpe.decode(bpe.encode(docs, path), path).collect() == []


def test_digests(spark, library):
    import hashlib

    docs = spark.createDataFrame([(1, "Some text here.")], "doc_id bigint, text string")
    row = bpe.digests(docs, bpe.tokenizer_path()).first()
    ids = library.encode("Some text here.", add_special_tokens=False).ids
    assert row.n_tokens == len(ids)
    assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()

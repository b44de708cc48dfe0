"""The pipeline against its operators and brute force."""

from collections import Counter

import corpus_pipeline
from logweir.llm import bpe, registry

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    tokenizers = __import__("tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        from logweir.llm.common import saved

        frames.append(saved(stage(spark, frames[-1], SF), "test"))
    for frame in frames[:-1]:
        assert frame.columns == docs.columns
    given, languages, lines, groups, mixed, tokens = ([r for r in f.collect()] for f in frames)
    # Everything with a letter is claimed by a language here.
    lettered = {r.doc_id for r in given if any(map(str.isalpha, r.text or ""))}
    assert {r.doc_id for r in languages} <= lettered
    assert len(languages) >= 0.98 * len(lettered)
    assert {r.doc_id for r in lines} == {r.doc_id for r in languages}
    keys = Counter(k for r in lines for k in {
        x.strip(" \t\n\x0b\x0c\r").lower() for x in r.text.split("\n")} if len(k) >= 10)
    assert max(keys.values()) == 1
    assert {r.doc_id for r in groups} <= {r.doc_id for r in lines}
    assert all(r.n_chars == len(r.text) for r in lines)
    times = Counter(r.doc_id for r in mixed)
    assert max(times.values()) <= 3 and set(times) <= {r.doc_id for r in groups}
    assert Counter(r.doc_id for r in tokens) == times
    library = tokenizers.Tokenizer.from_file(bpe.tokenizer_path())
    text_of = {r.doc_id: r.text for r in mixed}
    for r in tokens[:60]:
        assert r.ids == library.encode(text_of[r.doc_id], add_special_tokens=False).ids


def test_stages_take_odd_tables(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0),
            (2, "the cat and the dog", None, None, None), (None, "the cat and the dog", "en", "b", 3)]
    docs = spark.createDataFrame(
        [(*r, "z") for r in rows],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, row string")
    for _, stage in corpus_pipeline.STAGES:
        for frame in (docs, docs.limit(0)):
            stage(spark, frame, SF).collect()


def test_every_operator_is_registered():
    names = registry.registered()
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 14))
    assert set(registry.statements()) <= set(names)

"""Fill-in-middle against the plain pattern."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweir.llm import common, middle

TEXTS = [
    None, "", "a", "abc", "abc def", "12 ab!cd", "é", "日本語abc", "🙂x🙂", "a" * 700, "[`{@", "AZaz",
    "x <P> y", "<S>", "q<M>", "<P", "S>abc", "ends <", "P>>", "\x00\x80\xff", "\n\n a\tb\r\n",
    "12345678", "abcdefgh", "abcdefg1", "abcdefgh" * 9, "é" * 40, "漢字" * 33 + "abc",
] + [f"word{i} and é{i} <S more{i}> text 漢{i}🙂" * (i % 9) for i in range(120)]


def plain(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_transformation_equals_the_pattern(spark, monkeypatch):
    monkeypatch.setattr(common, "CHUNK_BYTES", 500)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (7, "twice"), (7, "twice"), (-3, "ab c")]
    docs = spark.createDataFrame(
        [(*r, "x", i) for i, r in enumerate(rows)], "doc_id bigint, text string, row string, n int")
    found = middle.fill_in_middle(docs)
    got = found.select(
        "row.n", F.struct("n", "form", "prefix_chars", "middle_chars", "output").alias("made"),
        middle.restored(F.col("form"), F.col("output")).alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        doc_id, text = rows[r.n]
        assert tuple(r.made) == plain(doc_id, text), text
        assert r.back == (text or "")
    assert {r.made.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    assert middle.fill_in_middle(docs).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(
    st.sampled_from("abzAZ@[`{ é漢🙂\x00"), st.characters(exclude_categories=["Cs"])), max_size=40),
    min_size=1, max_size=5), st.data())
def test_cuts(texts, data):
    import numpy as np

    units = [re.findall("[A-Za-z]+|[^A-Za-z]", t) for t in texts]
    found = middle.Units([t.encode() for t in texts])
    assert found.counts.tolist() == [len(u) for u in units]
    k = [data.draw(st.integers(0, len(u))) for u in units]
    size, chars = found.cut(np.array(k))
    heads = ["".join(u[:n]) for u, n in zip(units, k)]
    assert chars.tolist() == [len(h) for h in heads]
    assert size.tolist() == [len(h.encode()) for h in heads]


def test_a_very_long_text(spark):
    text = "word é " * 300_000
    docs = spark.createDataFrame([(11, text)], "doc_id bigint, text string")
    r = middle.fill_in_middle(docs).first()
    assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(11, text)


@pytest.mark.parametrize("form,output,text", [
    ("plain", "<P>", "<P>"), ("psm", "<P><S><M>", ""), ("psm", "<P>a<<S>S>b<M>c", "a<cS>b"),
    ("spm", "<S>P>x<P>y<S<M>M>z", "y<SM>zP>x")])
def test_restored(spark, form, output, text):
    row = spark.createDataFrame([(form, output)], "form string, output string").select(
        middle.restored(F.col("form"), F.col("output")).alias("t")).first()
    assert row.t == text

"""Sketches and edits against plain loops."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from logweir.llm import fingerprints


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def hashes(text):
    w = words(text)
    return {hashlib.md5(" ".join(w[i : i + 5]).encode()).hexdigest()[:16]
            for i in range(max(len(w) - 4, min(len(w), 1)))}


def kept(every):
    small = sorted(h for h in every if h < fingerprints.BELOW)
    return small if len(small) >= fingerprints.LEAST else sorted(every)[: fingerprints.LEAST]


def near(a, b):
    if a == b:
        return 1.0
    def upto(s):
        return "g" if len(s) < fingerprints.LEAST else max(fingerprints.BELOW, s[-1])
    limit = min(upto(a), upto(b))
    a, b = ({h for h in s if h <= limit} for s in (a, b))
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def corpus(count):
    rng = random.Random(2)
    pool = [f"w{i}" for i in range(400)] + ["é漢", "🙂"]
    texts = [None, "", " \n ", "one", "one two three four", " lead and trail "]
    texts += [" ".join(rng.choices(pool, k=rng.choice([3, 30, 60, 900]))) for _ in range(count)]
    return texts + texts[-20:]


@pytest.mark.parametrize("parts", [1, 7])
def test_edits_equal_loops(spark, parts):
    texts = corpus(70)
    ids = [3 * i - 40 for i in range(len(texts))]
    ids[5] = None
    random.Random(4).shuffle(ids)
    rows = [(i, t, "x", "y") for i, t in zip(ids, texts)]
    docs = spark.createDataFrame(
        rows, "doc_id bigint, text string, body string, place string").repartition(parts)
    got = fingerprints.edits(docs).select("row.doc_id", "n_chars", "edited", "sketch",
                                          "edited_sketch", "near_edited", "near_next").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = {}
    for (i, t, *_), (_, after, *_) in zip(order, order[1:] + order[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = (kept(hashes(x)) for x in (t, edited, after))
        want[i] = (i, len(t), edited, a, b, near(a, b), near(a, c))
    assert len(got) == len(want)
    for r in got:
        assert tuple(r) == want[r.doc_id]


def test_rows_of_one_id_follow_each_other(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c d"), (2, "e f"), (None, "g"), (None, "g")] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.row.doc_id or 0, r.edited) for r in fingerprints.edits(docs).collect())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    want = sorted((i or 0, t[: len(t) - len(t) // 2] + u[: len(t) // 2])
                  for (i, t), (_, u) in zip(order, order[1:] + order[:1]))
    assert got == want


def test_one_row_and_none(spark):
    kind = "doc_id bigint, text string"
    row = fingerprints.edits(spark.createDataFrame([(1, "abcd efgh")], kind)).first()
    assert row.edited == "abcd abcd" and row.near_next == 1.0
    assert fingerprints.edits(spark.createDataFrame([], kind)).collect() == []


def test_no_python_in_the_plan(spark, capsys):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a b c d e f").alias("text"))
    fingerprints.edits(docs).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_containment_of_unequal_texts(spark):
    rng = random.Random(9)
    long = [f"x{rng.randrange(10**6)}" for _ in range(20000)]
    short = long[5000:7000]
    half = short[:1000] + [f"y{i}" for i in range(1000)]
    docs = spark.createDataFrame(
        [(1, " ".join(long)), (2, " ".join(short)), (3, " ".join(half))], "id int, text string")
    s = {r.id: r.sketch for r in fingerprints.sketch(docs).collect()}
    frame = spark.createDataFrame([(s[1], s[2], s[3])], "a array<string>, b array<string>, c array<string>")
    one, other, apart = frame.select(
        fingerprints.likeness(F.col("a"), F.col("b")), fingerprints.likeness(F.col("a"), F.col("c")),
        fingerprints.likeness(F.col("c"), F.col("b"))).first()
    assert one == 1.0 and abs(other - 0.5) < 0.1 and abs(apart - 0.5) < 0.1


def test_merged_sketches_are_those_of_the_joined_sets(spark):
    texts = [t for t in corpus(30) if t]
    docs = spark.createDataFrame([(i % 4, t) for i, t in enumerate(texts)], "g int, text string")
    got = {r.g: r.sketch for r in fingerprints.merged(fingerprints.sketch(docs), ["g"]).collect()}
    for g in range(4):
        assert got[g] == kept(set().union(*[hashes(t) for i, t in enumerate(texts) if i % 4 == g]))

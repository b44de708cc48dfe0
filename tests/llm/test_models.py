"""Language, urls, pages and neighbours."""

import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logweir.llm import html, language, neighbours, urls

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.identify(docs).select(
        "row.doc_id", "row.lang", "lang_pred", "score").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    right = sum(r.lang == r.lang_pred for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark):
    rows = [(i, f"the cat and the dog {i}", "en", "a") for i in range(30)]
    rows += [(100 + i, f"der Hund und die Katze {i}", "de", "a") for i in range(30)]
    rows += [(200, None, "en", "a"), (201, "", None, "a"), (202, "12 34 !?", "de", "a"),
             (203, "die Katze und der Hund", None, None), (None, "the dog", None, "a"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, row string")
    got = {}
    for r in language.identify(docs).select("row.doc_id", "lang_pred", "score").collect():
        got[r.doc_id] = r
    assert [got[i].lang_pred for i in (200, 201, 202)] == ["und"] * 3
    assert got[203].lang_pred == "de" and got[None].lang_pred == "en"
    assert language.identify(docs.limit(0)).collect() == []
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(nothing).collect()} == {"und"}


def test_label_of_a_held_out_document_is_not_used(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    swapped = docs.withColumn("lang", F.when(
        F.expr("crc32(cast(doc_id as string)) % 4 = 2"), F.lit("zz")).otherwise(F.col("lang")))
    a = language.identify(docs).select("row.doc_id", "lang_pred", "score").collect()
    b = language.identify(swapped).select("row.doc_id", "lang_pred", "score").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


URLS = [
    "https://www.Example.org/es/1?x", "http://example.org/en/15", "https://a.b.com/fr/2#t",
    "https://b.com/de/", "https://net.example.net/de/2", "http://x.org", "no scheme", None, "://",
    "ftp://h.example.org/en/2/a?b#c", "https://org/", "https://borg/es/", "http://com/fr", "",
]


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    cut = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return host.lower(), rest[:cut]


def test_url_rules(spark):
    pages = spark.createDataFrame(
        [(i, u, "<p>the cat</p>", "z") for i, u in enumerate(URLS)],
        "page_id bigint, url string, html string, host string")
    got = {r.page_id: r for r in urls.judge_urls(pages).collect()}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = brute_url(url)
        fits = [(len(t), t, k) for k, t in urls.RULES
                if (host == t.split("/")[0] or host.endswith("." + t.split("/")[0]))
                and path.startswith(t[t.index("/"):])]
        rule = max(fits)[1:] if fits else (None, got[i].verdict)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *rule)
    assert urls.judge_urls(pages.limit(0)).collect() == []


def test_words_of_a_name():
    counts = {"the": 50, "red": 20, "there": 5, "hat": 20, "at": 30, "d": 1}
    segmenter = urls.Segmenter(counts)
    assert segmenter.split("theredhat") == ["the", "red", "hat"]
    assert segmenter.split("theqq") == ["the", "qq"] and segmenter.split("") == []
    # Brute force over all cuts.
    rng = random.Random(2)
    for _ in range(50):
        name = "".join(rng.choices("thredaq", k=rng.randint(1, 9)))

        def cost(words):
            return sum(segmenter.costs.get(w, segmenter.unseen + len(w) * np.log(10)) for w in words)

        best = min(
            cost([name[a:b] for a, b in zip([0, *cut], [*cut, len(name)])])
            for mask in range(1 << (len(name) - 1))
            for cut in [[i + 1 for i in range(len(name) - 1) if mask >> i & 1]])
        assert cost(segmenter.split(name)) == pytest.approx(best)


def test_bayes_learns_from_the_rules(spark):
    rows = [(i, f"https://goodcat.org/x/{i}", "good cat bad dog") for i in range(40)]
    rows += [(100 + i, f"https://baddog.com/de/{i}", "good cat bad dog") for i in range(40)]
    rows += [(200, "https://good.net/x/1", None), (201, "https://bad.net/de/1", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.verdict for r in urls.judge_urls(pages).collect()}
    assert got[200] == "allow" and got[201] == "block"


def invented(rng):
    """Makes texts of some languages, each of syllables of its own."""
    letters = list("abcdefghijklmnopqrstuvwxyz")
    syllables = [["".join(rng.choice(letters, 2)) for _ in range(10)] for _ in range(20)]

    def text(k, words):
        return " ".join("".join(rng.choice(syllables[k], 3)) for _ in range(words))

    return text


@pytest.mark.parametrize("count", [2, 4, 20])
def test_rejection_does_not_move_with_the_languages(spark, count):
    """Clean texts stay, however few their language has; a strange script goes."""
    rng = np.random.default_rng(count)
    text = invented(rng)
    rows = [(text(k, int(rng.integers(1, 40))), f"l{k:02}")
            for k in range(count) for _ in range(150 if k == 0 else 30)]
    rows += [(text(k, 1), f"l{k:02}") for k in range(count)]
    rows += [("\u0416\u0443\u043a " * n, None) for n in (1, 5, 200)]
    docs = spark.createDataFrame(
        [(i, t, l) for i, (t, l) in enumerate(rows)], "doc_id bigint, text string, lang string")
    kept = corpus_pipeline.language_id(spark, docs, SF).collect()
    assert {r.doc_id for r in kept} == set(range(len(rows) - 3))
    assert sum(r.lang == rows[r.doc_id][1] for r in kept) >= 0.98 * len(kept)


def test_weights_are_the_unfolded_landmarks(spark):
    """The folded model scores as kernels with all landmarks do, on exact n-gram sets."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sample = language.labelled_sample(docs.select("doc_id", "text", "lang")).collect()
    sample = sorted((r for r in sample if any(map(str.isalpha, r.text))),
                    key=lambda r: (r.lang, r.place))

    def grams(text):
        low = text.lower()
        return {low[i : i + n] for n in (1, 2, 3) for i in range(len(low) - n + 1)}

    sets = [grams(r.text) for r in sample]
    marks = [s for s, r in zip(sets, sample) if r.mark]

    def kernels(a):
        return np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in marks] for x in a])

    names, factors, base = language.regression(
        [r.lang for r in sample], kernels(sets), kernels(marks))
    texts = {r.doc_id: r.text for r in docs.where("doc_id % 20 = 0").collect() if r.text}
    every = set().union(*marks)
    checked = 0
    for r in language.identify(docs).select("row.doc_id", "lang_pred", "score", "known").collect():
        if r.doc_id in texts and any(map(str.isalpha, texts[r.doc_id])):
            own = grams(texts[r.doc_id])
            values = (kernels([own]) @ factors + base)[0]
            assert r.score == pytest.approx(min(max((values.max() + 1) / 2, 0), 1), abs=1e-3)
            assert values[names.index(r.lang_pred)] == pytest.approx(values.max(), abs=2e-3)
            assert r.known == pytest.approx(len(own & every) / len(own), abs=1e-6)
            checked += 1
    assert checked > 40


def test_grams_with_taken_slots():
    rng = np.random.default_rng(2)
    codes = np.unique(rng.integers(1, 1 << 62, 20_000).astype(np.uint64))
    grams = language.Grams(codes)
    assert len(grams.rest)
    asked = np.concatenate((codes[::3], rng.integers(1, 1 << 62, 5_000).astype(np.uint64)))
    places, unknown = grams.split(asked)
    assert sorted(grams.codes[places]) == sorted(codes[::3])
    assert len(unknown) == 5_000


def test_language_of_long_texts_and_repeated_rows(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL")
    want = {r.row.doc_id: (r.lang_pred, r.score) for r in language.identify(docs).collect()}
    monkeypatch.setattr(language, "PIECE", 100)
    found = language.identify(docs.unionByName(docs)).collect()
    assert len(found) == 2 * docs.count()
    model = {}
    for r in found:
        assert model.setdefault(r.row.doc_id, (r.lang_pred, r.score)) == (r.lang_pred, r.score)
    assert sum(model[k][0] == want[k][0] for k in want) >= 0.99 * len(want)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>"</p>"</script></head>
<body><header>Site</header><nav><ul><li><a href="/a">A</a></ul></nav><div class="ad">Buy</div>
<article><h1>Head &amp; line</h1><p><b>One  two&nbsp;three<br><p>Four &lt;five&gt; &amp six</p>
<form><input>Name</form><div class="comments"><p>Nice</p></div><ul><li>x<li>y</ul></article>
<aside>More</aside><footer>&copy; me</footer></body></html>"""


def extracted(spark, pages, hosts=None):
    """Main texts through Spark; pages stand on one host unless hosts are given."""
    hosts = hosts or ["h"] * len(pages)
    frame = spark.createDataFrame(
        [(i, f"http://{h}/{i}", p) for i, (p, h) in enumerate(zip(pages, hosts))],
        "page_id bigint, url string, html string")
    return [r.text for r in html.main_text(frame).orderBy("page_id").collect()]


def article(page):
    return "\n".join(text for text, mark in html.blocks(page) if mark == html.MARKED)


def test_main_text(spark):
    want = "Head & line\nOne two three\nFour <five> & six\nx\ny"
    cut = PAGE[: PAGE.index("<aside>")]
    pages = [PAGE, cut, "", "<p>", "plain <b>text</b>"]
    assert extracted(spark, pages) == [want, want, "", "", "plain text"]


def test_classes_that_do_not_empty_an_article():
    for opening in ('<article class="post has-sidebar">', '<article class="entry no-comments">',
                    '<main class="content no-comments">', '<div class="widget"><article>',
                    '<div id="page-with-nav"><article>', '<article id="related">'):
        assert article(f"<body>{opening}<p>One</p></body>") == "One"
    inside = "<article><h2 id='related-work'>Two</h2><p class='notice'>Three</p>{}</article>"
    for chrome in ('<div class="cookie-banner">x</div>', '<div class="site comments-area">x</div>',
                   '<div class="comments"><article>x</article></div>', "<aside>x</aside>",
                   '<article class="comment">x</article>', '<section id="newsletter">x</section>'):
        assert article(inside.format(chrome)) == "Two\nThree"
    assert article("<div role='navigation'><article>x</article></div>") == ""


def test_end_tags_without_a_start_are_cheap():
    started = time.perf_counter()
    assert html.blocks("<i><b></u>" * 100_000 + "text") == [("text", html.OPEN)]
    assert html.blocks("</div>" * 100_000 + "text") == [("text", html.OPEN)]
    assert time.perf_counter() - started < 3


MENU = "home news sports weather contact imprint search login about"


def own_words(i, count=30):
    return " ".join(f"u{i}x{k}" for k in range(count))


def test_shared_runs_of_unmarked_pages_go(spark):
    pages = [f"<div>{MENU}</div><div>story {own_words(i)}</div>" for i in range(4)]
    # Half menu, half own words in one block: only the menu goes.
    pages.append(f"<div>{MENU} but {own_words(9, 5)}</div><div>{own_words(10)}</div>")
    texts = extracted(spark, pages)
    assert texts[:4] == [f"story {own_words(i)}" for i in range(4)]
    assert texts[4] == f"but {own_words(9, 5)}\n{own_words(10)}"
    # Other hosts are no evidence, nor are equal pages and near copies.
    assert extracted(spark, pages[:2], ["a", "b"])[0].startswith(MENU)
    assert extracted(spark, [pages[0]] * 2)[0].startswith(MENU)
    long = [f"<p>{own_words(7, 100)}</p><p>{word} {own_words(8, 100)}</p>" for word in "ab"]
    assert extracted(spark, long) == [
        f"{own_words(7, 100)}\n{word} {own_words(8, 100)}" for word in "ab"]


def test_shared_runs_of_marked_pages_stay(spark):
    page = f"<div>{MENU}</div><article>{own_words(1)}</article><p>%d</p>"
    pages = [page % 1, page % 2, f"<div>{MENU}</div><div>{own_words(2)}</div>",
             f"<article>{own_words(3)}</article><div>{MENU}</div>"]
    assert extracted(spark, pages) == [own_words(1), own_words(1), own_words(2), own_words(3)]


def test_two_pages_of_a_large_host_share_a_run(spark, monkeypatch):
    """The pages lie in different pieces, and the answer is that of one piece."""
    pages = [f"<p>{own_words(i, 60)}</p>" for i in range(200)]
    pages[3] += f"<p>{MENU}</p>"
    pages[190] += f"<p>{MENU}</p>"
    want = [own_words(i, 60) for i in range(200)]
    assert extracted(spark, pages) == want
    monkeypatch.setattr(html, "PIECE_BYTES", 500)
    assert extracted(spark, pages) == want


def test_sorted_runs_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(30):
        pages = np.sort(rng.integers(0, 4, 120))
        tokens = rng.integers(0, 3, 120)
        want = {}
        for i in range(113):
            if pages[i] == pages[i + 7]:
                want.setdefault(tuple(tokens[i : i + 8].tolist()), set()).add(i)
        at, new = html.sorted_runs(tokens, pages)
        got = {tuple(tokens[g[0] : g[0] + 8].tolist()): set(g.tolist())
               for g in np.split(at, new[1:]) if len(g)}
        assert got == want


def test_pages_against_brute_force(spark):
    rng = np.random.default_rng(6)
    words = [[f"w{x}" for x in rng.integers(0, 3, 60)] + own_words(i, 60).split()
             for i in range(12)]
    holders = {}
    for i, w in enumerate(words):
        for k in range(len(w) - 7):
            holders.setdefault(tuple(w[k : k + 8]), set()).add(i)
    want = []
    for w in words:
        gone = {k + j for k in range(len(w) - 7) if len(holders[tuple(w[k : k + 8])]) > 1
                for j in range(8)}
        want.append(" ".join(x for k, x in enumerate(w) if k not in gone))
    assert any(len(w.split()) < 120 for w in want)
    assert extracted(spark, [f"<p>{' '.join(w)}</p>" for w in words]) == want


def test_frequent_words_are_cut_exactly(spark, monkeypatch):
    monkeypatch.setattr(urls, "MODEL_WORDS", 40)
    rng = np.random.default_rng(3)
    names = ["".join(rng.choice(list("abcdef"), 3)) for _ in range(3000)]
    texts = [" ".join(names[i : i + 50]) for i in range(0, 3000, 50)]
    pages = spark.createDataFrame([(t,) for t in texts], "html string")
    counts = Counter(names)
    want = dict(sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:40])
    assert urls.frequent_words(pages) == want
    assert urls.frequent_words(pages.limit(0)) == {}


def test_pages_table(spark):
    rows = [(1, "http://a/x", PAGE, "z"), (2, None, None, "z"), (None, "http://a/y", "", None),
            (1, "http://a/x", PAGE, "z")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, host string")
    got = [r.text for r in html.main_text(pages).orderBy("page_id").collect()]
    assert len(got) == 4 and got.count("") == 2 and len(set(got)) == 2
    assert html.main_text(pages.limit(0)).collect() == []


def brute_nearest(rows, queries):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None for x in v)]
    good = [(i, v) for i, v in good if np.isfinite(v).all() and v.any()]
    want = {}
    for q, a in good:
        if q in queries:
            scored = [(-float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), i)
                      for i, b in good if i != q]
            want[q] = [(i, -s) for s, i in sorted(scored)[:5]]
    return want


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.5 * rng.standard_normal(16)).astype(np.float32).tolist())
            for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(30)]
    rows += [(3000, None), (3050, [0.0] * 16), (3100, [1.0] * 15 + [float("nan")]),
             (3150, [None] + [1.0] * 15), (3200, [1.0]), (3250, [])]
    frame = spark.createDataFrame(
        [(*r, "z") for r in rows], "vec_id bigint, embedding array<float>, node string")
    got = {}
    for r in neighbours.nearest(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_nearest([r for r in rows if r[0] < 3000], {i for i in range(0, 3000, 50)})
    assert got.keys() == want.keys()
    assert got[0] == want[0] and got[2000] == want[2000]
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    assert neighbours.nearest(frame.limit(0), F.lit(True)).collect() == []


def test_few_vectors(spark):
    frame = spark.createDataFrame(
        [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    got = neighbours.nearest(frame, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r["rank"], r.vec_id) for r in got] == [(1, 2), (2, 1)]


def test_recall_on_the_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    want = brute_nearest(rows, {i for i, _ in rows if i % 50 == 0})
    got = {}
    for r in neighbours.nearest(frame, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & {i for i, _ in w}) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_recall_does_not_fall_with_the_table(spark):
    """Answers come from the walks alone; the scan that fits their pool is exact."""
    rng = np.random.default_rng(21)
    for count, step in ((5_000, 50), (20_000, 200)):
        vectors = rng.standard_normal((count, 64))
        units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        asked = np.arange(0, count, step)
        sims = units[asked] @ units.T
        sims[np.arange(len(asked)), asked] = -2
        want = {int(q): set(np.argsort(-s)[:5].tolist()) for q, s in zip(asked, sims)}
        frame = spark.createDataFrame(pa.table({
            "vec_id": np.arange(count), "embedding": vectors.tolist()})).repartition(8)
        nodes = neighbours.usable_vectors(
            frame.select("vec_id", F.col("embedding").alias("v"))).select(
            F.col("vec_id").alias("node"), F.col("vec_id").alias("least"), "vec")
        queries = nodes.where(F.col("node") % step == 0).select(F.col("node").alias("query"), "vec")
        found = {}
        for r in neighbours.scan(nodes, queries, 6).collect():
            found.setdefault(r["query"], set()).add(r["id"])
        assert {q: ids - {q} for q, ids in found.items()} == want
        got = {}
        for r in neighbours.nearest(frame, F.col("vec_id") % step == 0).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert all(len(ids) == 5 for ids in got.values()) and got.keys() == want.keys()
        assert sum(len(got[q] & ids) for q, ids in want.items()) >= 0.9 * 5 * len(want)


def test_neighbours_among_near_copies(spark):
    """Copies whose cosines differ from the seventh digit on."""
    rng = np.random.default_rng(31)
    base = rng.standard_normal(64)
    rows = [(i, (base + 0.001 * rng.standard_normal(64)).tolist()) for i in range(1000)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in neighbours.nearest(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute_nearest(rows, set(range(0, 1000, 50)))
    assert got.keys() == want.keys()
    hits = sum(len(set(got[q]) & {i for i, _ in found}) for q, found in want.items())
    assert hits >= 0.9 * 5 * len(want)


def test_neighbours_of_a_vector_alone_in_its_leaves(spark):
    rng = np.random.default_rng(32)
    base = rng.standard_normal(64)
    rows = [(i, (base + 0.01 * rng.standard_normal(64)).tolist()) for i in range(1000)]
    rows.append((1000, (-base).tolist()))
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = [r.vec_id for r in neighbours.nearest(frame, F.col("vec_id") == 1000).orderBy("rank").collect()]
    assert got == [i for i, _ in brute_nearest(rows, {1000})[1000]]
    nodes = spark.createDataFrame(
        [(i, bytearray(neighbours._short(np.array([v]))[0].tobytes())) for i, v in rows],
        "node bigint, short binary")
    listed = neighbours.first_lists(nodes, len(rows), 64).where("node = 1000")
    assert listed.count() > 0


def _graph_nodes(spark, vectors):
    rows = [(i, i, bytearray(v.astype(np.float64).tobytes()),
             bytearray(neighbours._short(v[None, :])[0].tobytes())) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "node bigint, least bigint, vec binary, short binary")


def test_lists_are_widened_until_a_sample_of_the_queries_is_found(spark):
    rng = np.random.default_rng(5)
    nodes = _graph_nodes(spark, rng.standard_normal((1500, 32)))
    queries = nodes.where("node % 10 = 0").select(F.col("node").alias("query"), "vec")
    graph, listed, recall = neighbours.fitted_graph(nodes, queries, 1500, 32, 6, listed=6)
    assert listed > 6 and recall >= neighbours.RECALL
    assert {len(r.ids) // 8 for r in graph.select("ids").collect()} == {listed}


def test_what_a_query_looks_at_does_not_grow_with_the_table(spark):
    rng = np.random.default_rng(6)
    for count in (600, 2400):
        nodes = _graph_nodes(spark, rng.standard_normal((count, 16)))
        queries = nodes.where("node % 50 = 0").select(F.col("node").alias("query"))
        graph = neighbours.build_graph(nodes, count, 16, 12)
        looked = neighbours.scored_lists(graph, queries, nodes)
        assert looked.count() == 13 * queries.count()
    # Vectors brought to centres: at most 96 a node, however large the table.
    for count in (10**4, 10**6, 10**9):
        bins = neighbours.centre_bins(count, 64, 6)
        brought = bins * min(count, 96 * -(-count // bins))
        assert brought <= 97 * count


def test_answers_come_from_walks_beyond_the_list(spark, monkeypatch):
    """Lists that look one way along a curve: half of the nearest are on the other side."""
    count, listed = 60, 8
    angles = np.cumsum(np.random.default_rng(9).uniform(0.01, 0.03, count))
    vectors = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    want = brute_nearest(rows, set(range(0, count, 10)))

    def one_way(nodes, queries, count, size, keep):
        empty = nodes.select("node", "short", "least").toArrow().sort_by("least").to_pylist()
        lists = []
        for at, row in enumerate(empty):
            near = empty[at + 1 : at + 1 + listed]
            own = np.frombuffer(row["short"], np.float32)
            sims = [-((np.frombuffer(n["short"], np.float32) - own) ** 2).sum() for n in near]
            lists.append((
                row["node"], bytearray(row["short"]),
                bytearray(np.array([n["node"] for n in near], np.int64).tobytes()),
                bytearray(np.array(sims, np.float32).tobytes()), bytearray(len(near)), -9.0, 0))
        return spark.createDataFrame(lists, neighbours._GRAPH_DDL), listed, 1.0

    monkeypatch.setattr(neighbours, "fitted_graph", one_way)
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in neighbours.nearest(frame, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: [i for i, _ in found] for q, found in want.items()}


def test_links_travel_as_arrays_not_as_rows(spark):
    rng = np.random.default_rng(7)
    nodes = _graph_nodes(spark, rng.standard_normal((1200, 16)))
    graph = neighbours.build_graph(nodes, 1200, 16, 24)
    bins = neighbours.centre_bins(1200, 24, 4)
    found = neighbours.descend(neighbours.widened(graph), bins, 24)
    assert 0 < found.count() <= bins * bins
    links = neighbours.around_nodes(graph, bins, 24, False).toArrow().to_pylist()
    assert len(links) == bins
    around = {}
    for row in links:
        members = iter(np.frombuffer(row["members"], np.int64).tolist())
        for node, size in zip(np.frombuffer(row["ids"], np.int64).tolist(),
                              np.frombuffer(row["sizes"], np.int32).tolist()):
            around[node] = [next(members) for _ in range(size)]
    back = {}
    for r in graph.select("node", "ids").collect():
        ids = np.frombuffer(r.ids, np.int64).tolist()
        assert set(ids) <= set(around[r.node])
        for i in ids:
            back.setdefault(i, set()).add(r.node)
        around[r.node] = set(around[r.node]) - set(ids), set(ids)
    for node, (others, ids) in around.items():
        assert others <= back.get(node, set())
        assert len(others) <= 12 <= len(others | (ids & back.get(node, set()))) or (
            back.get(node, set()) <= others | ids)

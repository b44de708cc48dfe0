"""Main text of web pages (operator 9).

Token streams of a host's pages stand behind each other in pieces of bounded size. A piece's suffix
array groups its runs, whose hashes meet those of the host's other pieces in one exchange; runs that
distinct pages of the host hold are boilerplate, and unmarked pages lose the words they cover. What
the page itself marks as menu, advert, footer and the like goes as well.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, jaccard

# Open text of a piece: what a task holds with its suffix array. Results do not depend on it.
PIECE_BYTES = 1024 * 1024
# Tokens of a run that pages must share (a power of two).
RUN = 8

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[a-z!?/][^>]*(?:>|\Z)"
    r"|([^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"([a-z:-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.IGNORECASE)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol "
    "option p pre section summary table tbody td tfoot th thead tr ul".split())
_OPTIONAL_END = frozenset("p li dt dd td th tr option thead tbody tfoot colgroup".split())
_CHROME = frozenset(
    "nav footer aside form head button select menu dialog object fieldset".split())
_CHROME_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disclaimer footer login menu modal nav navbar navigation newsletter notice "
    "pagination popup promo related respond share sharing sidebar signup social sponsor sponsored "
    "subscribe toolbar widget".split())
_HEAD_WORDS = frozenset("header masthead topbar".split())
# Words that may stand beside such a word in one class or id without giving it another meaning.
_NEUTRAL_WORDS = frozenset(
    "area bar block bottom box container desktop fixed global group inner item items left links "
    "list main mobile outer page primary right secondary section site sticky top wrap wrapper"
    .split())
_CHROME_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form navigation search".split())
# Elements that no class or id makes chrome.
_TEXT = frozenset("body html h1 h2 h3 h4 h5 h6 p".split())
_WORDS = re.compile(r"[a-z]+|\d+")

MARKED, OPEN = 1, 0
_PLAIN, _ARTICLE, _NAMED, _CHROME_KIND = 0, 1, 2, 3


def _says(value: str, words: frozenset) -> bool:
    """Whether one name of a class or id consists of such words and neutral ones."""
    for name in value.split():
        parts = {w for w in _WORDS.findall(name) if not w.isdigit()}
        if parts & words and parts <= words | _NEUTRAL_WORDS:
            return True
    return False


def _kind(name: str, attributes: str, inside: bool) -> int:
    """What an element is: chrome, chrome by its class or id only, an article, or plain;
    ``inside`` an article."""
    names, role, hidden, main = "", "", False, False
    if attributes:
        for match in _ATTRIBUTE.finditer(attributes):
            key, value = match[1].lower(), (match[2] or "").strip("\"'").lower()
            if key in ("class", "id"):
                names += " " + value
            elif key == "role":
                role = value
            elif key == "hidden":
                hidden = True
            elif key == "itemprop" and value == "articlebody":
                main = True
    if name in ("body", "html"):
        return _PLAIN
    if hidden or name in _CHROME or role in _CHROME_ROLES or (name == "header" and not inside):
        return _CHROME_KIND
    if main or name in ("article", "main") or role in ("main", "article"):
        return _NAMED if {"comment", "comments"} & set(names.split()) else _ARTICLE
    if name not in _TEXT and names and (
            _says(names, _CHROME_WORDS) or (not inside and _says(names, _HEAD_WORDS))):
        return _NAMED
    return _PLAIN


def blocks(page: str) -> list[tuple[str, int]]:
    """Visible blocks outside chrome in page order, with 1 where they stand in an article.

    An article inside an element that is chrome by its class or id alone is visible, unless that
    element itself stands in an article (readers' comments are often articles).
    """
    found: list[tuple[str, int]] = []
    # Each open element with the state around it: how it is hidden, and whether in an article.
    stack: list[tuple[str, int, bool]] = []
    opened: Counter[str] = Counter()
    chrome, article = _PLAIN, False
    text: list[str] = []

    def end() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                found.append((line, MARKED if article else OPEN))
            text.clear()

    for match in _TOKEN.finditer(page):
        raw = match[5]
        if raw is not None:
            if not chrome:
                text.append(raw)
            continue
        name = match[3]
        if name is None:
            continue
        name = name.lower()
        if name in _BLOCK:
            end()
        if match[2]:
            if opened[name]:
                while True:
                    open_name, chrome, article = stack.pop()
                    opened[open_name] -= 1
                    if open_name == name:
                        break
        elif name in _VOID:
            if not chrome:
                text.append(" ")
        else:
            kind = _kind(name, match[4], article)
            # Elements whose end tag may be left out are followed only where they matter.
            if kind or name not in _OPTIONAL_END:
                stack.append((name, chrome, article))
                opened[name] += 1
                if kind >= _NAMED:
                    chrome = max(chrome, kind)
                elif kind == _ARTICLE and (chrome == _PLAIN or (chrome == _NAMED and not article)):
                    chrome, article = _PLAIN, True
    end()
    return found


def sorted_runs(
    tokens: np.ndarray, pages: np.ndarray, run: int = RUN
) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all whole runs of ``run`` tokens, equal runs together, and where in these each
    distinct run begins.

    Suffixes are sorted by prefix doubling, as far as the run needs; equal ranks share the run.
    ``pages`` is non-decreasing; a run ends with its page.
    """
    count = len(tokens)
    if not count:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    _, rank = np.unique(tokens, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    size, order = 1, np.argsort(rank, kind="stable")
    while size < run:
        after = np.zeros(count, dtype=np.int64)
        if size < count:
            same_page = pages[size:] == pages[:-size]
            after[:-size] = np.where(same_page, rank[size:], 0)
        pair = rank * (count + 2) + after
        order = np.argsort(pair, kind="stable")
        ranked = pair[order]
        new = np.ones(count, dtype=np.int64)
        new[1:] = ranked[1:] != ranked[:-1]
        rank = np.empty(count, dtype=np.int64)
        rank[order] = np.cumsum(new)
        size *= 2
    at = order[order + run <= np.searchsorted(pages, pages[order], side="right")]
    ranked = rank[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    return at, np.flatnonzero(new)


def _parse(columns: list) -> dict:
    pages, ids, urls = columns
    texts, opened = [], []
    for page in pages:
        found = blocks(page.decode("utf-8", "replace"))
        marked = any(mark == MARKED for _, mark in found)
        texts.append("\n".join(t for t, mark in found if mark == MARKED) if marked else None)
        opened.append([t for t, mark in found if mark == OPEN])
    return {"page_id": ids, "url": urls, "text": texts, "opened": opened}


_PAGES = pa.list_(pa.struct([
    ("digest", pa.int64()), ("host", pa.int64()), ("unmarked", pa.bool_()),
    ("opened", pa.list_(pa.string()))]))
_RUNS = pa.list_(pa.struct([
    ("run", pa.int64()), ("least", pa.int64()), ("most", pa.int64()), ("wanted", pa.bool_())]))
_PIECE = pa.schema([("piece", pa.int64()), ("pages", _PAGES), ("runs", _RUNS)])
_PIECE_DDL = (
    "piece bigint, "
    "pages array<struct<digest:bigint,host:bigint,unmarked:boolean,opened:array<string>>>, "
    "runs array<struct<run:bigint,least:bigint,most:bigint,wanted:boolean>>")


def _stream(page: dict) -> bytes:
    return "\n".join(page["opened"]).encode("utf-8", "replace")


def run_names(hashes: np.ndarray, host: int) -> np.ndarray:
    """Runs of a host by 64 bits: equal runs of two hosts have different names."""
    return common.mix(hashes ^ common.mix(np.array([host]).astype(np.uint64))).astype(np.int64)


def _runs_of(pages: list[dict]) -> list[np.ndarray]:
    """The distinct runs of the pages of one host, with the least and the most page class that
    holds each, and whether an unmarked page does: four columns."""
    chunk = common.Chunk([_stream(p) for p in pages])
    owners = chunk.owners()
    at, new = sorted_runs(chunk.hashes, owners)
    if not len(at):
        return [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
    kinds = np.array([p["class_id"] for p in pages])[owners[at]]
    wanted = np.array([p["unmarked"] for p in pages])[owners[at]]
    names = run_names(common.hash_windows(chunk.hashes, RUN)[at[new]], pages[0]["host"])
    return [names, np.minimum.reduceat(kinds, new), np.maximum.reduceat(kinds, new),
            np.logical_or.reduceat(wanted, new)]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each PIECE_BYTES of open text; rows come ordered by host."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        rows = batch.to_pylist()
        for first, last in common.pieces([len(_stream(r)) for r in rows], PIECE_BYTES):
            part, runs, start = rows[first:last], [], 0
            for upto in range(1, len(part) + 1):
                if upto == len(part) or part[upto]["host"] != part[start]["host"]:
                    runs.append(_runs_of(part[start:upto]))
                    start = upto
            # Only pages that lose words are needed again.
            pages = [{k: p[k] for k in ("digest", "host", "unmarked", "opened")}
                     for p in part if p["unmarked"]]
            flat = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(c)) for c in zip(*runs)], fields=list(_RUNS.value_type))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([pages], _PAGES),
                 pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)],
                schema=_PIECE)
            number += 1


def without_runs(page: dict, shared: np.ndarray) -> str:
    """The page's open text without the words that shared runs cover. Runs cross blocks (a menu is
    many short ones); where one reaches less than RUN words into a block, these stay."""
    chunk = common.Chunk([_stream(page)])
    hashes, at = chunk.windows(RUN)
    gone = common.covered(
        at[np.isin(run_names(hashes, page["host"]), shared)], RUN, len(chunk.hashes))
    lines, first = [], 0
    for block in page["opened"]:
        words = block.split(" ")
        out = gone[first : first + len(words)]
        first += len(words)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], out, [0])).astype(np.int8)))
        kept, done = [], 0
        for start, end in edges.reshape(-1, 2):
            if end - start >= RUN or end - start == len(words):
                kept += words[done:start]
                done = end
        kept += words[done:]
        if kept:
            lines.append(" ".join(kept))
    return "\n".join(lines)


_KEPT = pa.schema([("of", pa.int64()), ("kept", pa.string())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pages, shared in zip(batch.column("pages"), batch.column("shared")):
            runs = np.array(shared.as_py() or [], dtype=np.int64)
            rows = pages.as_py()
            yield pa.RecordBatch.from_pydict(
                {"of": [p["digest"] for p in rows],
                 "kept": [without_runs(p, runs) for p in rows]}, schema=_KEPT)


def unshared(opened: DataFrame) -> DataFrame:
    """``of`` (digest) and ``kept`` text of the unmarked pages among (digest, host, text, opened).

    Streams are ranged by host, so a host's pages lie in neighbouring pieces and a hot host is many
    pieces. A run's holders are compared over the whole host: each piece sends each distinct
    run once, and gets back the shared ones among its own.
    """
    streams = common.saved(
        opened.dropDuplicates(["digest"]).select(
            "digest", "host", F.col("text").isNull().alias("unmarked"), "opened",
            F.concat_ws("\n", "text", "opened").alias("whole")), "html-streams")
    kinds = jaccard.jaccard_join(streams, "digest", "whole").select(
        F.col("doc_id").alias("of"), "class_id")
    ranged = streams.drop("whole").join(kinds, F.col("digest") == F.col("of")).drop("of")
    width = int(opened.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = common.saved(
        ranged.repartitionByRange(width, "host", "digest").sortWithinPartitions("host", "digest")
        .mapInArrow(_pieces, _PIECE_DDL), "html-pieces")
    held = pieces.select("piece", F.inline("runs"))
    shared = held.groupBy(F.col("run").alias("found")).agg(
        F.min("least").alias("least"), F.max("most").alias("most")
    ).where("least < most").select("found")
    # A list is bounded by the distinct runs of its piece.
    back = held.where("wanted").join(shared, F.col("run") == F.col("found")).groupBy(
        F.col("piece").alias("to")).agg(F.collect_list("run").alias("shared"))
    return (
        pieces.where(F.size("pages") > 0)
        .join(back, F.col("piece") == F.col("to"), "left").select("pages", "shared")
        .mapInArrow(_cut, "of bigint, kept string"))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url",
              page: str = "html") -> DataFrame:
    """Every page's ``page_id``, ``url`` and main ``text``.

    On a page that marks an article (article, main, articleBody), the text is what stands in it;
    else it is the body. Elements and roles that name menus, headers, footers, sidebars, notices,
    adverts, forms and comments go, as do scripts, styles and comments of the markup. So do
    elements whose class or id says so, but no headings and paragraphs, and no article unless its
    class is ``comment``. Names count whole: ``site-footer`` is one, ``has-sidebar`` is none.

    An unmarked page loses all words in runs of RUN tokens that distinct pages of its host hold
    (of a block all words, or RUN in a row at least), and keeps its other words; equal and near-equal pages (five-word shingles 0.8 alike, see
    operator 1, and chains of these) are not distinct. What stands outside a page's article is
    evidence too; what stands in it is never removed.

    Hosts are read from the url (without ``://``: the empty host). Null and empty html give the
    empty text. Repeated rows give equal texts. An empty table gives no rows. Only the three
    named columns are read, so other columns cannot clash.
    """
    rest = F.expr("CASE WHEN locate('://', url) > 0 "
                  "THEN substring(url, locate('://', url) + 3) END")
    host = F.coalesce(F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))
    kind = pages.schema[key].dataType
    schema = pa.schema([("page_id", common.arrow_type(kind)), ("url", pa.string()),
                        ("text", pa.string()), ("opened", pa.list_(pa.string()))])
    frame = pages.select(
        common.as_bytes(page).alias("html"), F.col(key).alias("page_id"), F.col(url).alias("url"))
    parsed = common.saved(
        frame.mapInArrow(
            common.by_chunk(_parse, ["html", "page_id", "url"], schema),
            f"page_id {kind.simpleString()}, url string, text string, opened array<string>")
        .withColumn("host", F.xxhash64(host))
        .withColumn("digest", F.when(
            F.size("opened") > 0, F.xxhash64("host", "text", "opened"))), "html-parsed")
    opened = parsed.where(F.size("opened") > 0)
    settled = F.col("text").isNotNull() | (F.size("opened") == 0)
    done = parsed.where(settled).select(
        "page_id", "url", F.coalesce("text", F.lit("")).alias("text"))
    if opened.isEmpty():
        return done
    kept = common.saved(unshared(opened), "html-kept")
    return done.unionByName(
        parsed.where(~settled).join(kept, F.col("digest") == F.col("of"))
        .select("page_id", "url", F.col("kept").alias("text")))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(common.table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

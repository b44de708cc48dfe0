"""Fill-in-middle transformation by SWAR words (operator 12).

A text is cut into units: a run of ASCII letters, or one other character. Eight bytes at a time,
viewed as one uint64, arithmetic marks the bytes that end a unit; ``bitwise_count`` gives the
units of a word. The k-th unit's end is found by searching the cumulated counts for its word and
then selecting the bit inside that word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Of 100 documents, those left plain, and those of the others that put the suffix first.
PLAIN_PERCENT = 10
SUFFIX_FIRST_PERCENT = 20

_HIGH = np.uint64(0x8080808080808080)
_ONES = np.uint64(0x0101010101010101)
_ONE, _SHIFT, _TOP = np.uint64(1), np.uint64(8), np.uint64(56)


def _letters(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that holds an ASCII letter. No sum leaves its byte."""
    low = (words | _ONES * np.uint64(0x20)) & ~_HIGH
    from_a = low + _ONES * np.uint64(0x80 - ord("a"))
    past_z = low + _ONES * np.uint64(0x80 - ord("z") - 1)
    return from_a & ~past_z & ~words & _HIGH


def _following(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that continues a character (10xxxxxx)."""
    return words & ~(words << _ONE) & _HIGH


def _next(marks: np.ndarray) -> np.ndarray:
    """Marks of the bytes one place on, at the place before; past the end there are none."""
    found = marks >> _SHIFT
    found[:-1] |= marks[1:] << _TOP
    return found


def _select(words: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """The byte that holds the nth (from 1) set high bit of each word."""
    left = words.copy()
    for done in range(1, 8):
        more = nth > done
        left[more] &= left[more] - _ONE
    return np.bitwise_count((left & (~left + _ONE)) - _ONE).astype(np.int64) >> 3


class Units:
    """Texts as words of eight bytes, each text in words of its own with a zero byte after it."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.concatenate(([0], np.cumsum(sizes // 8 + 1)))
        padded = b"".join([t + bytes(8 - len(t) % 8) for t in texts])
        self.words = np.frombuffer(padded, dtype="<u8").astype(np.uint64, copy=False)
        inside = np.full(len(self.words), _HIGH)
        inside[self.starts[1:] - 1] &= (_ONE << (_SHIFT * (sizes % 8).astype(np.uint64))) - _ONE
        letters, following = _letters(self.words), _following(self.words)
        self.ends = inside & ~_next(following) & ~(letters & _next(letters))
        self.chars = inside & ~following
        # Units and characters before each word, over all texts.
        self.units_before = self._before(self.ends)
        self.chars_before = self._before(self.chars)
        self.counts = np.diff(self.units_before[self.starts])

    @staticmethod
    def _before(marks: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)))

    def cut(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and characters of each text before its cut after so many units."""
        first = self.starts[:-1]
        wanted = self.units_before[first] + units
        word = np.searchsorted(self.units_before, wanted) - 1
        at = np.flatnonzero(units)
        inner = _select(self.ends[word[at]], wanted[at] - self.units_before[word[at]]) + 1
        size, chars = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        size[at] = 8 * (word[at] - first[at]) + inner
        # A cut behind the eighth byte takes the whole word.
        bits = np.where(inner == 8, np.uint64(0), _ONE << (_SHIFT * (inner % 8).astype(np.uint64)))
        part = np.bitwise_count(self.chars[word[at]] & (bits - _ONE)).astype(np.int64)
        chars[at] = self.chars_before[word[at]] - self.chars_before[first[at]] + part
        return size, chars


def _transformed(texts: list[bytes], h: np.ndarray) -> dict:
    """Columns of the transformed texts; ``h`` holds the four numbers of each."""
    found = Units(texts)
    n = found.counts
    one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
    (first, first_chars), (second, second_chars) = (
        found.cut(np.minimum(one, two)), found.cut(np.maximum(one, two)))
    plain, late = h[:, 2] % 100 >= 100 - PLAIN_PERCENT, h[:, 3] % 100 < SUFFIX_FIRST_PERCENT
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    forms, outputs = [], []
    for text, a, b, is_plain, is_late in zip(
            texts, first.tolist(), second.tolist(), plain.tolist(), late.tolist()):
        if is_plain or not text or any(m in text for m in marks):
            forms.append("plain")
            outputs.append(text)
            continue
        p, s = marks[0] + text[:a], marks[1] + text[b:]
        forms.append("spm" if is_late else "psm")
        outputs.append(b"".join((*((s, p) if is_late else (p, s)), marks[2], text[a:b])))
    none = np.array([f == "plain" for f in forms], dtype=bool)
    return {
        "n": n, "form": forms, "prefix_chars": pa.array(first_chars, mask=none),
        "middle_chars": pa.array(second_chars - first_chars, mask=none),
        "output": pa.array(outputs, pa.binary()).cast(pa.string())}


def numbers(key: F.Column) -> F.Column:
    """Four numbers of 32 bits from the digest of ``1:`` and the key (null: nothing)."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[
        F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the text as struct ``row``, with ``n`` units, ``form``, ``prefix_chars``,
    ``middle_chars`` and the transformed ``output``.

    The key alone decides form and cuts, so repeated rows give equal results and reruns agree.
    Null and empty texts, and those that spell a mark, stay plain; their parts are null. An empty
    table gives no rows. Other columns travel inside the struct. A text is cut whole, in one task.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    frame = docs.select(common.as_bytes(text).alias("t"), numbers(F.col(key)).alias("h"),
                        F.struct(*rest).alias("row"))
    kind = frame.schema["row"].dataType
    schema = pa.schema([
        ("row", common.arrow_type(kind)), ("n", pa.int64()), ("form", pa.string()),
        ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])

    def work(columns: list) -> dict:
        texts, h, rows = columns
        return {"row": rows, **_transformed(texts, h.flatten().to_numpy().reshape(-1, 4))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from common.by_chunk(work, ["t", "h", "row"], schema)(batches)

    return frame.mapInArrow(
        run, f"row {kind.simpleString()}, n bigint, form string, prefix_chars bigint, "
             "middle_chars bigint, output string")


def restored(form: F.Column, output: F.Column) -> F.Column:
    """The text that ``output`` was made of. A mark never arises where a part meets a mark, since
    it begins with a character that no mark holds further on."""
    def part(after: str, before: str | None) -> F.Column:
        rest = F.substring_index(output, before, 1) if before else output
        return F.substring(rest, F.instr(rest, after) + F.lit(len(after)), F.length(rest))

    return F.when(form == "plain", output).when(
        form == "psm",
        F.concat(part(PREFIX, SUFFIX), part(MIDDLE, None), part(SUFFIX, MIDDLE))).otherwise(
        F.concat(part(PREFIX, MIDDLE), part(MIDDLE, None), part(SUFFIX, PREFIX)))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "row.doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH cut AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d
  FROM documents),
numbered AS (
  SELECT rid, doc_id, body, u, len(u) AS n, ('0x' || d[1:8])::BIGINT AS h1,
    ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3,
    ('0x' || d[25:32])::BIGINT AS h4 FROM cut),
formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>')
      OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbered),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m,
    array_to_string(u[b + 1:n], '') AS s FROM formed)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(body) AS restored_sha256
FROM parts
"""

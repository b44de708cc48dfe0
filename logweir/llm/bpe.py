"""BPE encoding by forced boundaries, and decoding (operator 7).

A byte pair that stands inside no vocabulary token can never be merged over, so it is a certain
cut: what lies between cuts is encoded on its own and the ids are concatenated. Fragments recur
far more often than texts, so a task encodes each of them once.
"""

from __future__ import annotations

import codecs
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Words whose ids a process remembers; beyond it forgets the older half.
REMEMBERED = 1 << 18
# Words that are cut and encoded in one call; each call's result objects are large.
LEARNED = 1 << 12
# Stands between fragments that are encoded in one call; no byte character.
_BREAK = "\n"
# Texts with characters from here on are normalised and cut by the library itself.
FIRST_OTHER = 0x300


def _class(kind: str) -> str:
    """Characters below FIRST_OTHER of a Unicode category, for a character class."""
    return "".join(
        re.escape(chr(c)) for c in range(FIRST_OTHER) if unicodedata.category(chr(c))[0] == kind)


def _word_pattern() -> re.Pattern:
    """The vocabulary's pre-tokenizer for lower-cased text below FIRST_OTHER."""
    letters, numbers = _class("L"), _class("N")
    white = "\t\n\x0b\x0c\r \x85\xa0"
    return re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{white}{letters}{numbers}]+")


def inner_pairs(vocabulary: dict[str, int], suffix: str) -> set[str]:
    """All pairs of neighbouring characters (bytes) inside the tokens."""
    pairs = set()
    for token in vocabulary:
        body = token[: -len(suffix)] if suffix and token.endswith(suffix) else token
        pairs.update(a + b for a, b in zip(body, body[1:]))
    return pairs


class Encoder:
    """A byte-level BPE with word ends, from the text of its JSON file."""

    def __init__(self, text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(text)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.byte_char = "".join(_byte_chars())
        self.byte_of = {c: b for b, c in enumerate(self.byte_char)}
        self.pairs = inner_pairs(model["vocab"], self.suffix)
        # Whether two bytes, one after the other, stand inside some token.
        self.joined = np.zeros((256, 256), dtype=bool)
        for a, b in self.pairs:
            if a in self.byte_of and b in self.byte_of:
                self.joined[self.byte_of[a], self.byte_of[b]] = True
        # Normaliser and pre-tokenizer alone, without a second copy of the vocabulary.
        self.whole = Tokenizer.from_str(json.dumps(
            spec | {"added_tokens": [], "model": model | {"vocab": {}, "merges": []}}))
        plain = spec | {"normalizer": None, "post_processor": None, "added_tokens": [],
                        "truncation": None, "padding": None, "pre_tokenizer": {
                            "type": "Split", "pattern": {"String": _BREAK},
                            "behavior": "Removed", "invert": False}}
        self.last = Tokenizer.from_str(json.dumps(plain))
        self.inner = Tokenizer.from_str(
            json.dumps(plain | {"model": model | {"end_of_word_suffix": None}}))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile(
            "(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")"
        ) if self.special else None
        self.words = _word_pattern()
        self.other = re.compile(f"[{chr(FIRST_OTHER)}-{chr(0x10FFFF)}]")
        # Ids as int32 bytes, of words as such and of words in byte characters.
        self.known: dict[bool, dict[str, bytes]] = {False: {}, True: {}}

    def cuts(self, body: bytes, ends: np.ndarray) -> np.ndarray:
        """Ends of the fragments of words, which end at ``ends``: wherever the bytes on both
        sides stand side by side in no token."""
        codes = np.frombuffer(body, np.uint8)
        cut = np.ones(len(codes) + 1, dtype=bool)
        cut[1:-1] = ~self.joined[codes[:-1], codes[1:]]
        cut[ends] = True
        return np.flatnonzero(cut[1:]) + 1

    def learn(self, words: list[str], mapped: bool) -> None:
        """Remembers the ids of words; each distinct fragment of them is encoded once."""
        raw = [bytes(map(self.byte_of.__getitem__, w)) if mapped else w.encode() for w in words]
        body, ends = b"".join(raw), np.cumsum([len(w) for w in raw])
        text = codecs.charmap_decode(body, "strict", self.byte_char)[0]
        cuts = self.cuts(body, ends)
        bounds = [0, *cuts.tolist()]
        parts = [text[a:b] for a, b in zip(bounds, bounds[1:])]
        at = np.searchsorted(cuts, ends)
        final = np.zeros(len(parts), dtype=bool)
        final[at] = True
        found = [b""] * len(parts)
        for model, places in ((self.inner, ~final), (self.last, final)):
            places = np.flatnonzero(places).tolist()
            ids = _encoded(model, list({parts[i] for i in places}))
            for i in places:
                found[i] = ids[parts[i]]
        firsts = [0, *(at + 1).tolist()]
        known = self.known[mapped]
        for word, a, b in zip(words, firsts, firsts[1:]):
            known[word] = found[a] if b == a + 1 else b"".join(found[a:b])

    def _make_room(self) -> None:
        for known in self.known.values():
            if len(known) > REMEMBERED:
                for word in list(islice(known, len(known) // 2)):
                    del known[word]

    def _split(self, text: str) -> tuple[list[str], bool]:
        """The words of a text without special tokens; whether they are byte characters."""
        if text.isascii() or not self.other.search(text):
            return self.words.findall(text.lower()), False
        normal = self.whole.normalizer.normalize_str(text)
        return [w for w, _ in self.whole.pre_tokenizer.pre_tokenize_str(normal)], True

    def _sections(self, text: str) -> list[tuple[list[str], bool] | int]:
        if self.special_pattern is None or "<|" not in text:
            return [self._split(text)]
        return [
            self.special[s] if s in self.special else self._split(s)
            for s in self.special_pattern.split(text) if s]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as int32 bytes."""
        sections = [self._sections(t) for t in texts]
        self._make_room()
        for mapped, known in self.known.items():
            new = {word for section in chain.from_iterable(sections)
                   if not isinstance(section, int) and section[1] == mapped
                   for word in section[0]}
            new = [w for w in new if w not in known]
            for first in range(0, len(new), LEARNED):
                self.learn(new[first : first + LEARNED], mapped)
        found = []
        for parts in sections:
            ids = []
            for section in parts:
                if isinstance(section, int):
                    ids.append(array("i", [section]).tobytes())
                else:
                    ids += map(self.known[section[1]].__getitem__, section[0])
            found.append(b"".join(ids))
        return found


def _byte_chars() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the rest from
    code point 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, other = [""] * 256, 256
    for byte in range(256):
        if byte in printable:
            chars[byte] = chr(byte)
        else:
            chars[byte], other = chr(other), other + 1
    return chars


def _encoded(model, parts: list[str]) -> dict[str, bytes]:
    """The ids of distinct fragments, in one call: the model takes each as a word of its own."""
    if not parts:
        return {}
    whole = model.encode(_BREAK.join(parts), add_special_tokens=False)
    ids, words = np.array(whole.ids, np.int32), np.array(whole.word_ids)
    bounds = [0, *(np.flatnonzero(np.diff(words)) + 1).tolist(), len(ids)]
    if len(bounds) != len(parts) + 1:
        raise ValueError("the tokenizer has no token for some byte")
    body = ids.tobytes()
    return {p: body[4 * a : 4 * b] for p, a, b in zip(parts, bounds, bounds[1:])}


class Codec:
    """A tokenizer file that tasks encode and decode with; a process builds it once."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, encoding="utf-8") as file:
            self.spec = spark.sparkContext.broadcast(file.read())
        self.path = path

    def encoder(self) -> Encoder:
        return common.once(("encoder", self.path), lambda: Encoder(self.spec.value))

    def names(self) -> pa.Array:
        return common.once(("names", self.path), lambda: _names(json.loads(self.spec.value)))

    def encoded(self, texts: list[bytes]) -> pa.ListArray:
        found = self.encoder().encode([t.decode() for t in texts])
        ends = (np.cumsum([0, *map(len, found)]) // 4).astype(np.int32)
        return pa.ListArray.from_arrays(
            pa.array(ends), pa.array(np.frombuffer(b"".join(found), np.int32)))

    def decoded(self, ids: pa.ListArray) -> pa.Array:
        """The tokens' strings, special ones included, joined by one space (the vocabulary has
        no decoder of its own)."""
        strings = self.names().take(ids.flatten())
        starts = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(ids).to_numpy())))
        return pa.compute.binary_join(
            pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), strings), " ")


def _names(spec: dict) -> pa.Array:
    names = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
    strings = [""] * (max(names.values()) + 1)
    for name, number in names.items():
        strings[number] = name
    return pa.array(strings, pa.string())


def encode(docs: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` without the text as struct ``row``, with ``ids`` (no special tokens added).

    The ids are those of the tokenizer file at ``path``, read once by the driver. Texts that
    spell a special token give its id, as in the library. Null and empty texts give no ids.
    Other columns travel inside the struct, so their names cannot clash. Repeated rows are
    encoded each; an empty table gives no rows. A text is encoded whole, in one task.
    ``decoded`` adds the ``text`` that the ids decode to, in the same pass.
    """
    codec = Codec(docs.sparkSession, path)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    frame = docs.select(common.as_bytes(text).alias("t"), F.struct(*rest).alias("row"))
    kind = frame.schema["row"].dataType
    schema = pa.schema([("ids", pa.list_(pa.int32())), ("row", common.arrow_type(kind)),
                        *[("text", pa.string())] * decoded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(columns: list) -> dict:
            texts, rows = columns
            ids = codec.encoded(texts)
            return {"ids": ids, "row": rows, **({"text": codec.decoded(ids)} if decoded else {})}

        yield from common.by_chunk(work, ["t", "row"], schema)(batches)

    return frame.mapInArrow(
        run, f"ids array<int>, row {kind.simpleString()}" + ", text string" * decoded)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds the decoded ``text`` to ``ids`` and ``row``."""
    codec = Codec(encoded.sparkSession, path)
    kind = encoded.schema["row"].dataType
    schema = pa.schema([("ids", pa.list_(pa.int32())), ("row", common.arrow_type(kind)),
                        ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column("ids")).to_pylist()
            for first, last in common.pieces([4 * n for n in sizes]):
                part = batch.slice(first, last - first)
                yield pa.RecordBatch.from_pydict(
                    {"ids": part.column("ids"), "row": part.column("row"),
                     "text": codec.decoded(part.column("ids"))}, schema=schema)

    return encoded.mapInArrow(run, f"ids array<int>, row {kind.simpleString()}, text string")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id`` with the number of ids, and digests of the ids and of the decoded text."""
    found = encode(docs.select("doc_id", "text"), path, decoded=True)
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"), tokenizer_path())

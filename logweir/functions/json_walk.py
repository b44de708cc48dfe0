"""JSON of unknown depth (J3, J5, J6): small Arrow-batched helpers.

Built-in functions cannot walk a document whose depth is not known, nor cut balanced
blocks out of free text; everything around these helpers is a DataFrame operation.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from logweir.functions.json import MAX_DEPTH, printed

HIDDEN_KEY = "exception"  # fixed: the key that is folded away


class Number(str):
    """A number as it is spelled; ``printed`` gives it its one form."""


def _refuse(constant: str) -> None:
    raise ValueError(f"{constant} is not JSON")


def _number(text: str) -> Number:
    if not math.isfinite(float(text)):
        raise ValueError(f"{text} is too large")
    return Number(text)


def _depth(value: Any) -> int:
    deepest, level = 0, [value]
    while level:
        nested = [v for v in level if isinstance(v, (dict, list))]
        deepest += bool(nested)
        level = [x for v in nested for x in (v.values() if isinstance(v, dict) else v)]
    return deepest


_SURROGATE = re.compile("[\ud800-\udfff]")


def load(text: str | None) -> tuple[bool, Any]:
    """(is it one JSON value, the value). Half a surrogate pair, a number that is not finite
    and more than MAX_DEPTH levels are no JSON."""
    if text is None:
        return False, None
    try:
        value = json.loads(
            text, parse_constant=_refuse, parse_float=_number, parse_int=_number)
        fits = _depth(value) <= MAX_DEPTH
    except (ValueError, RecursionError):
        return False, None
    if not fits or ("\\u" in text and _SURROGATE.search(dump(value))):
        return False, None
    return True, value


def dump(value: Any) -> str:
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(
            f"{json.dumps(k, ensure_ascii=False)}:{dump(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(dump, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def without_hidden(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: without_hidden(v) for k, v in value.items() if k != HIDDEN_KEY}
    return [without_hidden(v) for v in value] if isinstance(value, list) else value


def leaves(value: Any, show_exception: bool, path: str = "$", key: str = "") -> Iterator[dict]:
    """One record per scalar or empty container, keys in order."""
    if isinstance(value, dict) and value:
        for name in sorted(value):
            if show_exception or name != HIDDEN_KEY:
                yield from leaves(value[name], show_exception, f"{path}.{name}", name)
    elif isinstance(value, list) and value:
        for i, item in enumerate(value):
            yield from leaves(item, show_exception, f"{path}[{i}]", key)
    else:
        is_text = isinstance(value, str) and not isinstance(value, Number)
        yield {"path": path, "key": key, "value": value if is_text else dump(value),
               "is_text": is_text}


# Inside a block: a whole string (or an unclosed one up to the end), or one bracket.
_TOKENS = {
    "{": re.compile(r'"(?:\\.|[^"\\])*(?:"|\\?\Z)|[{}]', re.DOTALL),
    "[": re.compile(r'"(?:\\.|[^"\\])*(?:"|\\?\Z)|[\[\]]', re.DOTALL),
}
_OPENING = re.compile(r"[{\[]")


def balanced_blocks(text: str) -> Iterator[tuple[int, str]]:
    """(offset, text) of the outermost balanced blocks; ends at a block that never closes."""
    opening = _OPENING.search(text)
    while opening:
        start, bracket = opening.start(), opening.group()
        depth, end = 0, None
        for token in _TOKENS[bracket].finditer(text, start):
            sign = token.group()
            if len(sign) == 1 and sign != '"':
                depth += 1 if sign == bracket else -1
                if depth == 0:
                    end = token.end()
                    break
        if end is None:
            return
        yield start, text[start:end]
        opening = _OPENING.search(text, end)


def _blocks_of(text: str | None) -> list[dict]:
    found = []
    for offset, block in balanced_blocks(text or ""):
        ok, value = load(block)
        if ok:
            found.append({"char_offset": offset, "json": dump(value)})
    return found


# Text whose records Python holds at once; an Arrow batch may be much larger.
PIECE_BYTES = 1024 * 1024
_RECORDS = {
    "path": pa.string(), "key": pa.string(), "value": pa.string(), "is_text": pa.bool_(),
    "char_offset": pa.int32(), "json": pa.string()}


def _records(*names: str) -> pa.DataType:
    return pa.list_(pa.struct([(n, _RECORDS[n]) for n in names]))


def in_pieces(
    work: Callable[[str | None], Any], kind: pa.DataType
) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """``work`` on each text of a column; results go back piece by piece."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found, held = [], 0
            for text in batch:
                value = text.as_py()
                if found and held + len(value or "") > PIECE_BYTES:
                    yield pa.array(found, kind)
                    found, held = [], 0
                found.append(work(value))
                held += len(value or "") + 1
            yield pa.array(found, kind)

    return run


def json_blocks(text: Column) -> Column:
    """All valid JSON blocks of a text with their character offsets, as an array."""
    run = F.arrow_udf(
        in_pieces(_blocks_of, _records("char_offset", "json")),
        "array<struct<char_offset:int,json:string>>")
    return F.transform(run(text), lambda block: F.struct(
        block["char_offset"].alias("char_offset"), printed(block["json"]).alias("json")))


def json_fields(text: Column, show_exception: bool = False) -> Column:
    """Scalar fields of a JSON text at any depth, as an array; null when it is not JSON."""

    def walk(value: str | None) -> list[dict] | None:
        ok, parsed = load(value)
        return list(leaves(parsed, show_exception)) if ok else None

    run = F.arrow_udf(
        in_pieces(walk, _records("path", "key", "value", "is_text")),
        "array<struct<path:string,key:string,value:string,is_text:boolean>>")
    return F.transform(run(text), lambda field: F.struct(
        field["path"].alias("path"), field["key"].alias("key"),
        F.when(field["is_text"], field["value"]).otherwise(printed(field["value"]))
        .alias("value")))


def hide_exception(text: Column) -> Column:
    """JSON text without any ``exception`` key. Other texts never leave the JVM's value."""

    def fold(value: str | None) -> str | None:
        ok, parsed = load(value)
        return dump(without_hidden(parsed)) if ok else None

    run = F.arrow_udf(in_pieces(fold, pa.string()), "string")
    concerned = F.when(F.contains(text, F.lit(f'"{HIDDEN_KEY}"')), text)
    return F.coalesce(printed(run(concerned)), text)

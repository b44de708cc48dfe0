"""JSON inside messages and continuation text (J1, J2, J4, J7) with VARIANT built-ins.

They rely on ``configure``: repeated keys are legal and the last one counts. ``json_walk``
takes the same texts for JSON and prints them with ``printed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 127  # fixed: deeper documents are not accepted as JSON

# A string, whole or unclosed at the end of the text; possessive, so that long ones need no stack.
_STRING = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"?'
_ESCAPED = r"(?<!\\)(?:\\\\)*\\u[dD]"
_LONE_HIGH = _ESCAPED + r"[89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])"
_LONE_LOW = r"(?<!\\u[dD][89abAB][0-9a-fA-F]{2})" + _ESCAPED + r"[c-fC-F]"
# A number can be too large from this many digits or exponent digits on.
_LONG_NUMBER = r"[0-9]{309}|[eE]\+?[0-9]{3}"
_NUMBER = r"(-?[0-9][0-9.]*(?:[eE][+-]?[0-9]+)?)"


def _depth(text: Column) -> Column:
    """Depth of brackets outside strings."""
    brackets = F.regexp_replace(F.regexp_replace(text, _STRING, ""), r"[^{}\[\]]", "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state: Column, sign: Column) -> Column:
        now = state["now"] + F.when(sign.isin("{", "["), 1).when(sign == "", 0).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    return F.aggregate(F.split(brackets, ""), zero, step, lambda state: state["most"])


def _beyond_json(text: Column) -> Column:
    """What VARIANT takes and JSON does not: half a surrogate pair, a number that is not
    finite, more than MAX_DEPTH levels. Each is looked for only where its signs occur."""
    lone = F.contains(F.lower(text), F.lit("\\ud")) & (
        F.rlike(text, F.lit(_LONE_HIGH)) | F.rlike(text, F.lit(_LONE_LOW)))
    numbers = F.regexp_extract_all(F.regexp_replace(text, _STRING, '""'), F.lit(_NUMBER))
    too_large = F.rlike(text, F.lit(_LONG_NUMBER)) & F.exists(
        numbers, lambda n: F.abs(n.try_cast("double")) == F.lit(float("inf")))
    closed = F.replace(F.replace(text, F.lit("{")), F.lit("["))
    openings = F.char_length(text) - F.char_length(closed)
    return lone | too_large | (F.when(openings > MAX_DEPTH, _depth(text) > MAX_DEPTH)
                               .otherwise(False))


def strict_json(text: Column) -> Column:
    """VARIANT when ``text`` is exactly one JSON value of MAX_DEPTH levels at most, else null.

    The parser ignores text behind a value. Inside an array only ``,`` or ``]`` may follow
    the value and inside an object only ``,`` and a key or ``}``, so a text that parses in
    both places is one value and nothing else.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when(
        in_array.isNotNull() & ~_beyond_json(text), F.try_variant_get(in_object, "$.v", "variant"))


def printed(json: Column) -> Column:
    """The one way in which JSON is printed: compact, keys sorted, numbers as Spark has them."""
    return F.to_json(F.try_parse_json(json))


def from_first_bracket(message: Column) -> Column:
    """The message from its first opening bracket on, null without one."""
    return F.nullif(F.regexp_extract(message, r"(?s)[{\[].*", 0), F.lit(""))


def trailing_json(rest: Column) -> Column:
    """Compact text of the JSON value ``rest`` is, or its first line is; else null."""
    first_line = F.substring_index(rest, "\n", 1)
    value = F.coalesce(
        strict_json(rest), F.when(F.contains(rest, F.lit("\n")), strict_json(first_line))
    )
    return F.to_json(value)


def text_before(message: Column, rest: Column) -> Column:
    """The message before its JSON, without the spaces, dashes and colons in between."""
    head = F.left(message, F.char_length(message) - F.char_length(rest))
    return F.regexp_replace(head, r"[ :-]+\z", "")


def extract_json(message: Column) -> tuple[Column, Column]:
    """(text before the JSON, JSON) when the message ends in one JSON value, else nulls.

    The JSON starts at the first opening bracket. When the rest of the message is not one
    value, the rest of that line is tried.
    """
    rest = from_first_bracket(message)
    json = trailing_json(rest)
    return F.when(json.isNotNull(), text_before(message, rest)), json


def with_json(df: DataFrame, message: str = "message") -> DataFrame:
    """``extract_json`` as columns ``json_head`` and ``json``, made step by step so that a
    value used several times is parsed once."""
    found = df.withColumn("_rest", from_first_bracket(F.col(message)))
    found = found.withColumn("json", trailing_json(F.col("_rest")))
    head = F.when(F.col("json").isNotNull(), text_before(F.col(message), F.col("_rest")))
    return found.withColumn("json_head", head).drop("_rest")


def normalize_json(text: Column) -> Column:
    """Compact JSON with sorted keys, or the text itself when it is not JSON."""
    return F.coalesce(F.to_json(strict_json(text)), text)


def json_value(json: Column, path: str, kind: str = "string") -> Column:
    """One value of a JSON text by path, null when absent (J7: ``$.exception``)."""
    return F.try_variant_get(F.try_parse_json(json), path, kind)

"""Text functions: message split and prefix, preview, labels, names, sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweir import fixed


def trim_space(text: Column) -> Column:
    """Trim all Unicode white space; the built-in trim removes only spaces."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def _separator_position(message: Column) -> Column:
    """Position of the first object separator, else of the first array separator, else 0."""
    found = [F.nullif(F.instr(message, s), F.lit(0)) for s in fixed.JSON_SEPARATORS]
    return F.coalesce(*found, F.lit(0))


def split_at_json(message: Column) -> tuple[Column, Column]:
    """(text before the separator, separator and rest); the rest is null without one."""
    at = _separator_position(message)
    head = F.when(at > 0, F.left(message, at - 1)).otherwise(message)
    rest = F.when(at > 0, F.substr(message, at))
    return head, rest


def message_prefix(message: Column) -> Column:
    """Stable part of a message: the text before its JSON, trimmed."""
    return trim_space(split_at_json(message)[0])


def cut_bytes(text: Column, max_bytes: int) -> Column:
    """Longest start of ``text`` with at most ``max_bytes`` bytes of whole characters."""
    raw = text.cast("binary")
    # A UTF-8 character has at most four bytes, so one of four cuts is on a boundary.
    cuts = [
        F.try_validate_utf8(F.substring(raw, 1, n).cast("string"))
        for n in range(max_bytes, max(max_bytes - 4, -1), -1)
    ]
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(
        F.coalesce(*cuts, F.lit(""))
    )


def preview(text: Column, max_bytes: int) -> Column:
    """``text`` when it fits, else cut and ended with three dots."""
    short = F.concat(cut_bytes(text, max(max_bytes - 3, 0)), F.lit("..."))
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(short)


def level_label(level: Column) -> Column:
    return F.concat(F.lit("["), level, F.lit("]"))


def request_label(request_id: Column) -> Column:
    return F.coalesce(request_id, F.lit("-"))


def severity_class(level: Column) -> Column:
    """Display group of a level: critical, error, warning, info or debug."""
    branches = list(fixed.SEVERITY_CLASSES.items())
    start = F.when(level.isin(branches[0][1]), branches[0][0])
    return reduce(lambda c, b: c.when(level.isin(b[1]), b[0]), branches[1:], start)


def is_log_name(name: Column) -> Column:
    """True for ``x.log`` and rotated ``x.log.suffix``, judged on the last ``.log``."""
    suffix = F.substring_index(name, ".log", -1)
    rotated = F.startswith(suffix, F.lit(".")) & (F.char_length(suffix) > 1)
    return F.contains(name, F.lit(".log")) & ((suffix == "") | rotated)


def size_label(size: Column) -> Column:
    """Bytes as B, KB, MB or GB with one decimal, base 1024, halves to even."""
    kb, mb, gb = 1024, 1024**2, 1024**3

    def unit(divisor: int, name: str) -> Column:
        return F.concat(F.call_function("format_number", size / divisor, F.lit("0.0")), F.lit(name))

    return (
        F.when(size >= gb, unit(gb, " GB"))
        .when(size >= mb, unit(mb, " MB"))
        .when(size >= kb, unit(kb, " KB"))
        .otherwise(F.concat(size.cast("string"), F.lit(" B")))
    )


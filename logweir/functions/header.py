"""Header parsing with built-in expressions.

A line is a header when the pattern matches (known level, time and offset in range), the
date exists and falls on the named weekday. Any other line is a continuation.

The functions take the name of the line column. They are SQL text, since a job uses them
many times and one text is one call to the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweir import fixed


def _names(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _place(names: list[str], text: str) -> str:
    """1-based position of a name in any case, 0 when unknown."""
    lower = _names([n.lower() for n in names])
    return f"cast(array_position(array({lower}), lower({text})) as int)"


def _number(line: str, start: int, length: int) -> str:
    return f"try_cast(substring({line}, {start}, {length}) as int)"


def severity(level: Column) -> Column:
    """0 for EMERGENCY up to 7 for DEBUG; case is ignored, unknown names give null."""
    place = F.array_position(F.array(*[F.lit(n) for n in fixed.LEVELS]), F.upper(level))
    return (F.nullif(place, F.lit(0)) - 1).cast("int")


def parse_level(name: Column) -> Column:
    """Upper-case level name, or null when the name is unknown."""
    return F.when(severity(name).isNotNull(), F.upper(name))


def clean_line(line: str) -> Column:
    """Line text as the parser sees it: without the one carriage return a CRLF end leaves,
    and with broken UTF-8 replaced."""
    return F.expr(
        f"make_valid_utf8(if(endswith({line}, '\\r'), left({line}, char_length({line}) - 1), {line}))"
    )


def is_blank(line: str) -> Column:
    """True when the line has only Unicode white space."""
    return F.expr(rf"{line} rlike r'(?U)\A\s*\z'")


def _wall(line: str, time: str) -> str:
    month = _place(fixed.MONTHS, f"substring({line}, 9, 3)")
    return f"try_make_timestamp_ntz({_number(line, 13, 4)}, {month}, {_number(line, 6, 2)}, {time})"


def _day(line: str) -> str:
    """Calendar day of the date part, null when there is no such day."""
    return f"cast({_wall(line, '0, 0, 0')} as date)"


def _level(line: str) -> str:
    """Text in the level brackets of a header."""
    longest = max(len(name) for name in fixed.LEVELS) + 1
    return f"substring_index(substring({line}, {fixed.LEVEL_BRACKET_POSITION + 1}, {longest}), ']', 1)"


def looks_like_header(line: str) -> Column:
    """Pattern test only. The cheap bracket test comes first and rules out most lines."""
    return F.expr(_looks_like_header(line))


def _looks_like_header(line: str) -> str:
    bracket = f"substring({line}, {fixed.LEVEL_BRACKET_POSITION}, 1) = '['"
    return f"{bracket} and {line} rlike r'{fixed.HEADER_PATTERN}'"


def is_header(line: str) -> Column:
    """True or false, never null. The day has to exist and to fall on the named weekday."""
    named_day = _place(fixed.WEEKDAYS, f"substring({line}, 1, 3)")
    return F.expr(
        f"coalesce({_looks_like_header(line)} and weekday({_day(line)}) + 1 = {named_day}, false)"
    )


def header_columns(line: str) -> list[Column]:
    """Typed fields of a line that ``is_header`` accepts; meaningless on other lines.

    Nothing goes through the session time zone. A leap second counts as the first second
    of the next minute. The pattern forbids quotes in the request and component fields, so
    one split at the first four quotes yields all three text fields.
    """
    hour, minute, second = (_number(line, at, 2) for at in (18, 21, 24))
    sign = f"if(substring({line}, 27, 1) = '-', -1, 1)"
    zone = f"{sign} * ({_number(line, 28, 2)} * 60 + {_number(line, 30, 2)})"
    local = (
        f"(cast(unix_date({_day(line)}) as bigint) * 86400"
        f" + {hour} * 3600 + {minute} * 60 + {second})"
    )
    pieces = f"split({line}, '\"', 5)"
    level = _level(line)
    place = f"array_position(array({_names(fixed.LEVELS)}), {level})"
    columns = {
        "ts": f"timestamp_seconds({local} - ({zone}) * 60)",
        "ts_local": _wall(line, f"{hour}, {minute}, {second}"),
        "tz_offset_min": zone,
        "level": level,
        "severity": f"cast({place} - 1 as int)",
        "request_id": f"nullif(get({pieces}, 1), '')",
        "component": f"get({pieces}, 3)",
        "message": f"substring(get({pieces}, 4), 3)",
    }
    return [F.expr(f"{text} as {name}") for name, text in columns.items()]

"""Date and time functions. They work on the entry's own wall clock, never on a zone."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _clock_text(ts_local: Column, year_start: int, year_length: int, gap: str) -> Column:
    iso = ts_local.cast("timestamp_ntz").cast("string")  # yyyy-MM-dd HH:mm:ss
    return F.concat(
        F.substring(iso, 9, 2),
        F.lit("."),
        F.substring(iso, 6, 2),
        F.lit("."),
        F.substring(iso, year_start, year_length),
        F.lit(gap),
        F.substring(iso, 12, 8),
    )


def short_timestamp(ts_local: Column) -> Column:
    """``02.04.26 12:00:00``"""
    return _clock_text(ts_local, 3, 2, " ")


def full_timestamp(ts_local: Column) -> Column:
    """``02.04.2026, 12:00:00``"""
    return _clock_text(ts_local, 1, 4, ", ")


def shift_hours(ts_local: Column, hours: int) -> Column:
    """Wall clock moved for display. The offset and all filters stay as stored."""
    return ts_local + F.make_dt_interval(F.lit(0), F.lit(hours))


def shift_label(hours: int) -> str:
    return f"{hours:+d}h" if hours else ""


def parse_date_column(text: Column) -> Column:
    """Dates typed as ``02.04.2026`` or ``2026-04-02``; anything else is null."""
    from logweir.functions.text import trim_space

    value = trim_space(text)
    german = F.split(F.when(value.rlike(r"\A[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{1,4}\z"), value), r"\.")
    iso = F.split(F.when(value.rlike(r"\A[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}\z"), value), "-")

    def date(year: Column, month: Column, day: Column) -> Column:
        parts = [c.try_cast("int") for c in (year, month, day)]
        midnight = F.try_make_timestamp_ntz(*parts, F.lit(0), F.lit(0), F.lit(0))
        return midnight.cast("date")

    return F.coalesce(date(german[2], german[1], german[0]), date(iso[0], iso[1], iso[2]))


def parse_date_input(text: str) -> dt.date | None:
    """The same rule for one value on the driver, used to build filters."""
    value = text.strip()
    found = re.fullmatch(r"([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{1,4})", value)
    if found:
        day, month, year = map(int, found.groups())
    else:
        found = re.fullmatch(r"([0-9]{1,4})-([0-9]{1,2})-([0-9]{1,2})", value)
        if not found:
            return None
        year, month, day = map(int, found.groups())
    try:
        return dt.date(year, month, day)
    except ValueError:
        return None


def add_months(day: dt.date, months: int) -> dt.date:
    """Same day of another month, or that month's last day when it is shorter."""
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    next_month = dt.date(year + (month == 11), (month + 1) % 12 + 1, 1)
    last = (next_month - dt.timedelta(days=1)).day
    return dt.date(year, month + 1, min(day.day, last))

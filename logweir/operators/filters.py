"""Entry filters (F1-F15): a frozen description that turns into one Catalyst predicate."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, fields, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweir import fixed
from logweir.functions.text import message_prefix
from logweir.functions.times import add_months, parse_date_input


def _holds(column: Column, text: str) -> Column:
    """Case-insensitive literal substring."""
    return F.contains(F.lower(column), F.lower(F.lit(text)))


@dataclass(frozen=True)
class LogFilter:
    """All set fields must hold; a field that is None lets every entry pass."""

    min_level: str | None = None
    search_text: str | None = None
    component_filter: str | None = None
    request_id: str | None = None
    message_prefix: str | None = None
    date_from: dt.date | None = None
    date_to: dt.date | None = None

    def __post_init__(self) -> None:
        if self.min_level is not None:
            name = self.min_level.upper()
            if name not in fixed.LEVELS:
                raise ValueError(f"unknown level {self.min_level!r}")
            object.__setattr__(self, "min_level", name)

    def predicates(self) -> list[Column]:
        """Set predicates, cheapest first. Dates are those of the entry's own offset."""
        day = F.col("ts_local").cast("date")
        found: list[Column] = []
        if self.min_level is not None:
            found.append(F.col("severity") <= fixed.LEVELS.index(self.min_level))
        if self.date_from is not None:
            found.append(day >= F.lit(self.date_from))
        if self.date_to is not None:
            found.append(day <= F.lit(self.date_to))
        if self.request_id is not None:
            found.append(F.coalesce(F.col("request_id") == self.request_id, F.lit(False)))
        if self.component_filter is not None:
            found.append(_holds(F.col("component"), self.component_filter))
        if self.search_text is not None:
            found.append(
                _holds(F.col("message"), self.search_text)
                | _holds(F.col("component"), self.search_text)
            )
        if self.message_prefix is not None:
            found.append(message_prefix(F.col("message")) == self.message_prefix)
        return found

    def to_column(self) -> Column:
        return reduce(and_, self.predicates(), F.lit(True))

    @property
    def is_active(self) -> bool:
        return any(getattr(self, f.name) is not None for f in fields(self))

    def clear(self) -> LogFilter:
        return LogFilter()

    def clear_dates(self) -> LogFilter:
        return replace(self, date_from=None, date_to=None)

    def with_level(self, level: str | None) -> LogFilter:
        return replace(self, min_level=level)

    def with_shortcut(self, key: int) -> LogFilter:
        """Level keys: 1 errors, 2 warnings, 3 info, 4 everything down to debug."""
        return replace(self, min_level=fixed.LEVEL_SHORTCUTS[key])

    def with_search(self, text: str | None) -> LogFilter:
        return replace(self, search_text=text or None)

    def same_request(self, request_id: str | None) -> LogFilter:
        """Focus on one request; an entry without a request leaves the filter alone."""
        return self if request_id is None else replace(self, request_id=request_id)

    def same_message(self, prefix: str) -> LogFilter:
        """Focus on one message template; an empty prefix leaves the filter alone."""
        return self if not prefix else replace(self, message_prefix=prefix)

    def between(self, start: dt.date | None, end: dt.date | None) -> LogFilter:
        return replace(self, date_from=start, date_to=end)

    def today(self, as_of: dt.date | None = None) -> LogFilter:
        day = as_of or dt.date.today()
        return self.between(day, day)

    def last_month(self, as_of: dt.date | None = None) -> LogFilter:
        """First to last day of the calendar month before ``as_of``."""
        first = (as_of or dt.date.today()).replace(day=1)
        return self.between(add_months(first, -1), first - dt.timedelta(days=1))

    def last_months(self, months: int, as_of: dt.date | None = None) -> LogFilter:
        """The same day ``months`` months ago up to ``as_of``."""
        day = as_of or dt.date.today()
        return self.between(add_months(day, -months), day)

    def date_range(self, start: str, end: str = "") -> LogFilter:
        """Typed dates. Without an end it is one day; an unreadable side stays open."""
        first = parse_date_input(start)
        return self.between(first, parse_date_input(end) if end else first)

    def date_label(self) -> str | None:
        def text(day: dt.date) -> str:
            return f"{day.day:02d}.{day.month:02d}.{day.year:04d}"

        start, end = self.date_from, self.date_to
        if start is None and end is None:
            return None
        if end is None:
            return fixed.DATE_FROM_LABEL.format(text(start))
        if start is None:
            return fixed.DATE_TO_LABEL.format(text(end))
        return text(start) if start == end else fixed.DATE_RANGE_LABEL.format(text(start), text(end))

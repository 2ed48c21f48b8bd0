"""Dates: patterns, zones and stored answers. No function reads the clock or the session zone."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_PATTERN = "dd-MM-yyyy"
_PART = re.compile(r"yyyy|yy|MMMM|MMM|MM|M|dd|d|HH|H|hh|h|mm|m|ss|s|a|[\s\-/:.,]+")


def check_pattern(pattern: str) -> bool:
    """One year, month and day; a 12-hour clock with ``a`` or a 24-hour one without; seconds only with minutes."""
    if not 0 < len(pattern) <= 64:
        return False
    tokens, at = [], 0
    while at < len(pattern):
        m = _PART.match(pattern, at)
        if m is None:
            return False
        at = m.end()
        if m[0][0].isalpha():
            tokens.append(m[0])
    count = lambda *names: sum(tokens.count(n) for n in names)
    year, month, day = count("yyyy", "yy"), count("MMMM", "MMM", "MM", "M"), count("dd", "d")
    h24, h12, minute, second, half = count("HH", "H"), count("hh", "h"), count("mm", "m"), count("ss", "s"), count("a")
    if (year, month, day) != (1, 1, 1) or max(h24, h12, minute, second, half) > 1 or h24 + h12 > 1:
        return False
    timed = h24 + h12 + minute + second + half > 0
    return not (timed and h24 + h12 != 1 or second and not minute or h12 and not half or h24 and half)


def format_instant(instant: Column, pattern: str, zone: str) -> Column:
    """An instant (UTC timestamp) on the wall clock of a zone."""
    if not check_pattern(pattern):
        raise ValueError(f"date pattern {pattern!r} isn't supported")
    return F.date_format(F.from_utc_timestamp(instant, zone), pattern)


ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"


def parse_iso(text: Column) -> Column:
    """The instant of an ISO 8601 text with seconds and an offset; else null."""
    return F.when(text.rlike(ISO), F.try_to_timestamp(text))


def is_part(text: Column, include_time: bool) -> Column:
    return text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$" if include_time else r"^\d{4}-\d{2}-\d{2}$")


def is_complete(answer: Column, include_time: bool = False, date_range: bool = False) -> Column:
    parts = F.split(answer, "/")
    whole = F.forall(parts, lambda p: is_part(p, include_time))
    return whole & (F.size(parts) == (2 if date_range else 1))


def wall_to_instant(local: Column, zone: str) -> Column:
    """The instant of a wall-clock time; null in a gap of the zone's clock."""
    instant = F.to_utc_timestamp(local, zone)
    return F.when(F.from_utc_timestamp(instant, zone) == local, instant)

"""Arguments of range filters: numbers, sizes and dates, each an inclusive range of integers."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from filelens.plans.nodes import HIGH, LOW, QueryError, fold

Range = tuple[int, int]
Parse = Callable[[str, int], Range]

#: Longest value that is looked at, in characters.
LONGEST = 255

#: Named sizes and unit powers of 1024, fixed values.
NAMED_SIZES = {
    "empty": (0, 0),
    "tiny": (0, 10 << 10),
    "small": ((10 << 10) + 1, 100 << 10),
    "medium": ((100 << 10) + 1, 1 << 20),
    "large": ((1 << 20) + 1, 16 << 20),
    "huge": ((16 << 20) + 1, 128 << 20),
    "gigantic": ((128 << 20) + 1, HIGH),
}
UNIT_POWERS = {"": 0, "b": 0} | {p + s: k for k, p in enumerate("kmgtp", 1) for s in ("", "b", "ib")}

_SIZE = re.compile(r"(\d+(?:\.\d+)?)[ \t\r\n]*([a-z]*)", re.A)
_RELATIVE = re.compile(r"(?:last|past)(\d+)(day|week|month|year)s?", re.A)
_INTEGER = re.compile(r"[+-]?\d+", re.A)
_DATE_HELP = "expected a date such as 2024, 2024-03 or 2024-03-15"


def number(text: str, now: int = 0) -> Range:
    """A single integer."""
    value = text.strip()
    if not _INTEGER.fullmatch(value) or not LOW <= int(value) <= HIGH:
        raise QueryError(f'expected a number, got "{text}"')
    return int(value), int(value)


def size(text: str, now: int = 0) -> Range:
    """Bytes: a named size, or a number with a unit; fractions are cut off."""
    text = fold(text.strip())[:LONGEST]
    if text in NAMED_SIZES:
        return NAMED_SIZES[text]
    m = _SIZE.fullmatch(text)
    if not m:
        raise QueryError(f'expected a size such as 10mb, got "{text}"')
    if m[2] not in UNIT_POWERS:
        raise QueryError(f'unknown size unit "{m[2]}"')
    n = min(int(float(m[1]) * 1024.0 ** UNIT_POWERS[m[2]]), HIGH)
    return n, n


def at_local(year: int, month: int, day: int, hour: int = 0, minute: int = 0, second: int = 0) -> int:
    """Seconds since the epoch of a local time whose fields may be out of range; they carry over as mktime has it."""
    try:
        return int(time.mktime((year, month, day, hour, minute, second, 0, 0, -1)))
    except (OverflowError, ValueError) as e:
        raise QueryError(f"date out of range: {year}-{month}-{day}") from e


def date(text: str, now: int) -> Range:
    """Seconds: a named span, ``last``/``past`` N units up to now, or YYYY[-MM[-DD]] with any of - / . between."""
    text = fold(text.strip())[:LONGEST]
    t = time.localtime(now)
    y, m, d = t.tm_year, t.tm_mon, t.tm_mday
    monday = d - t.tm_wday
    named = {
        "today": ((y, m, d), (y, m, d + 1)),
        "yesterday": ((y, m, d - 1), (y, m, d)),
        "thisweek": ((y, m, monday), (y, m, monday + 7)),
        "lastweek": ((y, m, monday - 7), (y, m, monday)),
        "thismonth": ((y, m, 1), (y, m + 1, 1)),
        "lastmonth": ((y, m - 1, 1), (y, m, 1)),
        "thisyear": ((y, 1, 1), (y + 1, 1, 1)),
        "lastyear": ((y - 1, 1, 1), (y, 1, 1)),
    }
    if text in named:
        begin, end = named[text]
        return at_local(*begin), at_local(*end) - 1
    if ago := _RELATIVE.fullmatch(text):
        n, unit = int(ago[1]), ago[2]
        back = {"day": (y, m, d - n), "week": (y, m, d - 7 * n), "month": (y, m - n, d), "year": (y - n, m, d)}[unit]
        return at_local(*back, t.tm_hour, t.tm_min, t.tm_sec), now
    return _absolute(text)


def _absolute(text: str) -> Range:
    parts = [p for p in re.split(r"[-/.]", text) if p]
    fields = []
    for p in parts[:3]:
        if not _INTEGER.fullmatch(p) or abs(int(p)) >= 1 << 31:
            raise QueryError(f'unknown date "{text}"')
        fields.append(int(p))
    if not fields or len(parts) > 3:
        raise QueryError(_DATE_HELP)
    if fields[0] < 1000:
        raise QueryError(f'year must come first in "{text}"')
    begin, end = [*fields, 1, 1][: max(3, len(fields))], [*fields]
    end[-1] += 1
    return at_local(*begin[:3]), at_local(*[*end, 1, 1][:3]) - 1


def ranged(text: str, parse: Parse, now: int = 0) -> Range:
    """A value, or a comparison or ``a..b`` of values. Bounds saturate at 64 bits."""
    text = text.strip()[:LONGEST]
    for sign in (">=", "<=", ">", "<", "="):
        if text.startswith(sign):
            low, high = parse(text[len(sign) :], now)
            return {">=": (low, HIGH), "<=": (LOW, high), ">": (min(high + 1, HIGH), HIGH), "<": (LOW, max(low - 1, LOW)), "=": (low, high)}[sign]
    first, dots, last = text.partition("..")
    if not dots:
        return parse(text, now)
    return parse(first, now)[0] if first else LOW, parse(last, now)[1] if last else HIGH


#: Sort keys by their names, fixed values.
SORT_KEYS = {
    "path": "path",
    "name": "name",
    "size": "size",
    "dm": "dm",
    "modified": "dm",
    "date-modified": "dm",
    "dc": "dc",
    "created": "dc",
    "date-created": "dc",
    "ext": "ext",
    "extension": "ext",
    "relevance": "relevance",
    "rank": "relevance",
}


def sort_key(name: str) -> str:
    key = SORT_KEYS.get(fold(name))
    if key is None:
        raise QueryError(f'unknown sort key "{name}"')
    return key


#: Units of a duration in seconds, fixed values.
DURATION_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def duration(text: str) -> float:
    """Seconds of a duration such as 1h30m or 1.5s; it must be over zero."""
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)", text)
    total = sum(float(n) * DURATION_UNITS[u] for n, u in parts)
    if "".join(n + u for n, u in parts) != text or total <= 0:
        raise QueryError(f'invalid duration "{text}"')
    return total


def seconds_of(nanoseconds: int) -> int:
    """Whole seconds, rounded down."""
    return nanoseconds // 1_000_000_000

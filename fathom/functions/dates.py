"""Dates: parsing with date math, truncation to calendar units, times and time deltas."""

from __future__ import annotations

import calendar
import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = re.compile(r"(\d{4})[-/]?(\d{2})[-/]?(\d{2})(?:[T ]?(\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?\s*(Z|[+-]\d{2}:?\d{2})?")
_MATH = re.compile(r"([+-]\d+|/{1,2})([yMwdhms])")
_TIME = re.compile(r"([+-])?(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d+))?)?([+-]\d{2}:?\d{2})?")
UNITS = ("millennium", "century", "decade", "year", "month", "week", "day", "hour", "minute", "second")


def parse(text: str) -> datetime | None:
    """A date as a naive UTC datetime, with date math after "||"; null if it isn't one.

    +N and -N with a unit of y M w d h m s add; /unit goes to the end of the unit, //unit to
    its start. Weeks begin on Sunday.
    """
    body, _, math = text.strip().partition("||")
    m = _DATE.fullmatch(body.strip())
    if not m:
        return None
    try:
        at = datetime(int(m[1]), int(m[2]), int(m[3]), int(m[4] or 0), int(m[5] or 0), int(m[6] or 0), int((m[7] or "0").ljust(6, "0")[:6]))
    except ValueError:
        return None
    if m[8] and m[8] != "Z":
        sign = 1 if m[8][0] == "+" else -1
        at -= sign * timedelta(hours=int(m[8][1:3]), minutes=int(m[8][-2:]))
    return apply(at, math) if math else at


def apply(at: datetime, math: str) -> datetime:
    text = math.strip()
    if "".join(m[0] for m in _MATH.finditer(text)) != re.sub(r"\s", "", text):
        raise ValueError(f"bad date math {math!r}")
    for op, unit in _MATH.findall(text):
        at = _round(at, unit, op == "/") if op[0] == "/" else _add(at, int(op), unit)
    return at


def _add(at: datetime, n: int, unit: str) -> datetime:
    if unit in "yM":
        months = at.year * 12 + at.month - 1 + n * (12 if unit == "y" else 1)
        year, month = divmod(months, 12)
        return at.replace(year=year, month=month + 1, day=min(at.day, calendar.monthrange(year, month + 1)[1]))
    return at + n * {"w": timedelta(weeks=1), "d": timedelta(days=1), "h": timedelta(hours=1), "m": timedelta(minutes=1), "s": timedelta(seconds=1)}[unit]


def _round(at: datetime, unit: str, up: bool) -> datetime:
    start = at.replace(microsecond=0)
    for u, f in (("s", None), ("m", "second"), ("h", "minute"), ("d", "hour")):
        if f:
            start = start.replace(**{f: 0})
        if u == unit:
            break
    if unit == "w":
        start -= timedelta(days=(start.weekday() + 1) % 7)
    elif unit == "M":
        start = start.replace(day=1)
    elif unit == "y":
        start = start.replace(month=1, day=1)
    return _add(start, 1, unit) - timedelta(microseconds=1) if up else start


def from_object(value: dict) -> datetime:
    """{_year, _month, _day, _hour, _min, _sec, _fsec} or {_time: ..} beside them."""
    second, fraction = int(value.get("_sec", 0)), float(value.get("_fsec", 0))
    return datetime(int(value["_year"]), int(value.get("_month", 1)), int(value.get("_day", 1)), int(value.get("_hour", 0)), int(value.get("_min", 0)), second, int(fraction * 1e6))


def from_epoch(seconds: float) -> datetime:
    return datetime.fromtimestamp(seconds, timezone.utc).replace(tzinfo=None)


def parse_time(text: str) -> float | None:
    """Seconds of HH:MM[:SS[.f]] with an offset, or of a signed time delta."""
    m = _TIME.fullmatch(text.strip())
    if not m:
        return None
    value = int(m[2]) * 3600 + int(m[3]) * 60 + int(m[4] or 0) + float(f"0.{m[5]}" if m[5] else 0)
    if m[6]:
        value -= (1 if m[6][0] == "+" else -1) * (int(m[6][1:3]) * 3600 + int(m[6][-2:]) * 60)
    return -value if m[1] == "-" else value


def seconds_of(text: Column) -> Column:
    """Seconds of a time or time delta column of strings, null if it isn't one."""
    p = r"^([+-]?)(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?$"
    part = lambda k: F.coalesce(F.expr("nullif(x, '')") if k is None else F.when(F.regexp_extract(text, p, k) == "", None).otherwise(F.regexp_extract(text, p, k)).cast("double"), F.lit(0.0))
    value = part(2) * 3600 + part(3) * 60 + part(4)
    return F.when(text.rlike(p), F.when(F.regexp_extract(text, p, 1) == "-", -value).otherwise(value))


def truncate(at: Column, unit: str) -> Column:
    """The start of the unit that holds the timestamp; decades and up by arithmetic."""
    spans = {"decade": 10, "century": 100, "millennium": 1000}
    if unit in spans:
        n = spans[unit]
        return F.make_timestamp_ntz(F.year(at) - F.pmod(F.year(at), F.lit(n)), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}")
    return F.date_trunc(unit, at).cast("timestamp_ntz")

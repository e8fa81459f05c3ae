"""Explicit casts of query values and the guessing of a string's type."""

from __future__ import annotations

import re
import uuid
from datetime import datetime

from . import dates

_UUID = re.compile(r"(?:urn:uuid:)?\{?([0-9a-fA-F]{8}-?(?:[0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12})\}?")
_BASE59 = "0123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
KINDS = ("_integer", "_positive", "_float", "_floating", "_boolean", "_keyword", "_term", "_text", "_string", "_datetime", "_date", "_time", "_timedelta", "_uuid")


def normal_uuid(text: str) -> str | None:
    """The canonical lower-case form of a uuid in any accepted dress."""
    m = _UUID.fullmatch(text.strip())
    return str(uuid.UUID(m[1])) if m else None


def encode_uuid(text: str) -> str:
    """A compact form of a uuid: "~" and its number in base 59."""
    n, out = uuid.UUID(text).int, ""
    while n:
        n, d = divmod(n, 59)
        out = _BASE59[d] + out
    return "~" + (out or _BASE59[0])


def decode_uuid(text: str) -> str:
    n = 0
    for c in text.removeprefix("~"):
        n = n * 59 + _BASE59.index(c)
    return str(uuid.UUID(int=n))


def boolean(value: object) -> bool:
    text = str(value).strip().lower()
    if text in ("t", "true", "1"):
        return True
    if text in ("f", "false", "0", ""):
        return False
    raise ValueError(f"not a boolean: {value!r}")


def cast(kind: str, value: object) -> object:
    """The value of a cast such as {"_integer": "3"}; raises ValueError where it doesn't fit."""
    if kind in ("_integer", "_positive"):
        out = int(float(value)) if not isinstance(value, str) else int(value)
        if kind == "_positive" and out < 0:
            raise ValueError(f"{value!r} is negative")
        return out
    if kind in ("_float", "_floating"):
        return float(value)
    if kind == "_boolean":
        return boolean(value)
    if kind in ("_keyword", "_term", "_text", "_string"):
        return ("true" if value else "false") if isinstance(value, bool) else str(value)
    if kind in ("_datetime", "_date"):
        out = dates.from_object(value) if isinstance(value, dict) else dates.from_epoch(value) if isinstance(value, int | float) else dates.parse(value)
        if out is None:
            raise ValueError(f"not a date: {value!r}")
        return out
    if kind in ("_time", "_timedelta"):
        out = float(value) if isinstance(value, int | float) else dates.parse_time(value)
        if out is None:
            raise ValueError(f"not a time: {value!r}")
        return out
    if kind == "_uuid":
        out = normal_uuid(str(value))
        if out is None:
            raise ValueError(f"not a uuid: {value!r}")
        return out
    raise ValueError(f"unknown cast {kind!r}")


def guess(text: str) -> str:
    """The type of a string on first sight: uuid, datetime, time, timedelta, geo, boolean, text or keyword."""
    if normal_uuid(text):
        return "uuid"
    if isinstance(dates.parse(text), datetime):
        return "datetime"
    if re.fullmatch(r"[+-]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?", text.strip()):
        return "timedelta"
    if dates.parse_time(text) is not None:
        return "time"
    if re.match(r"(?i)\s*(srid=\d+;)?\s*(point|circle|convex|polygon|chull|multi\w+|geometry\w+)\s*(z\s*)?\(", text):
        return "geo"
    if text.lower() in ("true", "false"):
        return "boolean"
    return "text" if len(text.encode()) >= 128 or re.search(r"[^\w.\-]", text) else "keyword"

"""Reading and writing document collections: JSON, NDJSON, YAML, MessagePack, Parquet and others."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .msgpack import pack, unpack_all


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None, lines: bool = True) -> DataFrame:
    """JSON documents, one a line or one a file; comments and single quotes are allowed."""
    reader = spark.read.option("allowComments", True).option("multiLine", not lines).option("allowSingleQuotes", True)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def dump(df: DataFrame, path: str, kind: str = "ndjson", mode: str = "errorifexists") -> None:
    """Exports a collection as ndjson, parquet, orc, csv or msgpack."""
    if kind == "msgpack":
        df.select(F.to_json(F.struct("*")).alias("d")).mapInPandas(_packed, "value binary").write.mode(mode).parquet(path)
    elif kind in ("ndjson", "json"):
        write_json(df, path, mode)
    else:
        df.write.mode(mode).format(kind).save(path)


def restore(spark: SparkSession, path: str, kind: str = "ndjson", schema: T.StructType | str | None = None) -> DataFrame:
    """What dump() wrote."""
    if kind == "msgpack":
        if schema is None:
            raise ValueError("MessagePack needs a schema")
        text = spark.read.parquet(path).mapInPandas(_unpacked, "d string")
        return text.select(F.from_json("d", schema if isinstance(schema, str) else schema.simpleString()).alias("d")).select("d.*")
    if kind in ("ndjson", "json"):
        return read_json(spark, path, schema)
    reader = spark.read.format(kind)
    return (reader.schema(schema) if schema else reader).load(path)


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"value": [pack(json.loads(d)) for d in b["d"]]})


def _unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"d": [json.dumps(x) for v in b["value"] for x in unpack_all(bytes(v))]})


def strip_json(text: str) -> str:
    """JSON text without its comments and trailing commas."""
    out, i, quoted = [], 0, False
    while i < len(text):
        c = text[i]
        if quoted:
            out.append(c)
            if c == "\\":
                i += 1
                out.append(text[i : i + 1])
            quoted = c != '"'
        elif c == '"':
            quoted = True
            out.append(c)
        elif text.startswith("//", i) or c == "#":
            i = text.find("\n", i) if "\n" in text[i:] else len(text)
            continue
        elif text.startswith("/*", i):
            i = text.find("*/", i) + 2 if "*/" in text[i:] else len(text)
            continue
        else:
            if c in "}]":  # without the comma before it
                last = next((k for k in range(len(out) - 1, -1, -1) if not out[k].isspace()), None)
                if last is not None and out[last] == ",":
                    del out[last]
            out.append(c)
        i += 1
    return "".join(out)


def loads(text: str) -> object:
    return json.loads(strip_json(text))


_KEY = re.compile(r"""("(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^\s\[\]{}#"',|>&*!%@`-][^#]*?|-[^\s#][^#]*?)\s*:(?:\s+(.*))?$""")


def yaml_loads(text: str) -> object:
    """The YAML that queries and documents use: nested maps and lists, quoted and plain scalars,
    flow lists and maps, literal and folded blocks, comments. No anchors, tags or directives.
    """
    rows = []
    lines = text.splitlines()
    k = 0
    while k < len(lines):
        line, k = lines[k], k + 1
        bare = _uncommented(line).rstrip()
        if not bare.strip() or bare.startswith(("---", "...")):
            continue
        depth = len(bare) - len(bare.lstrip(" "))
        block = re.search(r"(?:^|[:\-]\s)\s*([|>])([+-]?)$", bare)
        if block:
            inner = []
            while k < len(lines) and (not lines[k].strip() or len(lines[k]) - len(lines[k].lstrip(" ")) > depth):
                inner.append(lines[k])
                k += 1
            indent = min((len(x) - len(x.lstrip(" ")) for x in inner if x.strip()), default=0)
            body = [x[indent:] for x in inner]
            joined = ("\n" if block[1] == "|" else " ").join(body).rstrip("\n ")
            rows.append((depth, bare[: block.start(1)].strip() + " " + json.dumps(joined + ("" if block[2] == "-" or not joined else "\n"))))
        else:
            rows.append((depth, bare.strip()))
    value, rest = _block(rows, rows[0][0]) if rows else (None, [])
    if rest:
        raise ValueError(f"can't read {rest[0][1]!r}")
    return value


def _uncommented(line: str) -> str:
    """The line without a comment, which begins with "#" at its start or after a space, outside quotes."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote and not (quote == '"' and line[i - 1] == "\\") else quote
        elif c in "\"'" and (i == 0 or line[i - 1] in " \t[{,:-'"):  # '' within quotes is one of them
            quote = c
        elif c == "#" and (i == 0 or line[i - 1] in " \t"):
            return line[:i]
    return line


def _scalar(x: str) -> object:
    if x[:1] in "[{":
        value, rest = _flow(x)
        if rest.strip():
            raise ValueError(f"can't read {rest!r}")
        return value
    if len(x) > 1 and x[0] == x[-1] == "'":
        return x[1:-1].replace("''", "'")
    known = {"null": None, "~": None, "": None, "yes": True, "no": False, "true": True, "false": False, "on": True, "off": False}
    if x.lower() in known:
        return known[x.lower()]
    try:
        return json.loads(x)
    except ValueError:
        return x


def _flow(x: str) -> tuple[object, str]:
    """The value of a flow list or map at the beginning of x, and what follows it."""
    x = x.lstrip()
    if x[:1] not in ("[", "{"):
        m = re.match(r"""("(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^,\]}]*)""", x)
        return _scalar(m[1].strip()), x[m.end() :].lstrip()
    close, listed = ("]", True) if x[0] == "[" else ("}", False)
    items: list = []
    x = x[1:].lstrip()
    while not x.startswith(close):
        if listed:
            item, x = _flow(x)
        else:
            m = re.match(r"""("(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^:,}]*?)\s*:\s*""", x)
            if not m:
                raise ValueError(f"a key is missing: {x!r}")
            value, x = _flow(x[m.end() :])
            item = str(_scalar(m[1])), value
        items.append(item)
        if x.startswith(","):
            x = x[1:].lstrip()
        elif not x.startswith(close):
            raise ValueError(f"{close!r} is missing: {x!r}")
    return (items if listed else dict(items)), x[1:].lstrip()


def _block(rows: list, depth: int) -> tuple[object, list]:
    first = rows[0][1]
    if first == "-" or first.startswith("- "):
        items: list = []
        while rows and rows[0][0] == depth and (rows[0][1] == "-" or rows[0][1].startswith("- ")):
            inner = rows[0][1][1:]
            within = depth + 1 + len(inner) - len(inner.lstrip())
            inner, rows = inner.strip(), rows[1:]
            if not inner:
                value, rows = _block(rows, rows[0][0]) if rows and rows[0][0] > depth else (None, rows)
            elif inner == "-" or inner.startswith("- ") or inner[0] not in "[{" and _KEY.match(inner):
                value, rows = _block([(within, inner), *rows], within)
            else:
                value = _scalar(inner)
            items.append(value)
        return items, rows
    if first[0] in "[{" or not _KEY.match(first):
        return _scalar(first), rows[1:]
    out: dict = {}
    while rows and rows[0][0] == depth:
        m = _KEY.match(rows[0][1])
        if not m:
            break
        key, inner, rows = m[1], (m[2] or "").strip(), rows[1:]
        name = str(_scalar(key)) if key[0] in "\"'" else key
        if inner:
            out[name] = _scalar(inner)
        elif rows and (rows[0][0] > depth or rows[0][0] == depth and (rows[0][1] == "-" or rows[0][1].startswith("- "))):
            out[name], rows = _block(rows, rows[0][0])
        else:
            out[name] = None
    return out, rows

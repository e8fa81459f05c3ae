"""Schemas of untyped documents: inference on first sight, then fixed types.

infer() reads the JSON type of every path and what strings look like, in one aggregation;
a path of two types is a conflict, unless one is a wider number.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a string is taken for, in this order, each by a pattern over the whole string.
DETECTORS = [
    ("uuid", r"^(urn:uuid:)?\{?[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}\}?$"),
    ("datetime", r"^\d{4}[-/]?\d{2}[-/]?\d{2}([T ]?\d{2}:?\d{2}(:?\d{2}([.,]\d+)?)?)?\s*(Z|[+-]\d{2}:?\d{2})?(\|\|.*)?$"),
    ("timedelta", r"^[+-]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?$"),
    ("time", r"^\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?([+-]\d{2}:?\d{2})?$"),
    ("geo", r"(?i)^\s*(srid=\d+;)?\s*(point|circle|convex|polygon|chull|multi\w+|geometry\w+)\s*(z\s*)?\(.*$"),
    ("boolean", r"(?i)^(true|false)$"),
]
WIDER = {("positive", "integer"): "integer", ("integer", "floating"): "floating", ("positive", "floating"): "floating"}


class TypeMismatch(Exception):
    """A path holds values of types that don't go together."""


@dataclass(frozen=True)
class FieldSpec:
    path: str
    type: str
    array: bool = False


_PATTERNS = [(kind, re.compile(pattern, re.ASCII)) for kind, pattern in DETECTORS]
_PLAIN = re.compile(r"[\w.\-]*", re.ASCII)


@lru_cache(maxsize=50_000)
def string_type(x: str) -> str:
    """uuid, datetime, timedelta, time, geo, boolean, text or keyword."""
    for kind, pattern in _PATTERNS:
        if pattern.search(x):
            return kind
    return "keyword" if len(x.encode()) < 128 and _PLAIN.fullmatch(x) else "text"


def _refuse(name: str):
    raise ValueError(f"not JSON: {name}")


def document_types(text: str) -> Iterator[tuple[str, str, bool]]:
    """(path, type, array) of every value of a JSON text but nulls, however deep."""
    todo = [("", False, json.loads(text, parse_constant=_refuse))]
    while todo:
        path, array, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{path}.{k}" if path else k, array, x) for k, x in v.items() if k and not k.startswith("#")]
        elif isinstance(v, list):
            todo += [(path, True, x) for x in v]
        elif isinstance(v, str):
            yield path, string_type(v) if len(v) < 256 else "text", array
        elif isinstance(v, bool):
            yield path, "boolean", array
        elif isinstance(v, float) or isinstance(v, int) and not -(2**63) <= v < 2**63:
            yield path, "floating", array
        elif v is not None:
            yield path, "integer" if v < 0 else "positive", array


def type_counts(df: DataFrame, json_col: str) -> DataFrame:
    """path, type, array, n: how many values of each type a JSON column holds at each path.

    No expression walks documents of any depth, so this is one Arrow-batched pass, of which
    each task gives its own counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text is not None:
                    seen.update(document_types(text))
        paths, kinds, arrays = zip(*seen, strict=True) if seen else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(kinds, pa.string()), pa.array(arrays, pa.bool_()), pa.array(list(seen.values()), pa.int64())], names=["path", "type", "array", "n"])

    found = df.select(F.col(json_col).cast("string").alias("j")).mapInArrow(run, "path string, type string, array boolean, n long")
    return found.groupBy("path", "type", "array").agg(F.sum("n").alias("n"))


def infer(df: DataFrame, json_col: str) -> dict[str, FieldSpec]:
    """The frozen schema of a JSON column: path -> FieldSpec. Bounded by the number of paths."""
    out: dict[str, FieldSpec] = {}
    for r in type_counts(df, json_col).orderBy("path", "type").collect():
        before = out.get(r.path)
        kind = r.type
        if before and before.type != kind:
            pair = tuple(sorted((before.type, kind), key=lambda t: {"positive": 0, "integer": 1, "floating": 2}.get(t, 9)))
            kind = WIDER.get(pair) or ("text" if {before.type, kind} <= {"text", "keyword"} else None)
            if kind is None:
                raise TypeMismatch(f"{r.path} holds {before.type} and {r.type}")
        out[r.path] = FieldSpec(r.path, kind, r.array or bool(before and before.array))
    return out

"""Sorting by value or by distance, paging, collapsing and field selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..functions.strings import metric, metric_of_each
from ..plans.compiler import Compiler, Schema, _literal


def sort_keys(schema: Schema, spec: object, default_metric: str | None = None) -> list[Column]:
    """Orderings of "f", "+f", "-f", "f:value", {"f": {_order, _value, _metric}} or a list.

    Arrays sort by their least element, or greatest if descending; missing values come last
    either way. With _value, by the distance to it.
    """
    if isinstance(spec, list):
        return [k for s in spec for k in sort_keys(schema, s, default_metric)]
    if isinstance(spec, str):
        down = spec.startswith("-")
        name, _, value = spec.lstrip("+-").partition(":")
        body = {"_order": "desc" if down else "asc"} | ({"_value": value} if value else {})
        return [_key(schema, name, body, default_metric)]
    return [_key(schema, name, {"_order": body} if isinstance(body, str) else body, default_metric) for name, body in spec.items()]


def _key(schema: Schema, name: str, body: dict, default_metric: str | None) -> Column:
    down = body.get("_order", "asc") == "desc"
    unknown = {k for k in body if k.startswith("_")} - {"_order", "_value", "_metric", "_icase", "_language"}
    shapes = [k for k in unknown if k[1:].upper() in geo.KINDS or k == "_ewkt"]
    if name in schema.points:
        given = body.get("_value") or ({shapes[0]: body[shapes[0]]} if shapes else None)
        if given is None:
            raise ValueError("a place is sorted by its distance to another, which is missing")
        shape = geo.parse_ewkt(given) if isinstance(given, str) else geo.from_object(*next(iter(given.items())))
        key = geo.angle(*schema.points[name], *shape.centroid())
        return key.desc_nulls_last() if down else key.asc_nulls_last()
    f = schema.find(name)
    if f is None:
        return F.lit(None).asc()
    if "_value" in body:
        key = _distance(schema, f, body, down, default_metric)
    else:
        key = (F.array_max(f.column) if down else F.array_min(f.column)) if f.array else f.column
    return key.desc_nulls_last() if down else key.asc_nulls_last()


def _distance(schema: Schema, f, body: dict, down: bool, default_metric: str | None) -> Column:
    value = Compiler(schema).convert(f, body["_value"])
    if value is None:
        raise ValueError(f"{body['_value']!r} isn't of the type of {f.name}")
    if isinstance(f.element, T.StringType):
        asked = body.get("_metric", default_metric or "jaro"), bool(body.get("_icase")), body.get("_language", "en")
        if not f.array:
            return metric(*asked)(f.column, F.lit(value))
        each = F.array_compact(metric_of_each(*asked)(f.column, F.lit(value)))
        return F.array_max(each) if down else F.array_min(each)
    if isinstance(f.element, T.BooleanType):
        one = lambda x: F.when(x == value, 0.0).otherwise(1.0)
    elif isinstance(f.element, T.TimestampType | T.TimestampNTZType | T.DateType):
        one = lambda x: F.abs(F.unix_micros(x.cast("timestamp")) - F.unix_micros(_literal(value).cast("timestamp"))) / 1e6
    else:
        one = lambda x: F.abs(x - F.lit(value))
    if not f.array:
        return F.when(f.column.isNotNull(), one(f.column))
    each = F.transform(f.column, one)
    return F.array_max(each) if down else F.array_min(each)


def page(df: DataFrame, keys: list[Column], offset: int = 0, limit: int = 10) -> DataFrame:
    """A page of the ordering; a top-k merges each task's best and sorts nothing else."""
    out = df.orderBy(*keys)
    return (out.offset(offset) if offset else out).limit(limit)


def collapse(df: DataFrame, key: Column, keys: list[Column], most: int = 1) -> DataFrame:
    """The first `most` rows of each key in the ordering; rows without a key all stay."""
    ranked = df.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*keys)))
    return ranked.where(key.isNull() | (F.col("__k") <= most)).drop("__k")


def parse_selector(text: str) -> dict | str:
    """{"a": {}, "b": {"c": {}}} of "{a,b{c}}", or the path of "a.b.c"."""
    text = text.strip()
    if not text.startswith("{"):
        return text
    at = 1

    def fields() -> dict:
        nonlocal at
        out, name = {}, ""
        while at < len(text):
            c = text[at]
            at += 1
            if c == "{":
                out[name.strip()] = fields()
                name = ""
            elif c in ",}":
                if name.strip():
                    out[name.strip()] = {}
                name = ""
                if c == "}":
                    return out
            else:
                name += c
        raise ValueError(f"'}}' is missing: {text!r}")

    out = fields()
    if at != len(text):
        raise ValueError(f"text after the selector: {text[at:]!r}")
    return out


def select(df: DataFrame, selector: str) -> DataFrame:
    """The fields of a selector; only their columns are read."""
    tree = parse_selector(selector)
    if isinstance(tree, str):
        return df.select(F.col(tree).alias(tree.rpartition(".")[2]))

    def build(kind: T.StructType, at: Column | None, below: dict) -> list[Column]:
        out = []
        for name, inner in below.items():
            if name not in kind.names:
                continue
            col = F.col(f"`{name}`") if at is None else at[name]
            sub = kind[name].dataType
            if inner and isinstance(sub, T.StructType):
                col = F.struct(*build(sub, col, inner))
            elif inner and isinstance(sub, T.ArrayType) and isinstance(sub.elementType, T.StructType):
                col = F.transform(col, _inner(build, sub.elementType, inner))
            out.append(col.alias(name))
        return out

    return df.select(*build(df.schema, None, tree))


def _inner(build, kind: T.StructType, keep: dict):
    return lambda x: F.struct(*build(kind, x, keep))

"""From query documents to Spark expressions.

compile_query() turns a JSON query (or what a query string was parsed to) into a predicate
and, where asked for, a relevance weight, both plain Columns over the document DataFrame, so
that Catalyst prunes, pushes down and fuses them. Weights of text terms need corpus figures
(document count, mean length, document frequencies); these are counted in one aggregation
for all terms of the query before the expression is built.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import casts, dates, geo, porter, text
from .querystring import parse, parse_range, parse_text, unquote

BM25_K1, BM25_K3, BM25_B, BM25_MIN_LEN = 1.0, 1.0, 0.5, 0.5
ELITE = 10
EXPANSION = 50
OPERATORS = ("_and", "_or", "_not", "_and_not", "_xor", "_and_maybe", "_filter", "_elite_set", "_synonym", "_max", "_scale_weight")
MODIFIERS = ("_and", "_or", "_near", "_phrase", "_elite_set", "_synonym", "_max", "_wildcard", "_partial", "_fuzzy")
GEO = tuple("_" + k.lower() for k in geo.KINDS) + ("_ewkt",)


@dataclass
class Field:
    """How a field is searched. column: its Column; element: its (element) type."""

    name: str
    column: Column
    element: T.DataType
    array: bool
    text: bool = False
    bool_term: bool = False
    stemmed: bool = False

    @property
    def key(self) -> str:
        return f"{self.name}~" if self.stemmed else self.name


@dataclass
class Schema:
    """The searched DataFrame's fields.

    text: names of full-text fields; bool_terms: keyword fields compared with case; points:
    name -> (longitude, latitude) columns; spread: ranking by all text fields together isn't
    done: lengths are counted by field. Fields with an upper-case letter in the name are
    bool_terms, as are those listed. weights: name -> what each occurrence in a text field
    counts for in ranking. Words of stop_language, or stop_words, are no tokens. stem: "some"
    compares stems of plain words that don't begin with a capital letter, "all" of all words
    but in patterns (English; see porter). cjk: see text.tokens. meshes: name of a place ->
    (column of its mesh ids, their level); where there is one, shapes are looked for by
    ranges of ids first, which a scan of sorted files can skip by.
    """

    frame: DataFrame
    text: tuple[str, ...] = ()
    bool_terms: tuple[str, ...] = ()
    points: dict[str, tuple[Column, Column]] = field(default_factory=dict)
    meshes: dict[str, tuple[str, int]] = field(default_factory=dict)
    id_field: str | None = None
    stop_language: str | None = None
    stop_words: tuple[str, ...] = ()
    stem: str | None = None
    cjk: bool = False
    weights: dict[str, float] = field(default_factory=dict)
    open_ranges: bool = False
    known: dict = field(default_factory=dict, init=False, repr=False, compare=False)  # what corpus() has counted of the frame

    @property
    def stops(self) -> list[str]:
        return [*text.STOP_WORDS.get(self.stop_language or "", []), *self.stop_words]

    def find(self, name: str) -> Field | None:
        kind: T.DataType = self.frame.schema
        array = False
        col: Column | None = None
        parts = name.split(".")
        for i, part in enumerate(parts):
            if isinstance(kind, T.ArrayType):
                array, kind = True, kind.elementType
            if isinstance(kind, T.MapType):
                rest = parts[i:]
                values = F.map_values(F.map_filter(col, _under(rest)))
                return Field(name, values, kind.valueType, True)
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return None
            kind = kind[part].dataType
            col = F.col(f"`{part}`") if col is None else col[part]
        if isinstance(kind, T.ArrayType):
            array, kind = True, kind.elementType
            while isinstance(kind, T.ArrayType):
                col, kind = F.flatten(col), kind.elementType
        return Field(name, col, kind, array, name in self.text, name in self.bool_terms or any(c.isupper() for c in parts[-1]))

    def of_type(self, value: object) -> list[Field]:
        """Fields that a query without a field looks into: those of the value's type."""
        found = [self.find(n) for n in self.frame.columns]
        want = (T.BooleanType,) if isinstance(value, bool) else (T.NumericType,) if isinstance(value, int | float) else (T.TimestampType, T.TimestampNTZType, T.DateType) if isinstance(value, datetime) else (T.StringType,)
        return [f for f in found if f is not None and isinstance(f.element, want)]


def _under(rest: list[str]) -> Callable[[Column, Column], Column]:
    """Whether a namespace's key holds the path's parts in order, ending in the last."""
    return lambda key, _: key.rlike("(^|.*\\.)" + "\\.(.*\\.)?".join(rest) + "$")


@dataclass
class Term:
    """One weighted text term of the query."""

    field: Field
    word: str
    wqf: int = 1


@dataclass
class Node:
    """A compiled query: its predicate, and its weight given what corpus() has counted."""

    match: Column
    weight: Callable[[dict], Column]
    terms: list[Term] = field(default_factory=list)


_ZERO = lambda _: F.lit(0.0)
_ONE = lambda _: F.lit(1.0)


def _all(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols) if cols else F.lit(True)


def _any(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols) if cols else F.lit(False)


def _sum(nodes: list[Node]) -> Callable[[dict], Column]:
    def weight(stats: dict) -> Column:
        return reduce(lambda a, b: a + b, [F.when(n.match, n.weight(stats)).otherwise(0.0) for n in nodes], F.lit(0.0))

    return weight


def _greatest(nodes: list[Node]) -> Callable[[dict], Column]:
    def weight(stats: dict) -> Column:
        return F.greatest(F.lit(0.0), *[F.when(n.match, n.weight(stats)).otherwise(0.0) for n in nodes]) if nodes else F.lit(0.0)

    return weight


class Compiler:
    def __init__(self, schema: Schema):
        self.schema = schema

    # -- compound queries

    def query(self, q: object, op: str = "_and", path: str = "") -> Node:
        if q == "*" and not path:
            return Node(F.lit(True), _ZERO)
        if isinstance(q, str):
            return self.query(parse(q), op, path) if not path else self.leaf(path, q)
        if isinstance(q, list):
            return self.combine(op, [self.query(x, op, path) for x in q])
        if not isinstance(q, dict):
            return self.leaf(path, q)
        nodes = []
        for key, value in q.items():
            if not key or key.startswith("#"):
                continue
            nodes.append(self.entry(key, value, op, path))
        return nodes[0] if len(nodes) == 1 else self.combine(op, nodes)

    def entry(self, key: str, value: object, op: str, path: str) -> Node:
        if key == "_match_all":
            return Node(F.lit(True), _ZERO)
        if key == "_match_none":
            return Node(F.lit(False), _ZERO)
        if key == "_scale_weight" or key == "_boost":
            inner = self.query(value["_query"], op, path)
            factor = float(value["_factor"])
            return Node(inner.match, lambda s: inner.weight(s) * factor, inner.terms)
        if key in OPERATORS:
            if key in MODIFIERS and path and not isinstance(value, list | dict):
                return self.leaf(path, {key: value})
            items = value if isinstance(value, list) else [{k: v} for k, v in value.items()] if isinstance(value, dict) else [value]
            return self.combine(key, [self.query(x, "_or" if key == "_not" else key, path) for x in items])
        if key == "_id":
            return self.leaf(self.schema.id_field or "_id", value)
        if key == "_value":
            return self.anywhere(value)
        name = f"{path}.{key}" if path else key
        if isinstance(value, dict) and not any(k.startswith("_") and k not in ("_and", "_or", "_not", "_and_not", "_xor") for k in value):
            if any(k in OPERATORS and isinstance(v, list) for k, v in value.items()) or not any(k.startswith("_") for k in value):
                return self.query(value, op, name)
        return self.leaf(name, value)

    def combine(self, op: str, nodes: list[Node]) -> Node:
        terms = [t for n in nodes for t in n.terms]
        if not nodes:
            return Node(F.lit(True), _ZERO)
        first, rest = nodes[0], nodes[1:]
        if op == "_and":
            return Node(_all([n.match for n in nodes]), _sum(nodes), terms)
        if op == "_or":
            return Node(_any([n.match for n in nodes]), _sum(nodes), terms)
        if op == "_not":
            return Node(~_any([F.coalesce(n.match, F.lit(False)) for n in nodes]), _ZERO)
        if op == "_and_not":
            return Node(first.match & ~_any([F.coalesce(n.match, F.lit(False)) for n in rest]), first.weight, first.terms)
        if op == "_xor":
            odd = reduce(lambda a, b: a + b, [F.coalesce(n.match, F.lit(False)).cast("int") for n in nodes])
            return Node(odd % 2 == 1, _sum(nodes), terms)
        if op == "_and_maybe":
            return Node(first.match, _sum(nodes), terms)
        if op == "_filter":
            return Node(_all([n.match for n in nodes]), first.weight, first.terms)
        if op in ("_synonym", "_max"):
            return Node(_any([n.match for n in nodes]), _greatest(nodes), terms)
        if op == "_elite_set":
            return self.elite(nodes)
        raise ValueError(f"unknown operator {op!r}")

    def elite(self, nodes: list[Node], size: int = ELITE) -> Node:
        """OR of the `size` subqueries whose terms weigh most."""
        terms = [t for n in nodes for t in n.terms]
        if len(nodes) > size:
            stats = corpus(self.schema, terms)
            nodes = sorted(nodes, key=lambda n: -sum(most_weight(stats, t) for t in n.terms))[:size]
            terms = [t for n in nodes for t in n.terms]
        return Node(_any([n.match for n in nodes]), _sum(nodes), terms)

    # -- leaves

    def anywhere(self, value: object) -> Node:
        """A value without a field: any field of its type."""
        if isinstance(value, dict) and "_in" not in value and len(value) == 1:
            ((kind, v),) = value.items()
            value = casts.cast(kind, v)
        if isinstance(value, str):
            bare = unquote(value)
            found = [bare]
            for convert in (int, float):
                try:
                    found.append(convert(bare))
                    break
                except ValueError:
                    pass
            nodes = [self.leaf(f.name, value) for v in found for f in self.schema.of_type(v)]
        elif isinstance(value, dict):
            bounds = value["_in"].get("_range", {}) if isinstance(value["_in"], dict) else parse_range(value["_in"])
            numeric = all(not isinstance(b, str) or _number(b) is not None for k, b in bounds.items() if k != "_open")
            nodes = [self.leaf(f.name, value) for f in self.schema.of_type(1 if numeric else "")]
        else:
            nodes = [self.leaf(f.name, value) for f in self.schema.of_type(value)]
        return self.combine("_or", nodes) if nodes else Node(F.lit(False), _ZERO)

    def leaf(self, name: str, value: object) -> Node:
        f = self.schema.find(name)
        if f is None:
            if name in self.schema.points:
                return self.located(name, value)
            head, _, last = name.rpartition(".")
            if last.startswith("_") and (self.schema.find(head) is not None or head in self.schema.points):
                return self.bucket(head, last, value)
            return Node(F.lit(False), _ZERO)
        if isinstance(value, dict):
            return self.structured(f, value)
        if value is None or value == "":
            return Node(f.column.isNull() if not f.array else f.column.isNull() | (F.size(f.column) == 0), _ZERO)
        if value == "*":
            return Node(f.column.isNotNull() if not f.array else F.coalesce(F.size(f.column) > 0, F.lit(False)), _ZERO)
        if isinstance(value, list):
            return self.combine("_or", [self.leaf(name, v) for v in value])
        if isinstance(value, str) and isinstance(f.element, T.StringType):
            return self.text(f, value, "_or") if f.text else self.keyword(f, value)
        bounds = parse_range(value) if isinstance(value, str) and not isinstance(f.element, T.StringType) else None
        if bounds is not None:
            return self.ranged(f, bounds)
        typed = self.convert(f, value)
        return Node(self.each(f, lambda x: x == _literal(typed)), _ZERO) if typed is not None else self.fallback(f, value)

    def fallback(self, f: Field, value: object) -> Node:
        """A value that isn't of the field's type: fields of the value's own type are searched."""
        return self.combine("_or", [self.leaf(g.name, value) for g in self.schema.of_type(value) if g.name != f.name]) if self.schema.of_type(value) else Node(F.lit(False), _ZERO)

    def each(self, f: Field, test: Callable[[Column], Column]) -> Column:
        """The test on the value, or on any of an array's."""
        return F.coalesce(F.exists(f.column, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False)) if f.array else test(f.column)

    def convert(self, f: Field, value: object) -> object | None:
        """The value in the field's type, or null."""
        try:
            if isinstance(f.element, T.BooleanType):
                return casts.boolean(value)
            if isinstance(f.element, T.IntegralType):
                if isinstance(value, str):
                    n = _number(unquote(value))
                    return None if n is None else int(n) if n == int(n) else n
                return value
            if isinstance(f.element, T.NumericType):
                return float(unquote(value) if isinstance(value, str) else value)
            if isinstance(f.element, T.TimestampType | T.TimestampNTZType | T.DateType):
                return value if isinstance(value, datetime) else casts.cast("_datetime", unquote(value) if isinstance(value, str) else value)
            return str(value).lower() if isinstance(value, bool) else str(value)
        except (ValueError, TypeError):
            return None

    def structured(self, f: Field, value: dict) -> Node:
        nodes = []
        for key, v in value.items():
            if key == "_in":
                nodes.append(self.contained(f, v))
            elif key in MODIFIERS:
                nodes.append(self.modified(f, key, v))
            elif key in GEO:
                nodes.append(self.located(f.name, {key: v}))
            elif key in ("_value",):
                nodes.append(self.leaf(f.name, v))
            elif key in casts.KINDS:
                nodes.append(self.leaf(f.name, casts.cast(key, v)))
            elif key.startswith("_") and key[1:]:
                nodes.append(self.bucket(f.name, key, v))
            else:
                nodes.append(self.leaf(f"{f.name}.{key}", v))
        return self.combine("_and", nodes)

    def contained(self, f: Field, value: object) -> Node:
        if isinstance(value, str):
            bounds = parse_range(value)
            return self.ranged(f, bounds) if bounds is not None else self.leaf(f.name, value)
        ((key, v),) = value.items()
        return self.ranged(f, v) if key == "_range" else self.located(f.name, value)

    def ranged(self, f: Field, bounds: dict) -> Node:
        low, high = bounds.get("_from"), bounds.get("_to")
        unwrap = lambda b: casts.cast(*next(iter(b.items()))) if isinstance(b, dict) and next(iter(b)) in casts.KINDS else b
        low, high = (None if b is None else self.convert(f, unwrap(b)) for b in (low, high))
        if (low is None and bounds.get("_from") is not None) or (high is None and bounds.get("_to") is not None):
            return Node(F.lit(False), _ZERO)
        if low is None and high is None:
            return Node(F.lit(True), _ONE)
        if low is not None and high is not None and low > high:
            return Node(F.lit(False), _ZERO)
        kind = bounds.get("_open", "[]") if self.schema.open_ranges else "[]"

        def test(x: Column) -> Column:
            parts = []
            if low is not None:
                parts.append(x > _literal(low) if kind[0] == "(" else x >= _literal(low))
            if high is not None:
                parts.append(x < _literal(high) if kind[1] == ")" else x <= _literal(high))
            return _all(parts)

        return Node(self.each(f, test), _ONE)

    def keyword(self, f: Field, value: str, mode: str = "") -> Node:
        value = unquote(value)
        fold = (lambda c: c) if f.bool_term else F.lower
        value = value if f.bool_term else value.lower()
        fuzzy = value.rpartition("~")
        if mode == "_fuzzy" or fuzzy[1] and (fuzzy[2].isdigit() or not fuzzy[2]):
            word, most = (fuzzy[0], int(fuzzy[2] or 2)) if fuzzy[1] else (value, 2)
            return Node(self.each(f, lambda x: F.levenshtein(fold(x), F.lit(word), most) >= 0), _ZERO)
        if mode == "_partial" or value.endswith("**"):
            prefix = value.rstrip("*")
            few = self.frequent_values(f, fold, prefix)
            return Node(self.each(f, lambda x: fold(x).startswith(prefix) if few is None else fold(x).isin(few)), _ZERO)
        if "*" in value or "?" in value and mode == "_wildcard":
            if value.find("*") == len(value) - 1 and "?" not in value:
                return Node(self.each(f, lambda x: fold(x).startswith(value[:-1])), _ZERO)
            return Node(self.each(f, lambda x: fold(x).rlike(text.glob(value))), _ZERO)
        return Node(self.each(f, lambda x: fold(x) == value), _ZERO)

    def modified(self, f: Field, key: str, value: object) -> Node:
        value = value if isinstance(value, str) else str(value)
        if not f.text:
            return self.keyword(f, value, key)
        toks, ws = self.tokens(f), text.words(value)
        if key in ("_near", "_phrase") and ws:
            test = text.has_near if key == "_near" else text.has_ordered
            ws = [porter.stem(w) for w in ws] if self.schema.stem == "all" else ws
            return self.weighed(test(toks, ws, len(ws) + 9), f, ws)
        if key in ("_wildcard", "_partial", "_fuzzy"):
            end = {"_wildcard": "", "_partial": "**", "_fuzzy": "~"}[key]
            return self.text(f, " ".join(w + end for w in value.split()), "_or")
        if key in ("_elite_set", "_synonym", "_max"):
            return self.combine(key, [self.word(f, w) for w in dict.fromkeys(ws)])
        return self.text(f, value, key)

    # -- text

    def source(self, f: Field) -> Column:
        return F.array_join(f.column, " ") if f.array else f.column

    def tokens(self, f: Field) -> Column:
        found = text.tokens(self.source(f), self.schema.stops, self.schema.cjk)
        return porter.stems(found) if f.stemmed or self.schema.stem == "all" else found

    def word(self, f: Field, w: str, capital: bool = False) -> Node:
        if self.schema.cjk and len(grams := text.cjk_words(w)) > 1:
            return self.combine("_and", [self.weighed(F.array_contains(self.tokens(f), g), f, [g]) for g in grams])
        if self.schema.stem == "all" or self.schema.stem == "some" and not capital:
            f, w = replace(f, stemmed=True), porter.stem(w)
        return self.weighed(F.array_contains(self.tokens(f), w), f, [w])

    def weighed(self, match: Column, f: Field, ws: list[str]) -> Node:
        """match, which all of the words are needed for; texts without them aren't split into tokens."""
        terms = [Term(f, w, ws.count(w)) for w in dict.fromkeys(ws)]
        factor = self.schema.weights.get(f.name, 1)
        held = match if f.stemmed or self.schema.stem == "all" else text.may_hold(self.source(f), ws) & match
        return Node(held, lambda s: reduce(lambda a, b: a + b, [bm25(s, t, F.col(token_column(f)), factor) for t in terms]), terms)

    def text(self, f: Field, value: str, op: str) -> Node:
        if op in ("_and", "_or") and any(w in value.split() for w in ("AND", "OR", "NOT", "XOR")):
            return self.query(_in_field(parse(value), f.name))
        q = parse_text(value)
        stop = self.schema.stops
        loose = [i for i in q.any if not (i[0] == "word" and i[1] in stop)]
        any_of = [self.part(f, i) for i in loose]
        must, never = ([self.part(f, i) for i in items] for items in (q.must, q.never))
        body = self.combine(op, any_of) if any_of else None
        if must:
            node = self.combine("_and", must)
            node = self.combine("_and_maybe", [node, body]) if body else node
        else:
            node = body or Node(F.lit(bool(never)), _ZERO)
        return self.combine("_and_not", [node, *never]) if never else node

    def part(self, f: Field, item: tuple) -> Node:
        kind, value = item[:2]
        if kind == "word":
            return self.word(f, value, len(item) > 2)
        toks = self.tokens(f)
        value = [porter.stem(w) for w in value] if self.schema.stem == "all" and isinstance(value, list) else value
        if kind in ("near", "adj"):
            return self.weighed((text.has_near if kind == "near" else text.has_ordered)(toks, value, item[2]), f, value)
        if kind == "phrase":
            return self.weighed(text.has_phrase(toks, value), f, value)
        if kind == "wild":
            return Node(F.exists(toks, lambda w: w.rlike(text.glob(value))), _ZERO)
        if kind == "fuzzy":
            return Node(F.exists(toks, lambda w: F.levenshtein(w, F.lit(value), item[2]) >= 0), _ZERO)
        match = F.exists(toks, lambda w: w.startswith(value))
        return Node(match if self.schema.stem == "all" else text.may_hold(self.source(f), [value]) & match, _ZERO)

    def frequent_values(self, f: Field, fold: Callable[[Column], Column], prefix: str) -> list[str] | None:
        """The EXPANSION most frequent values that begin so; null if there are no more than these."""
        values = self.schema.frame.select(F.explode(F.array_distinct(f.column)).alias("v") if f.array else f.column.alias("v")).select(fold(F.col("v")).alias("v"))
        rows = values.where(F.col("v").startswith(prefix)).groupBy("v").count().orderBy(F.desc("count"), "v").limit(EXPANSION + 1).collect()
        return [r.v for r in rows[:EXPANSION]] if len(rows) > EXPANSION else None

    # -- buckets and places

    def bucket(self, name: str, unit: str, value: object) -> Node:
        """Equality with the value cut to an accuracy: f._100, f._day, f._geo5."""
        unit = unit[1:]
        if unit.startswith("geo") and name in self.schema.points:
            lon, lat = self.schema.points[name]
            return Node(geo.trixel(lon, lat, int(unit[3:])) == int(value), _ZERO)
        f = self.schema.find(name)
        if f is None:
            return Node(F.lit(False), _ZERO)
        if unit.isdigit():
            typed = self.convert(f, value)
            if typed is None:
                return Node(F.lit(False), _ZERO)
            step = int(unit)
            return Node(self.each(f, lambda x: x - F.pmod(x, F.lit(step)) == typed - typed % step), _ZERO)
        if unit in dates.UNITS:
            typed = self.convert(f, value)
            if typed is None:
                return Node(F.lit(False), _ZERO)
            return Node(self.each(f, lambda x: dates.truncate(x, unit) == dates.truncate(_literal(typed), unit)), _ZERO)
        seconds = {"tsecond": 1, "tminute": 60, "thour": 3600, "tdsecond": 1, "tdminute": 60, "tdhour": 3600}.get(unit)
        if seconds is None:
            raise ValueError(f"unknown accuracy {unit!r}")
        at = value if isinstance(value, int | float) else dates.parse_time(value)
        return Node(self.each(f, lambda x: F.floor((dates.seconds_of(x) if isinstance(f.element, T.StringType) else x) / seconds) == math.floor(at / seconds)), _ZERO)

    def located(self, name: str, value: object) -> Node:
        if name not in self.schema.points:
            return Node(F.lit(False), _ZERO)
        lon, lat = self.schema.points[name]
        if value in (None, "", "*"):
            here = lon.isNotNull() & lat.isNotNull()
            return Node(here if value == "*" else ~here, _ZERO)
        if isinstance(value, str):
            shape = geo.parse_ewkt(value)
        else:
            inner = value.get("_in", value)
            ((kind, v),) = inner.items() if isinstance(inner, dict) else (("_ewkt", inner),)
            shape = geo.parse_ewkt(v) if kind == "_ewkt" else geo.from_object(kind, v)
        held = shape.contains(lon, lat)
        if name in self.schema.meshes:
            ids, level = self.schema.meshes[name]
            held = _any([F.col(ids).between(a, b) for a, b in geo.cover(shape, level)]) & held
        return Node(F.coalesce(held, F.lit(False)), lambda _: math.pi - geo.angle(lon, lat, *shape.centroid()))


def _in_field(q: object, name: str) -> object:
    """A parsed boolean text with its words put into the field."""
    if isinstance(q, dict):
        return {k: [_in_field(x, name) for x in v] if isinstance(v, list) else v for k, v in q.items() if k != "_value"} | ({name: q["_value"]} if "_value" in q else {})
    return q


def _number(value: str) -> float | None:
    try:
        return float(value)
    except ValueError:
        return None


def _literal(value: object) -> Column:
    return F.lit(value).cast("timestamp_ntz") if isinstance(value, datetime) else F.lit(value)


# -- ranking


def token_column(f: Field) -> str:
    """The column that holds a field's tokens while documents are weighed; see tokenised()."""
    return f"__tokens.{f.key}".replace(".", "_")


def tokenised(schema: Schema, frame: DataFrame, terms: list[Term]) -> DataFrame:
    """The frame with the tokens of the terms' fields, each split once a row."""
    comp = Compiler(schema)
    fields = {t.field.key: t.field for t in terms}
    return frame.select("*", *[comp.tokens(f).alias(token_column(f)) for f in fields.values()])


def corpus(schema: Schema, terms: list[Term]) -> dict:
    """Document count, each field's mean length and each term's document frequency.

    One job counts whatever isn't known yet of the schema's frame, which is taken as a
    snapshot: its figures are kept.
    """
    known = schema.known
    means, dfs = known.setdefault("mean", {}), known.setdefault("df", {})
    fields = {t.field.key: t.field for t in terms}
    words = sorted({(t.field.key, t.word) for t in terms} - dfs.keys())
    new = [f for name, f in fields.items() if name not in means]
    if words or new:
        used = {name for name, _ in words} | {f.key for f in new}
        toks = tokenised(schema, schema.frame, [t for t in terms if t.field.key in used]).select(*[F.col(token_column(fields[n])) for n in sorted(used)])
        aggs = [F.count("*").alias("n")]
        aggs += [F.avg(F.coalesce(F.size(token_column(f)), F.lit(0))).alias(f"m_{i}") for i, f in enumerate(new)]
        aggs += [F.count(F.when(F.array_contains(token_column(fields[name]), w), True)).alias(f"d_{i}") for i, (name, w) in enumerate(words)]
        row = toks.agg(*aggs).first()
        known["n"] = row["n"]
        means.update({f.key: row[f"m_{i}"] or 1.0 for i, f in enumerate(new)})
        dfs.update({k: row[f"d_{i}"] for i, k in enumerate(words)})
    return {"n": known.get("n", 0), "mean": means, "df": dfs}


def _idf(stats: dict, t: Term) -> float:
    n, df = stats["n"], stats["df"].get((t.field.key, t.word), 0)
    odds = (n - df + 0.5) / (df + 0.5)
    return math.log(odds / 2 + 1 if odds < 2 else odds) * (BM25_K3 + 1) * t.wqf / (BM25_K3 + t.wqf) * (BM25_K1 + 1)


def most_weight(stats: dict, t: Term) -> float:
    return _idf(stats, t)


def bm25(stats: dict, t: Term, toks: Column, factor: float = 1) -> Column:
    """The weight of one term of a document, each occurrence of which counts `factor`."""
    wdf = text.term_count(toks, t.word) * factor
    length = F.greatest(F.size(toks) / stats["mean"].get(t.field.key, 1.0), F.lit(BM25_MIN_LEN))
    return F.when(wdf > 0, wdf / (BM25_K1 * (length * BM25_B + (1 - BM25_B)) + wdf) * _idf(stats, t)).otherwise(0.0)


def compile_query(schema: Schema, query: object) -> Node:
    return Compiler(schema).query(query)

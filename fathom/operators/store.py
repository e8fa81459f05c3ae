"""Keyed document tables: put, merge, upsert, delete and patch, with versions.

A store is a DataFrame with a key; each operation gives the new DataFrame, by one join on
the key. Merging is deep over structs: an absent (null) field of the update keeps the old.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = "_version"
_HELD, _OLD, _MOVED = "__held", "__old", "__moved"


class VersionConflict(Exception):
    """An update names a version that isn't the stored one."""


def latest(df: DataFrame, key: str, order: str = VERSION) -> DataFrame:
    """The last row of each key; of equal ones the one that comes last by all columns."""
    rest = [F.col(f"`{c}`").desc_nulls_last() for c in df.columns if c not in (key, order) and not isinstance(df.schema[c].dataType, T.MapType | T.VariantType)]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last(), *rest))
    return df.withColumn("__r", rank).where("__r = 1").drop("__r")


def single(df: DataFrame, key: str) -> DataFrame:
    """One row of each key: the last one by version if there is one, else by all columns."""
    if VERSION in df.columns:
        return latest(df, key)
    return latest(df.withColumn("__v", F.lit(0)), key, "__v").drop("__v")


def put(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Replaces or adds the new documents; of several of one key the last counts (see single)."""
    new = single(new, key)
    return store.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return store.join(keys.select(key), key, "left_anti").select(store.columns)


def _merged(kind: T.DataType, old: Column, new: Column) -> Column:
    if isinstance(kind, T.StructType):
        both = F.struct(*[_merged(f.dataType, old[f.name], new[f.name]).alias(f.name) for f in kind.fields])
        return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(both)
    return F.coalesce(new, old)


def _joined(store: DataFrame, new: DataFrame, key: str, how: str) -> DataFrame:
    a, b = store.alias("a"), new.alias("b")
    rows = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), how)
    cols = []
    for name in dict.fromkeys([*store.columns, *new.columns]):
        if name == key:
            cols.append(F.coalesce(F.col(f"b.{key}"), F.col(f"a.{key}")).alias(key))
        elif name == VERSION:
            cols.append((F.coalesce(F.col(f"a.{VERSION}"), F.lit(0)) + F.col(f"b.{key}").isNotNull().cast("int")).alias(VERSION))
        elif name not in new.columns:
            cols.append(F.col(f"a.`{name}`").alias(name))
        elif name not in store.columns:
            cols.append(F.col(f"b.`{name}`").alias(name))
        else:
            cols.append(_merged(store.schema[name].dataType, F.col(f"a.`{name}`"), F.col(f"b.`{name}`")).alias(name))
    return rows.select(*cols)


def update(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Merges new documents into stored ones; keys that aren't stored are left out."""
    return _joined(store, single(new, key), key, "left")


def upsert(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Merges new documents into stored ones or adds them."""
    return _joined(store, single(new, key), key, "full")


def checked(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new, if every row's _version is null or that of its stored document (0: none)."""
    at = store.select(F.col(key), F.col(VERSION).alias("__v"))
    bad = new.join(at, key, "left").where(F.col(VERSION).isNotNull() & (F.col(VERSION) != F.coalesce("__v", F.lit(0))))
    found = bad.select(key).first()
    if found:
        raise VersionConflict(f"{key} {found[0]!r} has another version")
    return new


def with_ids(df: DataFrame, id_field: str = "_id") -> DataFrame:
    """df with an id of its own for rows that have none."""
    given = F.col(id_field) if id_field in df.columns else F.lit(None).cast("string")
    return df.withColumn(id_field, F.coalesce(given.cast("string"), F.expr("uuid()")))


def union_indexes(*frames: DataFrame) -> DataFrame:
    """A search over several indexes: their union by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# -- patches


def patch(df: DataFrame, ops: list[dict]) -> DataFrame:
    """Applies patch operations to every row: add, remove, replace, copy, move, incr, decr, test.

    Paths are JSON pointers to columns, struct fields and array elements ("-" adds at the end;
    add inserts). Operations see what those before them did. All tests of a row must hold, or
    the row stays as it was; where there are tests, a field that is removed is null instead,
    as rows whose tests fail still have it. incr and decr stop at an optional limit.
    """
    tests = any(op["op"] == "test" for op in ops)
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(_OLD), "*", F.lit(True).alias(_HELD))
    for op in ops:
        kind, path = op["op"], _parts(op["path"])
        if kind == "test":
            value = F.array(*map(F.lit, op["value"])) if isinstance(op["value"], list) else F.lit(op["value"])
            held = _at(path).isNull() if op["value"] is None else F.coalesce(_at(path) == value, F.lit(False))
            out = out.withColumn(_HELD, F.col(_HELD) & held)
            continue
        if kind in ("remove", "replace", "incr", "decr") and not _has(out.schema, path):
            raise ValueError(f"nothing at {op['path']!r}")
        if kind == "remove":
            out = _drop(out, path, tests)
            continue
        if kind in ("add", "replace"):
            value = F.lit(op["value"]) if not isinstance(op["value"], list) else F.array(*map(F.lit, op["value"]))
        elif kind in ("copy", "move"):
            value = _at(_parts(op["from"]))
            if kind == "move":
                out, value = out.withColumn(_MOVED, value), F.col(_MOVED)
                out = _drop(out, _parts(op["from"]), tests)
        elif kind in ("incr", "decr"):
            step = op.get("value", 1)
            value = _at(path) + (step if kind == "incr" else -step)
            if "limit" in op:
                value = F.least(value, F.lit(op["limit"])) if kind == "incr" else F.greatest(value, F.lit(op["limit"]))
        else:
            raise ValueError(f"unknown operation {kind!r}")
        out = _set(out, path, value, insert=kind not in ("replace", "incr", "decr")).drop(_MOVED)
    if not tests:
        return out.drop(_HELD, _OLD)
    old = df.schema
    stayed = lambda c: _conformed(F.col(_OLD)[c], old[c].dataType, out.schema[c].dataType) if c in old.names else F.lit(None)
    return out.select(*[F.when(F.col(_HELD), F.col(f"`{c}`")).otherwise(stayed(c)).alias(c) for c in out.columns if c not in (_HELD, _OLD)])


def _conformed(value: Column, old: T.DataType, new: T.DataType) -> Column:
    """A value of the old type in the new one, which may have more fields."""
    if isinstance(old, T.StructType) and isinstance(new, T.StructType) and old != new:
        fields = [(_conformed(value[f.name], old[f.name].dataType, f.dataType) if f.name in old.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in new.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def _parts(pointer: str) -> list[str]:
    if not pointer.startswith("/"):
        raise ValueError(f"not a pointer: {pointer!r}")
    return [p.replace("~1", "/").replace("~0", "~") for p in pointer[1:].split("/")]


def _at(path: list[str]) -> Column:
    col = F.col(f"`{path[0]}`")
    for p in path[1:]:
        col = col[int(p)] if p.isdigit() else col[p]
    return col


def _has(schema: T.StructType, path: list[str]) -> bool:
    kind: T.DataType = schema
    for p in path:
        if isinstance(kind, T.ArrayType) and p.isdigit():
            kind = kind.elementType
        elif isinstance(kind, T.StructType) and p in kind.names:
            kind = kind[p].dataType
        else:
            return False
    return True


def _set(df: DataFrame, path: list[str], value: Column, insert: bool = False) -> DataFrame:
    if len(path) == 1:
        return df.withColumn(path[0], value)
    return df.withColumn(path[0], _set_in(F.col(f"`{path[0]}`"), df.schema[path[0]].dataType, path[1:], value, insert))


def _set_in(at: Column, kind: T.DataType, path: list[str], value: Column, insert: bool) -> Column:
    """`at` with the value at the path below it; beyond an array's end it is added there."""
    if not path:
        return value
    head, rest = path[0], path[1:]
    if isinstance(kind, T.ArrayType):
        if head == "-" and not rest:
            return F.concat(at, F.array(value))
        if not head.isdigit():
            raise ValueError(f"not an array's place: {head!r}")
        k = int(head)
        if insert and not rest:
            return F.concat(F.slice(at, F.lit(1), F.lit(k)), F.array(value), F.slice(at, F.lit(k + 1), F.greatest(F.size(at), F.lit(0))))
        return F.transform(at, lambda x, i: F.when(i == k, _set_in(x, kind.elementType, rest, value, insert)).otherwise(x))
    below = kind[head].dataType if isinstance(kind, T.StructType) and head in kind.names else T.NullType()
    return at.withField(f"`{head}`", _set_in(at[head], below, rest, value, insert) if rest else value)


def _drop(df: DataFrame, path: list[str], blank: bool) -> DataFrame:
    """df without what is at the path; with blank, fields are null instead."""
    if len(path) > 1:
        return df.withColumn(path[0], _without(F.col(f"`{path[0]}`"), df.schema[path[0]].dataType, path[1:], blank))
    return df.withColumn(path[0], F.lit(None).cast(df.schema[path[0]].dataType)) if blank else df.drop(path[0])


def _without(at: Column, kind: T.DataType, path: list[str], blank: bool) -> Column:
    head, rest = path[0], path[1:]
    if isinstance(kind, T.ArrayType):
        k = int(head)
        if not rest:
            return F.filter(at, lambda _, i: i != k)
        return F.transform(at, lambda x, i: F.when(i == k, _without(x, kind.elementType, rest, True)).otherwise(x))
    below = kind[head].dataType
    if rest:
        return at.withField(f"`{head}`", _without(at[head], below, rest, blank))
    return at.withField(f"`{head}`", F.lit(None).cast(below)) if blank or len(kind.names) == 1 else at.dropFields(f"`{head}`")

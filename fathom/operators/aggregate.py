"""Nested metric and bucket aggregations.

plan() reads the JSON form into a tree; frames() gives one DataFrame per node, keyed by its
ancestors' bucket keys: one groupBy a node over the matched documents, so nothing is
collected. Arrays count once for each distinct element; nulls are left out.

Metrics of no values are null, but _sum and _avg are 0. Variance is of the sample.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dates, geo
from ..plans.compiler import Compiler, Schema, compile_query

METRICS = ("_count", "_sum", "_avg", "_min", "_max", "_variance", "_std_deviation", "_std", "_median", "_mode", "_stats", "_extended_stats", "_cardinality", "_percentiles", "_percentiles_rank", "_geo_bounds", "_geo_centroid", "_scripted_metric")
BUCKETS = ("_values", "_value", "_terms", "_term", "_histogram", "_range", "_filter", "_date_histogram", "_date_range", "_missing", "_geo_distance", "_geo_trixels", "_ip_range")
#: Buckets that the query lists, fewer than BUCKET_LIMIT.
FEW = ("_range", "_filter", "_date_range", "_missing", "_geo_distance", "_ip_range")
BUCKET_LIMIT = 10_000


@dataclass
class Node:
    name: str
    kind: str
    spec: dict
    children: list[Node] = field(default_factory=list)

    @property
    def is_bucket(self) -> bool:
        return self.kind in BUCKETS


def plan(aggs: dict) -> list[Node]:
    out = []
    for name, body in aggs.items():
        if not name or name.startswith("#"):
            continue
        below = plan(body.get("_aggs", body.get("_aggregations", {})))
        kinds = [k for k in body if k in METRICS + BUCKETS]
        if len(kinds) != 1:
            raise ValueError(f"aggregation {name!r} needs one kind, has {kinds}")
        spec = body[kinds[0]]
        out.append(Node(name, kinds[0], spec if isinstance(spec, dict) else {"_field": spec}, below))
    return out


def metric_columns(node: Node, x: Column, kind: T.DataType) -> list[tuple[str, Column]]:
    """(name, aggregate) of a metric over the values x."""
    if node.kind == "_scripted_metric":  # a function from the values' Column to an aggregate
        return [(node.kind, node.spec["_script"](x))]
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType) and node.kind != "_count":
        x = F.unix_micros(x.cast("timestamp")) / 1e6
    elif isinstance(kind, T.BooleanType) and node.kind != "_count":
        x = x.cast("double")
    d = x.cast("double") if node.kind not in ("_count", "_mode", "_cardinality") else x
    zero = F.lit(0.0)
    count, total = F.count(x).alias("_count"), F.coalesce(F.sum(d), zero)
    mean = F.coalesce(F.avg(d), zero)
    simple = {"_count": count, "_sum": total, "_avg": mean, "_min": F.min(d), "_max": F.max(d), "_variance": F.var_samp(d), "_median": F.median(d), "_mode": F.mode(x, True), "_cardinality": F.approx_count_distinct(x)}
    if node.kind in simple:
        return [(node.kind, simple[node.kind])]
    sigma = float(node.spec.get("_sigma", 2.0))
    if sigma < 0:
        raise ValueError("_sigma can't be negative")
    spread = F.stddev_samp(d)
    bounds = [("_std_deviation", spread), ("_std_deviation_bounds._upper", mean + sigma * spread), ("_std_deviation_bounds._lower", mean - sigma * spread)]
    stats = [("_count", count), ("_min", F.min(d)), ("_max", F.max(d)), ("_avg", mean), ("_sum", total)]
    if node.kind in ("_std_deviation", "_std"):
        return bounds
    if node.kind == "_stats":
        return stats
    if node.kind == "_extended_stats":
        return [*stats, ("_sum_of_squares", F.coalesce(F.sum(d * d), zero)), ("_variance", F.var_samp(d)), *bounds]
    if node.kind == "_percentiles":
        percents = node.spec.get("_percents", [1, 5, 25, 50, 75, 95, 99])
        return [(f"_p{p:g}", F.percentile(d, F.lit(p / 100))) for p in percents]
    if node.kind == "_percentiles_rank":
        return [(f"_r{v:g}", F.avg((d <= v).cast("double")) * 100) for v in node.spec["_values"]]
    raise ValueError(f"unknown metric {node.kind!r}")


class Aggregator:
    def __init__(self, schema: Schema, docs: DataFrame):
        self.schema, self.docs = schema, docs

    def frames(self, nodes: list[Node]) -> dict[str, DataFrame]:
        """A DataFrame for each path a.b.c of the tree's nodes, with its ancestors' keys: key, key_1, ...

        Within, keys have reserved names, so that documents may have columns of these names.
        """
        out: dict[str, DataFrame] = {}
        self._level(nodes, self.docs, [], "", out)
        public = {f"__key_{k}": f"key_{k}" if k else "key" for k in range(20)}
        return {name: frame.withColumnsRenamed({c: public[c] for c in frame.columns if c in public}) for name, frame in out.items()}

    def _values(self, name: str, docs: DataFrame, keys: list[str]) -> tuple[DataFrame, T.DataType]:
        f = self.schema.find(name)
        if f is None:
            raise ValueError(f"no field {name!r}")
        value = F.explode(F.array_distinct(f.column)) if f.array else f.column
        return docs.select("*", value.alias("__v")) if f.array else docs.withColumn("__v", f.column), f.element

    def _level(self, nodes: list[Node], docs: DataFrame, keys: list[str], path: str, out: dict[str, DataFrame]) -> None:
        for node in nodes:
            at = f"{path}.{node.name}" if path else node.name
            if not node.is_bucket:
                out[at] = self.metric(node, docs, keys)
                continue
            key = f"__key_{len(keys)}"
            rows = self.bucketed(node, docs, key)
            counts = rows.groupBy(*keys, key).agg(F.count("*").alias("doc_count"))
            least = int(node.spec.get("_min_doc_count", 1))
            inner: dict[str, DataFrame] = {}
            self._level(node.children, rows, [*keys, key], at, inner)
            out[at] = self.limited(node, counts.where(F.col("doc_count") >= least), keys, key, {n[len(at) + 1 :]: d for n, d in inner.items()})
            if node.kind not in FEW or "_limit" in node.spec or least > 1:  # what a bucket that was cut holds goes with it
                inner = {n: d.join(out[at].select(*keys, key), [*keys, key], "left_semi").select(*[F.col(f"`{c}`") for c in d.columns]) for n, d in inner.items()}
            out |= inner

    def metric(self, node: Node, docs: DataFrame, keys: list[str]) -> DataFrame:
        if node.kind in ("_geo_bounds", "_geo_centroid"):
            lon, lat = self.schema.points[node.spec["_field"]]
            cols = [F.min(lat).alias("_bottom"), F.max(lat).alias("_top"), F.min(lon).alias("_left"), F.max(lon).alias("_right")] if node.kind == "_geo_bounds" else geo.mean_place(lon, lat)
            return docs.groupBy(*keys).agg(*cols)
        rows, kind = self._values(node.spec["_field"], docs, keys)
        return rows.groupBy(*keys).agg(*[c.alias(n) for n, c in metric_columns(node, F.col("__v"), kind)])

    def bucketed(self, node: Node, docs: DataFrame, key: str) -> DataFrame:
        """docs with a row for each bucket that a document falls into, named by `key`."""
        spec, kind = node.spec, node.kind
        if kind == "_filter":
            terms = spec.get("_term", spec)
            match = compile_query(self.schema, {"_or": [{f: v} for f, v in terms.items()]}).match
            return docs.where(match).withColumn(key, F.lit(node.name))
        if kind == "_missing":
            return docs.where(compile_query(self.schema, {spec["_field"]: None}).match).withColumn(key, F.lit("missing"))
        if kind == "_geo_trixels":
            lon, lat = self.schema.points[spec["_field"]]
            return docs.withColumn(key, geo.trixel(lon, lat, int(spec.get("_level", 5))))
        if kind == "_geo_distance":
            lon, lat = self.schema.points[spec["_field"]]
            shape = geo.parse_ewkt(spec["_origin"]) if isinstance(spec["_origin"], str) else geo.from_object("_point", spec["_origin"])
            return self._ranges(spec, docs.withColumn("__v", geo.angle(lon, lat, *shape.centroid()) * geo.EARTH_M), key, float)
        if kind in ("_terms", "_term"):
            f = self.schema.find(spec["_field"])
            return docs.select("*", F.explode(F.array_distinct(Compiler(self.schema).tokens(f))).alias(key))
        rows, element = self._values(spec["_field"], docs, [])
        rows = rows.where(F.col("__v").isNotNull())
        if kind in ("_values", "_value"):
            return rows.withColumnRenamed("__v", key)
        if kind == "_date_histogram":
            return rows.withColumn(key, dates.truncate(F.col("__v"), spec["_interval"])).drop("__v")
        if kind == "_ip_range":
            spec = {"_ranges": [_ip_bounds(r) for r in spec["_ranges"]]}
            return self._ranges(spec, rows.withColumn("__v", _ip_number(F.col("__v"))), key, int)
        temporal = isinstance(element, T.TimestampType | T.TimestampNTZType | T.DateType)
        if kind == "_date_range" or kind == "_range" and temporal:
            return self._ranges(spec, rows, key, _instant)
        if kind == "_range":
            return self._ranges(spec, rows, key, float)
        if kind == "_histogram":
            step, shift = spec["_interval"], spec.get("_shift", 0)
            if not step:
                raise ValueError("_interval can't be 0")
            x = F.unix_micros(F.col("__v").cast("timestamp")) / 1e6 if temporal else F.col("__v")
            if isinstance(element, T.IntegralType) and isinstance(step, int) and isinstance(shift, int):
                cut = F.expr(f"cast(((__v - {shift}) div {step}) * {step} + {shift} as bigint)")
            else:
                cut = F.floor((x - float(shift)) / float(step)) * float(step) + float(shift)
            return rows.withColumn(key, cut).drop("__v")
        raise ValueError(f"unknown bucket {kind!r}")

    def _ranges(self, spec: dict, rows: DataFrame, key: str, typed) -> DataFrame:
        found = []
        for r in spec["_ranges"]:
            low, high = r.get("_from"), r.get("_to")
            name = r.get("_key") or f"{'' if low is None else low}..{'' if high is None else high}"
            test = F.lit(True)
            if low is not None:
                test = test & (F.col("__v") >= _lit(typed(low)))
            if high is not None:
                test = test & (F.col("__v") < _lit(typed(high)))
            found.append(F.when(test & F.col("__v").isNotNull(), F.lit(name)))
        return rows.select("*", F.explode(F.array_compact(F.array(*found))).alias(key)).drop("__v")

    def limited(self, node: Node, buckets: DataFrame, keys: list[str], key: str, inner: dict[str, DataFrame]) -> DataFrame:
        """The buckets in their order, numbered within their parent, as many as _limit."""
        order = node.spec.get("_sort", "_key" if node.kind in ("_histogram", "_date_histogram") else None if node.kind in ("_range", "_date_range", "_geo_distance", "_ip_range") else {"_doc_count": "desc"})
        if order is None:
            ranges = [_ip_bounds(r) for r in node.spec["_ranges"]] if node.kind == "_ip_range" else node.spec["_ranges"]
            names = [r.get("_key") or f"{'' if r.get('_from') is None else r['_from']}..{'' if r.get('_to') is None else r['_to']}" for r in ranges]
            by = [F.array_position(F.array(*[F.lit(n) for n in names]), F.col(key)).asc()]
            rows = buckets
        else:
            what, way = (order, "asc" if order == "_key" else "desc") if isinstance(order, str) else next(iter(order.items()))
            way = way.get("_order", "asc") if isinstance(way, dict) else way
            if what in ("_key", "_doc_count"):
                rows, col = buckets, F.col({"_key": key, "_doc_count": "doc_count"}[what])
            else:
                rows, col = self._joined(buckets, what, inner, [*keys, key])
            down = way == "desc"
            by = [col.desc_nulls_last() if down else col.asc_nulls_last(), F.col(key).desc() if down else F.col(key).asc()]
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) if keys else None
        limit = int(node.spec.get("_limit", BUCKET_LIMIT))
        if rank is None:  # one parent: a top-k, which merges each task's best
            return rows.orderBy(*by).limit(limit).drop("__by")
        return rows.withColumn("__rank", rank).where(F.col("__rank") <= limit).drop("__rank", "__by")

    def _joined(self, buckets: DataFrame, what: str, inner: dict[str, DataFrame], keys: list[str]) -> tuple[DataFrame, Column]:
        """buckets with the column that a path such as sub._avg or a.b._max sorts them by."""
        path, _, column = what.rpartition(".")
        while path and path not in inner:
            path, _, head = path.rpartition(".")
            column = f"{head}.{column}"
        if not path and column in inner:  # a metric named alone: its only value
            path, column = column, next(c for c in inner[what].columns if c not in keys)
        if path not in inner:
            raise ValueError(f"can't sort by {what!r}")
        frame = inner[path]
        if column == "_doc_count":
            column = "doc_count"
        wanted = frame.groupBy(*keys).agg(F.max(F.col(f"`{column}`")).alias("__by"))
        return buckets.join(wanted, keys, "left"), F.col("__by")


def _ip_number(ip: Column) -> Column:
    """The number of a dotted IPv4 address; null for anything else."""
    parts = F.split(ip, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n * 256 + p.cast("long"))
    return F.when(ip.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)(\.|$)){4}$") & ~ip.endswith("."), number)


def _ip_bounds(r: dict) -> dict:
    """A range of {_from, _to} addresses (the end left out) or of {_mask: "a.b.c.d/n"}, as numbers with a _key."""
    import ipaddress

    if "_mask" in r:
        net = ipaddress.ip_network(r["_mask"], strict=False)
        return {"_key": r.get("_key") or r["_mask"], "_from": int(net.network_address), "_to": int(net.broadcast_address) + 1}
    name = r.get("_key") or f"{r.get('_from', '')}..{r.get('_to', '')}"
    return {"_key": name} | {k: int(ipaddress.ip_address(r[k])) for k in ("_from", "_to") if r.get(k)}


def _lit(value: object) -> Column:
    return F.lit(value).cast("timestamp_ntz") if isinstance(value, datetime) else F.lit(value)


def _instant(value: object) -> datetime:
    return value if isinstance(value, datetime) else dates.from_epoch(value) if isinstance(value, int | float) else dates.parse(value)


def render(nodes: list[Node], frames: dict[str, DataFrame], path: str = "", keys: int = 0) -> dict:
    """The response's nested dictionary. Collects: for results that are shown, not used."""
    out: dict = {}
    for node in nodes:
        at = f"{path}.{node.name}" if path else node.name
        names = ["key", *[f"key_{k}" for k in range(1, 20)]][: keys + node.is_bucket]
        for row in frames[at].collect():
            d = row.asDict()
            parent = tuple(d.pop(n) for n in names[:keys])
            if node.is_bucket:
                name = d.pop(names[-1])
                out.setdefault(parent, {}).setdefault(node.name, []).append({"_doc_count": d["doc_count"], "_key": _text(name), "__at": (*parent, name)})
            else:
                nested: dict = {}
                for k, v in d.items():
                    head, _, tail = k.partition(".")
                    if tail:
                        nested.setdefault(head, {})[tail] = v
                    else:
                        nested[head] = v
                out.setdefault(parent, {})[node.name] = nested
        if node.is_bucket:
            below = render(node.children, frames, at, keys + 1)
            for parent in list(out):
                for b in out[parent].get(node.name, []) if isinstance(out[parent].get(node.name), list) else []:
                    b.update(below.get(b.pop("__at"), {}))
                if node.spec.get("_keyed") and isinstance(out[parent].get(node.name), list):
                    out[parent][node.name] = {b["_key"]: b for b in out[parent][node.name]}
    return out if path else out.get((), {})


def _text(value: object) -> str:
    return ("true" if value else "false") if isinstance(value, bool) else str(value)

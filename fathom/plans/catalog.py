"""The registered queries of the search and aggregation engine, with their SQL.

Each runs over a whole table through the same engine calls that a user makes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Index
from ..functions import dates, geo, phonetic
from ..operators import feedback, store
from ..sources import infer

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "events": "event_id", "documents": "doc_id", "supplier": "s_suppkey", "labels": "doc_id", "nation": "n_nationkey"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def index(spark: SparkSession, sf_dir: str, table: str, **options: object) -> Index:
    return Index(read(spark, sf_dir, table), KEYS[table], **options)


def texts(spark: SparkSession, sf_dir: str, **options: object) -> Index:
    return index(spark, sf_dir, "documents", text=("text",), **options)


def places(spark: SparkSession, sf_dir: str) -> Index:
    """Customers with places made from their keys."""
    lon, lat = F.pmod("c_custkey", F.lit(360)) - 180.0, F.pmod(F.col("c_custkey") * 7, F.lit(170)) - 85.0
    return index(spark, sf_dir, "customer", points={"place": (lon.cast("double"), lat.cast("double"))})


def query(name: str, sql: str | None = None):
    """Registers a query under its name."""

    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def filtered(name: str, table: str, q: object, columns: list[str], where: str, **options: object) -> None:
    """A query whose result is the columns of the matching rows."""
    QUERIES[name] = lambda spark, sf_dir: index(spark, sf_dir, table, **options).matching(q).select(*columns)
    ORACLE[name] = f"SELECT {', '.join(columns)} FROM {table} WHERE {where}"


def aggregated(name: str, table: str, aggs: dict, path: str, sql: str, q: object = "*", rounded: int = 4, **options: object) -> None:
    """A query whose result is one frame of an aggregation tree, its doubles rounded."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = index(spark, sf_dir, table, **options).aggregations(aggs, q)[path]
        return out.select(*[(F.round(F.col(f"`{c}`"), rounded) if k == "double" else F.col(f"`{c}`")).alias(c.strip("_").replace("._", "_")) for c, k in out.dtypes])

    QUERIES[name] = run
    ORACLE[name] = sql


def text_filter(name: str, q: object, where: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: texts(spark, sf_dir).matching(q).select("doc_id")
    ORACLE[name] = f"WITH d AS ({_WORDS}) SELECT doc_id FROM d WHERE {where}"


_WORDS = r"SELECT doc_id, lang, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM documents"

# -- flagship

_FLAGSHIP_Q = {"_and": [{"l_returnflag": "R"}, {"l_quantity": {"_in": {"_range": {"_from": 10, "_to": 30}}}}]}
aggregated(
    "flagship", "lineitem",
    {"by_status": {"_values": {"_field": "l_linestatus"}, "_aggs": {"revenue": {"_sum": {"_field": "l_extendedprice"}}}}}, "by_status.revenue",
    "SELECT l_linestatus AS key, round(sum(l_extendedprice), 2) AS sum FROM lineitem WHERE l_returnflag = 'R' AND l_quantity BETWEEN 10 AND 30 GROUP BY 1",
    _FLAGSHIP_Q, 2,
)

# -- filters

_L = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"]
filtered("filter_term", "orders", {"o_orderstatus": "F"}, ["o_orderkey"], "lower(o_orderstatus) = 'f'")
filtered("filter_and_or", "orders", {"_or": [{"_and": [{"o_orderstatus": "O"}, {"o_totalprice": {"_in": {"_range": {"_from": 100000}}}}]}, {"o_orderpriority": "1-URGENT"}]}, ["o_orderkey"], "(o_orderstatus = 'O' AND o_totalprice >= 100000) OR o_orderpriority = '1-URGENT'")
filtered("filter_not", "orders", {"_not": [{"o_orderstatus": "F"}]}, ["o_orderkey"], "NOT o_orderstatus = 'F'")
filtered("filter_not_any", "orders", {"_not": [{"o_orderstatus": "F"}, {"o_orderpriority": "5-LOW"}]}, ["o_orderkey"], "NOT (o_orderstatus = 'F' OR o_orderpriority = '5-LOW')")
filtered("filter_and_not", "orders", {"_and_not": [{"o_orderstatus": "F"}, {"o_orderpriority": "1-URGENT"}, {"o_orderpriority": "5-LOW"}]}, ["o_orderkey"], "o_orderstatus = 'F' AND o_orderpriority NOT IN ('1-URGENT', '5-LOW')")
filtered("filter_xor", "orders", {"_xor": [{"o_orderstatus": "F"}, {"o_orderpriority": "1-URGENT"}, {"o_totalprice": {"_in": {"_range": {"_to": 100000}}}}]}, ["o_orderkey"], "((o_orderstatus = 'F')::INT + (o_orderpriority = '1-URGENT')::INT + (o_totalprice <= 100000)::INT) % 2 = 1")
filtered("filter_object_inherits", "orders", {"_or": [{"o_orderstatus": "F", "o_orderpriority": "5-LOW"}]}, ["o_orderkey"], "o_orderstatus = 'F' OR o_orderpriority = '5-LOW'")
filtered("filter_range_closed", "lineitem", {"l_quantity": {"_in": "10..20"}}, _L, "l_quantity BETWEEN 10 AND 20")
filtered("filter_range_open_from", "lineitem", {"l_quantity": {"_in": "..5"}}, _L, "l_quantity <= 5")
filtered("filter_range_open_to", "lineitem", {"l_quantity": {"_in": "[45,]"}}, _L, "l_quantity >= 45")
filtered("filter_range_half_open", "lineitem", {"l_quantity": {"_in": "(10,20)"}}, _L, "l_quantity > 10 AND l_quantity < 20", open_ranges=True)
filtered("filter_range_string", "part", {"p_brand": {"_in": {"_range": {"_from": "Brand#2", "_to": "Brand#4"}}}}, ["p_partkey"], "p_brand >= 'Brand#2' AND p_brand <= 'Brand#4'")
filtered("filter_range_empty", "lineitem", {"l_quantity": {"_in": "20..10"}}, _L, "false")
filtered("filter_range_all", "orders", {"o_totalprice": {"_in": {"_range": {}}}}, ["o_orderkey"], "true")
filtered("filter_date_range", "orders", {"o_orderdate": {"_in": {"_range": {"_from": "1996-01-01", "_to": "1996-12-31"}}}}, ["o_orderkey"], "o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
filtered("filter_date_math", "orders", {"o_orderdate": {"_in": {"_range": {"_from": "1997-03-15||//M", "_to": "1997-03-15||+1M/M"}}}}, ["o_orderkey"], "o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-05-01'")
filtered("filter_exists", "customer", {"c_mktsegment": "*"}, ["c_custkey"], "c_mktsegment IS NOT NULL")
filtered("filter_prefix", "part", {"p_type": "STANDARD*"}, ["p_partkey"], "lower(p_type) LIKE 'standard%'")
filtered("filter_partial", "part", {"p_name": "sm**"}, ["p_partkey"], "lower(p_name) IN (SELECT v FROM (SELECT lower(p_name) AS v, count(*) AS c FROM part WHERE lower(p_name) LIKE 'sm%' GROUP BY 1 ORDER BY c DESC, v LIMIT 50))")
filtered("filter_partial_frequent", "customer", {"c_name": "customer#0**"}, ["c_custkey"], "lower(c_name) IN (SELECT v FROM (SELECT lower(c_name) AS v, count(*) AS c FROM customer WHERE lower(c_name) LIKE 'customer#0%' GROUP BY 1 ORDER BY c DESC, v LIMIT 50))")
filtered("filter_glob", "part", {"p_name": {"_wildcard": "s*l r?ng"}}, ["p_partkey"], "regexp_full_match(lower(p_name), 's.*l r.ng')")
filtered("filter_fuzzy_keyword", "part", {"p_name": "smoll rong~3"}, ["p_partkey"], "levenshtein(lower(p_name), 'smoll rong') <= 3")
filtered("filter_case_insensitive", "customer", {"c_mktsegment": "bUiLdInG"}, ["c_custkey"], "lower(c_mktsegment) = 'building'")
filtered("filter_bool_term", "customer", {"c_mktsegment": "BUILDING"}, ["c_custkey"], "c_mktsegment = 'BUILDING'", bool_terms=("c_mktsegment",))
filtered("filter_casts", "orders", {"_and": [{"o_orderkey": {"_in": {"_range": {"_from": {"_integer": "100"}, "_to": {"_float": 900.5}}}}}, {"o_orderdate": {"_in": {"_range": {"_from": {"_datetime": "1996-01-01"}}}}}]}, ["o_orderkey"], "o_orderkey BETWEEN 100 AND 900.5 AND o_orderdate >= TIMESTAMP '1996-01-01'")
filtered("filter_global", "orders", {"_value": "1-URGENT"}, ["o_orderkey"], "lower(o_orderstatus) = '1-urgent' OR lower(o_orderpriority) = '1-urgent'")
filtered("filter_accuracy_num", "orders", {"o_totalprice._10000": 123456}, ["o_orderkey"], "floor(o_totalprice / 10000) = 12")
filtered("filter_accuracy_date", "orders", {"o_orderdate._month": "1997-06-17"}, ["o_orderkey"], "date_trunc('month', o_orderdate) = TIMESTAMP '1997-06-01'")
filtered("filter_accuracy_decade", "orders", {"o_orderdate._decade": "1993-01-01"}, ["o_orderkey"], "year(o_orderdate) BETWEEN 1990 AND 1999")
filtered("filter_list", "orders", {"o_orderpriority": ["1-URGENT", "5-low"]}, ["o_orderkey"], "o_orderpriority IN ('1-URGENT', '5-LOW')")
filtered("match_all", "nation", "*", ["n_nationkey"], "true")
filtered("match_none", "nation", {"_match_none": True}, ["n_nationkey"], "false")
filtered("id_query", "orders", {"_id": 7}, ["o_orderkey", "o_totalprice"], "o_orderkey = 7")
filtered("qs_boolean", "orders", "o_orderstatus:F AND NOT o_orderpriority:5-LOW", ["o_orderkey"], "o_orderstatus = 'F' AND o_orderpriority <> '5-LOW'")
filtered("qs_range", "lineitem", "l_quantity:[10,20] AND l_discount:0.05..", _L, "l_quantity BETWEEN 10 AND 20 AND l_discount >= 0.05")
filtered("qs_precedence", "orders", "o_orderstatus:F OR o_orderstatus:O AND o_orderpriority:1-URGENT", ["o_orderkey"], "o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')")
filtered("qs_parentheses", "orders", "(o_orderstatus:F | o_orderstatus:O) & !o_orderpriority:1-URGENT", ["o_orderkey"], "o_orderstatus IN ('F', 'O') AND o_orderpriority <> '1-URGENT'")
filtered("qs_xor_maybe", "orders", "o_orderstatus:F XOR o_orderpriority:1-URGENT MAYBE o_orderpriority:5-LOW", ["o_orderkey"], "((o_orderstatus = 'F')::INT + (o_orderpriority = '1-URGENT')::INT) = 1")
filtered("multi_query_and", "orders", ["o_orderstatus:F", "o_orderpriority:1-URGENT"], ["o_orderkey"], "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")


@query("filter_is_null", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = read(spark, sf_dir, "customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return Index(frame, "c_custkey").matching({"segment": None}).select("c_custkey")


@query("array_any", "SELECT o_custkey FROM orders GROUP BY 1 HAVING bool_or(o_totalprice BETWEEN 400000 AND 500000)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_totalprice").alias("prices"))
    return Index(rows, "o_custkey").matching("prices:400000..500000").select("o_custkey")


@query("array_agg", "SELECT count(*) AS count, round(sum(o_totalprice), 2) AS sum FROM (SELECT DISTINCT o_custkey, o_totalprice FROM orders)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_totalprice").alias("prices"))
    stats = Index(rows, "o_custkey").aggregations({"s": {"_stats": {"_field": "prices"}}})["s"]
    return stats.select(F.col("_count").alias("count"), F.round("_sum", 2).alias("sum"))


@query("namespace_partial_path", "SELECT event_id FROM events WHERE event_type = 'click'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = read(spark, sf_dir, "events").select("event_id", F.create_map(F.lit("kind.inner.name"), "event_type").alias("style"))
    return Index(frame, "event_id").matching({"style": {"kind": {"name": "click"}}}).select("event_id")


# -- metrics

for _agg, _sql in {
    "count": "count(l_discount)", "sum": "round(sum(l_discount), 4)", "avg": "round(avg(l_discount), 4)", "min": "min(l_extendedprice)", "max": "max(l_discount)",
    "variance": "round(var_samp(l_discount), 4)", "median": "round(median(l_discount), 4)",
    "mode": "(SELECT l_discount FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)",
}.items():
    aggregated(f"agg_{_agg}", "lineitem", {"m": {f"_{_agg}": {"_field": "l_extendedprice" if _agg == "min" else "l_discount"}}}, "m", f"SELECT {_sql} AS {_agg} FROM lineitem" if _agg != "mode" else f"SELECT {_sql} AS mode")
aggregated("agg_std_bounds", "events", {"m": {"_std_deviation": {"_field": "value", "_sigma": 3}}}, "m", "SELECT round(stddev_samp(value), 4) AS std_deviation, round(avg(value) + 3 * stddev_samp(value), 4) AS std_deviation_bounds_upper, round(avg(value) - 3 * stddev_samp(value), 4) AS std_deviation_bounds_lower FROM events")
_STATS = "count(c_acctbal) AS count, min(c_acctbal) AS min, max(c_acctbal) AS max, round(avg(c_acctbal), 2) AS avg, round(sum(c_acctbal), 2) AS sum"
aggregated("agg_stats", "customer", {"m": {"_stats": {"_field": "c_acctbal"}}}, "m", f"SELECT {_STATS} FROM customer", rounded=2)
aggregated("agg_extended_stats", "customer", {"m": {"_extended_stats": {"_field": "c_acctbal"}}}, "m", f"SELECT {_STATS}, round(sum(c_acctbal * c_acctbal), 2) AS sum_of_squares, round(var_samp(c_acctbal), 2) AS variance, round(stddev_samp(c_acctbal), 2) AS std_deviation, round(avg(c_acctbal) + 2 * stddev_samp(c_acctbal), 2) AS std_deviation_bounds_upper, round(avg(c_acctbal) - 2 * stddev_samp(c_acctbal), 2) AS std_deviation_bounds_lower FROM customer", rounded=2)
aggregated("agg_percentiles", "events", {"m": {"_percentiles": {"_field": "value", "_percents": [25, 50, 75]}}}, "m", "SELECT round(quantile_cont(value, 0.25), 4) AS p25, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.75), 4) AS p75 FROM events")
aggregated("agg_percentiles_rank", "events", {"m": {"_percentiles_rank": {"_field": "value", "_values": [50]}}}, "m", "SELECT round(avg((value <= 50)::INT) * 100, 4) AS r50 FROM events")
aggregated("agg_empty", "events", {"m": {"_stats": {"_field": "value"}}}, "m", "SELECT 0::BIGINT AS count, NULL::DOUBLE AS min, NULL::DOUBLE AS max, 0.0::DOUBLE AS avg, 0.0::DOUBLE AS sum", {"_match_none": True})

# -- buckets

aggregated("bucket_values", "orders", {"b": {"_values": {"_field": "o_orderpriority"}}}, "b", "SELECT o_orderpriority AS key, count(*) AS doc_count FROM orders GROUP BY 1")
aggregated("bucket_terms", "part", {"b": {"_terms": {"_field": "p_name"}}}, "b", "SELECT w AS key, count(*) AS doc_count FROM (SELECT p_partkey, unnest(list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9_]+'), lambda x: x <> ''))) AS w FROM part) GROUP BY 1")
aggregated("bucket_histogram_int", "part", {"b": {"_histogram": {"_field": "p_size", "_interval": 10}}}, "b", "SELECT CAST((p_size // 10) * 10 AS BIGINT) AS key, count(*) AS doc_count FROM part GROUP BY 1")
aggregated("bucket_histogram_float", "customer", {"b": {"_histogram": {"_field": "c_acctbal", "_interval": 1000}}}, "b", "SELECT floor(c_acctbal / 1000.0) * 1000.0 AS key, count(*) AS doc_count FROM customer GROUP BY 1")
aggregated("bucket_histogram_shift", "customer", {"b": {"_histogram": {"_field": "c_acctbal", "_interval": 1000, "_shift": 250}}}, "b", "SELECT floor((c_acctbal - 250) / 1000.0) * 1000.0 + 250 AS key, count(*) AS doc_count FROM customer GROUP BY 1")
aggregated("bucket_date_histogram", "orders", {"b": {"_date_histogram": {"_field": "o_orderdate", "_interval": "year"}}}, "b", "SELECT date_trunc('year', o_orderdate)::TIMESTAMP AS key, count(*) AS doc_count FROM orders GROUP BY 1")
_RANGES = [{"_to": 0}, {"_from": 0, "_to": 5000}, {"_key": "rich", "_from": 4000}]
_RANGE_SQL = "SELECT k AS key, count(*) AS doc_count FROM (SELECT unnest(list_filter([CASE WHEN c_acctbal < 0 THEN '..0' END, CASE WHEN c_acctbal >= 0 AND c_acctbal < 5000 THEN '0..5000' END, CASE WHEN c_acctbal >= 4000 THEN 'rich' END], lambda x: x IS NOT NULL)) AS k FROM customer) GROUP BY 1"
aggregated("bucket_range_overlap", "customer", {"b": {"_range": {"_field": "c_acctbal", "_ranges": _RANGES}}}, "b", _RANGE_SQL)
aggregated("bucket_date_range", "orders", {"b": {"_date_range": {"_field": "o_orderdate", "_ranges": [{"_key": "early", "_to": "1997-01-01"}, {"_key": "late", "_from": "1997-01-01"}]}}}, "b", "SELECT CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'early' ELSE 'late' END AS key, count(*) AS doc_count FROM orders GROUP BY 1")
aggregated("bucket_filter", "orders", {"b": {"_filter": {"_term": {"o_orderstatus": "F", "o_orderpriority": ["1-URGENT", "5-LOW"]}}, "_aggs": {"m": {"_sum": {"_field": "o_totalprice"}}}}}, "b.m", "SELECT 'b' AS key, round(sum(o_totalprice), 2) AS sum FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority IN ('1-URGENT', '5-LOW')", rounded=2)
_NEST2 = {"a": {"_values": {"_field": "o_orderstatus"}, "_aggs": {"b": {"_values": {"_field": "o_orderpriority"}, "_aggs": {"m": {"_avg": {"_field": "o_totalprice"}}}}}}}
aggregated("bucket_nested_2", "orders", _NEST2, "a.b", "SELECT o_orderstatus AS key, o_orderpriority AS key_1, count(*) AS doc_count FROM orders GROUP BY 1, 2")
aggregated("bucket_nested_metric", "orders", _NEST2, "a.b.m", "SELECT o_orderstatus AS key, o_orderpriority AS key_1, round(avg(o_totalprice), 2) AS avg FROM orders GROUP BY 1, 2", rounded=2)
aggregated("bucket_nested_3", "lineitem", {"a": {"_values": {"_field": "l_returnflag"}, "_aggs": {"b": {"_values": {"_field": "l_linestatus"}, "_aggs": {"c": {"_histogram": {"_field": "l_quantity", "_interval": 10}}}}}}}, "a.b.c", "SELECT l_returnflag AS key, l_linestatus AS key_1, floor(l_quantity / 10.0) * 10.0 AS key_2, count(*) AS doc_count FROM lineitem GROUP BY 1, 2, 3")
aggregated("bucket_sort_key", "nation", {"b": {"_values": {"_field": "n_name", "_sort": {"_key": "desc"}, "_limit": 5}}}, "b", "SELECT n_name AS key, count(*) AS doc_count FROM nation GROUP BY 1 ORDER BY 1 DESC LIMIT 5")
aggregated("bucket_sort_count_asc", "part", {"b": {"_values": {"_field": "p_name", "_sort": {"_doc_count": "asc"}, "_limit": 7}}}, "b", "SELECT p_name AS key, count(*) AS doc_count FROM part GROUP BY 1 ORDER BY 2, 1 LIMIT 7")
aggregated("bucket_sort_metric", "part", {"b": {"_values": {"_field": "p_brand", "_sort": {"m._avg": "desc"}, "_limit": 5}, "_aggs": {"m": {"_avg": {"_field": "p_retailprice"}}}}}, "b", "SELECT p_brand AS key, count(*) AS doc_count FROM part GROUP BY 1 ORDER BY avg(p_retailprice) DESC, 1 DESC LIMIT 5")
aggregated("bucket_sort_deep", "orders", {"b": {"_values": {"_field": "o_orderpriority", "_sort": {"s._std_deviation_bounds._upper": "asc"}, "_limit": 3}, "_aggs": {"s": {"_std_deviation": {"_field": "o_totalprice"}}}}}, "b", "SELECT o_orderpriority AS key, count(*) AS doc_count FROM orders GROUP BY 1 ORDER BY avg(o_totalprice) + 2 * stddev_samp(o_totalprice), 1 LIMIT 3")
aggregated("bucket_limit_nested", "part", {"a": {"_values": {"_field": "p_brand"}, "_aggs": {"b": {"_values": {"_field": "p_type", "_limit": 2}}}}}, "a.b", "SELECT p_brand AS key, p_type AS key_1, count(*) AS doc_count FROM part GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type DESC) <= 2")
_CUT = {"a": {"_values": {"_field": "p_brand", "_limit": 3}, "_aggs": {"b": {"_values": {"_field": "p_type"}}}}}
aggregated("bucket_limit_children", "part", _CUT, "a.b", "SELECT p_brand AS key, p_type AS key_1, count(*) AS doc_count FROM part WHERE p_brand IN (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 3) GROUP BY 1, 2")
aggregated("bucket_min_doc_count", "part", {"b": {"_values": {"_field": "p_name", "_min_doc_count": 30}}}, "b", "SELECT p_name AS key, count(*) AS doc_count FROM part GROUP BY 1 HAVING count(*) >= 30")

@query("bucket_key_columns", "SELECT o_orderpriority AS key, o_orderstatus AS key_1, round(sum(o_totalprice), 2) AS sum FROM orders GROUP BY 1, 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over documents whose columns are named as buckets' keys are."""
    frame = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("key"), F.col("o_orderstatus").alias("key_1"), F.col("o_totalprice").alias("doc_count"))
    tree = {"p": {"_values": {"_field": "key"}, "_aggs": {"s": {"_values": {"_field": "key_1"}, "_aggs": {"m": {"_sum": {"_field": "doc_count"}}}}}}}
    return Index(frame, "o_orderkey").aggregations(tree)["p.s.m"].select("key", "key_1", F.round("_sum", 2).alias("sum"))


# -- order


def sorted_hits(name: str, table: str, sort: object, columns: list[str], sql: str, metric: str | None = None, limit: int = 20, **options: object) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return index(spark, sf_dir, table, **options).search("*", sort=sort, limit=limit, metric=metric).select(*columns)

    QUERIES[name] = run
    ORACLE[name] = f"SELECT {', '.join(columns)} FROM {table} ORDER BY {sql} LIMIT {limit}"


sorted_hits("sort_multi", "orders", ["o_orderstatus", "-o_totalprice"], ["o_orderkey"], "o_orderstatus, o_totalprice DESC, o_orderkey")
sorted_hits("sort_numeric_ref", "orders", {"o_totalprice": {"_value": 200000}}, ["o_orderkey"], "abs(o_totalprice - 200000), o_orderkey")
sorted_hits("sort_date_ref", "orders", {"o_orderdate": {"_value": "1998-02-03"}}, ["o_orderkey"], "abs(epoch(o_orderdate) - epoch(TIMESTAMP '1998-02-03')), o_orderkey")
sorted_hits("sort_levenshtein", "part", {"p_name": {"_value": "small rung", "_metric": "levenshtein"}}, ["p_partkey"], "levenshtein(p_name, 'small rung')::DOUBLE / greatest(length(p_name), 10), p_partkey")
sorted_hits("sort_jaro", "part", "p_name:small rung", ["p_partkey"], "round(1 - jaro_similarity(p_name, 'small rung'), 9), p_partkey", metric="jaro")
sorted_hits("sort_jaro_winkler", "part", "p_name:small rung", ["p_partkey"], "round(1 - jaro_winkler_similarity(p_name, 'small rung'), 9), p_partkey", metric="jarowinkler")
sorted_hits("sort_jaccard", "part", "p_name:small rung", ["p_partkey"], "1 - len(list_intersect(list_distinct(string_split(p_name, '')), list_distinct(string_split('small rung', ''))))::DOUBLE / len(list_distinct(list_concat(string_split(p_name, ''), string_split('small rung', '')))), p_partkey", metric="jaccard")
_PAIRS = "list_distinct(list_transform(range(1, length({0})), lambda i: {0}[i:i + 1]))"
sorted_hits("sort_dice", "part", "p_name:small rung", ["p_partkey"], f"1 - 2 * len(list_intersect({_PAIRS.format('p_name')}, {_PAIRS.format(chr(39) + 'small rung' + chr(39))}))::DOUBLE / (len({_PAIRS.format('p_name')}) + len({_PAIRS.format(chr(39) + 'small rung' + chr(39))})), p_partkey", metric="dice")


@query("sort_desc_nulls_last", "SELECT c_custkey FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS s FROM customer) ORDER BY s DESC NULLS LAST, c_custkey LIMIT 2000")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = read(spark, sf_dir, "customer").withColumn("s", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return Index(frame, "c_custkey").search("*", sort="-s", limit=2000).select("c_custkey")


@query("sort_bool_ref", "SELECT o_orderkey FROM orders ORDER BY CASE WHEN o_totalprice > 100000 THEN 0 ELSE 1 END, o_orderkey LIMIT 50")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = read(spark, sf_dir, "orders").withColumn("big", F.col("o_totalprice") > 100000)
    return Index(frame, "o_orderkey").search("*", sort={"big": {"_value": True}}, limit=50).select("o_orderkey")


@query("sort_array_min", "SELECT o_custkey FROM orders GROUP BY 1 ORDER BY min(o_totalprice), 1 LIMIT 20")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_totalprice").alias("prices"))
    return Index(rows, "o_custkey").search("*", sort="prices", limit=20).select("o_custkey")


def _substrings(text: str) -> list[str]:
    return sorted({text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)})


def _subsequences(text: str) -> list[str]:
    out = {""}
    for c in text:
        out |= {x + c for x in out}
    return sorted(out - {""})


def _values(items: list[str]) -> str:
    return ", ".join(f"('{x}')" for x in items)


_CODE = "upper({0}[1]) || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(lower({0}), 'bpfvcksgjqxzdtlmnraehiouwy', '11223334455566788900000000'), '0+', '0', 'g'), '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g'), '7+', '7', 'g'), '8+', '8', 'g'), '9+', '9', 'g')"
_REFERENCE = "small rung"
for _m in ("lcs", "lcsq", "soundex"):
    QUERIES[f"sort_{_m}"] = lambda spark, sf_dir, m=_m: index(spark, sf_dir, "part").search("*", sort=f"p_name:{_REFERENCE}", metric=m, limit=20).select("p_partkey")
ORACLE["sort_lcs"] = f"""
    WITH s(x) AS (VALUES {_values(_substrings(_REFERENCE))}),
    n AS (SELECT p_name, max(length(x)) AS k FROM (SELECT DISTINCT p_name FROM part), s WHERE contains(p_name, x) GROUP BY 1)
    SELECT p_partkey FROM part LEFT JOIN n USING (p_name) ORDER BY 1.0::DOUBLE - coalesce(k, 0)::DOUBLE / greatest(length(p_name), {len(_REFERENCE)}), p_partkey LIMIT 20"""
ORACLE["sort_lcsq"] = f"""
    WITH s(x) AS (VALUES {_values(_subsequences(_REFERENCE))}),
    p AS (SELECT x, '%' || array_to_string(string_split(x, ''), '%') || '%' AS p FROM s),
    n AS (SELECT p_name, max(length(x)) AS k FROM (SELECT DISTINCT p_name FROM part), p WHERE p_name LIKE p GROUP BY 1)
    SELECT p_partkey FROM part LEFT JOIN n USING (p_name) ORDER BY 1.0::DOUBLE - coalesce(k, 0)::DOUBLE / greatest(length(p_name), {len(_REFERENCE)}), p_partkey LIMIT 20"""
_SMALL_RUNG = "S38079084"  # the code of _REFERENCE
ORACLE["sort_soundex"] = f"""
    WITH s(x) AS (VALUES {_values(_subsequences(_SMALL_RUNG))}),
    p AS (SELECT x, '%' || array_to_string(string_split(x, ''), '%') || '%' AS p FROM s),
    c AS (SELECT DISTINCT p_name, {_CODE.format("letters")} AS code FROM (SELECT p_name, regexp_replace(p_name, '[^A-Za-z]', '', 'g') AS letters FROM part)),
    n AS (SELECT p_name, code, max(length(x)) AS k FROM c, p WHERE code LIKE p GROUP BY 1, 2)
    SELECT p_partkey FROM part LEFT JOIN n USING (p_name) ORDER BY 1.0::DOUBLE - coalesce(k, 0)::DOUBLE / greatest(length(code), {len(_SMALL_RUNG)}), p_partkey LIMIT 20"""


@query("sort_array_string", "SELECT n_nationkey FROM (SELECT c_nationkey AS n_nationkey, list(DISTINCT c_name) AS names FROM customer GROUP BY 1) ORDER BY list_min(list_transform(names, lambda x: levenshtein(x, 'Customer#000000100')::DOUBLE / greatest(length(x), 18))), 1 LIMIT 12")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.collect_set("c_name").alias("names"))
    return Index(rows, "n_nationkey").search("*", sort={"names": {"_value": "Customer#000000100", "_metric": "levenshtein"}}, limit=12).select("n_nationkey")


@query("page_offset_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 30")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir, "orders").search({"_query": "*", "_sort": "-o_totalprice", "_offset": 30, "_limit": 10}).select("o_orderkey", "o_totalprice")


@query("collapse_top1", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir, "orders").search("*", sort="-o_totalprice", collapse="o_custkey", limit=25).select("o_custkey", "o_orderkey")


@query("collapse_topk", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) <= 2 ORDER BY o_totalprice, o_orderkey LIMIT 40")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir, "orders").search("*", sort="o_totalprice", collapse="o_custkey", collapse_max=2, limit=40).select("o_custkey", "o_orderkey")


def _nested(spark: SparkSession, sf_dir: str) -> Index:
    frame = read(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_name").alias("full"), F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("at")).alias("who"))
    return Index(frame, "c_custkey")


@query("select_fields", "SELECT c_custkey, c_mktsegment AS segment FROM customer")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.order import select

    return select(_nested(spark, sf_dir).frame, "{c_custkey,who{at{segment}}}").select("c_custkey", F.col("who.at.segment").alias("segment"))


@query("select_drill", "SELECT c_mktsegment AS segment FROM customer")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.order import select

    return select(_nested(spark, sf_dir).frame, "who.at.segment")


@query("filter_nested_path", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey = 3")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(spark, sf_dir).matching({"who": {"at": {"_or": [{"segment": "building"}, {"nation": 3}]}}}).select("c_custkey")


# -- text

text_filter("text_or", {"text": "heon stti"}, "list_has_any(w, ['heon', 'stti'])")
text_filter("text_and", {"text": {"_and": "the thing"}}, "list_has_all(w, ['the', 'thing'])")
text_filter("text_phrase", {"text": '"of the"'}, "contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')")
text_filter("text_love_hate", {"text": "+the -and is"}, "list_contains(w, 'the') AND NOT list_contains(w, 'and')")
text_filter("text_partial", {"text": "therh**"}, "len(list_filter(w, lambda x: starts_with(x, 'therh'))) > 0")
text_filter("text_fuzzy", {"text": "thee~1"}, "len(list_filter(w, lambda x: levenshtein(x, 'thee') <= 1)) > 0")
text_filter("text_wildcard", {"text": "th?rh*"}, "len(list_filter(w, lambda x: regexp_full_match(x, 'th.rh.*'))) > 0")
text_filter("text_boolean", {"text": {"_and": "the AND NOT heon"}}, "list_contains(w, 'the') AND NOT list_contains(w, 'heon')")
text_filter("text_near", {"text": {"_near": "heon the"}}, "len(list_filter(range(1, len(w) + 1), lambda i: list_contains(w[i:i + 10], 'heon') AND list_contains(w[i:i + 10], 'the'))) > 0")
text_filter("text_near_n", {"text": "heon NEAR/3 the"}, "len(list_filter(range(1, len(w) + 1), lambda i: list_contains(w[i:i + 3], 'heon') AND list_contains(w[i:i + 3], 'the'))) > 0")
text_filter("text_adj_n", {"text": "heon ADJ/3 the"}, "len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'heon' AND list_contains(w[i + 1:i + 3], 'the'))) > 0")
text_filter("text_hyphen_phrase", {"text": "of-the"}, "contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')")
text_filter("text_ordered", {"text": {"_phrase": "the and of"}}, r"len(list_filter(range(1, len(w) + 1), lambda i: regexp_matches(array_to_string(w[i:i + 11], ' '), '^the( \S+)* and( \S+)* of( |$)'))) > 0")


@query("text_stopwords", f"WITH d AS ({_WORDS}) SELECT doc_id FROM d WHERE list_contains(w, 'idiot')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, stop_language="en").matching({"text": "the idiot of"}).select("doc_id")


@query("text_stop_words", f"WITH d AS ({_WORDS}) SELECT doc_id FROM d WHERE list_contains(w, 'heon')")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, stop_words=("idiot", "clown")).matching({"text": "idiot heon clown"}).select("doc_id")


@query("text_stemmed", f"WITH d AS ({_WORDS}) SELECT doc_id FROM d WHERE list_has_any(w, ['idiot', 'idiots', 'idioted', 'idioting'])")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, stem="some").matching({"text": "idiots"}).select("doc_id")


def _bm25(words: list[str], where: str, scored: list[str] | None = None, limit: int = 20, times: int = 1, boost: float = 1) -> str:
    """SQL of the ranking by BM25 over documents.text."""
    scored = words if scored is None else scored
    df = ", ".join(f"count(*) FILTER (list_contains(w, '{x}')) AS d{i}" for i, x in enumerate(scored))
    parts = " + ".join(
        f"CASE WHEN f{i} > 0 THEN f{i} / (greatest(len(w) / m, 0.5) * 0.5 + 0.5 + f{i}) * ln(CASE WHEN (n - d{i} + 0.5) / (d{i} + 0.5) < 2 THEN (n - d{i} + 0.5) / (d{i} + 0.5) / 2 + 1 ELSE (n - d{i} + 0.5) / (d{i} + 0.5) END) * 2 ELSE 0 END"
        for i in range(len(scored))
    )
    freq = ", ".join(f"{times} * len(list_filter(w, lambda y: y = '{x}')) AS f{i}" for i, x in enumerate(scored))
    return f"WITH d AS ({_WORDS}), s AS (SELECT count(*) AS n, avg(len(w)) AS m, {df} FROM d), k AS (SELECT *, {freq} FROM d, s WHERE {where}) SELECT doc_id, round({f'{boost} * ({parts})' if boost != 1 else parts}, 6) AS weight FROM k ORDER BY weight DESC, doc_id LIMIT {limit}"


def _ranked(spark: SparkSession, sf_dir: str, q: object, limit: int = 20, **options: object) -> DataFrame:
    hits = texts(spark, sf_dir, **options).scored(q).select("doc_id", F.round("_weight", 6).alias("weight"))
    return hits.orderBy(F.desc("weight"), "doc_id").limit(limit)


@query("bm25_field_weight", _bm25(["idiot", "clown"], "list_has_any(w, ['idiot', 'clown'])", times=3))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, {"text": "idiot clown"}, weights={"text": 3})


for _name, _q, _sql in (
    ("bm25_topk", {"text": "idiot clown heon"}, _bm25(["idiot", "clown", "heon"], "list_has_any(w, ['idiot', 'clown', 'heon'])")),
    ("bm25_and_maybe", {"_and_maybe": [{"text": "idiot"}, {"text": "clown"}]}, _bm25(["idiot", "clown"], "list_contains(w, 'idiot')")),
    ("bm25_filter", {"_filter": [{"text": "idiot"}, {"lang": "en"}]}, _bm25(["idiot"], "list_contains(w, 'idiot') AND lang = 'en'")),
    ("elite_set", {"text": {"_elite_set": "idiot clown moron"}}, _bm25(["idiot", "clown", "moron"], "list_has_any(w, ['idiot', 'clown', 'moron'])")),
):
    QUERIES[_name] = lambda spark, sf_dir, q=_q: _ranked(spark, sf_dir, q)
    ORACLE[_name] = _sql


@query("term_stats", f"WITH d AS ({_WORDS}), t AS (SELECT doc_id, unnest(w) AS word FROM d) SELECT word, count(DISTINCT doc_id) AS documents, count(*) AS total FROM t GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = texts(spark, sf_dir)
    return feedback.term_statistics(at.schema, at.schema.find("text"))



_IDF = "ln(CASE WHEN (n - k + 0.5) / (k + 0.5) < 2 THEN (n - k + 0.5) / (k + 0.5) / 2 + 1 ELSE (n - k + 0.5) / (k + 0.5) END) * 2"
_PART = "f / (greatest(length / m, 0.5) * 0.5 + 0.5 + f) * idf"
#: The best five hits of "idiot", the words that set them apart, and the weight of each in each document.
_FEEDBACK = f"""
    WITH d AS MATERIALIZED ({_WORDS}), s AS (SELECT count(*) AS n, avg(len(w)) AS m FROM d),
    t AS MATERIALIZED (SELECT doc_id, word, count(*) AS f FROM (SELECT doc_id, unnest(w) AS word FROM d) GROUP BY 1, 2),
    c AS MATERIALIZED (SELECT word, count(*) AS k FROM t GROUP BY 1),
    i AS MATERIALIZED (SELECT word, k, {_IDF} AS idf FROM c, s),
    p AS MATERIALIZED (SELECT doc_id, word, {_PART} AS part FROM t JOIN i USING (word) JOIN (SELECT doc_id, len(w) AS length FROM d) USING (doc_id), s),
    hits AS (SELECT doc_id FROM p WHERE word = 'idiot' ORDER BY part DESC, doc_id LIMIT 5),
    r AS (SELECT word, count(*) AS r FROM t WHERE doc_id IN (SELECT doc_id FROM hits) GROUP BY 1),
    e AS MATERIALIZED (
        SELECT word, weight, idf FROM (
            SELECT word, idf, round(r * ln((r + 0.5) * (n - k - h + r + 0.5) / ((k - r + 0.5) * (h - r + 0.5))), 9) AS weight
            FROM r JOIN i USING (word), s, (SELECT count(*) AS h FROM hits))
        WHERE weight > 0 ORDER BY weight DESC, word LIMIT 32),
    elite AS (SELECT word FROM e ORDER BY idf DESC, weight DESC, word LIMIT 10)"""


@query("nearest_docs", f"{_FEEDBACK} SELECT doc_id, round(sum(part), 6) AS weight FROM p WHERE word IN (FROM elite) GROUP BY 1 ORDER BY sum(part) DESC, 1 LIMIT 10")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).like({"text": "idiot"}, "text").select("doc_id", F.round("_weight", 6).alias("weight"))


@query("fuzzy_docs", f"{_FEEDBACK} SELECT doc_id, round(sum(part * (CASE WHEN word IN (FROM elite) THEN 1 ELSE 0 END + CASE WHEN word = 'idiot' THEN 1 ELSE 0 END)), 6) AS weight FROM p WHERE word IN (FROM elite) OR word = 'idiot' GROUP BY 1 ORDER BY sum(part * (CASE WHEN word IN (FROM elite) THEN 1 ELSE 0 END + CASE WHEN word = 'idiot' THEN 1 ELSE 0 END)) DESC, 1 LIMIT 10")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).like({"text": "idiot"}, "text", keep=True).select("doc_id", F.round("_weight", 6).alias("weight"))


@query("count_total", "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F'")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir, "orders").matching("o_orderstatus:F").agg(F.count("*").alias("total"))


@query("index_info", f"WITH d AS ({_WORDS}) SELECT count(*) AS doc_count, max(doc_id) AS last_id, round(avg(len(w)), 6) AS av_length, CAST(min(len(w)) AS INTEGER) AS doc_len_lower, CAST(max(len(w)) AS INTEGER) AS doc_len_upper FROM d")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).info("text").withColumn("av_length", F.round("av_length", 6))


@query("multi_index_union", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 5000")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..engine import Engine

    e = Engine()
    for table, p in (("customer", "c_cust"), ("supplier", "s_supp")):
        e.create(table, read(spark, sf_dir, table).select(F.col(f"{p}key").alias("id"), F.col(f"{p[0]}_name").alias("name"), F.col(f"{p[0]}_acctbal").alias("balance")), id_field="id")
    return e.index("customer,supplier").matching({"_and": [{"balance": {"_in": "5000.."}}, {"_not": [{"balance": 5000}]}]}).select("id", "name")


# -- places

_LON, _LAT = "(c_custkey % 360 - 180.0)", "(c_custkey * 7 % 170 - 85.0)"
_ANGLE = f"acos(least(greatest(sin(radians({_LAT})) * sin(radians(21.0)) + cos(radians({_LAT})) * cos(radians(21.0)) * cos(radians({_LON} - 10.0)), -1.0), 1.0))"


@query("geo_circle", f"SELECT c_custkey FROM customer WHERE {_ANGLE} <= 3000000 / 6371000.0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).matching({"place": {"_in": {"_circle": {"_longitude": 10, "_latitude": 21, "_radius": "3000km"}}}}).select("c_custkey")


@query("geo_sort", f"SELECT c_custkey FROM customer ORDER BY round({_ANGLE}, 9), c_custkey LIMIT 15")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).search("*", sort={"place": {"_value": "POINT(10 21)"}}, limit=15).select("c_custkey")


def _ring_sql(ring: list[tuple[float, float]]) -> str:
    """Whether a point is west of every edge of a convex ring, counter-clockwise: a product with each edge's normal."""
    tests = []
    for p, q in zip(ring, [*ring[1:], ring[0]], strict=True):
        u, v = geo.unit(*p), geo.unit(*q)
        n = u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]
        tests.append(f"cos(radians({_LAT})) * cos(radians({_LON})) * {n[0]!r} + cos(radians({_LAT})) * sin(radians({_LON})) * {n[1]!r} + sin(radians({_LAT})) * {n[2]!r} > 0")
    return " AND ".join(tests)


for _name, _ring in {"geo_polygon": [(0.5, -10.5), (40.5, -10.5), (40.5, 30.5), (0.5, 30.5)], "geo_polygon_antimeridian": [(160.5, -20.5), (-150.5, -30.5), (-160.5, 40.5), (170.5, 30.5)], "geo_polygon_pole": [(0.5, 60.5), (90.5, 55.5), (-179.5, 50.5), (-90.5, 65.5)]}.items():
    _text = f"POLYGON(({', '.join(f'{x} {y}' for x, y in [*_ring, _ring[0]])}))"
    QUERIES[_name] = lambda spark, sf_dir, text=_text: places(spark, sf_dir).matching({"place": {"_in": {"_ewkt": text}}}).select("c_custkey")
    ORACLE[_name] = f"SELECT c_custkey FROM customer WHERE {_ring_sql(_ring)}"


@query("geo_centroid", f"SELECT round(degrees(atan2(y, x)), 6) AS longitude, round(degrees(atan2(z, sqrt(x * x + y * y))), 6) AS latitude FROM (SELECT avg(cos(radians({_LAT})) * cos(radians({_LON}))) AS x, avg(cos(radians({_LAT})) * sin(radians({_LON}))) AS y, avg(sin(radians({_LAT}))) AS z FROM customer)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = places(spark, sf_dir).aggregations({"g": {"_geo_centroid": {"_field": "place"}}})["g"]
    return out.select(F.round("_longitude", 6).alias("longitude"), F.round("_latitude", 6).alias("latitude"))


def _trixels(level: int) -> list[tuple[int, tuple]]:
    """Every mesh triangle of a level: id and corners."""
    corners = [(0.0, 0.0, 1.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (-1.0, 0.0, 0.0), (0.0, -1.0, 0.0), (0.0, 0.0, -1.0)]
    found = [(8 + k, tuple(corners[i] for i in f)) for k, f in enumerate([(1, 5, 2), (2, 5, 3), (3, 5, 4), (4, 5, 1), (1, 0, 4), (4, 0, 3), (3, 0, 2), (2, 0, 1)])]

    def middle(u: tuple, v: tuple) -> tuple:
        w = [a + b for a, b in zip(u, v, strict=True)]
        size = sum(x * x for x in w) ** 0.5
        return tuple(x / size for x in w)

    for _ in range(level):
        found = [(4 * i + k, t) for i, (u, v, w) in found for k, t in enumerate([(u, middle(u, v), middle(u, w)), (v, middle(v, w), middle(u, v)), (w, middle(u, w), middle(v, w)), (middle(v, w), middle(u, w), middle(u, v))])]
    return found


def _trixel_sql(level: int) -> str:
    rows = []
    for i, (u, v, w) in _trixels(level):
        normals = [(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]) for a, b in ((u, v), (v, w), (w, u))]
        rows.append(f"({i}, {', '.join(repr(x) for n in normals for x in n)})")
    inside = " AND ".join(f"x * n{k}x + y * n{k}y + z * n{k}z >= -1e-12" for k in range(3))
    names = ", ".join(f"n{k}{c}" for k in range(3) for c in "xyz")
    return f"""
        WITH t(id, {names}) AS (VALUES {', '.join(rows)}),
        p AS (SELECT c_custkey, cos(radians({_LAT})) * cos(radians({_LON})) AS x, cos(radians({_LAT})) * sin(radians({_LON})) AS y, sin(radians({_LAT})) AS z FROM customer)
        SELECT key, count(*) AS doc_count FROM (SELECT c_custkey, CAST(min(id) AS BIGINT) AS key FROM p, t WHERE {inside} GROUP BY 1) GROUP BY 1"""


@query("geo_htm_bucket", _trixel_sql(3))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).aggregations({"t": {"_geo_trixels": {"_field": "place", "_level": 3}}})["t"]


@query("geo_distance_ranges", f"SELECT CASE WHEN {_ANGLE} * 6371000.0 < 5000000 THEN '..5000000' ELSE '5000000..' END AS key, count(*) AS doc_count FROM customer GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = [{"_to": 5000000}, {"_from": 5000000}]
    return places(spark, sf_dir).aggregations({"d": {"_geo_distance": {"_field": "place", "_origin": "POINT(10 21)", "_ranges": ranges}}})["d"]


@query("geo_bounds", f"SELECT min({_LAT})::DOUBLE AS bottom, max({_LAT})::DOUBLE AS top, min({_LON})::DOUBLE AS \"left\", max({_LON})::DOUBLE AS \"right\" FROM customer")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = places(spark, sf_dir).aggregations({"g": {"_geo_bounds": {"_field": "place"}}})["g"]
    return out.toDF(*[c.strip("_") for c in out.columns])


def _from(lon: float, lat: float) -> str:
    """Radians from a customer's place to another."""
    return f"acos(least(greatest(sin(radians({_LAT})) * sin(radians({lat})) + cos(radians({_LAT})) * cos(radians({lat})) * cos(radians({_LON} - {lon})), -1.0), 1.0))"


def _near_sql(lon: float, lat: float, metres: int) -> str:
    return f"{_from(lon, lat)} <= {metres} / 6371000.0"


_BOX = [(0.5, -10.5), (40.5, -10.5), (40.5, 30.5), (0.5, 30.5)]
_FAR_BOX = [(100.5, -10.5), (140.5, -10.5), (140.5, 30.5), (100.5, 30.5)]
_text_of = lambda ring: ", ".join(f"{x} {y}" for x, y in [*ring, ring[0]])
for _name, _shape, _where in (
    ("geo_point", {"_point": {"_longitude": -179, "_latitude": -78}}, f"{_LON} = -179 AND {_LAT} = -78"),
    ("geo_convex", {"_ewkt": "CONVEX((0.5 0.5, 3000000), (20.5 10.5, 2000000))"}, f"{_near_sql(0.5, 0.5, 3000000)} AND {_near_sql(20.5, 10.5, 2000000)}"),
    ("geo_multipoint", {"_ewkt": "MULTIPOINT(-179 -78, -178 -71)"}, f"({_LON} = -179 AND {_LAT} = -78) OR ({_LON} = -178 AND {_LAT} = -71)"),
    ("geo_multicircle", {"_ewkt": "MULTICIRCLE((0.5 0.5, 2000000), (179.5 10.5, 2000000))"}, f"{_near_sql(0.5, 0.5, 2000000)} OR {_near_sql(179.5, 10.5, 2000000)}"),
    ("geo_multiconvex", {"_ewkt": "MULTICONVEX(((0.5 0.5, 3000000), (20.5 10.5, 2000000)), ((90.5 40.5, 2500000)))"}, f"({_near_sql(0.5, 0.5, 3000000)} AND {_near_sql(20.5, 10.5, 2000000)}) OR {_near_sql(90.5, 40.5, 2500000)}"),
    ("geo_multipolygon", {"_ewkt": f"MULTIPOLYGON((({_text_of(_BOX)})), (({_text_of(_FAR_BOX)})))"}, f"({_ring_sql(_BOX)}) OR ({_ring_sql(_FAR_BOX)})"),
    ("geo_chull", {"_ewkt": f"CHULL(({_text_of(_BOX)}, 20.5 10.5))"}, _ring_sql(_BOX)),
    ("geo_collection", {"_ewkt": f"GEOMETRYCOLLECTION(CIRCLE(179.5 10.5, 2000000), POLYGON(({_text_of(_BOX)})))"}, f"{_near_sql(179.5, 10.5, 2000000)} OR ({_ring_sql(_BOX)})"),
    ("geo_intersection", {"_ewkt": f"GEOMETRYINTERSECTION(CIRCLE(0.5 0.5, 3000000), POLYGON(({_text_of(_BOX)})))"}, f"{_near_sql(0.5, 0.5, 3000000)} AND ({_ring_sql(_BOX)})"),
):
    QUERIES[_name] = lambda spark, sf_dir, shape=_shape: places(spark, sf_dir).matching({"place": {"_in": shape}}).select("c_custkey")
    ORACLE[_name] = f"SELECT c_custkey FROM customer WHERE {_where}"


@query("geo_mesh_ranges", f"SELECT c_custkey FROM customer WHERE {_near_sql(0.5, 0.5, 3000000)} AND ({_ring_sql(_BOX)})")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = places(spark, sf_dir).schema
    lon, lat = at.points["place"]
    frame = at.frame.withColumn("mesh", geo.trixel(lon, lat, 8))
    shape = f"GEOMETRYINTERSECTION(CIRCLE(0.5 0.5, 3000000), POLYGON(({_text_of(_BOX)})))"
    return Index(frame, "c_custkey", points=at.points, meshes={"place": ("mesh", 8)}).matching({"place": {"_in": {"_ewkt": shape}}}).select("c_custkey")


@query("geo_weight", f"SELECT c_custkey, round(pi() - {_from(10.0, 21.0)}, 6) AS weight FROM customer WHERE {_near_sql(10.0, 21.0, 3000000)}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = places(spark, sf_dir).scored({"place": {"_in": {"_ewkt": "CIRCLE(10 21, 3000000)"}}})
    return hits.select("c_custkey", F.round("_weight", 6).alias("weight"))


_CELL = geo.trixel_ids([10.5], [21.5], 2)[0].item()


@query("filter_accuracy_geo", _trixel_sql(2).replace("SELECT key, count(*) AS doc_count FROM", "SELECT c_custkey FROM").removesuffix("GROUP BY 1") + f"WHERE key = {_CELL}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places(spark, sf_dir).matching({"place._geo2": _CELL}).select("c_custkey")


# -- more of the language


@query("range_weight", "SELECT o_orderkey, 1.0::DOUBLE AS weight FROM orders WHERE o_totalprice >= 300000")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir, "orders").scored("o_totalprice:300000..").select("o_orderkey", F.col("_weight").alias("weight"))


filtered("filter_type_mismatch", "orders", {"o_orderkey": "1-URGENT"}, ["o_orderkey"], "lower(o_orderstatus) = '1-urgent' OR lower(o_orderpriority) = '1-urgent'")


def _timed(spark: SparkSession, sf_dir: str) -> Index:
    """Events with a time of day and a span of time as text."""
    at = F.pmod("event_id", F.lit(86400))
    clock = F.format_string("%02d:%02d:%02d", F.floor(at / 3600).cast("int"), F.pmod(F.floor(at / 60), F.lit(60)).cast("int"), F.pmod(at, F.lit(60)).cast("int"))
    return Index(read(spark, sf_dir, "events").select("event_id", clock.alias("at"), F.concat(F.lit("-"), clock).alias("span")), "event_id")


@query("filter_accuracy_time", "SELECT event_id FROM events WHERE event_id % 86400 // 60 = 7")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(spark, sf_dir).matching({"at._tminute": "00:07:30"}).select("event_id")


@query("filter_accuracy_timedelta", "SELECT event_id FROM events WHERE floor(-(event_id % 86400) / 60.0) = -8")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timed(spark, sf_dir).matching({"span._tdminute": "-00:07:30"}).select("event_id")


@query("agg_cardinality", "SELECT count(DISTINCT c_mktsegment) AS cardinality FROM customer")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir, "customer").aggregations({"m": {"_cardinality": {"_field": "c_mktsegment"}}})["m"].select(F.col("_cardinality").alias("cardinality"))


@query("bucket_missing", "SELECT 'missing' AS key, count(*) AS doc_count FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = read(spark, sf_dir, "customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return Index(frame, "c_custkey").aggregations({"m": {"_missing": {"_field": "segment"}}})["m"]


@query("agg_scripted", "SELECT round(sqrt(sum(c_acctbal * c_acctbal)), 2) AS norm FROM customer")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = {"m": {"_scripted_metric": {"_field": "c_acctbal", "_script": lambda x: F.sqrt(F.sum(x * x))}}}
    return index(spark, sf_dir, "customer").aggregations(tree)["m"].select(F.round("_scripted_metric", 2).alias("norm"))


@query("bucket_ip_range", "SELECT unnest(list_filter([CASE WHEN c_custkey % 4 = 1 THEN '10.1.0.0/16' END, CASE WHEN c_custkey % 4 >= 2 THEN 'high' END], lambda x: x IS NOT NULL)) AS key, count(*) AS doc_count FROM customer GROUP BY 1")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip = F.concat(F.lit("10."), (F.col("c_custkey") % 4).cast("string"), F.lit("."), (F.col("c_custkey") % 200).cast("string"), F.lit(".7"))
    at = Index(read(spark, sf_dir, "customer").select("c_custkey", ip.alias("ip")), "c_custkey")
    return at.aggregations({"b": {"_ip_range": {"_field": "ip", "_ranges": [{"_mask": "10.1.0.0/16"}, {"_key": "high", "_from": "10.2.0.0", "_to": "10.4.0.0"}]}}})["b"]


@query("search_ranked", f"SELECT doc_id, CAST(row_number() OVER (ORDER BY w DESC, doc_id) - 1 AS INTEGER) AS rank, round(100 * w / max(w) OVER (), 4) AS percent FROM ({_bm25(['idiot', 'clown'], "list_has_any(w, ['idiot', 'clown'])", limit=10).replace('AS weight', 'AS w').replace('ORDER BY weight', 'ORDER BY w')})")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = texts(spark, sf_dir).search({"text": "idiot clown"}, ranked=True)
    return hits.select("doc_id", F.col("_rank").alias("rank"), F.round("_percent", 4).alias("percent"))


_EITHER = _bm25(["idiot", "clown"], "list_has_any(w, ['idiot', 'clown'])")
for _op in ("_synonym", "_max"):
    QUERIES[f"text{_op}"] = lambda spark, sf_dir, op=_op: _ranked(spark, sf_dir, {"text": {op: "idiot clown"}})
    ORACLE[f"text{_op}"] = _EITHER.replace("round(CASE", "round(greatest(CASE").replace(" END + CASE WHEN f1", " END, CASE WHEN f1").replace("END, 6)", "END), 6)")


@query("boost", _bm25(["idiot"], "list_contains(w, 'idiot')", boost=2.5))
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir, {"_boost": {"_query": {"text": "idiot"}, "_factor": 2.5}})


@query("get_selected", "SELECT o_totalprice FROM orders WHERE o_orderkey = 3")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir, "orders").get(3, "{o_totalprice}")


@query("doc_terms", f"WITH d AS ({_WORDS} WHERE doc_id = 3) SELECT 'text' AS field, word AS value, count(*)::DOUBLE AS wdf FROM (SELECT unnest(w) AS word FROM d) GROUP BY 2 UNION ALL SELECT 'lang', lower(lang), 1.0::DOUBLE FROM d")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).describe(3).where("kind = 'term' and field in ('text', 'lang')").select("field", "value", "wdf")


# -- functions


@query("soundex_en", "SELECT p_partkey, upper(letters[1]) || regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(lower(letters), 'bpfvcksgjqxzdtlmnraehiouwy', '11223334455566788900000000'), '0+', '0', 'g'), '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g'), '7+', '7', 'g'), '8+', '8', 'g'), '9+', '9', 'g') AS code FROM (SELECT p_partkey, regexp_replace(p_name, '[^A-Za-z]', '', 'g') AS letters FROM part)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", phonetic.soundex(F.col("p_name")).alias("code"))


@query("date_truncation", "SELECT o_orderkey, make_timestamp(year(o_orderdate) - year(o_orderdate) % 10, 1, 1, 0, 0, 0) AS decade, make_timestamp(year(o_orderdate) - year(o_orderdate) % 100, 1, 1, 0, 0, 0) AS century, date_trunc('week', o_orderdate)::TIMESTAMP AS week FROM orders")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate")
    return read(spark, sf_dir, "orders").select("o_orderkey", *[dates.truncate(at, u).alias(u) for u in ("decade", "century", "week")])


# -- schema and store


@query("json_infer", "SELECT 'k' AS path, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) < 0 THEN 'integer' ELSE 'positive' END AS type, false AS array, count(*) AS n FROM events GROUP BY 1, 2, 3 UNION ALL SELECT 'name', 'keyword', false, count(*) FROM events UNION ALL SELECT 'tags', 'keyword', true, count(*) * 2 FROM events UNION ALL SELECT 'at', 'datetime', false, count(*) FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    body = F.to_json(F.struct(k.alias("k"), F.col("event_type").alias("name"), F.array("event_type", F.lit("x")).alias("tags"), F.lit("2024-01-05").alias("at")))
    return infer.type_counts(read(spark, sf_dir, "events").select(body.alias("j")), "j")


@query("json_infer_deep", "SELECT 'a.b.c.d.e.f.g.h' AS path, 'keyword' AS type, true AS array, count(*) AS n FROM events UNION ALL SELECT 'a.n', 'floating', false, count(*) FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('{"a": {"n": 1.5, "z": null, "b": {"c": {"d": {"e": {"f": {"g": [{"h": "'), F.col("event_type"), F.lit('"}]}}}}}}}'))
    return infer.type_counts(read(spark, sf_dir, "events").select(body.alias("j")), "j")


def _changes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice").withColumn(store.VERSION, F.lit(1))
    new = base.where("o_orderkey % 10 = 0").select(F.when(F.col("o_orderkey") % 20 == 0, F.col("o_orderkey")).otherwise(-F.col("o_orderkey")).alias("o_orderkey"), F.lit("X").alias("o_orderstatus"), F.lit(None).cast("double").alias("o_totalprice"))
    return base, new.withColumn(store.VERSION, F.lit(1))


_NEW = "(SELECT CASE WHEN o_orderkey % 20 = 0 THEN o_orderkey ELSE -o_orderkey END AS k FROM orders WHERE o_orderkey % 10 = 0)"


@query("doc_put", f"SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT k FROM {_NEW}) UNION ALL SELECT k, 'X', NULL FROM {_NEW}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, new = _changes(spark, sf_dir)
    return store.put(base, new, "o_orderkey").drop(store.VERSION)


@query("doc_upsert", f"SELECT coalesce(k, o_orderkey) AS o_orderkey, CASE WHEN k IS NULL THEN o_orderstatus ELSE 'X' END AS o_orderstatus, o_totalprice, CAST(CASE WHEN o_orderkey IS NULL THEN 0 ELSE 1 END + CASE WHEN k IS NULL THEN 0 ELSE 1 END AS INTEGER) AS version FROM orders FULL JOIN {_NEW} ON k = o_orderkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, new = _changes(spark, sf_dir)
    return store.upsert(base, new, "o_orderkey").withColumnRenamed(store.VERSION, "version")


@query("doc_upsert_repeated", f"SELECT coalesce(k, o_orderkey) AS o_orderkey, CASE WHEN k IS NULL THEN o_orderstatus ELSE 'Y' END AS o_orderstatus FROM orders FULL JOIN {_NEW} ON k = o_orderkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, new = _changes(spark, sf_dir)
    return store.upsert(base, new.union(new.withColumn("o_orderstatus", F.lit("Y")).withColumn(store.VERSION, F.lit(2))), "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("doc_merge", f"SELECT o_orderkey, CASE WHEN k IS NULL THEN o_orderstatus ELSE 'X' END AS o_orderstatus, o_totalprice FROM orders LEFT JOIN {_NEW} ON k = o_orderkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, new = _changes(spark, sf_dir)
    return store.update(base, new, "o_orderkey").drop(store.VERSION)


@query("doc_delete", f"SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT k FROM {_NEW})")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, new = _changes(spark, sf_dir)
    return store.delete(base, new, "o_orderkey").select("o_orderkey")


@query("doc_script", f"SELECT o_orderkey, CASE WHEN k IS NULL THEN o_orderstatus ELSE 'X' END AS o_orderstatus, CASE WHEN k IS NULL THEN o_totalprice ELSE o_totalprice + 5 END AS o_totalprice FROM orders LEFT JOIN {_NEW} ON k = o_orderkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..engine import Engine

    base, new = (x.drop(store.VERSION) for x in _changes(spark, sf_dir))
    e = Engine()
    e.create("orders", base, id_field="o_orderkey")
    e.script("raise", lambda docs, method, by: docs.where("_old_doc is not null").withColumn("o_totalprice", F.col("_old_doc.o_totalprice") + by))
    return e.write("orders", new, "update", "raise", by=5).frame


@query("doc_patch", "SELECT c_custkey, c_name AS title, least(c_nationkey + 5, 20) AS c_nationkey, 'new' AS c_mktsegment FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT c_custkey, NULL, c_nationkey, c_mktsegment FROM customer WHERE c_acctbal < 0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = [{"op": "copy", "from": "/c_name", "path": "/title"}, {"op": "incr", "path": "/c_nationkey", "value": 5, "limit": 20}, {"op": "replace", "path": "/c_mktsegment", "value": "new"}]
    return index(spark, sf_dir, "customer").patch(ops, "c_acctbal:0..").frame.select("c_custkey", "title", "c_nationkey", "c_mktsegment")


_TESTED = "c_mktsegment = 'BUILDING'"


@query("doc_patch_test_remove", f"SELECT c_custkey, CASE WHEN {_TESTED} THEN NULL ELSE c_name END AS c_name, CASE WHEN {_TESTED} THEN 0 ELSE c_nationkey END AS c_nationkey FROM customer")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = [{"op": "replace", "path": "/c_nationkey", "value": 0}, {"op": "test", "path": "/c_mktsegment", "value": "BUILDING"}, {"op": "remove", "path": "/c_name"}]
    return index(spark, sf_dir, "customer").patch(ops).frame.select("c_custkey", "c_name", "c_nationkey")


@query("doc_patch_test_move", f"SELECT c_custkey, CASE WHEN {_TESTED} THEN NULL ELSE c_name END AS c_name, CASE WHEN {_TESTED} THEN c_name END AS title FROM customer")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = [{"op": "test", "path": "/c_mktsegment", "value": "BUILDING"}, {"op": "move", "from": "/c_name", "path": "/title"}]
    return index(spark, sf_dir, "customer").patch(ops).frame.select("c_custkey", "c_name", "title")


@query("doc_get", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 3")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, sf_dir, "orders").get(3).select("o_orderkey", "o_totalprice")


@query("relevance_terms", f"{_FEEDBACK} SELECT word, weight FROM e")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = texts(spark, sf_dir)
    ids = [r[0] for r in at.search({"text": "idiot"}, limit=feedback.N_RSET).select("doc_id").collect()]
    found = feedback.expansion(at.schema, at.schema.find("text"), ids, "doc_id")
    return spark.createDataFrame(found or [("", 0.0)], "word string, weight double")


__all__ = ["KEYS", "ORACLE", "QUERIES", "geo"]

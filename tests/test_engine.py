import json
from datetime import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathom.engine import Engine, Index
from fathom.functions import casts, dates, geo, phonetic, porter, strings
from fathom.operators import order, store
from fathom.plans.querystring import parse, parse_range, parse_text
from fathom.sources import formats, infer, msgpack
from fathom.streaming.ingest import generation, ingest


def test_precedence_and_flattening():
    assert parse("a:1 OR b:2 AND c:3") == {"_or": [{"a": "1"}, {"_and": [{"b": "2"}, {"c": "3"}]}]}
    assert parse("a:1 b:2") == {"_or": [{"a": "1"}, {"b": "2"}]}
    assert parse("NOT a:1 AND b:2") == {"_and": [{"_not": [{"a": "1"}]}, {"b": "2"}]}
    assert parse("a:1 MAYBE b:2 XOR c:3") == {"_xor": [{"_and_maybe": [{"a": "1"}, {"b": "2"}]}, {"c": "3"}]}
    assert parse("(a:1 | b:2) & !c:3") == {"_and": [{"_or": [{"a": "1"}, {"b": "2"}]}, {"_not": [{"c": "3"}]}]}


@pytest.mark.parametrize("bad", ["a:1 AND", "(a:1", "a:1)", "AND a:1"])
def test_bad_queries(bad):
    with pytest.raises(ValueError):
        parse(bad)


def test_ranges():
    assert parse_range("1..5") == {"_from": "1", "_to": "5"}
    assert parse_range("..5") == {"_to": "5"}
    assert parse_range("[1,]") == {"_from": "1"}
    assert parse_range("(1,5]") == {"_from": "1", "_to": "5", "_open": "(]"}
    assert parse_range('["a b",\'c\']') == {"_from": "a b", "_to": "c"}
    assert parse_range("plain") is None
    with pytest.raises(ValueError):
        parse_range("1..2..3")


def test_text_language():
    q = parse_text('one "two three" +must -never par** wi?d* fuz~1')
    assert q.must == [("word", "must")] and q.never == [("word", "never")]
    assert q.any == [("word", "one"), ("phrase", ["two", "three"]), ("partial", "par"), ("wild", "wi?d*"), ("fuzzy", "fuz", 1)]


@given(st.recursive(st.sampled_from(["a:1", "b:2", "c:3"]), lambda x: st.tuples(st.sampled_from(["AND", "OR", "XOR"]), x, x), max_leaves=6))
def test_query_string_means_its_tree(tree):
    show = lambda t: t if isinstance(t, str) else f"({show(t[1])} {t[0]} {show(t[2])})"

    def true(t, on):
        if isinstance(t, str):
            return t in on
        a, b = true(t[1], on), true(t[2], on)
        return {"AND": a and b, "OR": a or b, "XOR": a != b}[t[0]]

    def value(q, on):
        ((op, items),) = q.items()
        if not op.startswith("_"):
            return f"{op}:{items}" in on
        got = [value(i, on) for i in items]
        return {"_and": all(got), "_or": any(got), "_xor": sum(got) % 2 == 1}[op]

    for on in ([], ["a:1"], ["a:1", "b:2"], ["b:2", "c:3"], ["a:1", "b:2", "c:3"]):
        assert value(parse(show(tree)), on) == true(tree, on)


def test_string_distances(spark):
    df = spark.createDataFrame([("cook", "cooking"), ("cook", "cook"), ("", "x"), ("cook", "bookstore")], "a string, b string")
    got = {m: [r[0] for r in df.select(strings.metric(m)(F.col("a"), F.col("b"))).collect()] for m in ("jaro", "jarowinkler", "lcs", "lcsq", "dice", "jaccard", "levenshtein", "soundex")}
    assert got["jaro"][0] == pytest.approx(0.142857, abs=1e-6)
    assert got["jarowinkler"][3] == pytest.approx(0.305556, abs=1e-6)
    assert all(d[1] == 0.0 and d[2] == 1.0 for d in got.values())
    assert got["lcs"][0] == pytest.approx(1 - 4 / 7) and got["lcsq"][3] == pytest.approx(1 - 3 / 9)


def test_soundex(spark):
    words = ["Caren", "!!caron-", "Lambard", "brrraz", "aaaa", "Hark", ""]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(phonetic.soundex(F.col("w"))).collect()]
    assert got == ["C30908", "C30908", "L7081096", "B1905", "A0", "H093", ""]
    assert phonetic.german("Müller-Lüdenscheidt") == phonetic.german("Mueller Luedenscheidt") == "6050750206802"
    assert phonetic.german("Meier") == phonetic.german("Mayr") == "607"
    assert phonetic.spanish("Queso") == phonetic.spanish("kiso") == "K2020" and phonetic.spanish("Vena") == "B1050"
    assert phonetic.french("GRAU") == phonetic.french("GROS") and phonetic.french("ROUSSOT") == phonetic.french("RASSAT")


def test_dates():
    assert dates.parse("2012-02-29||+1y") == datetime(2013, 2, 28)
    assert dates.parse("2015-03-18||//w") == datetime(2015, 3, 15)
    assert dates.parse("2015-03-18||/M") == datetime(2015, 3, 31, 23, 59, 59, 999999)
    assert dates.parse("20150318T10:20:30+02:00") == datetime(2015, 3, 18, 8, 20, 30)
    assert dates.parse("nonsense") is None
    assert dates.parse_time("01:02:03") == 3723 and dates.parse_time("-00:01") == -60


def test_casts():
    assert casts.cast("_integer", "12") == 12 and casts.cast("_boolean", "t") is True
    assert casts.guess("2011-01-01") == "datetime" and casts.guess("POINT(1 2)") == "geo" and casts.guess("one two") == "text"
    u = "5759b016-10c0-4526-a981-47d6d19f6fb4"
    assert casts.guess("{" + u.upper() + "}") == "uuid" and casts.decode_uuid(casts.encode_uuid(u)) == u
    with pytest.raises(ValueError):
        casts.cast("_positive", -1)


def test_stems():
    assert [porter.stem(w) for w in ("caresses", "ponies", "relational", "hopping", "happy", "generalizations")] == ["caress", "poni", "relat", "hop", "happi", "gener"]


def test_geometry(spark):
    df = spark.createDataFrame([(0, 10.0, 21.0), (1, 0.0, 0.0), (2, 5.0, 5.0)], "id int, lon double, lat double")
    inside = lambda text: [r[0] for r in df.where(geo.parse_ewkt(text).contains(F.col("lon"), F.col("lat"))).orderBy("id").collect()]
    assert inside("POINT(10 21)") == [0] and inside("CIRCLE(0 0, 2000000)") == [1, 2]
    assert inside("SRID=4326;POLYGON((-1 -1, 6 -1, 6 6, -1 6, -1 -1))") == [1, 2]
    assert inside("MULTIPOINT(0 0, 5 5)") == [1, 2] and inside("CONVEX((0 0, 2000000), (10 10, 1000000))") == [2]
    assert inside("GEOMETRYCOLLECTION(POINT(10 21), CIRCLE(0 0, 10))") == [0, 1]
    assert inside("GEOMETRYINTERSECTION(CIRCLE(0 0, 2000000), POINT(5 5))") == [2]
    assert inside("CHULL((0 0, 6 0, 0 6, 6 6, 3 3))")[-1:] == [2]
    near, far = geo.trixel_ids([10.0, 10.0001], [21.0, 21.0001], 8), geo.trixel_ids([-100.0], [-21.0], 8)
    assert near[0] == near[1] != far[0] and near[0].item().bit_length() == 4 + 16
    assert geo.xor_ranges([(1, 5)], [(4, 9)]) == [(1, 3), (6, 9)] and geo.union_ranges([(1, 2)], [(3, 4)]) == [(1, 4)]


def test_selector(spark):
    df = spark.createDataFrame([(1, (2, (3, 4)))], "a int, b struct<c int, d struct<e int, f int>>")
    assert order.select(df, "{a,b{d{e}}}").schema.simpleString() == "struct<a:int,b:struct<d:struct<e:int>>>"
    assert order.select(df, "b.d.f").first()[0] == 4


def test_missing_values_sort_last_both_ways(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 7)], "_id int, x int")
    assert [r[0] for r in Index(df).search("*", sort="x").collect()] == [2, 3, 1]
    assert [r[0] for r in Index(df).search("*", sort="-x").collect()] == [3, 2, 1]


def test_ranked_search(spark):
    df = spark.createDataFrame([(1, "red fox"), (2, "red red dog"), (3, "blue")], "_id int, t string")
    hits = Index(df, text=("t",)).search({"t": "red dog"}, ranked=True).collect()
    assert [h["_id"] for h in hits] == [2, 1] and hits[0]["_percent"] == 100 and [h["_rank"] for h in hits] == [0, 1]


def test_rendered_aggregation(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (2, "a", 4.0), (3, "b", 1.0)], "_id int, k string, v double")
    tree = Index(df).aggregate({"ks": {"_values": {"_field": "k"}, "_aggs": {"m": {"_std_deviation": {"_field": "v"}}}}})
    assert [(b["_key"], b["_doc_count"]) for b in tree["ks"]] == [("a", 2), ("b", 1)]
    assert tree["ks"][0]["m"]["_std_deviation"] == pytest.approx(2**0.5) and tree["ks"][1]["m"]["_std_deviation"] is None


def test_max_of_negatives_and_open_range_with_zero(spark):
    df = spark.createDataFrame([(1, -5.0), (2, -1.0), (3, 0.0)], "_id int, v double")
    i = Index(df.where("v < 0"))
    assert i.aggregations({"m": {"_max": {"_field": "v"}}})["m"].first()[0] == -1.0
    r = Index(df).aggregations({"r": {"_range": {"_field": "v", "_ranges": [{"_to": 1}]}}})["r"].first()
    assert r["doc_count"] == 3


def test_store_versions(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 3)], "_id int, x string, _version int")
    new = spark.createDataFrame([(2, None, 2), (3, "c", None)], "_id int, x string, _version int")
    got = {r["_id"]: (r["x"], r["_version"]) for r in store.upsert(base, new, "_id").collect()}
    assert got == {1: ("a", 1), 2: ("b", 4), 3: ("c", 1)}
    with pytest.raises(store.VersionConflict):
        store.checked(base, new, "_id")


def test_patch(spark):
    df = spark.createDataFrame([(1, ("x", 5))], "_id int, s struct<a string, n int>")
    ops = [{"op": "test", "path": "/_id", "value": 1}, {"op": "decr", "path": "/s/n", "value": 3, "limit": 4}, {"op": "move", "from": "/s/a", "path": "/b"}, {"op": "add", "path": "/s/c", "value": True}]
    assert store.patch(df, ops[1:]).first().asDict(True) == {"_id": 1, "s": {"n": 4, "c": True}, "b": "x"}
    # With a test some rows may stay as they were, so a field that goes is null.
    assert store.patch(df, ops).first().asDict(True) == {"_id": 1, "s": {"a": None, "n": 4, "c": True}, "b": "x"}
    same = store.patch(df, [{"op": "test", "path": "/_id", "value": 2}, {"op": "incr", "path": "/s/n"}]).first().asDict(True)
    assert same["s"]["n"] == 5


def test_engine_indexes_and_scripts(spark):
    e = Engine()
    e.create("a", spark.createDataFrame([(1, "x")], "_id int, v string"))
    e.create("b", spark.createDataFrame([(2, "y")], "_id int, v string"))
    assert e.index("a,b").count() == 2 and e.index("a").exists(1) and not e.index("a").exists(2)
    e.script("upper", lambda df: df.withColumn("v", F.upper("v")))
    assert e.run("upper", "a").get(1).first()["v"] == "X"


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", [1.5, None]), (2, None, [])], "a long, b string, c array<double>")
    for kind in ("ndjson", "parquet", "orc", "msgpack"):
        formats.dump(df, f"{tmp_path}/{kind}", kind)
        assert sorted(formats.restore(spark, f"{tmp_path}/{kind}", kind, df.schema).collect()) == sorted(df.collect())
    assert formats.loads('{"a": [1, 2,], // note\n "b": "x//y", /* z */}') == {"a": [1, 2], "b": "x//y"}
    assert formats.yaml_loads("a: 1\nb:\n  - x\n  - c: 2\n    d: true\n") == {"a": 1, "b": ["x", {"c": 2, "d": True}]}


@given(st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False) | st.text(max_size=40) | st.binary(max_size=300), lambda x: st.lists(x, max_size=20) | st.dictionaries(st.text(max_size=5), x, max_size=18), max_leaves=40))
def test_msgpack_round_trip(x):
    assert msgpack.unpack_all(msgpack.pack(x)) == [x]


def test_inference(spark):
    docs = [{"n": 1, "s": "one two", "d": "2020-01-01", "o": {"b": True}, "l": [1, -2]}, {"n": 2.5, "s": "x", "z": None, "#note": 1}]
    found = infer.infer(spark.createDataFrame([(json.dumps(d),) for d in docs], "j string"), "j")
    assert {k: (v.type, v.array) for k, v in found.items()} == {"n": ("floating", False), "s": ("text", False), "d": ("datetime", False), "o.b": ("boolean", False), "l": ("integer", True)}
    with pytest.raises(infer.TypeMismatch):
        infer.infer(spark.createDataFrame([('{"a": 1}',), ('{"a": true}',)], "j string"), "j")


def test_streaming_ingest(spark, tmp_path):
    inbox, table, at = (str(tmp_path / x) for x in ("inbox", "table", "at"))
    for rows in ([(1, "a", 1), (1, "b", 2), (2, "c", 1)], [(1, "old", 1), (2, "d", 5), (3, "e", 1)]):
        spark.createDataFrame(rows, "k int, v string, _version int").coalesce(1).write.mode("append").parquet(inbox)
        ingest(spark.readStream.schema("k int, v string, _version int").parquet(inbox), table, "k", "_version", at).awaitTermination(120)
    assert {r.k: r.v for r in generation(spark, table).collect()} == {1: "b", 2: "d", 3: "e"}


@pytest.mark.parametrize("metric", ["jaro", "jarowinkler", "lcs", "lcsq", "levenshtein", "dice", "jaccard", "soundex"])
def test_string_distance_reads_whole_arrays(spark, metric):
    far = ["zzzz"] * 10
    rows = [(1, [*far, "robert"]), (2, ["rupert", *far]), (3, None), (4, []), (5, [*far, None, "robin"]), (6, far)]
    df = spark.createDataFrame(rows, "_id long, names array<string>")
    for language in ("en", "fr") if metric == "soundex" else ("en",):
        spec = {"_value": "robert", "_metric": metric, "_language": language}
        got = [r._id for r in Index(df).search("*", sort=[{"names": spec}]).collect()]
        assert set(got[-2:]) == {3, 4} and got[3] == 6 and got[0] == 1
        down = [r._id for r in Index(df).search("*", sort=[{"names": {**spec, "_order": "desc"}}]).collect()]
        assert down[:4] == [1, 2, 5, 6]


@pytest.mark.parametrize("ops", [
    [{"op": "test", "path": "/_id", "value": 1}, {"op": "remove", "path": "/a"}],
    [{"op": "remove", "path": "/a"}, {"op": "test", "path": "/_id", "value": 1}],
    [{"op": "test", "path": "/_id", "value": 1}, {"op": "move", "from": "/a", "path": "/b"}],
    [{"op": "replace", "path": "/n", "value": 0}, {"op": "test", "path": "/_id", "value": 1}],
    [{"op": "add", "path": "/s/x", "value": "new"}, {"op": "remove", "path": "/s/p"}, {"op": "test", "path": "/_id", "value": 1}, {"op": "test", "path": "/n", "value": 5}],
    [{"op": "add", "path": "/l/1", "value": 9}, {"op": "remove", "path": "/l/0"}, {"op": "test", "path": "/l/0", "value": 9}, {"op": "test", "path": "/_id", "value": 1}],
])
def test_a_failed_test_leaves_its_row(spark, ops):
    df = spark.createDataFrame([(1, "A", 5, ("p", 1), [1, 2]), (2, "B", 6, ("q", 2), [3, 4]), (3, None, None, None, None)], "_id int, a string, n int, s struct<p string, q int>, l array<int>")
    got = {r["_id"]: r.asDict(True) for r in store.patch(df, ops).collect()}
    for old in (r.asDict(True) for r in df.where("_id > 1").collect()):
        new = got[old["_id"]]
        for k, v in old.items():
            kept = {x: y for x, y in new[k].items() if x in v} if isinstance(v, dict) else new[k]
            assert kept == v, (k, new)
        assert all(new[k] is None for k in new if k not in old)
    assert got[1] != df.where("_id = 1").first().asDict(True)


def test_patches_of_arrays(spark):
    df = spark.createDataFrame([(1, [1, 2, 3], [("x", 1), ("y", 2)])], "_id int, l array<int>, o array<struct<k string, v int>>")
    ops = [{"op": "add", "path": "/l/1", "value": 9}, {"op": "add", "path": "/l/-", "value": 7}, {"op": "remove", "path": "/l/0"}, {"op": "replace", "path": "/l/0", "value": 8}, {"op": "incr", "path": "/o/1/v", "value": 5}, {"op": "copy", "from": "/l/1", "path": "/first"}]
    got = store.patch(df, ops).first().asDict(True)
    assert got == {"_id": 1, "l": [8, 2, 3, 7], "o": [{"k": "x", "v": 1}, {"k": "y", "v": 7}], "first": 2}
    with pytest.raises(ValueError):
        store.patch(df, [{"op": "remove", "path": "/nothing"}])


def test_buckets_cut_by_a_limit_take_their_children(spark):
    df = spark.createDataFrame([(k, "a" if k < 6 else "b", f"x{k % 2}", 1.0) for k in range(10)], "_id int, p string, c string, v double")
    tree = {"ps": {"_values": {"_field": "p", "_limit": 1}, "_aggs": {"cs": {"_values": {"_field": "c"}, "_aggs": {"m": {"_sum": {"_field": "v"}}}}, "s": {"_sum": {"_field": "v"}}}}}
    got = Index(df).aggregations(tree)
    assert {r["key"] for name in got for r in got[name].collect()} == {"a"}
    assert got["ps.cs"].count() == 2 and got["ps.cs.m"].columns[:2] == ["key", "key_1"]


def test_documents_may_have_columns_named_like_keys(spark):
    df = spark.createDataFrame([(1, "a", "q", 2), (2, "a", "r", 3)], "_id int, k string, key string, key_1 int")
    got = Index(df).aggregations({"ks": {"_values": {"_field": "k"}, "_aggs": {"keys": {"_values": {"_field": "key"}, "_aggs": {"m": {"_sum": {"_field": "key_1"}}}}}}})
    assert sorted(tuple(r) for r in got["ks.keys.m"].collect()) == [("a", "q", 2.0), ("a", "r", 3.0)]


def test_repeated_keys_of_an_update_are_one(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "_id int, x string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e"), (3, "e")], "_id int, x string")
    for change, want in ((store.upsert, {1: "a", 2: "d", 3: "e"}), (store.update, {1: "a", 2: "d"}), (store.put, {1: "a", 2: "d", 3: "e"})):
        rows = change(base, new, "_id").collect()
        assert {r["_id"]: r["x"] for r in rows} == want and len(rows) == len(want)


def test_deep_documents_are_inferred(spark):
    deep = {"v": -1}
    for k in range(40):
        deep = {f"k{k}": [deep]}
    found = infer.infer(spark.createDataFrame([(json.dumps(deep),), (None,), ("3",)], "j string"), "j")
    (path,) = [p for p in found if p.endswith(".v")]
    assert path.count(".") == 40 and found[path].array and found[path].type == "integer"


def test_great_circle_polygons(spark):
    df = spark.createDataFrame([(0, 179.5, 0.0), (1, -179.5, 5.0), (2, 0.0, 0.0), (3, 0.0, 44.0), (4, 0.0, 40.5), (5, 12.0, 89.0), (6, None, 1.0)], "id int, lon double, lat double")
    inside = lambda text: [r[0] for r in df.where(geo.parse_ewkt(text).contains(F.col("lon"), F.col("lat"))).orderBy("id").collect()]
    assert inside("POLYGON((170 -10, -170 -10, -170 10, 170 10, 170 -10))") == [0, 1]
    # the arc from (-40, 40) to (40, 40) rises to 47.6 degrees: 44 lies south of it
    assert inside("POLYGON((-40 40, 40 40, 40 60, -40 60, -40 40))") == []
    assert inside("POLYGON((-40 20, 40 20, 40 40, -40 40, -40 20))") == [3, 4]
    assert inside("POLYGON((0 60, 90 60, 180 60, -90 60, 0 60))") == [5]
    assert inside("CHULL((170 -10, -170 -10, -170 10, 170 10, 180 0))") == [0, 1]
    assert len(geo.hull([(170.0, -10.0), (-170.0, -10.0), (-170.0, 10.0), (170.0, 10.0), (180.0, 0.0)])) == 4
    place = df.where("id < 2").agg(*geo.mean_place(F.col("lon"), F.col("lat"))).first()
    assert abs(abs(place[0]) - 180) < 1 and abs(place[1] - 2.5) < 0.1


def test_boxes_hold_their_shapes(spark):
    import random

    r = random.Random(3)
    df = spark.createDataFrame([(r.uniform(-180, 180), r.uniform(-90, 90)) for _ in range(4000)], "lon double, lat double")
    shapes = ["CIRCLE(0 0, 2000000)", "CIRCLE(179 10, 900000)", "CIRCLE(20 85, 1500000)", "POLYGON((-40 40, 40 40, 40 60, -40 60, -40 40))", "CONVEX((0 0, 2000000), (10 10, 1000000))", "MULTICIRCLE((0 0, 500000), (60 10, 900000))"]
    for text in shapes:
        g = geo.parse_ewkt(text)
        lon, lat = F.col("lon"), F.col("lat")
        assert df.where(g._holds(lon, lat) & ~g.within_box(lon, lat)).count() == 0
        assert 0 < df.where(g.contains(lon, lat)).count() == df.where(g._holds(lon, lat)).count()


def test_other_reference_systems():
    from fathom.functions.crs import DATUMS, geocentric, geodetic, to_wgs84

    for srid, (axes, _) in DATUMS.items():
        lon, lat = to_wgs84(10.0, 45.0, srid)
        assert abs(lon - 10) < 0.02 and abs(lat - 45) < 0.02
        assert max(map(abs, (a - b for a, b in zip(geodetic(*geocentric(-70.5, -33.25, axes), axes), (-70.5, -33.25), strict=True)))) < 1e-9
    assert geo.parse_ewkt("SRID=4326;POINT(10 21)").points == [(10.0, 21.0)]
    assert geo.parse_ewkt("SRID=4277;CIRCLE(-1 52, 10)").points != [(-1.0, 52.0)]
    with pytest.raises(ValueError):
        geo.parse_ewkt("SRID=9999;POINT(1 2)")


def found(frame, q, **options):
    return sorted(r[0] for r in Index(frame, text=("t",), **options).matching({"t": q}).select("_id").collect())


def test_windows_in_text_queries(spark):
    df = spark.createDataFrame([(1, "red small fox runs"), (2, "fox then a red hen"), (3, "red a b c d e f g h i j k fox"), (4, "red fox")], "_id int, t string")
    assert parse_text("a NEAR/3 b NEAR c d").any == [("near", ["a", "b", "c"], 12), ("word", "d")]
    assert found(df, "red NEAR/2 fox") == [1, 4] and found(df, "red NEAR/3 fox") == [1, 2, 4]
    assert found(df, "red ADJ/3 fox") == [1, 4] and found(df, "red ADJ fox") == [1, 4] and found(df, "fox ADJ red") == [2]
    assert found(df, {"_near": "fox red"}) == [1, 2, 4] and found(df, {"_phrase": "red fox"}) == [1, 4]


def test_stems_stop_words_and_weights(spark):
    df = spark.createDataFrame([(1, "relational tables"), (2, "a relation"), (3, "Relate it"), (4, "hopping the fence"), (5, None)], "_id int, t string")
    assert found(df, "relations") == [] and found(df, "relations", stem="some") == [1, 2, 3] and found(df, "Relational", stem="some") == [1]
    assert found(df, "Relates", stem="all") == [1, 2, 3] and found(df, "hops", stem="some") == [4] and found(df, '"hopping the"', stem="some") == [4]
    assert found(df, "the hopping", stop_words=("the",)) == [4] and found(df, "the", stop_language="en") == []
    plain = Index(df, text=("t",)).scored({"t": "fence"}).first()["_weight"]
    heavy = Index(df, text=("t",), weights={"t": 3}).scored({"t": "fence"}).first()["_weight"]
    assert heavy > plain > 0
    stemmed = {r["_id"]: r["_weight"] for r in Index(df, text=("t",), stem="some").scored({"t": "relations fences"}).collect()}
    assert set(stemmed) == {1, 2, 3, 4} and min(stemmed.values()) > 0


def test_chinese_words_are_grams(spark):
    df = spark.createDataFrame([(1, "我爱北京abc天安门"), (2, "北方 京城"), (3, "カタカナ text")], "_id int, t string")
    assert found(df, "北京", cjk=True) == [1] and found(df, "京", cjk=True) == [1, 2] and found(df, "天安门", cjk=True) == [1]
    assert found(df, "abc", cjk=True) == [1] and found(df, "タカ", cjk=True) == [3] and found(df, "北京") == []


def test_a_stop_list_is_read_from_a_file(tmp_path):
    from fathom.functions.text import read_stop_words

    (tmp_path / "x.txt").write_text(" | a list\nel | the\n\nLa\n# no\n", encoding="utf-8")
    assert read_stop_words(str(tmp_path / "x.txt")) == ["el", "la"]


def test_one_document_is_described(spark):
    df = spark.createDataFrame([(1, "Red fox, red", "A b", [3, 3, 4], None)], "_id int, t string, k string, l array<int>, n int")
    got = sorted(tuple(r) for r in Index(df, text=("t",), weights={"t": 2}).describe(1).where("field in ('t', 'k', 'l', 'n')").collect() if r.kind == "term")
    assert got == [("term", "k", "a b", 1.0), ("term", "l", "3", 1.0), ("term", "l", "4", 1.0), ("term", "t", "fox", 2.0), ("term", "t", "red", 4.0)]
    assert Index(df).get(1, "{k}").columns == ["k"]
    blobs = spark.createDataFrame([(1, [("image/png", bytearray(b"x")), ("text/plain", bytearray(b"y"))])], "_id int, _blobs array<struct<content_type string, data binary>>")
    assert bytes(Index(blobs).blob(1, "text/plain").first()[0]) == b"y"


def test_scripts_see_the_stored_document(spark):
    e = Engine()
    e.create("a", spark.createDataFrame([(1, "x", 1), (2, "y", 5)], "_id int, v string, n int"))

    def count(docs, method, by):
        assert method == "upsert"
        return docs.withColumn("n", F.coalesce("_old_doc.n", F.lit(0)) + by).where("v != 'no'")

    e.script("count", count)
    new = spark.createDataFrame([(1, "z", 0), (3, "w", 0), (2, "no", 0)], "_id int, v string, n int")
    assert sorted(tuple(r) for r in e.write("a", new, "upsert", "count", by=10).frame.collect()) == [(1, "z", 11), (2, "y", 5), (3, "w", 10)]
    e.settings("a", text=("v",), stem="all")
    assert e.described("a")["settings"]["stem"] == "all" and e.described("a")["schema"]["n"] == "int"


def test_tables_change_bucket_by_bucket(spark, tmp_path):
    from fathom.operators.table import Table

    table = Table(spark, str(tmp_path / "t"), "k", buckets=8)
    assert table.read() is None
    merge = lambda old, new: store.latest(new if old is None else old.unionByName(new), "k", "_version")
    first = spark.createDataFrame([(k, "a", 1) for k in range(100)], "k int, v string, _version int")
    assert table.change(first, merge) == 0
    places = table.manifest(0)["buckets"]
    assert table.change(spark.createDataFrame([(5, "b", 2), (200, "c", 1)], first.schema), merge, batch=7) == 1
    moved = [b for b, p in table.manifest(1)["buckets"].items() if places.get(b) != p]
    assert 1 <= len(moved) <= 2
    assert {r.k: r.v for r in table.read().collect()} == {k: "a" for k in range(100)} | {5: "b", 200: "c"}
    assert table.read(0).count() == 100 and table.as_of(3).count() == 100 and table.last_batch() == 7
    raced = []

    def slow(old, new):  # another writer commits in between, once
        if not raced:
            raced.append(1)
            Table(spark, table.path, "k").change(spark.createDataFrame([(5, "won", 3)], first.schema), merge)
        return merge(old, new)

    assert table.change(spark.createDataFrame([(6, "later", 2)], first.schema), slow) == 3
    assert {r.k: r.v for r in table.read().where("k in (5, 6)").collect()} == {5: "won", 6: "later"}
    table.expire(1)
    assert table.numbers() == [3] and table.read().count() == 101
    with pytest.raises(store.VersionConflict):
        table._commit(3, {})


def test_an_index_is_committed(spark, tmp_path):
    at = Index(spark.createDataFrame([(k, "x") for k in range(20)], "_id int, v string")).commit(str(tmp_path / "i"))
    assert at.count() == 20
    at = at.delete(spark.createDataFrame([(3,)], "_id int")).put(spark.createDataFrame([(4, "y"), (99, "z")], "_id int, v string")).commit(str(tmp_path / "i"))
    assert at.count() == 20 and not at.exists(3) and at.get(4).first().v == "y"


def test_covers_hold_their_shapes():
    import math
    import random

    import numpy as np

    r = random.Random(9)
    points = [(r.uniform(-180, 180), math.degrees(math.asin(r.uniform(-1, 1)))) for _ in range(4000)] + [(r.uniform(-3, 3), r.uniform(-3, 3)) for _ in range(500)]
    vectors = np.array([geo.unit(*p) for p in points])
    near = lambda lon, lat, metres: np.arccos(np.clip(vectors @ np.array(geo.unit(lon, lat)), -1, 1)) <= metres / geo.EARTH_M
    cases = {
        "CIRCLE(0 0, 300000)": near(0, 0, 300000), "CIRCLE(179 80, 3000000)": near(179, 80, 3000000), "CONVEX((0 0, 300000), (2 1, 250000))": near(0, 0, 300000) & near(2, 1, 250000),
        "MULTICIRCLE((0 0, 100000), (60 10, 900000))": near(0, 0, 100000) | near(60, 10, 900000),
    }
    for level in (2, 7):
        ids = geo.trixel_ids(*np.array(points).T, level)
        for text, inside in cases.items():
            ranges = geo.cover(geo.parse_ewkt(text), level)
            held = np.zeros(len(points), bool)
            for a, b in ranges:
                held |= (ids >= a) & (ids <= b)
            assert held[inside].all() and inside.any() and len(ranges) <= 64
            assert level < 7 or held.sum() < 0.5 * len(points)


def test_yaml():
    text = """
---
# a query
_query:
  "a:b": 'it''s # no comment'   # a comment
  url: http://x.org/?q=1
  list: [1, "two, three", {k: v, n: [true, null]}]
  map: {a: 1.5, 'b c': "x:y"}
  none:
  yes_no: [yes, no]
  text: |
    one
      two

    three
  folded: >-
    four
    five
  items:
    - name: x
      deep:
      - - 1
        - -2
      - plain words: here
    - just a string
    -
      k: 3
_limit: 10
"""
    assert formats.yaml_loads(text) == {
        "_query": {
            "a:b": "it's # no comment", "url": "http://x.org/?q=1", "list": [1, "two, three", {"k": "v", "n": [True, None]}], "map": {"a": 1.5, "b c": "x:y"}, "none": None, "yes_no": [True, False],
            "text": "one\n  two\n\nthree\n", "folded": "four five", "items": [{"name": "x", "deep": [[1, -2], {"plain words": "here"}]}, "just a string", {"k": 3}],
        },
        "_limit": 10,
    }
    assert formats.yaml_loads("") is None and formats.yaml_loads("- a\n- 2") == ["a", 2] and formats.yaml_loads("plain") == "plain"
    with pytest.raises(ValueError):
        formats.yaml_loads("a: [1, 2")


def test_documents_alike_by_several_fields(spark):
    rows = [(k, f"common words {k % 3}", "plain title") for k in range(30)] + [(100, "rare quokka", "zebra"), (101, "quokka sight", "other"), (102, "nothing", "zebra crossing")]
    at = Index(spark.createDataFrame(rows, "_id int, t string, title string"), text=("t", "title"))
    ids = lambda fields: {r["_id"] for r in at.like({"_id": 100}, fields).collect()}
    assert ids("t") == {100, 101} and ids(["t", "title"]) == {100, 101, 102}


def test_a_prefix_finds_every_word_of_a_text(spark):
    rows = [(k, f"Fox, THERH{k:03d}!") for k in range(70)] + [(100, "fox therh"), (101, "fox xtherh1"), (102, "fox ther h"), (103, None), (104, "")]
    df = spark.createDataFrame(rows, "_id int, t string")
    want = [*range(70), 100]
    assert found(df, "therh**") == found(df, {"_partial": "Therh"}) == found(df, "therh**", stem="all") == found(df, "therh**", cjk=True) == want
    assert found(df, "+fox -therh**") == [101, 102] and found(df, "therh06**") == [*range(60, 70)] and found(df, "therho**") == []
    assert found(df, "therh**", stop_words=("therh", "therh005")) == [*range(5), *range(6, 70)]
    assert found(df.select("_id", F.array("t", F.lit("hen")).alias("t")), "therh**") == want
    assert found(spark.createDataFrame([(1, "happy"), (2, "happily"), (3, "hap")], "_id int, t string"), "happi**", stem="all") == [1, 2]

import os

import duckdb
import pytest

import corpus_pipeline
from fathom.llm import queries, stages
from fathom.llm.quality import quality
from fathom.llm.toxicity import toxicity

from . import helpers

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_follow_each_other_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stages.written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        assert docs.count() <= left
        left = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert sorted(map(str, packed.select("doc_id", "start", "length").collect())) == sorted(map(str, corpus_pipeline.run(spark, SF).select("doc_id", "start", "length").collect()))


def test_each_stage_does_what_its_operator_decides(spark):
    """On all rows of the small table, with rows that must go added."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.where("doc_id < 20 and text is not null").collect()
    near = [(10**6 + k, r.text + " end", *r[2:]) for k, r in enumerate(some)]
    docs = docs.union(spark.createDataFrame(near, docs.schema)).union(spark.createDataFrame([(10**7, "too short", *some[0][2:])], docs.schema))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}

    scores = {r.doc_id: r.score for r in toxicity(docs, labels).collect()}
    left = ids(stages.toxicity(spark, docs, SF))
    assert left == sorted(d for d in texts if scores[d] < 0.5)

    verdicts = {r.doc_id: r.kept for r in quality(docs, labels)[0].collect()}
    left = ids(stages.quality_rules(spark, docs, SF))
    assert left == sorted(d for d in texts if verdicts[d]) and 10**7 not in left

    groups = helpers.near_groups(texts, 5, 80)
    left = ids(stages.near_dedup(spark, docs, SF))
    assert left == sorted(d for d, (_, c) in groups.items() if c == d) and len(left) < len(texts) - 10

    mixed = {r.doc_id: r for r in stages.mixing(spark, docs, SF).collect()}
    total = sum(len(helpers.words(t)) for t in texts.values())
    assert sum(len(helpers.words(r.text)) for r in mixed.values()) == int(0.75 * total)
    cut = [d for d, r in mixed.items() if r.text != texts[d]]
    assert all(texts[d].startswith(mixed[d].text) and mixed[d].n_chars == len(mixed[d].text) for d in cut)
    assert 0 < len(cut) <= len({(r.lang, r.source) for r in mixed.values()})


def test_rows_of_one_id_or_none_are_judged_by_their_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (1, a), (None, c), (None, c + " end"), (None, None), (2, b + " end"), (3, None)]
    docs = spark.createDataFrame([(*x, "__row") for x in rows], "doc_id long, text string, note string")
    left = sorted(((r.doc_id, (r.text or "")[:2]) for r in stages.near_dedup(spark, docs.coalesce(1), SF).collect()), key=str)
    assert left == sorted([(1, "a0"), (1, "b0"), (None, "c0"), (None, ""), (3, "")], key=str)


def ids(frame):
    return sorted(r.doc_id for r in frame.collect())


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_stages_take_odd_rows_and_clashing_columns(spark, stage):
    rows = [(1, "a b c d e f " * 20, "en", "src0", 3, "x", 1), (1, "a b c d e f " * 20, "en", "src0", 3, "x", 1), (None, None, None, None, None, None, None), (2, "", "de", "odd", 0, "y", 2)]
    names = "doc_id long, text string, lang string, source string, n_chars long, epoch string, level_domain int"
    got = stage(spark, spark.createDataFrame(rows, names), SF)
    assert got.columns == [x.split()[0] for x in names.split(", ")] and got.count() <= 4
    assert stage(spark, spark.createDataFrame([], names), SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    show = lambda v: f"{v:.9f}" if isinstance(v, float) else str(v)
    want = con.execute(f"select {', '.join(cols)} from ({queries.ORACLE[name]})").fetchall()
    assert sorted(tuple(map(show, r)) for r in got.select(*cols).collect()) == sorted(tuple(map(show, r)) for r in want)

"""Every registered engine query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from fathom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    show = lambda v: "null" if v is None or v != v else f"{v + 0.0:.6f}" if isinstance(v, float) else str(v)
    return cols, sorted(tuple(map(show, r)) for r in frame[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas().astype(object)
    want = duck.execute(catalog.ORACLE[name]).df().astype(object)
    assert rows(got.where(got.notna(), None)) == rows(want.where(want.notna(), None))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).toPandas() is not None

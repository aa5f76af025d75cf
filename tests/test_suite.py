"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import math
import os

import duckdb
import pytest

from fieldloom.plans import problems, stages, suite

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DIR}/{f}'")
    return c


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool) or isinstance(v, str):
        return repr(v)
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return "nan" if math.isnan(v) else repr(round(float(v), 9) + 0.0)
    return repr(v)


SQL, QUERIES = suite.SQL | stages.SQL, suite.QUERIES | stages.QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    rel = con.sql(SQL[name])
    at = [list(rel.columns).index(c) for c in cols]
    assert sorted(rel.columns) == cols
    got = sorted(tuple(map(plain, r)) for r in df.select(*cols).collect())
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)) + sorted(problems.queries()))
def test_runs(spark, name):
    assert {**QUERIES, **problems.queries()}[name](spark, DIR).count() > 0

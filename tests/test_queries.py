"""Queries against their oracles on the smallest tables."""

import math

import duckdb
import pytest

from notewright.plans import flows, inferred, rest  # noqa: F401
from notewright.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def _plain(v):
    return (None if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    r = duck.execute(ORACLES[name])
    names = [x[0] for x in r.description]
    want = sorted((tuple(_plain(dict(zip(names, x))[c]) for c in cols) for x in r.fetchall()), key=repr)
    assert sorted(names) == cols
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).columns
    assert QUERIES[name](spark, DATA).limit(1).count() == 1

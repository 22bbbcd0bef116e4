"""Every query with a SQL twin gives its rows, on the smallest tables."""

import math
import os

import duckdb
import pytest

from skein.plans.catalog import DRIVER, ORACLE_SQL, QUERIES

SF = os.environ.get("SKEIN_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, duck, name):
    got = QUERIES[name](spark, SF)
    rel = duck.sql(ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(rel.columns)
    key = lambda row: tuple(value(row[c]) for c in sorted(row))
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert sorted(map(key, got.toArrow().to_pylist()), key=repr) == sorted(map(key, want), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_twice_alike(spark, name):
    rows = lambda: sorted(map(repr, QUERIES[name](spark, SF).toArrow().to_pylist()))
    first = rows()
    assert first and first == rows()

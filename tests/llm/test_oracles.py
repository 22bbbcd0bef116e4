"""The operators' queries against their SQL, and every query over whole tables, on the smallest tables."""

import os

import duckdb
import pytest

from skein.llm.oracles import ORACLE_SQL
from skein.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rel = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF).select(*rel.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rel.fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_whole_tables(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id")
    got = QUERIES[name](spark, SF).select("doc_id").distinct()
    assert docs.join(got, "doc_id", "left_anti").count() == 0

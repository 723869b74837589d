"""Registered queries: all thirteen and the pipeline, and those that SQL can express against their SQL."""

import duckdb
import pytest

import __spark_entry__ as contract
from normtrace.llm import queries
from tools.check_oracles import TABLES, compare

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    names = set(contract.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= names and set(queries.ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    verdict, _ = compare(spark, con, name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert verdict.startswith("ok"), verdict

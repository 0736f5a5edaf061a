"""The queries of the subpackage that SQL can express, against DuckDB on the same tables."""

import os

import duckdb
import pytest

from icekeel.llm import queries as registered

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    done = c.execute(registered.oracle_sql()[name])
    columns = [d[0] for d in done.description]
    df = registered.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(done.fetchall())

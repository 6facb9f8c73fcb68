"""The registered corpus queries and the pipeline, on the smallest tables."""

import duckdb
import pytest

from gridloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    names = sorted(df.columns)
    want = con.sql(queries.oracle_sql()[name])
    at = [want.columns.index(n) for n in names]
    assert sorted(tuple(str(r[n]) for n in names) for r in df.collect()) == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())

"""Every named query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from gridloom.plans import queries as plane

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return con


def same(spark, duck, query, sql):
    df = query(spark, SF)
    names = sorted(df.columns)
    want = duck.sql(sql)
    assert sorted(want.columns) == names
    at = [want.columns.index(n) for n in names]
    key = lambda row: tuple(map(str, row))
    assert sorted(key([r[n] for n in names]) for r in df.collect()) == sorted(key([r[i] for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(plane.queries()))
def test_query_equals_sql(spark, duck, name):
    same(spark, duck, entry.queries()[name], entry.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

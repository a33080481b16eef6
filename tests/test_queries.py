"""Every query against its SQL on the smallest tables; queries without SQL must run and give a stable schema."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module

DATA = os.environ.get("LEXIFORGE_TEST_DATA", "/root/testdata/sf0.001")
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    assert len(set(columns)) == len(columns)
    got = sorted(str([norm(r[c]) for c in columns]) for r in df.collect())
    if name in SQL:
        want = db.sql(SQL[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert got == sorted(str([norm(r[i]) for i in at]) for r in want.fetchall())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_sql_is_for_queries():
    assert set(SQL) <= set(QUERIES)

"""Every catalogue query against its DuckDB statement on the smallest tables."""

import datetime
import glob
import os

import duckdb
import pytest

from lexforge.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(catalog.oracle_sql()[name])
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


def test_entry_has_every_query():
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Catalogue queries that ask for every row of their tables, against brute force on a small fixture."""

import pytest

from lexforge.plans import catalog


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(k, p) for k, p in ((1, "1-URGENT"), (2, "5-LOW"), (12, "3-MEDIUM"), (3, "5-LOW"))], "o_orderkey long, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    lines = [(k, n, float(n)) for k, last in ((1, 7), (2, 4), (12, 5)) for n in range(1, last + 1)] + [(2, 4, 10.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double").selectExpr("*", "1L AS l_partkey", "1L AS l_suppkey", "DATE '2024-01-01' AS l_shipdate", "1.0D AS l_extendedprice", "0.0D AS l_discount", "'N' AS l_returnflag", "'O' AS l_linestatus").write.parquet(f"{d}/lineitem.parquet")
    return str(d), lines


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_within_all_orders(spark, tables):
    d, lines = tables
    want = sorted((f"o:{k}", sum(a == k for a, _, _ in lines), sum(q for a, _, q in lines if a == k)) for k in {a for a, _, _ in lines})
    assert rows(catalog.queries()["within_join_all"](spark, d).select("outer_id", "n_within", "quantity")) == want


def test_related_all_lines(spark, tables):
    d, lines = tables
    a = {f"o:{k}.{n}" for k, n, _ in lines}
    b = ["o:1", "o:2", "o:12", "o:3", *a]
    want = sorted((x, y) for x in a for y in b if x == y or x.startswith(y + ".") or y.startswith(x + "."))
    assert rows(catalog.queries()["related_join_all"](spark, d).select("gid", "other")) == want


def test_xref_all_lines(spark, tables):
    d, lines = tables
    want = sorted((k, n + i) for k, n in {(k, n) for k, n, _ in lines} for i in range(3))
    assert rows(catalog.queries()["xref_expand_all"](spark, d).select("l_orderkey", "cited")) == want


def test_table_members_ties(spark, tmp_path):
    """Of a user's events with one value the later one is next, however the rows lie: only the last one runs past the region."""
    rows = [(k, 1, "view", 5.0) for k in range(1, 41)] + [(90, 1, "error", 30.0)]
    for n, order in enumerate((rows, rows[::-1], rows[20:] + rows[:20])):
        spark.createDataFrame(order, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/{n}/events.parquet")
        got = catalog.queries()["table_members"](spark, f"{tmp_path}/{n}").filter("inside").collect()
        assert [r["event_id"] for r in got] == [40]

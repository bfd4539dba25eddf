from pyspark.sql import functions as F

from lexforge.functions import ids, textfn
from lexforge.operators import ledger, sequences


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_fold_greek(spark):
    assert one(spark, textfn.fold(F.lit("ΟΔΟΣ Άρθρο ϊΐ"))) == "οδοσ αρθρο ιι"


def test_ancestors_and_parts(spark):
    assert one(spark, ids.ancestors(F.lit("code:224.3.β#1"))) == ["code:224", "code:224.3", "code:224.3.β", "code:224.3.β#1"]
    assert one(spark, ids.article(F.lit("120#1~4"))) == "120"
    assert one(spark, ids.numbered(F.lit("224.3.β#1"))) == "224.3.β"


def test_within_needs_a_mark(spark):
    inner = spark.createDataFrame([("c:224.3.β",), ("c:224.30",), ("c:224.3#1",)], "a string")
    outer = spark.createDataFrame([("c:224.3",)], "b string")
    assert {r["a"] for r in ids.within_join(inner, outer, "a", "b").collect()} == {"c:224.3.β", "c:224.3#1"}


def test_as_of_brings_back_superseded(spark):
    rows = spark.createDataFrame([("A", "2013-01-01", "2016-01-01"), ("B", "2016-01-01", None)], "k string, d string, s string")
    rows = rows.select("k", F.to_date("d").alias("d"), F.to_date("s").alias("superseded_on"))
    assert {r["k"] for r in ledger.as_of(rows, "d", "2015-01-01").collect()} == {"A"}
    assert {r["k"] for r in ledger.as_of(rows, "d", "2017-01-01").collect()} == {"B"}


def test_forward_asof_falls_back(spark):
    left, right = spark.createDataFrame([(1, 3), (1, 9)], "k int, n long"), spark.createDataFrame([(1, 3), (1, 5)], "k int, n long")
    assert {(r["n"], r["g"]) for r in ledger.forward_asof(left, right, "k", "n", "n", "g").collect()} == {(3, 3), (9, 5)}


def test_merge_intervals(spark):
    rows = spark.createDataFrame([(1, 0, 10), (1, 5, 6), (1, 11, 12), (1, 40, 41)], "k int, lo int, hi int")
    assert sorted((r["lo"], r["hi"], r["n"]) for r in sequences.merge_intervals(rows, ["k"], "lo", "hi", 2).collect()) == [(0, 12, 3), (40, 41, 1)]

"""Ranges in lists of provisions."""

from pyspark.sql import functions as F

from lexforge.functions import amend


def test_ranges_give_the_provisions_between(spark):
    want = {
        "2 έως 5": ["2", "3", "4", "5"],
        "1, 3 έως 5 και 9": ["1", "3", "4", "5", "9"],
        "α΄ έως δ΄": ["α", "β", "γ", "δ"],
        "ε΄ έως ζ΄": ["ε", "στ", "ζ"],
        "5 έως 2": ["5", "2"],
        "1 έως 60": ["1", "60"],
        "3α έως 5": ["3.α", "5"],
        "2 και 4": ["2", "4"],
    }
    rows = spark.createDataFrame([(x,) for x in want], "x string").select("x", amend.labels(F.col("x")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == want


def test_range_in_a_sentence_and_a_reference(spark):
    s = "Οι παρ. 2 έως 5 του άρθρου 27 του ν. 4067/2012 τροποποιούνται ως εξής:"
    r = spark.createDataFrame([(s,)], "s string").select(amend.amendments(F.col("s"), r"του\s+ν\.\s+4067/2012")[0]["targets"].alias("t"), amend.law_references(F.col("s"), "4067/2012").alias("l")).first()
    assert r["t"] == r["l"] == ["27.2", "27.3", "27.4", "27.5"]

"""Connected components by alternating large-star and small-star steps, in tables; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .joins import skew_left_join


def _min_of(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("deg"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for each node of an edge list, component being the smallest node that it reaches.

    A hot node's edges stay where they are: its minimum is broadcast, as skew_left_join does. Each step is written to
    the shared folder. No edges give no rows; loops and repeated edges do no harm.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = materialize(spark, e, "cc")
    seen = None
    while True:
        total, mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if total == 0 or (total, mark) == seen:
            break
        seen = (total, mark)
        # Large star: each node links its larger neighbours to its smallest one.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        mins = materialize(spark, _min_of(both), "cc-min")
        up = e.select(F.col("v").alias("u"), F.col("u").alias("v"))  # from smaller to larger
        large = skew_left_join(up, mins, "u", "deg", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(spark, large, "cc-large")
        # Small star: each node links its smaller neighbours and itself to the smallest of them.
        mins = materialize(spark, _min_of(large), "cc-min")
        small = skew_left_join(large, mins, "u", "deg", total).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = small.unionByName(mins.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        e = materialize(spark, e, "cc")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()

"""Amendment-ledger operators: grouping, reconciliation, supersession, as-of views, forward as-of join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def superseded_on(pointers: DataFrame, key: str, date: str, candidate: Column, confirming: Column, covers) -> DataFrame:
    """pointers with superseded_on: for candidate rows, the earliest later confirming row of the key that covers them.

    covers(p, q) gets two column accessors. The self join is on the key; only the minimum date leaves it.
    """
    p, q = pointers.alias("p"), pointers.filter(confirming).alias("q")
    cond = (F.col(f"p.{key}") == F.col(f"q.{key}")) & (F.col(f"q.{date}") > F.col(f"p.{date}")) & covers(lambda c: F.col(f"p.{c}"), lambda c: F.col(f"q.{c}"))
    first = p.filter(candidate).join(q, cond).groupBy(F.col(f"p.{key}").alias(key), F.col(f"p.{date}").alias(date)).agg(F.min(f"q.{date}").alias("superseded_on"))
    return pointers.join(first, [key, date], "left")


def as_of(pointers: DataFrame, date: str, day: str) -> DataFrame:
    """Rows published by `day` (undated ones too), less those whose superseder was published by then."""
    d = F.lit(day).cast("date")
    return pointers.filter(F.col(date).isNull() | (F.col(date) <= d)).filter(F.col("superseded_on").isNull() | (F.col("superseded_on") > d))


def forward_asof(left: DataFrame, right: DataFrame, key: str, lnum: str, rnum: str, out: str) -> DataFrame:
    """For each left row the smallest right number at or above its own within the key, else the largest.

    Both sides meet in one window per key over their union: no pair is made.
    """
    both = left.select(key, F.col(lnum).alias("_n"), F.lit(1).alias("_l")).unionByName(right.select(key, F.col(rnum).alias("_n"), F.lit(0).alias("_l")))
    # From the largest number down, as a frame that ends with its row grows by a row; on equal numbers the right row comes first.
    w = Window.partitionBy(key).orderBy(F.col("_n").desc(), "_l").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(key)
    value = F.when(F.col("_l") == 0, F.col("_n"))
    got = both.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(w), F.max(value).over(whole)))
    return got.filter("_l = 1").select(key, F.col("_n").alias(lnum), out).filter(F.col(out).isNotNull())


def reconcile(found: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two pointer sources: both sides confirm each other, one side alone is unchecked or listed."""
    a, b = found.select(*keys, F.lit(True).alias("_a")), listed.select(*keys, F.lit(True).alias("_b"))
    both = F.coalesce("_a", F.lit(False)) & F.coalesce("_b", F.lit(False))
    return a.join(b, keys, "full_outer").select(*keys, F.when(both, "confirmed").when(F.col("_a"), "unchecked").otherwise("listed").alias("status"))


def reconcile_reasons(found: DataFrame, listed: DataFrame, keys: list[str], reasons: dict[str, Column], otherwise: str) -> DataFrame:
    """Full outer join of found and listed pointers (distinct in keys): `confirmed` on both sides, `listed` on the second alone;
    on the first alone the first reason that holds, in the order given, else `otherwise`."""
    both = found.withColumn("_found", F.lit(True)).join(listed.select(*keys, F.lit(True).alias("_listed")), keys, "full_outer")
    status = F.when(F.col("_found") & F.col("_listed"), "confirmed").when(F.col("_found").isNull(), "listed")
    for name, holds in reasons.items():
        status = status.when(holds, name)
    return both.select(*keys, status.otherwise(otherwise).alias("status"))

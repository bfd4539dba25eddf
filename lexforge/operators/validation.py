"""Checks of texts and indexes: each gives rows of (severity, rule, key), and a report counts them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def noise(rows: DataFrame, key: Column, text: str, rules: dict[str, tuple[str, str]]) -> DataFrame:
    """rules: name -> (severity, pattern). One row for each rule that a text breaks; one pass over the texts."""
    found = F.array_compact(F.array(*(F.when(F.col(text).rlike(p), F.struct(F.lit(s).alias("severity"), F.lit(name).alias("rule"))) for name, (s, p) in rules.items())))
    return rows.select(key.alias("key"), F.explode(found).alias("x")).select("x.severity", "x.rule", "key")


def repeated(rows: DataFrame, key: Column) -> DataFrame:
    """Ids that stand more than once."""
    n = rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return n.select(F.lit("error").alias("severity"), F.lit("repeated id").alias("rule"), "key")


def out_of_sequence(rows: DataFrame, group: str, position: list[str], number: str, key: Column) -> DataFrame:
    """Rows whose number doesn't follow the one before it (equal or one more) in their group."""
    before = F.lag(number).over(Window.partitionBy(group).orderBy(*position))
    step = F.col(number) - F.col("_before")
    return rows.withColumn("_before", before).filter(~step.isin(0, 1)).select(F.lit("warning").alias("severity"), F.lit("number out of sequence").alias("rule"), key.alias("key"))


def dangling(rows: DataFrame, reference: str, known: DataFrame, gid: str, key: Column) -> DataFrame:
    """Rows whose reference names nothing."""
    ids = known.select(F.col(gid).alias("_known")).distinct()
    left = rows.filter(F.col(reference).isNotNull()).join(ids, F.col(reference) == F.col("_known"), "left_anti")
    return left.select(F.lit("error").alias("severity"), F.lit("dangling reference").alias("rule"), key.alias("key"))


def flagged_pages(words: DataFrame, page: list[str], broken: Column, least: int) -> DataFrame:
    """Pages with at least so many broken words."""
    return words.groupBy(*page).agg(F.count_if(broken).alias("n")).filter(F.col("n") >= least)


def margins(lines: DataFrame, page: list[str], left: str, right: str, least: int = 12) -> DataFrame:
    """Left and right edge of each page; pages with fewer than `least` lines take those of all pages of their parity."""
    number = page[-1]
    own = lines.groupBy(*page).agg(F.min(left).alias("_l"), F.max(right).alias("_r"), F.count(F.lit(1)).alias("n"))
    rest = [F.pmod(F.col(number), F.lit(2)).alias("_odd"), *page[:-1]]
    keys = ["_odd", *page[:-1]]
    usual = lines.select(*rest, left, right).groupBy(*keys).agg(F.min(left).alias("_ul"), F.max(right).alias("_ur"))
    both = own.withColumn("_odd", F.pmod(F.col(number), F.lit(2))).join(usual, keys)
    few = F.col("n") < least
    return both.select(*page, F.when(few, F.col("_ul")).otherwise(F.col("_l")).alias(left), F.when(few, F.col("_ur")).otherwise(F.col("_r")).alias(right))


def coverage(expected: DataFrame, got: DataFrame, key: str, word: str, share: float = 0.01, least: int = 5) -> DataFrame:
    """Keys whose text lacks more than `share` of the expected words, and more than `least`: (key, missing). Bags of words, so
    a word that stands too seldom counts as often as it is missing."""
    want, have = (x.groupBy(key, word).agg(F.count(F.lit(1)).alias(n)) for x, n in ((expected, "_want"), (got, "_have")))
    both = want.join(have, [key, word], "left").groupBy(key).agg(F.sum("_want").alias("_all"), F.sum(F.greatest(F.col("_want") - F.coalesce("_have", F.lit(0)), F.lit(0))).alias("missing"))
    return both.filter((F.col("missing") > least) & (F.col("missing") > share * F.col("_all"))).select(key, "missing")


def report(*checks: DataFrame) -> DataFrame:
    """(severity, rule, n) over all checks; a rule without a row has none."""
    return reduce(lambda a, b: a.unionByName(b), checks).groupBy("severity", "rule").agg(F.count(F.lit(1)).alias("n"))

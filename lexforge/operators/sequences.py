"""Ordered operators: sequence checks, quote state, carry-forward, islands, interval merge, ranges, modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shuffle_partitions


def quote_state(rows: DataFrame, keys: list[str], order: list, opens: Column, closes: Column) -> DataFrame:
    """inside: whether a row begins inside a quotation, by the last row before it that opened or closed one."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    state = F.when(opens, True).when(closes, False)
    return rows.withColumn("inside", F.coalesce(F.last(state, ignorenulls=True).over(before), F.lit(False)))


def islands(rows: DataFrame, keys: list[str], order: list, breaks: Column) -> DataFrame:
    """island: 0-based number of the run; a row where `breaks` holds begins a new one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("island", F.sum(F.when(breaks, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


#: Rows that a task sorts; at 300 bytes a row that is 300 MB.
ROWS_A_TASK = 1_000_000


def merge_intervals(rows: DataFrame, keys: list[str], lo: str, hi: str, gap: float = 0) -> DataFrame:
    """Overlapping or near intervals of a key as one: keys, lo, hi, n. The rows are counted first: a task sorts about ROWS_A_TASK
    of them, however many there are, but for a key that has more."""
    tasks = max(shuffle_partitions(rows.sparkSession), -(-rows.count() // ROWS_A_TASK))
    rows = rows.repartition(tasks, *keys)
    before = Window.partitionBy(*keys).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(hi).over(before)
    started = rows.withColumn("_reach", reach).withColumn("_new", F.col("_reach").isNull() | (F.col(lo) > F.col("_reach") + gap))
    runs = started.withColumn("_run", F.sum(F.col("_new").cast("int")).over(Window.partitionBy(*keys).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count(F.lit(1)).alias("n")).drop("_run")


def carry_forward(rows: DataFrame, keys: list[str], order: list, value: Column, out: str) -> DataFrame:
    """out: the last non-null value up to each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(out, F.last(value, ignorenulls=True).over(w))


def next_value(rows: DataFrame, keys: list[str], order: list, value: Column, out: str) -> DataFrame:
    """out: the first non-null value after each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn(out, F.first(value, ignorenulls=True).over(w))


def last_page(rows: DataFrame, keys: list[str], page: str, out: str) -> DataFrame:
    """out: where an item ends, the page on which the next one begins; the last ends on its own."""
    return rows.withColumn(out, F.coalesce(F.lead(page).over(Window.partitionBy(*keys).orderBy(page)), page))


def jumps(rows: DataFrame, keys: list[str], order: list, number: str, out: str) -> DataFrame:
    """Rows whose number is neither that of the row before them nor one more, with that number as `out`."""
    before = F.lag(number).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(out, before).filter(~(F.col(number) - F.col(out)).isin(0, 1))


def fill_gaps(rows: DataFrame, key: str, number: str) -> DataFrame:
    """key, number, missing: every number from a key's least to its greatest."""
    span = rows.groupBy(key).agg(F.min(number).alias("_lo"), F.max(number).alias("_hi"))
    every = span.select(key, F.explode(F.sequence("_lo", "_hi")).alias(number))
    return every.join(rows.select(key, number).distinct().withColumn("_has", F.lit(True)), [key, number], "left").select(key, number, F.col("_has").isNull().alias("missing"))


def mode(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of a key; the smallest on ties."""
    n = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.min_by(F.struct(value, "n"), F.struct((-F.col("n")).alias("a"), F.col(value).alias("b"))).alias("m")).select(*keys, f"m.{value}", "m.n")


def repair_boundaries(rows: DataFrame, keys: list[str], group: str, label: str, position: str) -> DataFrame:
    """`repaired`: the group of each row after moving a group's closing run of label 1 to the next group, where that one
    doesn't begin with 1. A moved run needs another label before it in its own group."""
    others = F.max(F.when(F.col(label) != 1, F.col(position)))
    heads = rows.groupBy(*keys, group).agg(F.min(position).alias("_first_pos"), F.min_by(label, position).alias("_first"), others.alias("_last_other"))
    order = Window.partitionBy(*keys).orderBy("_first_pos")
    heads = heads.withColumn("_next", F.lead(group).over(order)).withColumn("_next_first", F.lead("_first").over(order))
    moved = (F.col(label) == 1) & (F.col(position) > F.col("_last_other")) & (F.col("_next_first") > 1)
    joined = rows.join(heads, [*keys, group])
    return joined.withColumn("repaired", F.when(moved, F.col("_next")).otherwise(F.col(group))).drop("_first_pos", "_first", "_last_other", "_next", "_next_first")

"""Mixing sources to target weights (operator 3): subset-sum budget fitting over length counts.

1. Targets: each source's weight share of the whole budget, stopped at `max_repeat` times its size; the excess is
   reshared by weight until none is above. That is min(cap, level * weight) at one water level, found with running sums
   over the sources (a table with a row a source).
2. Fit: documents are counted by (source, exact length). Whole repeats of a source come first; of the rest each length
   gives its proportional share, and a bounded-knapsack dynamic program over the remaining length counts closes the
   budget to the word where any subset can.
3. Choice: of each (source, length) the documents with the smallest seeded hash are taken, as many as the fit says.
   Documents are ranked inside hash bins of a (source, length); counts of the bins before give the rest of the rank, so
   no task sees a whole hot group.

Defined results: null text has size 0 and is taken 0 words; a null source is a source of its own, last; repeated rows
are separate documents; where ids repeat or are null, rows are told apart by a number of their own, so that each row has its
own copies and the words taken meet the targets (which of such rows are taken then depends on the table's files); ties go
by hash, then id; no rows give no rows; extra columns aren't read by `mix` and pass through `mixed`, whatever their names.
Sizes are of whole texts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch, materialize, shuffle_partitions
from .joins import fresh, odd_ids, ref
from .text import words

WEIGHTS = (3, 1, 2)
BINS = 1024
#: The dynamic program runs on remaining budgets up to this many words; greedy steps come down to it first.
KNAPSACK_WORDS = 32768


def sizes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, size, source key ('=' + source, or '~' for null, which sorts last) and the row's number."""
    key = F.coalesce(F.concat(F.lit("="), ref(source)), F.lit("~"))
    return docs.select(ref(id_col).alias("doc_id"), key.alias("src"), F.size(words(ref(text))).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"))


def hashed(rows: DataFrame, seed: int, by: str) -> DataFrame:
    """rows with the seeded hash h of a column and its hash bin."""
    h = F.xxhash64(F.lit(seed), F.col(by))
    return rows.withColumn("h", h).withColumn("bin", F.pmod(F.shiftrightunsigned(h, 20), F.lit(BINS)).cast("int"))


def _places(rows: DataFrame, by: str, scratch: Scratch) -> DataFrame:
    """rows (distinct in `by`) with their place in that order, from 0: ranges are numbered apart, and the ranges' sizes
    (one row a partition) give the places before each."""
    parts = scratch.write(rows.repartitionByRange(shuffle_partitions(rows.sparkSession), by).withColumn("part", F.spark_partition_id()), "mix-ranges")
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("k"))
    before = counts.withColumn("before", F.sum("k").over(Window.orderBy("part")) - F.col("k")).drop("k")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(by)) - 1
    return parts.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("place", F.col("before") + F.col("inside")).drop("part", "inside", "before")


def targets(totals: DataFrame, scratch: Scratch, weights=WEIGHTS, share: float = 1.5, max_repeat: int = 2) -> DataFrame:
    """src, source_size, target from src, source_size (a row a source).

    target = min(cap, level * weight): a level that shares out what the capped sources leave is raised until no other
    source is above its cap; each pass is one sum over the sources.
    """
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    t = _places(totals, "src", scratch).select("src", "source_size", w.alias("w"), (F.col("source_size") * float(max_repeat)).alias("cap"))
    t = scratch.write(t, "mix-weights")
    budget = float((t.agg(F.sum("source_size")).first()[0] or 0) * share)
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") < F.lit(level) * F.col("w")
        n, fixed, open_weight = t.agg(F.count_if(over), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0))).first()
        if n == capped or not open_weight:
            break
        capped, level = n, (budget - fixed) / open_weight
    target = F.col("cap") if not open_weight else F.least("cap", F.lit(level) * F.col("w"))
    return t.select("src", "source_size", target.alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come as near below `budget` as can be found.

    Proportional shares first, then the longest that fit until the rest is small, then a bounded knapsack over bit
    sets: bit s of a state says that s words can be made exactly; states are kept to walk back. Where that leaves a
    gap, more of the budget is left to the knapsack.
    """
    total = int((lengths * counts).sum())
    if total <= 0 or budget <= 0:
        return np.zeros(len(lengths), dtype=np.int64)
    if budget >= total:
        return np.where(lengths > 0, counts, 0).astype(np.int64)
    best, least = None, budget + 1
    for reserve in (0, 1024, 8192, KNAPSACK_WORDS):  # words left to the knapsack besides those of rounding down
        take = _fit(lengths, counts, budget, reserve, total)
        gap = budget - int((lengths * take).sum())
        if gap < least:
            best, least = take, gap
        if not gap or reserve >= budget:
            break
    return best


def _fit(lengths: np.ndarray, counts: np.ndarray, budget: int, reserve: int, total: int) -> np.ndarray:
    shared = max(0, budget - reserve)
    take = np.array([int(c) * shared // total if s > 0 else 0 for s, c in zip(lengths, counts, strict=True)], dtype=np.int64)
    left = budget - int((lengths * take).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if left <= KNAPSACK_WORDS:
            break
        s = int(lengths[i])
        if s > 0:
            k = min(int(counts[i] - take[i]), (left - KNAPSACK_WORDS) // s)
            if k > 0:
                take[i] += k
                left -= k * s
    items: list[tuple[int, int, int]] = []
    for i in order[::-1]:
        s, free = int(lengths[i]), int(counts[i] - take[i])
        if s <= 0 or s > left or free <= 0:
            continue
        free, part = min(free, left // s), 1
        while free > 0:  # binary splitting
            part = min(part, free)
            items.append((int(i), part, part * s))
            free -= part
            part *= 2
    room, states, state = (1 << (left + 1)) - 1, [], 1
    for _, _, weight in items:
        states.append(state)
        state |= (state << weight) & room
        if state >> left & 1:
            break
    at = state.bit_length() - 1
    for (i, part, weight), before in zip(reversed(items[: len(states)]), reversed(states), strict=True):
        if not before >> at & 1:
            take[i] += part
            at -= weight
    return take


def _fit_source(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("size", kind="stable").reset_index(drop=True)
    lengths, counts = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
    source, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
    whole = int(target // source) if source else 0
    extra = fit(lengths, counts, int(np.floor(target - whole * source + 1e-6)))
    return pd.DataFrame({"src": pdf["src"], "size": lengths, "whole": whole, "extra": extra})


def mix(docs: DataFrame, seed: int = 7, weights=WEIGHTS, share: float = 1.5, max_repeat: int = 2, text: str = "text", id_col: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (words, repeats counted) for each row of docs."""
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.write(sizes(docs, text, id_col, source), "mix-sizes")
        rows = hashed(rows, seed, "row" if odd_ids(rows, "doc_id") else "doc_id")
        bins = scratch.write(rows.groupBy("src", "size", "bin").agg(F.count(F.lit(1)).alias("n")), "mix-bins")
        lengths = bins.groupBy("src", "size").agg(F.sum("n").alias("n"))
        goal = targets(lengths.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), scratch, weights, share, max_repeat)
        goal = scratch.write(goal, "mix-goal")
        plan = lengths.join(goal, "src").groupBy("src").applyInPandas(_fit_source, "src string, size long, whole long, extra long")
        plan = scratch.write(plan, "mix-plan")
        before = F.sum("n").over(Window.partitionBy("src", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        places = bins.withColumn("before", F.coalesce(before, F.lit(0))).join(plan, ["src", "size"]).join(goal, "src")
        # A bin that is taken whole or not at all needs no ranks; the one on the border is ranked by hash.
        ranked = rows.join(places, ["src", "size", "bin"])
        rank = F.row_number().over(Window.partitionBy("src", "size", "bin").orderBy("h", F.col("doc_id").asc_nulls_last(), "row"))
        copies = F.col("whole") + (F.col("before") + rank <= F.col("extra")).cast("long")
        found = ranked.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
        return scratch.keep(found, "mix-found")


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of docs as the mix takes them: none, once or repeated, with their own columns.

    Rows are told apart by id; where ids repeat or are null, docs is written once with a number for each row.
    """
    spark, own = docs.sparkSession, [ref(c) for c in docs.columns]
    row, copies = fresh(docs.columns, "_row"), fresh(docs.columns, "_copies")
    if odd_ids(docs, id_col):
        docs = materialize(spark, docs.select(*own, F.monotonically_increasing_id().alias(row)), "mix-docs")
        key = row
    else:
        docs, key = docs.withColumn(row, ref(id_col)), row
    picks = mix(docs, id_col=key, text=text, source=source, **options).filter("copies > 0").select(F.col("doc_id").alias(row), F.col("copies").alias(copies))
    out = docs.join(picks.hint("merge"), row).withColumn(copies, F.explode(F.sequence(F.lit(1), ref(copies))))
    return out.select(*own)

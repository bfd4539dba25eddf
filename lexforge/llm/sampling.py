"""Bounded training samples of labelled rows: the same rows at every run, at most `per_class` of each class.

Defined results: null labels and ids are not sampled; an id repeated under one label counts once, under two labels once for
each; of the rows that share an id one is learned from, that with the smallest hash of its text; with more than
`MAX_CLASSES` labels the most frequent ones are learned (ties by label).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_CLASSES = 256


def sample_ids(rows: DataFrame, label: str, per_class: int, id_col: str = "doc_id") -> list[tuple]:
    """[(id, label)] of the rows with the smallest id hashes, per class, in the order of labels and hashes.

    Labels are counted first, so that only rows with a hash low enough to be among the first (with a fifth and a hundred
    to spare) are ranked.
    """
    rows = rows.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label}`").alias("label")).filter("id IS NOT NULL AND label IS NOT NULL")
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "label").limit(MAX_CLASSES)
    spread = 1 << 40
    u = F.pmod(F.xxhash64("id"), F.lit(spread))
    near = rows.join(F.broadcast(counts), "label").withColumn("u", u).filter(F.col("u") * F.col("k").cast("double") < (1.2 * per_class + 100) * spread)
    place = F.row_number().over(Window.partitionBy("label").orderBy("u", "id"))
    top = near.select("id", "label", "u").distinct().withColumn("place", place).filter(F.col("place") <= per_class)
    return [(r["id"], r["label"]) for r in top.orderBy("label", "place").collect()]


def sample_texts(docs: DataFrame, picked: list[tuple], text: Column, id_col: str = "doc_id") -> list[tuple]:
    """[(id, text)] for sampled ids, in the order of ids; the ids are broadcast, as sample_ids bounds them."""
    if not picked:
        return []
    ids = docs.sparkSession.createDataFrame([(int(i),) for i in sorted({p[0] for p in picked})], "_sampled long")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text")).join(F.broadcast(ids), F.col("id") == F.col("_sampled"), "left_semi")
    return [(r["id"], r["text"]) for r in rows.groupBy("id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).orderBy("id").collect()]

"""Exact dedup (operator 6): a persistent digest index, bucketed and sorted by hash.

Texts are equal when identical after lower-casing A-Z. New data meets the index in a sort-merge anti-join, and only
digests it hasn't seen are appended; the largest doc_id of a new digest stays. Rows whose digest an earlier batch
brought are all copies of the row that the index names. A batch has an id: a job that failed and runs again under the same
id finds its own digests, whether all or a part of them were appended, and gets the verdicts of an undisturbed run. The bucket number is
written beside the data, so an index keeps it whatever the session's settings are.

Defined results: a null text counts as empty, so all empty and null texts are one group; rows that repeat a doc_id
with the same text get the same verdict (kept, where that id stays); a null doc_id stays only if its group has no
other id; an empty table appends nothing; extra columns are not touched; very long texts are hashed whole. Without
an id, each run is a batch of its own. Only digests and ids are shuffled, never
texts; a digest that a third of the rows share is counted before the shuffle and joined by broadcast.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch, read_note, remove, shared_dir, shuffle_partitions, write_note
from .joins import ref, skew_left_join, without_ids
from .text import ascii_lower

SCHEMA = "digest BINARY, keep_id BIGINT, n_rows BIGINT, batch STRING"


class DigestIndex:
    """One row for each distinct text: digest, the id that stays, rows of the batch that brought it, that batch.

    `path` is where the index lives on; opening the same path again continues it with the bucket number that it began with, and
    another number that is asked for is an error. Without a path the index is temporary: `drop` deletes it.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.temporary = spark, path is None
        self.path = path or os.path.join(shared_dir(spark), f"digests-{uuid.uuid4().hex}")
        note = os.path.join(self.path, "_buckets")
        stored = read_note(spark, note)
        if stored is not None and buckets not in (None, int(stored)):
            raise ValueError(f"the index at {self.path} has {stored} buckets, not {buckets}")
        self.buckets = int(stored) if stored is not None else buckets or shuffle_partitions(spark)
        if stored is None:
            write_note(spark, note, str(self.buckets))
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.table} ({SCHEMA}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def close(self) -> None:
        """Take the index out of the catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def drop(self) -> None:
        """Close it, and delete a temporary index."""
        self.close()
        if self.temporary:
            remove(self.spark, self.path)

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, rows: DataFrame) -> None:
        rows.select("digest", "keep_id", "n_rows", "batch").repartition(self.buckets, "digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)


def digests(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    return docs.select(ref(id_col).alias("doc_id"), F.unhex(F.sha2(ascii_lower(ref(text)), 256)).alias("digest"))


def dedup(docs: DataFrame, index: DigestIndex, text: str = "text", id_col: str = "doc_id", batch: str | None = None) -> DataFrame:
    """A row for each row of docs: doc_id, digest, keep_id, group_size (rows of this batch with the digest), kept.

    Appends the batch's new digests to the index. `batch` names these very rows: the caller's id, the same at a retry.
    """
    batch = batch or uuid.uuid4().hex
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.write(digests(docs, text, id_col), "digest-rows")  # each text is hashed once
        # Written, as the optimizer would else push the anti-join below the sums and shuffle every row of a hot digest.
        groups = scratch.write(rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n_rows")), "digest-groups")
        new = groups.join(index.read().select(F.col("digest").alias("_seen")).hint("merge"), F.col("digest") == F.col("_seen"), "left_anti")
        index.append(new.withColumn("batch", F.lit(batch)))
        known = index.read()
        total = known.filter(F.col("batch") == batch).agg(F.sum("n_rows")).first()[0] or 0
        verdict = skew_left_join(rows, known, "digest", "n_rows", total)
        return scratch.keep(verdict.select("doc_id", "digest", "keep_id", F.col("n_rows").alias("group_size"), ((F.col("batch") == batch) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept")), "digest-verdict")


def drop_copies(docs: DataFrame, index: DigestIndex, text: str = "text", id_col: str = "doc_id", batch: str | None = None) -> DataFrame:
    """docs without the copies, with their own columns."""
    return without_ids(docs, dedup(docs, index, text, id_col, batch).filter(~F.col("kept")).select("doc_id").distinct(), id_col)

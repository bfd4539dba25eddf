"""Incremental discovery: new files are scanned once for needles; a rescan of a year replaces its records."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir


def needle_counts(docs: DataFrame, needles: dict[str, str], text: str = "text") -> DataFrame:
    return docs.select(*(c for c in docs.columns if c != text), *(F.regexp_count(text, F.lit(p)).cast("long").alias(n) for n, p in needles.items()))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the keys that new has, and new: a rescan replaces whole partitions of records."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def scan_stream(spark: SparkSession, path: str, glob: str, schema, needles: dict[str, str], state: str | None = None) -> DataFrame:
    """All needle counts of what matches in the folder, files or folders of files; files seen before under the same state
    folder aren't read again.

    A file-source stream runs until nothing is left (availableNow); its checkpoint and its result lie under `state`.
    """
    state = state or os.path.join(shared_dir(spark), f"discovery-{uuid.uuid4().hex}")
    # A name without a wildcard still goes as one: the source takes a plain path for a folder.
    names = glob if any(c in glob for c in "*?[{") else f"{glob[:-1]}[{glob[-1]}]"
    found = needle_counts(spark.readStream.schema(schema).parquet(os.path.join(path, names)), needles)
    run = found.writeStream.format("parquet").option("checkpointLocation", f"{state}/checkpoint").option("path", f"{state}/found").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{state}/found")


def years_to_scan(years: DataFrame, state: DataFrame, needles: list[str], this_year: int, force: bool = False) -> DataFrame:
    """The years whose scan isn't settled: not scanned, scanned with failures, with other needles, or not over yet. The state
    has year, failures and needles (null in old states: no failures, no needles)."""
    want = F.array_sort(F.array(*(F.lit(n) for n in needles)))
    settled = state.filter((F.coalesce("failures", F.lit(0)) == 0) & (F.array_sort(F.coalesce("needles", F.array().cast("array<string>"))) == want) & (F.col("year") < this_year)).select("year")
    return years if force else years.join(settled.distinct(), "year", "left_anti")

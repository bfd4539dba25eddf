"""Session helpers: reading tables, the folder that all executors share, and tables written on the way."""

from __future__ import annotations

import atexit
import os
import threading
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark opens the path, so any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Without one, a local master gets a folder below its warehouse; on a cluster that
    is an error, as each executor would write to its own disk."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "_stages")
        sc.setCheckpointDir(at)
    return at


class _Open(threading.local):
    """The blocks that are open in this thread, innermost last."""

    def __init__(self):
        self.blocks: list[Block] = []


_open = _Open()
#: Tables of results that are read after their operator has ended: (session, path). They go with the application.
_results: list[tuple[SparkSession, str]] = []


def _written(spark: SparkSession, df: DataFrame, path: str, blocks: list) -> DataFrame:
    """df, written and read back; the table belongs to the innermost of `blocks`, or else to the application."""
    df.write.parquet(path)
    if blocks:
        blocks[-1].paths.append(path)
    else:
        _results.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df under the shared folder and read it back: lineage ends there, and a lost executor loses nothing. The table
    goes when the innermost open `Block` ends, or with the application."""
    return _written(spark, df, os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}"), _open.blocks)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, wherever it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _remove_results() -> None:
    if SparkContext._active_spark_context is not None:
        for spark, path in _results:
            remove(spark, path)


def read_note(spark: SparkSession, path: str) -> str | None:
    """A small text file through Hadoop's file system; None if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(at):
        return None
    stream = files.open(at)
    try:
        return stream.readUTF()
    finally:
        stream.close()


def write_note(spark: SparkSession, path: str, text: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    stream.writeUTF(text)
    stream.close()


class Block:
    """What `materialize` writes inside the block goes when it ends. `keep` writes a result, which stays: it belongs to the
    block around this one, or to the application."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], ""

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.kept = os.path.join(shared_dir(self.spark), f"{name}-{uuid.uuid4().hex}")
        return _written(self.spark, df, self.kept, _open.blocks[:-1])

    def __enter__(self):
        _open.blocks.append(self)
        return self

    def __exit__(self, *error) -> None:
        _open.blocks.remove(self)
        for path in self.paths:
            remove(self.spark, path)


class Scratch(Block):
    """A block whose `write` puts tables into one folder of its own, which goes with it.

    Inside the block, Arrow batches hold at most 2,000 rows, so that a Python stage's memory doesn't follow the length of
    10,000 texts; and a write's shuffle files go when it has ended, as its table is what later steps read. The settings are the
    session's: the first block that opens sets them, and the last that ends puts them back.
    """

    SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    lock, users, before = threading.Lock(), 0, {}

    def __init__(self, spark: SparkSession):
        super().__init__(spark)
        self.path = os.path.join(shared_dir(spark), f"scratch-{uuid.uuid4().hex}")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = os.path.join(self.path, f"{name}-{uuid.uuid4().hex[:8]}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        with Scratch.lock:
            if not Scratch.users:
                Scratch.before = {k: self.spark.conf.get(k, None) for k in self.SETTINGS}
                for k, v in self.SETTINGS.items():
                    self.spark.conf.set(k, v)
            Scratch.users += 1
        return super().__enter__()

    def __exit__(self, *error) -> None:
        with Scratch.lock:
            Scratch.users -= 1
            if not Scratch.users:
                for k, v in Scratch.before.items():
                    self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        super().__exit__(*error)
        remove(self.spark, self.path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread(df: DataFrame) -> DataFrame:
    """df's rows over as many tasks as a shuffle has. A small file comes as one task, however many rows are packed in it: what
    costs much a row goes after this."""
    return df.repartition(shuffle_partitions(df.sparkSession))

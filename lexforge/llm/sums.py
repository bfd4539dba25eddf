"""Sums of arrays that tasks hand over, merged in two shuffles: first in groups of at most `FAN` tasks, then over those."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 256


def merged(parts: DataFrame, keys: list[str], values: list[str], add) -> DataFrame:
    """A row for each key: the arrays in `values` of all its rows, added in the order of `part`, so that reruns agree.

    `add` takes and returns a tuple of float arrays; no group holds more rows than FAN, or than tasks / FAN.
    """
    schema = ", ".join([*(f"{k} long" for k in keys), "part long", *(f"{v} array<double>" for v in values)])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        columns = [table.column(v).combine_chunks() for v in values]
        total = None
        for i in range(len(table)):
            row = tuple(np.asarray(c[i].values, dtype=float) for c in columns)
            total = row if total is None else add(total, row)
        head = [pa.array([table.column(k)[0].as_py()], pa.int64()) for k in keys]
        return pa.table([*head, pa.array([table.column("part")[0].as_py()], pa.int64()), *(pa.array([t.tolist()], pa.list_(pa.float64())) for t in total)], names=[*keys, "part", *values])

    group = F.floor(F.col("part") / FAN).alias("group")
    return parts.groupBy(*keys, group).applyInArrow(run, schema).groupBy(*keys).applyInArrow(run, schema)


def plain(a: tuple, b: tuple) -> tuple:
    return tuple(x + y for x, y in zip(a, b, strict=True))

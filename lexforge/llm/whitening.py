"""Embedding whitening (operator 13): compensated covariance in double-double, divide-and-conquer eigenvectors.

Entries become whole numbers, so sums, means and deviations are exact. The fit list is the distinct vectors. Tasks centre each
vector by the exact mean (a double-double) before multiplying, and add the outer products with error-free
transformations, high parts and low parts apart; tasks' results are merged as pairs too. The eigen-solve is `eigen.symmetric`.
A last pass over the fit list measures the whitened values' covariance.

Defined results: rows whose vector is null, or holds a null or non-finite entry, go; of the others, those of the commonest
length stay (of lengths as common the longest), as the rest have no place in that space. Entries beyond 2^60 / 64 count
as that. Components whose variance is below 2^-40 of the first's count as having none and aren't returned, so
there are fewer than 16 where the vectors span less, and no rows for an empty table, empty vectors or a single distinct vector.
`deviation` is null where it exceeds a long; `deviation_digits` has it in full. Null and repeated ids get their rows; extra columns aren't read. What
reaches the driver has the size of dimensions squared.
"""

from __future__ import annotations

import pickle
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .eigen import symmetric
from .joins import ref
from .sums import merged, plain

COMPONENTS = 16
SHIFT, STEP, MOST = 1_000_000, 64, 2.0**60
#: Outer products that are added as a block.
BLOCK = 8
#: Vectors whose result rows are made together.
ROWS = 1024
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"


def two_sum(a, b):
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a):
    t = 134217729.0 * a
    high = t - (t - a)
    return high, a - high


def two_product(a, b):
    p = a * b
    (ah, al), (bh, bl) = halves(a), halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add_pairs(a: tuple, b: tuple) -> tuple:
    """The sum of two double-doubles (high, low)."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def pair(x: Fraction) -> tuple[float, float]:
    high = float(x)
    return high, float(x - Fraction(high))


def exact(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as double-doubles."""
    high = x.astype(float)
    return high, (x - high.astype(np.int64)).astype(float)


def outer_sums(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Double-double sum over rows of the outer products of double-double rows."""
    n = high.shape[1]
    total = (np.zeros((n, n)), np.zeros((n, n)))
    for i in range(0, len(high), BLOCK):
        a, b = high[i : i + BLOCK, :, None], high[i : i + BLOCK, None, :]
        p, e = two_product(a, b)
        e = e + (a * low[i : i + BLOCK, None, :] + low[i : i + BLOCK, :, None] * b)
        s = two_sum(p, e)
        while len(s[0]) > 1:
            if len(s[0]) % 2:
                total = add_pairs(total, (s[0][-1], s[1][-1]))
            k = len(s[0]) // 2
            s = add_pairs((s[0][:k], s[1][:k]), (s[0][k : 2 * k], s[1][k : 2 * k]))
        total = add_pairs(total, (s[0][0], s[1][0]))
    return total


class Centre:
    """The exact mean of the fit list: a whole number and a double-double rest for each dimension."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.whole = n, np.array([(2 * s + n) // (2 * n) for s in sums], dtype=np.int64)
        self.rest = [Fraction(s - n * int(w), n) for s, w in zip(sums, self.whole, strict=True)]
        pairs = [pair(x) for x in self.rest]
        self.high, self.low = (np.array([p[k] for p in pairs]) for k in (0, 1))

    def deviations(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return add_pairs(exact(x - self.whole), (-self.high, -self.low))

    def squares(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n x - S)^2, exactly."""
        y, rest = x - self.whole, np.array([int(r * self.n) for r in self.rest], dtype=object)
        if y.size and (self.n * (int(np.abs(y).max()) + 1)) ** 2 * y.shape[1] < 1 << 62:
            return ((self.n * y - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
        return ((self.n * y.astype(object) - rest) ** 2).sum(axis=1).tolist()


def whole_vectors(rows: DataFrame, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """vec_id and x, the whole-number vector, of rows without null or non-finite entries."""
    v = ref(vector)
    good = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    x = F.transform(v, lambda c: F.floor(F.greatest(F.least(c.cast("double") * STEP, F.lit(MOST)), F.lit(-MOST))).cast("long") + SHIFT)
    return rows.filter(v.isNotNull() & good).select(ref(id_col).cast("long").alias("vec_id"), x.alias("x"))


def _matrix(batch) -> np.ndarray:
    flat = np.asarray(batch.column("x").flatten())
    return flat.reshape(batch.num_rows, -1)


def _lines(*arrays: np.ndarray) -> pa.RecordBatch:
    """A row for each line of the arrays, with the task's number."""
    from pyspark import TaskContext

    n = len(arrays[0])
    columns = [pa.array(a.tolist(), pa.list_(pa.float64())) for a in arrays]
    return pa.record_batch([pa.array(np.arange(n)), pa.array(np.full(n, TaskContext.get().partitionId())), *columns], names=["line", "part", "high", "low"][: 2 + len(arrays)])


def exact_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """(rows, sum of each dimension) of the fit list."""

    def run(batches):
        for b in batches:
            x = _matrix(b)
            for k in range(0, len(x), 1 << 20):
                part = x[k : k + (1 << 20)]
                high, low = part >> 32, part & 0xFFFFFFFF
                yield pa.record_batch([pa.array(np.arange(x.shape[1])), pa.array(high.sum(axis=0)), pa.array(low.sum(axis=0)), pa.array(np.full(x.shape[1], len(part)))], names=["line", "high", "low", "n"])

    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    got = fit.mapInArrow(run, "line long, high long, low long, n long").groupBy("line").agg(total("high"), total("low"), total("n")).orderBy("line").collect()
    return (int(got[0]["n"]), [(int(r["high"]) << 32) + int(r["low"]) for r in got]) if got else (0, [])


def covariance(fit: DataFrame, centre: Centre) -> np.ndarray:
    """The fit list's covariance, divisor n, accumulated in double-double and rounded once."""
    shared = fit.sparkSession.sparkContext.broadcast(cloudpickle.dumps(centre))

    def run(batches):
        own, total = pickle.loads(shared.value), None
        for b in batches:
            part = outer_sums(*own.deviations(_matrix(b)))
            total = part if total is None else add_pairs(total, part)
        if total is not None:
            yield _lines(*total)

    k = len(centre.whole)
    v = np.zeros((k, k))
    sums = fit.mapInArrow(run, "line long, part long, high array<double>, low array<double>")
    for r in merged(sums, ["line"], ["high", "low"], add_pairs).collect():
        high, low = np.array(r["high"]), np.array(r["low"])
        q = high / centre.n
        p, e = two_product(q, float(centre.n))
        v[r["line"]] = q + ((high - p) - e + low) / centre.n
    return (v + v.T) / 2


class Whitening:
    """Mean, components (columns scaled to unit variance) and shares of variance explained."""

    def __init__(self, centre: Centre, v: np.ndarray, components: int):
        values, vectors = symmetric(v)
        keep = np.flatnonzero(values[:components] > max(values[0], 0.0) * 2.0**-40)
        self.centre, self.scaled, self.explained = centre, vectors[:, keep] / np.sqrt(values[keep]), values[keep] / np.trace(v)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        high, low = self.centre.deviations(x)
        return high @ self.scaled + low @ self.scaled


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the whitened fit list's covariance less the identity."""
    shared = fit.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def run(batches):
        own, total = pickle.loads(shared.value), None
        for b in batches:
            w = own(_matrix(b))
            part = np.concatenate([w.sum(axis=0)[None], w.T @ w])
            total = part if total is None else total + part
        if total is not None:
            yield _lines(total)

    rows = merged(fit.mapInArrow(run, "line long, part long, high array<double>"), ["line"], ["high"], plain).collect()
    of = {r["line"]: np.array(r["high"]) for r in rows}
    n, k = model.centre.n, model.scaled.shape[1]
    mean = of[0] / n
    found = np.stack([of[1 + i] for i in range(k)]) / n - np.outer(mean, mean)
    return float(np.abs(found - np.eye(k)).max())


def whiten(rows: DataFrame, vector: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """A row for each row of the space and component: see SCHEMA."""
    spark = rows.sparkSession
    none = spark.createDataFrame([], SCHEMA)
    vectors = whole_vectors(rows, vector, id_col)
    length = vectors.groupBy(F.size("x").alias("k")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("k")).first()
    if length is None or length["k"] == 0:
        return none
    vectors = vectors.filter(F.size("x") == length["k"])
    with Scratch(spark) as scratch:
        fit = scratch.write(vectors.select("x").distinct(), "fit")
        centre = Centre(*exact_sums(fit))
        model = Whitening(centre, covariance(fit, centre), components)
        if not model.scaled.shape[1]:
            return none
        error = identity_error(fit, model)
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(model))

    def run(batches):
        own = pickle.loads(shared.value)
        k = own.scaled.shape[1]
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            x = _matrix(b)
            squares = own.centre.squares(x)
            w, m = own(x), len(x)
            again = pa.array(np.repeat(np.arange(m), k))
            longs = pa.array([s if s < 1 << 63 else None for s in squares], pa.int64())
            digits = pa.array([str(s) for s in squares], pa.string())
            full = lambda value, kind: pa.array(np.full(m * k, value), kind)
            yield pa.record_batch(
                [b.column(0).take(again), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), full(own.centre.n, pa.int64()), longs.take(again), pa.array(w.ravel()), pa.array(np.tile(own.explained, m)), full(error, pa.float64()), digits.take(again)],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"],
            )

    return vectors.mapInArrow(run, SCHEMA)

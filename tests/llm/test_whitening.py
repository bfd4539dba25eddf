"""Whitening: error-free sums, the eigen-solve, the query against exact rational sums, odd tables."""

from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pytest

from lexforge.llm import queries
from lexforge.llm import whitening as wh
from lexforge.llm.eigen import symmetric


def matrices():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 7, 20, 64):
        a = rng.standard_normal((n, n))
        a = a + a.T
        half = rng.standard_normal((n, max(1, n // 3)))
        ends = np.diag(np.abs(np.arange(n) - n // 2).astype(float))
        yield from (a, a @ a.T, np.ones((n, n)), np.zeros((n, n)), np.diag(rng.integers(0, 3, n).astype(float)), half @ half.T, np.eye(n) + 1e-9 * a, ends + np.eye(n, k=1) + np.eye(n, k=-1))


def test_eigen_solve():
    for a in matrices():
        values, v = symmetric(a)
        scale = max(1.0, np.abs(a).max())
        assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-12 * scale
        assert np.abs(v.T @ v - np.eye(len(a))).max() <= 1e-13 and np.abs(a @ v - v * values).max() <= 1e-12 * scale


def test_double_double_sums_are_exact_to_106_bits():
    rng = np.random.default_rng(1)
    high = rng.standard_normal((37, 3)) * 10.0 ** rng.integers(-8, 9, (37, 3))
    low = high * rng.uniform(-1, 1, (37, 3)) * 2.0**-54
    a, b = wh.outer_sums(high, low)
    for i in range(3):
        for j in range(3):
            want = sum((Fraction(h[i]) + Fraction(w[i])) * (Fraction(h[j]) + Fraction(w[j])) for h, w in zip(high, low, strict=True))
            size = sum(abs(Fraction(h[i]) * Fraction(h[j])) for h in high)
            assert abs(Fraction(a[i, j]) + Fraction(b[i, j]) - want) <= size * Fraction(1, 1 << 98)


def plain(rows):
    """(deviations, whitened up to sign, explained, n) with exact rational covariance."""
    x = [[floor(64 * float(c)) + 1_000_000 for c in v] for v in rows]
    fit = sorted(set(map(tuple, x)))
    n, k = len(fit), len(x[0])
    sums = [sum(v[i] for v in fit) for i in range(k)]
    cov = np.array([[float(Fraction(sum((n * v[i] - sums[i]) * (n * v[j] - sums[j]) for v in fit), n**3)) for j in range(k)] for i in range(k)])
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    keep = [i for i in range(min(16, k)) if e[i] > e[0] * 2.0**-40]
    d = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in x])
    return [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x], d @ q[:, keep] / np.sqrt(e[keep]), e[keep] / np.trace(cov), n


def check(out, ids, vectors):
    deviation, whitened, explained, n = plain(vectors)
    got = {}
    for r in out.collect():
        got.setdefault(r["vec_id"], {})[r["component"]] = r
    assert sorted(got) == sorted(ids)
    k = whitened.shape[1]
    first = [got[i] for i in ids]
    table = np.array([[g[c + 1]["whitened"] for c in range(k)] for g in first])
    sign = np.sign((table * whitened).sum(axis=0))
    assert np.abs(table - whitened * sign).max() < 1e-7
    for g, d in zip(first, deviation, strict=True):
        assert sorted(g) == list(range(1, k + 1))
        for c, r in g.items():
            assert r["deviation_digits"] == str(d) and r["deviation"] == (d if d < 1 << 63 else None) and r["n"] == n
            assert abs(r["explained"] / explained[c - 1] - 1) < 1e-6 and r["identity_error"] < 1e-6


def test_query_equals_exact_sums(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    check(queries.op13_whitening(spark, "/root/testdata/sf0.001"), [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_small_spread_and_repeats(spark, scale):
    """Copies count once in the fit; a spread of a few units beside a large mean keeps its digits."""
    rng = np.random.default_rng(2)
    base = rng.integers(-3, 4, (40, 5)).astype(float)
    v = (base / 64 + scale * np.array([1, 0, -1, 2, 3])).tolist()
    rows = [(i, v[0] if i % 3 == 0 else v[i % 40]) for i in range(240)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    check(wh.whiten(df), [r[0] for r in rows], [r[1] for r in rows])


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    good = [(i, rng.standard_normal(3).tolist(), 0) for i in range(20)]
    bad = [(100, None, 0), (101, [1.0, None, 2.0], 0), (102, [nan, 1.0, 2.0], 0), (103, [inf, 0.0, 0.0], 0), (104, [1.0], 0), (105, [], 0)]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS x", "2 AS component", "3 AS k")
    check(wh.whiten(df), [r[0] for r in good], [r[1] for r in good])
    assert wh.whiten(df.limit(0)).count() == 0
    assert wh.whiten(df.filter("vec_id = 3")).count() == 0  # one vector spans nothing
    line = spark.createDataFrame([(i % 7, [float(i), 2.0 * i, 0.0]) for i in range(50)] + [(None, [0.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    out = wh.whiten(line).collect()
    assert len(out) == 51 and {r["component"] for r in out} == {1} and sum(r["vec_id"] is None for r in out) == 1
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    assert all(r["deviation"] is None and int(r["deviation_digits"]) > 1 << 63 for r in wh.whiten(huge).filter("vec_id < 3").collect())

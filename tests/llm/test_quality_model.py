"""Quality classifier: statistics by plain counting, the kernel, the normal equations, pooling, held-out rows."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexforge.llm import quality_model as qm
from lexforge.llm import queries
from lexforge.llm.bytesnp import chunks
from fixtures import words


def plain(text):
    data, own = (text or "").encode(), words(text)
    size, n = len(data), len(own)
    lines = [x for x in (text or "").split("\n") if words(x)]
    low = [w.encode().lower() for w in own]
    capitals = sum(c.isascii() and c.isupper() or "À" <= c <= "Þ" and c != "×" or c == "×" for c in text or "")
    share = lambda a, b: (a / max(b, 1)) ** 0.5
    of = lambda kind: sum(c in kind for c in data)
    return [np.log1p(n), np.log1p((size - max(n - 1, 0)) / max(n, 1)), share(capitals, size), *(share(of(k), size) for k in qm.KINDS[1:3]), *(share(of(k), n) for k in qm.KINDS[3:5]), share(of(qm.KINDS[5]), size),
            share(sum(a == b for a, b in zip(low, low[1:])), n), np.log1p(len(set(low))) / max(np.log1p(n), 1e-9), share(len(lines) - len(set(lines)), len(lines)), np.log1p(n / max(len(lines), 1)), share(sum("A" <= w[0] <= "Z" for w in own), n)]


def test_statistics_equal_plain_counts():
    rng = random.Random(2)
    pick = ["the", "The", "a1", "x!", "--", "Ére", "ÜB", "3.5", "#tag", "the", "中文"]
    texts = [None, "", " ", "\n\n", "one", "a a a", "a\na\nb\n", "\nx\n"] + ["".join(rng.choice(pick) + rng.choice([" ", "\n", "\t ", "  "]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    got = np.concatenate([qm.statistics(data, off) for _, data, off in chunks(pa.array(texts, pa.string()), 100)])
    assert np.allclose(got, [plain(t) for t in texts])


def test_cosines_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((30, 4))
    z = qm.Cosines(np.zeros(4), np.ones(4), 2.0, features=20_000)(x)[:, :-1]
    distance = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-distance / 8)).max() < 0.05


def test_sums_of_tasks_are_the_normal_equations(spark):
    rng = np.random.default_rng(6)
    k = len(qm.STATISTICS)
    x, y, fold = rng.standard_normal((300, k)), rng.integers(0, 2, 300), rng.integers(0, qm.FOLDS, 300)
    rows = spark.createDataFrame([(int(f), int(a), v.tolist()) for f, a, v in zip(fold, y, x, strict=True)], "fold int, y int, x array<double>").repartition(5)
    maps = [qm.Cosines(x.mean(axis=0), x.std(axis=0), w) for w in qm.WIDTHS]
    sums = qm.normal_equations(rows, maps)
    for m, cosines in enumerate(maps):
        for f in range(qm.FOLDS):
            z = np.concatenate([cosines(x[fold == f]), y[fold == f][:, None]], axis=1)
            assert np.allclose(sums[m, f], z.T @ z)
        z = cosines(x)
        w = qm.ridge(sums[m].sum(axis=0), 0.1)
        shrunk = np.append(np.full(z.shape[1] - 1, 0.1), 1e-9)
        assert np.allclose(z.T @ (y - z @ w), shrunk * w, atol=1e-6)  # where the penalised error is least
        assert np.isclose(qm.squared_error(sums[m].sum(axis=0), w), ((y - z @ w) ** 2).sum())


def test_pools_are_the_isotonic_fit():
    rng = np.random.default_rng(7)
    for _ in range(50):
        k = int(rng.integers(1, 9))
        n = rng.integers(1, 6, k).astype(float)
        ones = np.minimum(n, rng.integers(0, 6, k)).astype(float)
        x, share = qm.isotonic(np.arange(k, dtype=float), n, ones)
        assert (np.diff(share) > 0).all() and (np.diff(x) > 0).all()
        # the fit at i is the largest over j <= i of the least over l >= i of the mean of j..l
        fit = [max(min(ones[j : m + 1].sum() / n[j : m + 1].sum() for m in range(i, k)) for j in range(i + 1)) for i in range(k)]
        assert np.allclose(np.unique(np.round(fit, 12)), np.round(share, 12))


def test_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op12_quality_model(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    low, good = ([r for r in rows if r["quality"] == q] for q in (0, 1))
    assert len(low) > 8 and len(good) > 40
    assert sum(r["predicted"] == 0 for r in low) >= 0.9 * len(low) and all(r["predicted"] == 1 for r in good)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_few_labels(spark):
    docs = spark.createDataFrame([(1, "Some words here."), (2, None), (None, ""), (1, "Some words here.")], "doc_id long, text string")
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    scores = lambda rows: [r["score"] for r in qm.classify(docs, label(rows)).collect()]
    assert scores([]) == [0.0] * 4 and scores([(None, 1), (1, None), (9, 1)]) == [0.0] * 4
    assert scores([(1, 1)]) == [1.0] * 4 and scores([(2, 0)]) == [0.0] * 4
    assert len(scores([(1, 1), (1, 0), (2, 0)])) == 4
    assert qm.classify(docs.filter(F.lit(False)), label([(1, 1)])).count() == 0

"""Quality classifier (operator 12): random Fourier features, ridge scores, isotonic calibration.

Each whole text gives a vector of statistics (length, word length, shares of capitals, digits, symbols and punctuation, repeated
words and lines, words a line). Standardised by the labelled rows' means and deviations, it goes through random cosines
whose inner products approximate a Gaussian kernel. Tasks sum the normal equations of their labelled rows, by fold and kernel
width; those sums alone give the ridge weights and, fold against the others, the squared error by which width and ridge are chosen.
The labelled rows' scores by weights that haven't seen them, counted in bins, are made monotone by pooling adjacent
violators, and the curve through the pools' centres is the calibration.

All labelled rows are learned from; what reaches the driver is the sums (`FEATURES`^2 numbers for a fold and width) and the bins.

Defined results: null and empty texts have statistics of zero and get a score as any text; a label above 0 counts as 1, null labels
and null ids teach nothing; an id under two labels teaches both, an id in several rows each of its texts; without
labelled rows all scores are 0, with one class only its label; equal texts get equal scores, and every row its own; an empty
table gives no rows; very long texts are read whole; extra columns aren't read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch, materialize
from .bytesnp import U64, Words, _mix, chunks, tables, word_hashes
from .joins import ref
from .sums import merged, plain

STATISTICS = ("words", "word_bytes", "capitals", "digits", "symbols", "stops", "calls", "high_bytes", "repeats", "variety", "copied_lines", "line_words", "capital_words")
FEATURES = 160
#: Kernel widths and ridges tried, folds of the labelled rows, bins of the calibration.
WIDTHS, RIDGES = (2.0, 5.0), (1e-4, 1e-2, 1.0)
FOLDS, BINS = 3, 2048
#: Classes of bytes: capitals, digits, symbols, stops, calls, from 128 on, line ends.
KINDS = (bytes(range(65, 91)), b"0123456789", b"#*$%&|<>{}[]=~^_\\/@+", b".,;:", b"!?", bytes(range(128, 256)), b"\n")


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The statistics of a chunk's rows, a row each."""
    rows, size = len(off) - 1, np.diff(off)
    kind = np.full(256, len(KINDS), dtype=np.int64)
    for k, members in enumerate(KINDS):
        kind[list(members)] = k
    width = len(KINDS) + 1
    n = np.bincount(np.repeat(np.arange(rows), size) * width + kind[data], minlength=rows * width).reshape(rows, width).astype(float)
    per = lambda at: np.bincount(at, minlength=rows).astype(float)
    w = Words(data, off)
    h, words = w.hashes(), np.diff(w.first).astype(float)
    lead = data[w.start] if len(h) else data[:0]
    upper = (lead >= 65) & (lead <= 90)
    latin = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) if len(data) else np.zeros(0, np.int64)
    capitals = n[:, 0] + per(np.searchsorted(off, latin, side="right") - 1)
    same = np.flatnonzero((h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])) if len(h) else np.zeros(0, np.int64)
    key, at = np.unique(h ^ _mix(w.row.astype(U64)), return_index=True)
    variety = per(w.row[at])
    # lines with a word
    edge = np.unique(np.concatenate([off, np.flatnonzero(data == 10) + 1])).astype(np.int64)
    start, end = edge[:-1], edge[1:]
    first = np.searchsorted(w.start, edge)
    full = first[1:] > first[:-1]
    start, end = start[full], end[full]
    row = np.searchsorted(off, start, side="right") - 1
    end = np.where(data[end - 1] == 10, end - 1, end) if len(end) else end
    lines = per(row)
    key, at = np.unique(word_hashes(data, start, end, tables()[2]) ^ _mix(row.astype(U64)), return_index=True)
    copied = lines - per(row[at])
    share = lambda a, b: np.sqrt(a / np.maximum(b, 1))
    blanks = np.maximum(words - 1, 0)
    columns = [np.log1p(words), np.log1p(np.maximum(size - blanks, 0) / np.maximum(words, 1)), share(capitals, size), share(n[:, 1], size), share(n[:, 2], size), share(n[:, 3], words), share(n[:, 4], words),
               share(n[:, 5], size), share(per(w.row[same]), words), np.log1p(variety) / np.maximum(np.log1p(words), 1e-9), share(copied, lines), np.log1p(words / np.maximum(lines, 1)), share(per(w.row[upper]), words)]
    return np.stack(columns, axis=1)


def measure(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and x, its text's statistics, for each row of docs."""

    def run(batches):
        for b in batches:
            for at, data, off in chunks(b.column(1)):
                x = statistics(data, off)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.record_batch([b.column(0).slice(at, len(off) - 1).cast(pa.int64()), flat], names=["doc_id", "x"])

    return docs.select(ref(id_col).cast("long").alias("doc_id"), ref(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


class Cosines:
    """Random Fourier features of standardised statistics: inner products near exp(-distance^2 / (2 width^2)), and a constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, width: float, features: int = FEATURES, seed: int = 12):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, spread
        self.w, self.b = rng.standard_normal((len(mean), features)) / width, rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -20, 20) @ self.w + self.b
        return np.concatenate([np.sqrt(2 / len(self.b)) * np.cos(z), np.ones((len(x), 1))], axis=1)


def _table(batch, n: int) -> np.ndarray:
    return np.asarray(batch.column("x").flatten(), dtype=float).reshape(batch.num_rows, n)


def normal_equations(rows: DataFrame, maps: list[Cosines]) -> np.ndarray:
    """[map, fold]: the matrix of sums of (z, y) (z, y)' over rows (fold, y, x), added task by task."""
    shared = rows.sparkSession.sparkContext.broadcast(cloudpickle.dumps(maps))
    n, d = len(maps[0].mean), len(maps[0].b) + 2

    def run(batches):
        from pyspark import TaskContext

        own, total = pickle.loads(shared.value), None
        for b in batches:
            x, y, fold = _table(b, n), np.asarray(b.column("y"), dtype=float), np.asarray(b.column("fold"))
            for m, cosines in enumerate(own):
                z = np.concatenate([cosines(x), y[:, None]], axis=1)
                for f in range(FOLDS):
                    zf = z[fold == f]
                    if len(zf):
                        total = np.zeros((len(own), FOLDS, d, d)) if total is None else total
                        total[m, f] += zf.T @ zf
        if total is not None:
            flat, part = total.reshape(-1, d), TaskContext.get().partitionId()
            yield pa.record_batch([pa.array(np.arange(len(flat))), pa.array(np.full(len(flat), part)), pa.array(flat.tolist(), pa.list_(pa.float64()))], names=["line", "part", "s"])

    out = np.zeros((len(maps) * FOLDS * d, d))
    for r in merged(rows.select("fold", "y", "x").mapInArrow(run, "line long, part long, s array<double>"), ["line"], ["s"], plain).toLocalIterator():
        out[r["line"]] = r["s"]
    return out.reshape(len(maps), FOLDS, d, d)


def ridge(sums: np.ndarray, strength: float) -> np.ndarray:
    """Weights from the matrix of sums; the constant isn't shrunk."""
    a, r = sums[:-1, :-1], sums[:-1, -1]
    penalty = np.full(len(a), strength)
    penalty[-1] = 1e-9
    return np.linalg.solve(a + np.diag(penalty), r)


def squared_error(sums: np.ndarray, w: np.ndarray) -> float:
    v = np.append(w, -1.0)
    return float(v @ sums @ v)


def isotonic(x: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(centre, share of ones) of the pools that adjacent violators form, for bins in rising order of x."""
    pools: list[list[float]] = []
    for a, k, s in zip(x, n, ones, strict=True):
        pools.append([a * k, float(k), float(s)])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def train(measured: DataFrame, labels: DataFrame, label: str = "quality") -> dict:
    """The model from rows of `measure` and labels (doc_id, label); {} without labelled rows."""
    spark = measured.sparkSession
    known = labels.select(ref("doc_id").cast("long").alias("doc_id"), (ref(label) > 0).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL").distinct()
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    with Scratch(spark) as scratch:
        rows = scratch.write(measured.join(known, "doc_id").select("doc_id", fold, "y", "x"), "labelled")
        each = [F.col("x")[i] for i in range(len(STATISTICS))]
        told = rows.agg(F.count(F.lit(1)), *(F.avg(c) for c in each), *(F.stddev_pop(c) for c in each)).first()
        if not told[0]:
            return {}
        mean, spread = (np.array(told[1 + i * len(each) : 1 + (i + 1) * len(each)], dtype=float) for i in (0, 1))
        maps = [Cosines(mean, np.maximum(spread, 1e-3), width) for width in WIDTHS]
        sums = normal_equations(rows, maps)
        tried = []
        for m in range(len(maps)):
            total = sums[m].sum(axis=0)
            for strength in RIDGES:
                left = [ridge(total - own, strength) for own in sums[m]]
                tried.append((sum(squared_error(own, w) for own, w in zip(sums[m], left, strict=True)), m, strength, left))
        _, m, strength, left = min(tried, key=lambda t: t[0])
        unseen = np.stack(left, axis=1)
        shared = spark.sparkContext.broadcast(cloudpickle.dumps((maps[m], unseen)))

        def score(batches):
            cosines, weights = pickle.loads(shared.value)
            for b in batches:
                s = (cosines(_table(b, len(STATISTICS))) @ weights)[np.arange(b.num_rows), np.asarray(b.column("fold"))]
                place = np.clip((s + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)
                yield pa.record_batch([pa.array(place), pa.array(np.asarray(b.column("y")))], names=["bin", "y"])

        bins = rows.select("fold", "y", "x").mapInArrow(score, "bin long, y int").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).orderBy("bin").collect()
    at, n, ones = (np.array([float(r[c]) for r in bins]) for c in ("bin", "n", "ones"))
    centre, share = isotonic((at + 0.5) / BINS * 2 - 0.5, n, ones)
    return {"cosines": maps[m], "weights": ridge(sums[m].sum(axis=0), strength), "centre": centre, "share": share}


def score(measured: DataFrame, model: dict) -> DataFrame:
    """doc_id and score for each row of `measure`."""
    if not model:
        return measured.select("doc_id", F.lit(0.0).alias("score"))
    shared = measured.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    def run(batches):
        m = pickle.loads(shared.value)
        for b in batches:
            s = m["cosines"](_table(b, len(STATISTICS))) @ m["weights"]
            yield pa.record_batch([b.column("doc_id"), pa.array(np.interp(s, m["centre"], m["share"]))], names=["doc_id", "score"])

    return measured.select("doc_id", "x").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and score for each row of docs, learned from labels (doc_id, label). Each text is read once."""
    measured = materialize(docs.sparkSession, measure(docs, text, id_col), "statistics")
    return score(measured, train(measured, labels, label))

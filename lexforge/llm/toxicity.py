"""Toxicity (operator 1): class-conditional Kneser-Ney models of toxic and ordinary text.

Kneser-Ney models of words and of words after words are counted on labelled rows, with the class as the first history to
drop: an absolute discount is taken from each class's count, and what it takes is counted together over both classes,
as shared backoff counts, whose probability both classes get with the freed mass. So an expression too rare for the
discount has the shared probability in both classes and says nothing, and a frequent one speaks by its class counts. A
pair of words too rare to tell falls back to its second word. Log ratios are shrunk towards 0 by a few nats, since
a vocabulary has many expressions with a weak ratio by chance. A document's evidence is its length-normalised
log-likelihood ratio: toxic less ordinary, divided by its words; a logistic curve turns that one number into a score.
Discount, shrinking, order and curve are those that do best on the half of the sample that the models haven't seen.

Words are runs of letters by bytes: ASCII letters and bytes from 128 on, but for general punctuation and Latin-1 signs;
A-Z and Latin-1 capitals are lower-cased. They are held as 64-bit hashes; a document counts an expression once.

Training rows are bounded: `per_class` documents of each class, whole texts. Scoring reads whole texts of all rows.

Defined results: null and empty texts, and texts without letters, have no evidence and get the curve's value at zero
evidence, at most 0.5; without labels of both classes all scores are 0; repeated rows, and ids that repeat or are null,
get a row each and equal texts equal scores; an empty table gives no rows; very long texts are read whole; extra columns
aren't read. A label above 0 counts as 1; an id under several labels counts once for each. The model's size is bounded by the sample, so it is broadcast.
"""

from __future__ import annotations

import pickle
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesnp import U64, _mix, chunks, row_sums, word_hashes
from .sampling import sample_ids, sample_texts

#: Discounts tried, in documents.
DISCOUNTS = (0.75, 2.0, 4.0, 8.0)
#: Nats by which each log ratio is shrunk towards 0: weaker ones say nothing.
LEAST = (0.0, 1.0, 2.0, 3.0)
START = U64(0x9E3779B97F4A7C15)


def letters(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes in lower case, whether each belongs to a word)."""
    low = data.copy()
    upper = (data >= 65) & (data <= 90)
    low[upper] += 32
    inside = (low >= 97) & (low <= 122) | (data >= 128)
    lead = np.flatnonzero(data[:-1] >= 0xC2) if len(data) else np.zeros(0, np.int64)
    first, second = data[lead], data[lead + 1] if len(lead) else data[:0]
    capital = lead[(first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)]
    low[capital + 1] += 32
    sign = lead[(first == 0xC2) | (first == 0xC3) & ((second == 0x97) | (second == 0xB7))]
    inside[sign] = inside[sign + 1] = False
    mark = lead[(first == 0xE2) & ((second == 0x80) | (second == 0x81))]
    for k in range(3):
        inside[mark[mark + k < len(data)] + k] = False
    return low, inside


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, hash of it and the one before, first word of each row) of a chunk."""
    low, inside = letters(data)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    h = word_hashes(low, start, end)
    first = np.searchsorted(start, off)
    previous = np.concatenate([[START], h[:-1]]) if len(h) else h
    previous[first[:-1][first[:-1] < first[1:]]] = START
    return h, _mix(previous * U64(0xBF58476D1CE4E5B9) + h), first


class Counts:
    """Documents of each class that hold each word and, at order 2, each pair of words; `docs`: (words, pairs) of each."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, order: int = 2):
        one, two = [], []
        for (w, p), y in zip(docs, labels, strict=True):
            one.append((np.unique(w), y))
            if order < 2:
                continue
            key, at = np.unique(p, return_index=True)
            two.append((key, np.where(at > 0, w[at - 1], START), w[at], y))
        cat = lambda rows, i, kind=U64: np.concatenate([np.zeros(0, kind), *(r[i] for r in rows)])
        of = lambda rows, y: np.repeat([r[-1] == y for r in rows], [len(r[0]) for r in rows]).astype(float) if rows else np.zeros(0)
        self.words, at = np.unique(cat(one, 0), return_inverse=True)
        self.by = [np.bincount(at, weights=of(one, y), minlength=len(self.words)) for y in (1, 0)]
        self.pairs, first, at = np.unique(cat(two, 0), return_index=True, return_inverse=True)
        self.pair_by = [np.bincount(at, weights=of(two, y), minlength=len(self.pairs)) for y in (1, 0)]
        self.word = np.searchsorted(self.words, cat(two, 2)[first])
        _, self.context = np.unique(cat(two, 1)[first], return_inverse=True)


def _soft(x: np.ndarray, least: float) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - least, 0.0)


class KneserNey:
    """Log-likelihood ratios toxic : ordinary of words after words, less `least` nats. Only those that say something are
    stored; any other pair has its word's ratio, any other word 0."""

    def __init__(self, c: Counts, discount: float, least: float, order: int = 2):
        n = len(c.words)
        free = [np.minimum(count, discount) for count in c.by]
        weight = (free[0] + free[1]).sum() / max(1.0, (c.by[0] + c.by[1]).sum())
        shared = (free[0] + free[1]) / max(1e-300, (free[0] + free[1]).sum())
        uni = []
        for count in c.by:
            own = np.maximum(count - discount, 0.0)
            uni.append((1 - weight) * own / own.sum() + weight * shared if own.sum() > 0 else shared)
        ratio = _soft(np.log(uni[0]) - np.log(uni[1]) if n else np.zeros(0), least)
        told = np.flatnonzero(ratio)
        self.words, self.ratio = c.words[told], ratio[told]
        self.pairs, self.pair_ratio = c.pairs[:0], np.zeros(0)
        if order < 2 or not len(c.pairs):
            return
        m = int(c.context.max()) + 1
        total = lambda x: np.bincount(c.context, weights=x, minlength=m)
        free = [np.minimum(count, discount) for count in c.pair_by]
        kept = np.flatnonzero(np.maximum(*c.pair_by) > discount)
        at, p = c.context[kept], []
        shared = (free[0] + free[1])[kept] / np.maximum(total(free[0] + free[1])[at], 1e-300)
        for k, count in enumerate(c.pair_by):
            mass = total(count)[at]
            p.append(np.where(mass > 0, (np.maximum(count - discount, 0.0)[kept] + total(free[k])[at] * shared) / np.maximum(mass, 1.0), shared))
        self.pairs, self.pair_ratio = c.pairs[kept], _soft(np.log(p[0]) - np.log(p[1]), least)

    def evidence(self, words: np.ndarray, pairs: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each row the mean log ratio of its words; 0 without words."""
        each = np.zeros(len(words))
        for keys, ratio, asked in ((self.words, self.ratio, words), (self.pairs, self.pair_ratio, pairs)):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
                hit = keys[at] == asked
                each[hit] = ratio[at[hit]]
        return row_sums(each, first) / np.maximum(1, np.diff(first))


def fit_curve(x: np.ndarray, y: np.ndarray, positive: float = 0.5, steps: int = 100, ridge: float = 1e-3) -> tuple[float, float, float]:
    """(slope, constant, loss) of a logistic curve by Newton steps, with a share `positive` of weight on label 1."""
    scale = max(1e-9, float(np.std(x)))
    a = np.stack([x / scale, np.ones(len(x))], axis=1)
    weight = np.where(y > 0, positive / max(1, (y > 0).sum()), (1 - positive) / max(1, (y == 0).sum()))
    w = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        step = np.linalg.solve(hess, a.T @ (weight * (p - y)) + ridge * w * [1, 0])
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(a @ w, -30, 30))), 1e-12, 1 - 1e-12)
    loss = -float((weight * np.where(y > 0, np.log(p), np.log1p(-p))).sum())
    return float(w[0] / scale), float(w[1]), loss


def fit(texts: list[tuple[str | None, int]], discounts=DISCOUNTS, leasts=LEAST) -> dict:
    """The model as plain arrays: words, ratio, pairs, pair_ratio, slope, constant; empty without both classes."""
    labels = np.array([int(y > 0) for _, y in texts])
    if set(labels.tolist()) != {0, 1}:
        return {}
    docs = []
    for _, data, off in chunks(pa.array([t for t, _ in texts], pa.string())):
        w, p, first = tokens(data, off)
        docs += [(w[a:b], p[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    fold = np.zeros(len(docs), dtype=np.int64)
    for y in (0, 1):  # halves of each class
        own = np.flatnonzero(labels == y)
        fold[own] = np.arange(len(own)) % 2
    tried = list(product(discounts, leasts, (1, 2)))
    x = np.zeros((len(tried), len(docs)))
    for k in (0, 1):  # one half's counts at a time
        counts = Counts([docs[i] for i in np.flatnonzero(fold == k)], labels[fold == k])
        others = np.flatnonzero(fold != k)
        asked = _joined([docs[i] for i in others])
        for row, choice in enumerate(tried):
            x[row, others] = KneserNey(counts, *choice).evidence(*asked)
        del counts, asked
    found = []
    for row, choice in enumerate(tried):
        slope, constant, loss = fit_curve(x[row], labels.astype(float))
        found.append((loss, *choice, slope, constant))
    _, discount, least, order, slope, constant = min(found)
    model = KneserNey(Counts(docs, labels, order), discount, least, order)
    return {"words": model.words, "ratio": model.ratio, "pairs": model.pairs, "pair_ratio": model.pair_ratio, "slope": slope, "constant": constant, "discount": discount, "least": least, "order": order}


def _joined(docs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, pairs, first word of each document) of documents one after the other."""
    if not docs:
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(1, np.int64)
    return np.concatenate([w for w, _ in docs]), np.concatenate([p for _, p in docs]), np.concatenate([[0], np.cumsum([len(w) for w, _ in docs])])


def scores(model: dict, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Scores of a chunk's rows."""
    rows = len(off) - 1
    if not model:
        return np.zeros(rows)
    own = KneserNey.__new__(KneserNey)
    own.words, own.ratio, own.pairs, own.pair_ratio = (model[k] for k in ("words", "ratio", "pairs", "pair_ratio"))
    w, p, first = tokens(data, off)
    out = 1 / (1 + np.exp(-np.clip(model["slope"] * own.evidence(w, p, first) + model["constant"], -30, 30)))
    return np.where(np.diff(first) == 0, np.minimum(out, 0.5), out)


def train(docs: DataFrame, labels: DataFrame, per_class: int = 3000, text: str = "text", label: str = "toxic") -> dict:
    """labels: doc_id and the label 0/1 of the rows to learn from."""
    picked = sample_ids(labels, label, per_class)
    of: dict = {}
    for i, y in picked:
        of.setdefault(i, []).append(int(y))
    return fit([(t, y) for i, t in sample_texts(docs, picked, F.col(f"`{text}`")) for y in of[i]])


def score(docs: DataFrame, model: dict, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id and score for each row of docs. The model goes out as bytes of plain arrays."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        m = pickle.loads(shared.value)
        for b in batches:
            for at, data, off in chunks(b.column(1)):
                yield pa.record_batch([b.column(0).slice(at, len(off) - 1).cast(pa.int64()), pa.array(scores(m, data, off))], names=["doc_id", "score"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")

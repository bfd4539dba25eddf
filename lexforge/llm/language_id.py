"""Language ID (operator 8): a bidirectional gated recurrent network over bytes, trained in numpy.

A text's UTF-8 bytes (A-Z in lower case) are read in windows of WINDOW bytes that together cover all of it, each with
CONTEXT bytes of the text on either side, so that the network reads across words, lines and windows. Two gated recurrent
units read a window from both ends; at every byte both states give the languages' probabilities. A document's
probabilities are the pooled log-probabilities of all its byte positions, each counted once. Training is back-propagation
through time with Adam on windows drawn from all over the whole texts of a bounded sample: `per_class` documents of each
language.

Defined results: a text that is null or has no letter is `und` with score 0; ties go to the language first by code
point; without training rows every text is `und`; an empty table gives no rows; very long texts are read whole, window by
window; repeated rows, and ids that repeat or are null, get a row each and equal texts equal languages (scores agree to 32-bit
rounding); extra columns aren't read. Of more than 256 languages the most frequent ones are learned (see sampling).
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesnp import chunks, tables
from .sampling import sample_ids, sample_texts

LETTER = re.compile(r"[^\W\d_]")
WINDOW, CONTEXT = 112, 8
#: Windows run at a time, so that states stay in cache.
BLOCK = 2048


class BiGRU:
    """Per-byte language log-probabilities. Weights: input tables (bytes x 3h) and recurrent (h x 3h) for each direction;
    the columns are update gate, reset gate, candidate. Gates are (1 + tanh) / 2, so their inputs count half."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights
        self.h = len(weights["uf"])

    @classmethod
    def new(cls, classes: int, hidden: int = 8, seed: int = 3) -> BiGRU:
        rng = np.random.default_rng(seed)
        mat = lambda *shape: (rng.standard_normal(shape) / np.sqrt(hidden)).astype(np.float32)
        w = {}
        for d in "fb":
            w |= {f"x{d}": mat(256, 3 * hidden), f"u{d}": mat(hidden, 3 * hidden)}
        return cls(w | {"o": mat(2 * hidden, classes), "c": np.zeros(classes, dtype=np.float32)})

    def run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States of one direction: places x windows x h, of windows x (places x windows)."""
        h, (width, n) = self.h, x.shape
        table, u = self.w[f"x{d}"], self.w[f"u{d}"]
        state, out = np.zeros((n, h), dtype=table.dtype), np.empty((width, n, h), dtype=table.dtype)
        for t in range(width) if d == "f" else range(width - 1, -1, -1):
            g = table.take(x[t], axis=0)
            gh = state @ u
            g[:, : 2 * h] += gh[:, : 2 * h]
            np.tanh(g[:, : 2 * h], out=g[:, : 2 * h])
            g[:, : 2 * h] += 1
            g[:, : 2 * h] *= 0.5
            z, r = g[:, :h], g[:, h : 2 * h]
            new = r * gh[:, 2 * h :]
            new += g[:, 2 * h :]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((t, state, z, r, new, gh[:, 2 * h :]))
            state = np.subtract(state, new, out=out[t])
            state *= z
            state += new
        return out

    def log_probs(self, x: np.ndarray) -> np.ndarray:
        """Places x windows x classes."""
        w, h = self.w, self.h
        logits = self.run(x, "f") @ w["o"][:h]
        logits += self.run(x, "b") @ w["o"][h:]
        logits += w["c"]
        logits -= logits.max(axis=2, keepdims=True)
        logits -= np.log(np.exp(logits).sum(axis=2, keepdims=True))
        return logits

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(mean loss a position, gradients) of windows x with labels y, by back-propagation through time."""
        h, (width, n) = self.h, x.shape
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self.run(x, "f", kept["f"]), self.run(x, "b", kept["b"])], axis=2)
        logits = both @ self.w["o"] + self.w["c"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        loss = -float(np.log(p[:, np.arange(n), y] + 1e-12).mean())
        p[:, np.arange(n), y] -= 1
        p /= n * width
        grad = {"o": both.reshape(-1, 2 * h).T @ p.reshape(-1, p.shape[2]), "c": p.sum(axis=(0, 1))}
        back = p @ self.w["o"].T
        for d, part in (("f", back[:, :, :h]), ("b", back[:, :, h:])):
            u = self.w[f"u{d}"]
            gu, later = np.zeros_like(u), np.zeros((n, h), dtype=u.dtype)
            inputs = np.empty((width, n, 3 * h), dtype=u.dtype)
            for t, state, z, r, new, un in reversed(kept[d]):
                dh = later + part[t]
                dnew = dh * (1 - z) * (1 - new * new)
                # a gate is (1 + tanh) / 2, so its slope is 2 * gate * (1 - gate)
                dz = dh * (state - new) * 2 * z * (1 - z)
                dr = dnew * un * 2 * r * (1 - r)
                inputs[t] = np.concatenate([dz, dr, dnew], axis=1)
                inner = np.concatenate([dz, dr, dnew * r], axis=1)
                gu += state.T @ inner
                later = dh * z + inner @ u.T
            flat, at = inputs.reshape(-1, 3 * h), x.ravel()
            gx = np.stack([np.bincount(at, weights=flat[:, k], minlength=256) for k in range(3 * h)], axis=1).astype(u.dtype)
            grad |= {f"x{d}": gx, f"u{d}": gu}
        return loss, grad


def _lower(data: np.ndarray) -> np.ndarray:
    return tables()[0][data]


def fit(texts: list[tuple[str, str]], steps: int = 400, batch: int = 256, width: int = 40, hidden: int = 8, rate: float = 0.03, seed: int = 3) -> dict:
    """{"langs": languages by code point, "w": weights} from (text, language) rows; no rows give {"langs": []}.

    Languages weigh alike: a window is drawn by language, then by place among all its bytes.
    """
    langs = sorted({y for _, y in texts})
    if not langs:
        return {"langs": [], "w": {}}
    # Each language's bytes, with spaces between texts, so that a window may start anywhere.
    streams = [_lower(np.frombuffer(b"".join(t.encode("utf-8", "replace") + b" " * width for t, y in texts if y == lang) + b" " * width, dtype=np.uint8)) for lang in langs]
    rng = np.random.default_rng(seed)
    net = BiGRU.new(len(langs), hidden, seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    each = batch // len(langs) + 1
    labels = np.repeat(np.arange(len(langs)), each)
    for i in range(1, steps + 1):
        x = np.concatenate([s[rng.integers(0, len(s) - width + 1, each)[:, None] + np.arange(width)] for s in streams]).T.copy()
        _, grad = net.gradients(x, labels)
        step = rate * (1 - (i - 1) / steps) + 0.0005
        for k, g in grad.items():
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            net.w[k] -= step * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return {"langs": langs, "w": net.w}


def pooled(net: BiGRU, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Mean log-probabilities of each row's bytes: rows x classes. Rows without bytes get zeros."""
    sizes = np.diff(off)
    rows = len(sizes)
    each = -(-sizes // WINDOW)
    sums = np.zeros((rows, len(net.w["c"])))
    # Rows lie apart by CONTEXT spaces and end on a whole window.
    at = np.cumsum(each * WINDOW + 2 * CONTEXT) - (each * WINDOW + 2 * CONTEXT)
    stream = np.full(int((each * WINDOW + 2 * CONTEXT).sum()), 32, dtype=np.uint8)
    stream[np.arange(len(data)) + np.repeat(at + CONTEXT - off[:-1], sizes)] = _lower(data)
    owner = np.repeat(np.arange(rows), each)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
    start = at[owner] + nth * WINDOW
    valid = np.minimum(WINDOW, sizes[owner] - nth * WINDOW)
    for a in range(0, len(owner), BLOCK):
        own = owner[a : a + BLOCK]
        x = stream[start[a : a + BLOCK] + np.arange(WINDOW + 2 * CONTEXT)[:, None]]
        lp = net.log_probs(x)[CONTEXT:-CONTEXT]
        lp *= (np.arange(WINDOW)[:, None] < valid[a : a + BLOCK])[:, :, None]
        np.add.at(sums, own, lp.sum(axis=0, dtype=np.float64))
    return sums / np.maximum(sizes, 1)[:, None]


def labels(model: dict, data: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
    """(language, score) of a chunk's rows."""
    rows, langs = len(off) - 1, model["langs"]
    if not langs:
        return ["und"] * rows, np.zeros(rows)
    low = _lower(data)
    plain = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122))])
    has = plain[off[1:]] > plain[off[:-1]]
    for r in np.flatnonzero(~has & (np.diff(off) > 0)):
        has[r] = bool(LETTER.search(data[off[r] : off[r + 1]].tobytes().decode("utf-8", "replace")))
    means = pooled(BiGRU(model["w"]), data, off)
    p = np.exp(means - means.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    return [langs[k] if ok else "und" for k, ok in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, p[np.arange(rows), best], 0.0)


def train(docs: DataFrame, per_class: int = 400, text: str = "text", lang: str = "lang", **options) -> dict:
    """docs: the rows to learn from, with non-null labels used only. The model is plain arrays."""
    picked = sample_ids(docs, lang, per_class)
    of: dict = {}
    for i, y in picked:
        of.setdefault(i, []).append(y)
    return fit([(t, y) for i, t in sample_texts(docs, picked, F.col(f"`{text}`")) if t and LETTER.search(t) for y in of[i]], **options)


def predict(docs: DataFrame, model: dict, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score for each row of docs. The model goes out as bytes of plain arrays."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        m = pickle.loads(shared.value)
        for b in batches:
            for at, data, off in chunks(b.column(1)):
                found, score = labels(m, data, off)
                yield pa.record_batch([b.column(0).slice(at, len(found)).cast(pa.int64()), pa.array(found, type=pa.string()), pa.array(score, type=pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")

"""LM scoring (operator 4): context-tree weighting over bytes, with a word-count base beside it.

The model codes a text's tokens as bytes: each word (A-Z lower-cased) and a space, then an end byte; before the first
stand end bytes as context. A byte is eight binary decisions, one node of 255 for each prefix of bits; each has a context
tree over the DEPTH bytes before. At every context the Krichevsky-Trofimov estimate of its counts and the product of
its children's are weighted one half each, so that all depths are mixed. Counts are of all training texts. Every
context that was seen is kept, so the tree grows with the corpus. The tree is never in one place: byte strings lie in
buckets by their contexts' nearest bytes (context_table). Texts are cut into parts; a part sends its distinct byte strings
with their counts to the buckets, sorted and packed, and gets their log-probabilities back in the same order, where they
meet the part's texts again. Code length a byte is -score / n_bytes.

Base: add-one estimates of words. Words with 2^-18 of all tokens or more, so at most 2^18, are broadcast; the others meet
their counts in a shuffled join, as their number grows with the corpus. Words are told apart by 63-bit hashes.

Defined results: null and empty texts have one token, the end; without training rows the counts are 0 and the model is
uniform over bits; null and repeated ids, and repeated rows, get a row each and equal texts equal scores; an empty table
gives no rows; very long texts are read whole; extra columns aren't read.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .bytesnp import Lookup, Words, chunks, distinct, return_memory, row_sums
from .context_table import SPLIT, Subtrees, bucket, pieces, sum_runs, top
from .estimates import KT
from .joins import ref

DEPTH = 6
HEAD = 1 << 18
END = 10
#: Word hashes keep 63 bits.
NON_NEGATIVE = (1 << 63) - 1
#: A part ends at so many distinct byte strings or so many bytes; a chunk stays whole.
PART_GRAMS = 1_500_000
PART_BYTES = 32 << 20
#: New numbers that are held before they are merged into those of a part, and distinct words held at most.
FRESH = 400_000
CHUNK = 1 << 19
PARTS_DDL = "kind int, part long, bucket int, key long, n long, a binary, b binary"
PARTS = pa.schema([("kind", pa.int32()), ("part", pa.int64()), ("bucket", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])


def stream(w: Words, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a chunk's texts as the model codes them, each after `depth` end bytes of context."""
    rows = len(w.off) - 1
    sizes = w.end - w.start
    row_bytes = np.bincount(w.row, weights=sizes + 1, minlength=rows).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(row_bytes + depth + 1)])
    out = np.full(bounds[-1], 32, dtype=np.uint8)
    for k in range(depth):
        out[bounds[:-1] + k] = END
    out[bounds[1:] - 1] = END
    before = np.concatenate([[0], np.cumsum(sizes)])
    # A word's place: its row's first byte, the context, and the words of the row before it.
    offset = np.concatenate([[0], np.cumsum(sizes + 1)])
    base = bounds[w.row] + depth + offset[:-1] - offset[w.first[w.row]]
    each = np.arange(before[-1])
    out[each + np.repeat(base - before[:-1], sizes)] = w.data[each + np.repeat(w.start - before[:-1], sizes)]
    return out, bounds


def grams_of(w: Words, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams in the order of the coded bytes, their bounds by row)."""
    out, bounds = stream(w, depth)
    # The eight bytes before each one as a number, the nearest on top, read from the bytes in reverse.
    back = np.zeros(len(out) + 8, dtype=np.uint8)
    back[: len(out)] = out[::-1]
    code = np.ndarray(len(out), ">u8", back, 1, (1,))[::-1].astype(np.uint64)
    code >>= np.uint64(8 * (8 - depth))
    code <<= np.uint64(8)
    code |= out
    code = code.view(np.int64)
    coded = np.ones(len(out), dtype=bool)
    for k in range(depth):
        coded[bounds[:-1] + k] = False
    return code[coded], bounds - depth * np.arange(len(bounds))


def by_bucket(grams: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of sorted grams by bucket, the buckets, where each begins)."""
    at = bucket(grams, depth)
    order = np.argsort(at, kind="stable")
    names, first = np.unique(at[order], return_index=True)
    return order, names, first


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of whole numbers, plane by plane, compressed."""
    return zlib.compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), 1)


def _from_planes(data: bytes, width: int | None = None, n: int | None = None) -> np.ndarray:
    """The numbers of _planes, of a known width or a known number."""
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    raw = raw.reshape(width or len(raw) // n, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, : len(raw)] = raw.T
    return out.view("<i8").ravel()


def _asked(column_a, column_b, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(grams, counts) of packed rows."""
    out = []
    for a, b in zip(column_a.to_pylist(), column_b.to_pylist(), strict=True):
        grams = _from_planes(a, depth + 1)
        out.append((grams, _from_planes(b, n=len(grams))))
    return out


def _count_rows(depth: int):
    """Rows of PARTS: kind 0 for a bucket of a part's grams (a) and their counts in training texts (b), 1 for words, 2 for
    the number of training texts, 3 for a chunk of the part's texts: bytes (a), ids and offsets (b)."""

    def batch(rows, **columns):
        return pa.record_batch([columns.get(f.name, pa.nulls(rows, f.type)) for f in PARTS], schema=PARTS)

    def of_kind(kind, n):
        return pa.array(np.full(n, kind, np.int32))

    def grams(runs, part):
        keys, n = sum_runs(*(np.concatenate(x) for x in zip(*runs, strict=True)))
        order, names, first = by_bucket(keys, depth)
        a, b = [], []
        for at in np.split(order, first[1:]):
            a.append(_planes(keys[at], depth + 1))
            b.append(_planes(n[at], max(1, (int(n[at].max()).bit_length() + 7) // 8)))
        yield batch(len(names), kind=of_kind(0, len(names)), part=pa.array(np.full(len(names), part)), bucket=pa.array(names), a=pa.array(a, pa.binary()), b=pa.array(b, pa.binary()))

    def words(runs):
        keys, n = sum_runs(*(np.concatenate(x) for x in zip(*runs, strict=True)))
        for at in range(0, len(keys), 100_000):
            k = keys[at : at + 100_000]
            yield batch(len(k), kind=of_kind(1, len(k)), key=pa.array(k), n=pa.array(n[at : at + 100_000]))

    def run(batches):
        part = TaskContext.get().partitionId() << 24
        return_memory()
        texts, size, runs, counts, fresh = 0, 0, [], [], [0, 0]
        merged = lambda x: [sum_runs(*(np.concatenate(y) for y in zip(*x, strict=True)))]
        for b in batches:
            learn = np.asarray(b.column(2).fill_null(False))
            texts += int(learn.sum())
            for at, data, off in chunks(b.column(1), CHUNK):
                w = Words(data, off)
                rows = len(off) - 1
                taught = learn[at : at + rows]
                code, bounds = grams_of(w, depth)
                of_train = np.repeat(taught, np.diff(bounds))
                runs.append(np.unique(code[of_train], return_counts=True))
                other = distinct(code[~of_train])
                runs.append((other, np.zeros(len(other), np.int64)))
                counts.append(np.unique(w.hashes().view(np.int64)[taught[w.row]] & NON_NEGATIVE, return_counts=True))
                ids = b.column(0).slice(at, rows).cast(pa.int64())
                names = pickle.dumps((np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), off))
                yield batch(1, kind=of_kind(3, 1), part=pa.array([part]), a=pa.array([zlib.compress(data.tobytes(), 1)], pa.binary()), b=pa.array([zlib.compress(names, 1)], pa.binary()))
                size += len(data)
                fresh = [fresh[0] + len(runs[-2][0]) + len(other), fresh[1] + len(counts[-1][0])]
                if fresh[0] > FRESH:
                    runs, fresh[0] = merged(runs), 0
                    if len(runs[0][0]) > PART_GRAMS or size > PART_BYTES:
                        yield from grams(runs, part)
                        part, runs, size = part + 1, [], 0
                if fresh[1] > FRESH:
                    counts, fresh[1] = merged(counts), 0
                    if len(counts[0][0]) > FRESH:
                        yield from words(counts)
                        counts = []
        if runs:
            yield from grams(runs, part)
        if counts:
            yield from words(counts)
        yield batch(1, kind=of_kind(2, 1), key=pa.array([0]), n=pa.array([texts]))

    return run


def _upward(depth: int):
    """What the driver needs of a bucket: counts of SPLIT - 1 context bytes and the byte (kind 0), and its subtrees' weighted
    logs by their parents' nodes (kind 1)."""

    def run(t: pa.Table) -> pa.Table:
        return_memory()
        grams, n = sum_runs(*(np.concatenate(x) for x in zip(*_asked(t["a"], t["b"], depth), strict=True)))
        grams, n, kt = grams[n > 0], n[n > 0], KT()
        found = []
        for at in pieces(grams, depth):
            g, m = grams[at], n[at]
            key, count = sum_runs((g >> 8 * (depth + 2 - SPLIT)) << 8 | g & 255, m)
            found.append((np.zeros(len(key), np.int32), key, count.astype(float)))
            key, weighted = Subtrees(g, m, depth, kt).rows()
            found.append((np.ones(len(key), np.int32), key, weighted))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("kind", "key", "w"), columns, strict=True)))

    return run


def _downward(depth: int, shared):
    """(part, bucket, logs) of each part's grams of a bucket: the upper three bytes of rounded 32-bit floats."""

    def run(t: pa.Table) -> pa.Table:
        return_memory()
        upper, kt = pickle.loads(shared.value), KT()
        asked = _asked(t["a"], t["b"], depth)
        grams, n = sum_runs(*(np.concatenate(x) for x in zip(*asked, strict=True)))
        found = np.zeros(len(grams), np.float32)
        for at in pieces(grams, depth):
            found[at] = Subtrees(grams[at], n[at], depth, kt).logs(upper)
        high = (found.view(np.uint32).astype(np.int64) + 128 >> 8).astype(np.int64)
        answers = [_planes(high[np.searchsorted(grams, g)], 3) for g, _ in asked]
        return pa.table({"part": t["part"], "bucket": t["bucket"], "logs": pa.array(answers, pa.binary())})

    return run


def gram_logs(parts: DataFrame, scratch: Scratch, depth: int = DEPTH) -> DataFrame:
    """(part, bucket, logs) of all grams, written."""
    grams = parts.filter("kind = 0").select("part", "bucket", "a", "b")
    up = grams.groupBy("bucket").applyInArrow(_upward(depth), "kind int, key long, w double")
    up = up.groupBy("kind", "key").agg(F.sum("w").alias("w")).toArrow()
    kind, key, w = (up[c].to_numpy() for c in ("kind", "key", "w"))
    order = np.argsort(key[kind == 1])
    upper = top(key[kind == 0], w[kind == 0].astype(np.int64), (key[kind == 1][order], w[kind == 1][order]))
    shared = parts.sparkSession.sparkContext.broadcast(pickle.dumps(upper))
    out = scratch.write(grams.groupBy("bucket").applyInArrow(_downward(depth, shared), "part long, bucket int, logs binary"), "lm-logs")
    shared.destroy()
    return out


ROWS = "doc_id long, n_tokens long, n_bytes long, head double, n_known long, score double, keys array<long>, times array<int>"


def _score_part(shared, depth: int):
    def texts(docs: pa.Table):
        for a, b in zip(docs["a"].to_pylist(), docs["b"].to_pylist(), strict=True):
            ids, null, off = pickle.loads(zlib.decompress(b))
            yield pa.array(ids, mask=null), Words(np.frombuffer(zlib.decompress(a), np.uint8), off)

    def run(docs: pa.Table, values: pa.Table) -> pa.Table:
        return_memory()
        heads = Lookup(*pickle.loads(shared.value))
        # The part's distinct grams, in the order in which it sent them.
        runs: list[np.ndarray] = []
        for _, w in texts(docs):
            runs.append(distinct(grams_of(w, depth)[0]))
            if sum(map(len, runs[1:])) > FRESH:
                runs = [sum_runs(np.concatenate(runs))[0]]
        grams = sum_runs(np.concatenate([np.zeros(0, np.int64), *runs]))[0]
        order, names, _ = by_bucket(grams, depth)
        sent = dict(zip(values["bucket"].to_pylist(), values["logs"].to_pylist(), strict=True))
        high = np.concatenate([np.zeros(0, np.int64), *(_from_planes(sent[x], 3) for x in names.tolist())])
        table = Lookup(grams[order], (high << 8).astype(np.uint32).view(np.float32))
        del runs, grams, order, high
        out = []
        for ids, w in texts(docs):
            rows = len(w.off) - 1
            code, bounds = grams_of(w, depth)
            score = row_sums(table.find(code)[0], bounds) / np.log(10)
            h = w.hashes().view(np.int64) & NON_NEGATIVE
            known_log, hit = heads.find(h)
            base = np.bincount(w.row, weights=known_log, minlength=rows).astype(np.float64)
            n_known = np.bincount(w.row[hit], minlength=rows).astype(np.int64)
            miss_row, miss = w.row[~hit], h[~hit]
            order = np.lexsort((miss, miss_row))
            miss_row, miss = miss_row[order], miss[order]
            new = np.ones(len(miss), dtype=bool)
            new[1:] = (miss[1:] != miss[:-1]) | (miss_row[1:] != miss_row[:-1])
            starts = np.flatnonzero(new)
            times = np.diff(np.concatenate([starts, [len(miss)]])).astype(np.int32)
            offsets = np.searchsorted(miss_row[starts], np.arange(rows + 1)).astype(np.int32)
            out.append(
                pa.record_batch(
                    [ids, pa.array(np.diff(w.first).astype(np.int64) + 1), pa.array(np.diff(bounds).astype(np.int64)), pa.array(base), pa.array(n_known), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets), pa.array(miss[starts])), pa.ListArray.from_arrays(pa.array(offsets), pa.array(times))],
                    names=["doc_id", "n_tokens", "n_bytes", "head", "n_known", "score", "keys", "times"],
                )
            )
        return pa.Table.from_batches(out)

    return run


def score(docs: DataFrame, training: Column, text: str = "text", id_col: str = "doc_id", depth: int = DEPTH) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes of each row; `training` picks the rows to learn from.

    The result is written to the shared folder; all tables on the way are deleted.
    """
    if not SPLIT <= depth <= 6:
        raise ValueError("contexts are 3 to 6 bytes")
    spark = docs.sparkSession
    picked = docs.select(ref(id_col).cast("long").alias("doc_id"), ref(text).cast("string").alias("text"), training.alias("training"))
    with Scratch(spark) as scratch:
        parts = scratch.write(picked.mapInArrow(_count_rows(depth), PARTS_DDL), "lm-parts")
        words = scratch.write(parts.filter("kind = 1").groupBy("key").agg(F.sum("n").alias("n")), "lm-words")
        texts = parts.filter("kind = 2").agg(F.sum("n")).first()[0] or 0
        n_words, n_kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        total, kinds = n_words + texts, n_kinds + (texts > 0)
        head = words.filter(F.col("n") * HEAD >= F.lit(total)).select("key", "n").toArrow()
        shared = spark.sparkContext.broadcast(pickle.dumps((head["key"].to_numpy().astype(np.int64), np.log10(head["n"].to_numpy() + 1.0))))
        values = gram_logs(parts, scratch, depth)
        whole = parts.filter("kind = 3").select("part", "a", "b").groupBy("part").cogroup(values.groupBy("part"))
        rows = scratch.write(whole.applyInArrow(_score_part(shared, depth), ROWS).withColumn("row", F.monotonically_increasing_id()), "lm-rows")
        shared.destroy()  # the rows are written
        tail = rows.select("row", F.explode(F.arrays_zip("keys", "times")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.times").alias("times"))
        rare = words.filter(F.col("n") * HEAD < F.lit(total)).select("key", "n")
        found = tail.join(rare.hint("merge"), "key").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("tail"), F.sum("times").alias("more"))
        both = rows.drop("keys", "times").join(found, "row", "left")
        base = F.col("head") + F.coalesce("tail", F.lit(0.0)) + F.lit(float(np.log10(texts + 1.0))) - F.col("n_tokens") * F.lit(float(np.log10(total + kinds + 1.0)))
        n_known = F.col("n_known") + F.coalesce("more", F.lit(0)) + F.lit(int(texts > 0))
        return scratch.keep(both.select("doc_id", "n_tokens", n_known.alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes"), "lm-scores")

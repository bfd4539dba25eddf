"""Token ids and binary output (operator 7): best-fit-decreasing packing of token sequences into fixed-width rows.

Texts are encoded with a byte-level BPE rank file; each document ends with the free id. Sequences over the width are cut
into pieces without loss. A task packs its rows in shards of `shard_tokens` tokens: longest pieces first, each into
the open row with the least room that is enough, which a segment tree over the rooms 0 to width finds in log(width)
steps. Nothing is shuffled, and a task holds one shard; an executor that is lost costs its tasks only, as shards follow
from the input splits.

A packed row has: ids (a row of the id matrix, little-endian 32-bit, filled with the end id), cu_seqlens (0 and the
running sums of its segments), positions (restarting at 0 in each segment, little-endian 32-bit), doc_ids and starts
(the token of its document at which each segment begins), so `unpack` gives the documents back.

Defined results: null and empty texts are the end id alone; equal pieces keep the input's order; repeated rows
are packed as often as they stand; null ids are packed under a null id, and `unpack` joins what shares an id, null
included, in the order of the starts; very long texts are cut into rows; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public pattern that cuts texts before byte-pair merges of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_ID = 50256


class Rooms:
    """A segment tree over rooms 0..width: how many open rows have each room; finds the least room of a size or more."""

    def __init__(self, width: int):
        self.leaves = 1 << width.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = self.leaves + room
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, row) with the least room >= size, removed; None if there is none."""
        i = self.leaves + size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        while i:
            self.count[i] -= 1
            i >>= 1
        return room, self.rows[room].pop()


def pack(sizes: list[int], width: int) -> list[list[int]]:
    """Rows of piece numbers, best fit decreasing."""
    rows: list[list[int]] = []
    rooms = Rooms(width)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        got = rooms.take(sizes[i])
        if got is None:
            room, row = width, len(rows)
            rows.append([])
        else:
            room, row = got
        rows[row].append(i)
        if room > sizes[i]:
            rooms.add(room - sizes[i], row)
    return rows


def _encoding(data: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


SCHEMA = "pack_id string, n_tokens int, doc_ids array<long>, starts array<int>, cu_seqlens array<int>, ids binary, positions binary"


def _pack_rows(ranks, width: int, shard_tokens: int, end_id: int):
    def emit(name, docs, tokens):
        flat = np.concatenate(tokens).astype("<i4")
        ends = np.cumsum([len(t) for t in tokens])
        doc_of, start, at = [], [], []
        for d, (e, t) in enumerate(zip(ends, tokens, strict=True)):
            for s in range(0, len(t), width):
                doc_of.append(d)
                start.append(s)
                at.append(int(e) - len(t) + s)
        sizes = [min(width, len(tokens[d]) - s) for d, s in zip(doc_of, start, strict=True)]
        count = np.arange(width, dtype="<i4")
        out: dict[str, list] = {k: [] for k in ("pack_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", "ids", "positions")}
        for k, row in enumerate(pack(sizes, width)):
            ids, pos = np.full(width, end_id, dtype="<i4"), np.zeros(width, dtype="<i4")
            cu = [0]
            for i in row:
                a = cu[-1]
                ids[a : a + sizes[i]] = flat[at[i] : at[i] + sizes[i]]
                pos[a : a + sizes[i]] = count[: sizes[i]]
                cu.append(a + sizes[i])
            for key, value in zip(out, (f"{name}-{k}", cu[-1], [docs[doc_of[i]] for i in row], [start[i] for i in row], cu, ids.tobytes(), pos.tobytes()), strict=True):
                out[key].append(value)
        types = [pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        step = 512
        for a in range(0, len(out["pack_id"]), step):
            yield pa.record_batch([pa.array(v[a : a + step], type=t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    def run(batches):
        from pyspark import TaskContext

        enc, part = _encoding(ranks.value), TaskContext.get().partitionId()
        docs, tokens, held, shard = [], [], 0, 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py() or ""
                # The library's own array output; lone surrogates can't occur in Arrow strings.
                t = np.append(np.asarray(enc.encode_ordinary(text), dtype=np.int32), np.int32(end_id))
                docs.append(doc)
                tokens.append(t)
                held += len(t)
                if held >= shard_tokens:
                    yield from emit(f"{part}-{shard}", docs, tokens)
                    docs, tokens, held, shard = [], [], 0, shard + 1
        if tokens:
            yield from emit(f"{part}-{shard}", docs, tokens)

    return run


def pack_documents(docs: DataFrame, ranks_path: str, width: int = 2048, shard_tokens: int = 2_000_000, end_id: int = END_ID, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Packed rows (see above) of the documents of each shard."""
    spark = docs.sparkSession
    try:
        with open(ranks_path, "rb") as f:
            data = f.read()
    except OSError:
        data = bytes(spark.read.format("binaryFile").load(ranks_path).select("content").first()[0])
    shared = spark.sparkContext.broadcast(data)
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return picked.mapInArrow(_pack_rows(shared, width, shard_tokens, end_id), SCHEMA)


def unpack(packed: DataFrame) -> DataFrame:
    """doc_id and ids (with the end id) of each document, from packed rows. For tables with one row a doc_id."""

    def cut(batches):
        for b in batches:
            doc, start, ids = [], [], []
            for r in b.to_pylist():
                flat = np.frombuffer(r["ids"], dtype="<i4")
                for i, (d, s) in enumerate(zip(r["doc_ids"], r["starts"], strict=True)):
                    doc.append(d)
                    start.append(s)
                    ids.append(flat[r["cu_seqlens"][i] : r["cu_seqlens"][i + 1]].tolist())
            yield pa.record_batch([pa.array(doc, type=pa.int64()), pa.array(start, type=pa.int32()), pa.array(ids, type=pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    pieces = packed.select("doc_ids", "starts", "cu_seqlens", "ids").mapInArrow(cut, "doc_id long, start int, ids array<int>")
    joined = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "ids"))).alias("p"))
    return joined.select("doc_id", F.flatten("p.ids").alias("ids"))


def write_packed(packed: DataFrame, path: str) -> None:
    """Parquet with the id matrix and position rows as fixed-width binary columns."""
    packed.write.parquet(path)

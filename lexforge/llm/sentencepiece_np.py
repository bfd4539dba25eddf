"""SentencePiece encoding and decoding (operator 9): batched numpy Viterbi over words, from a model file.

Words of up to `LONG` characters advance together, a character at a time. A trie of the pieces, as a hash table, is walked from all
characters at once, a level at a time, until no piece goes on; the pieces found are sorted by where in their word they end. At each place,
vectorised maxima keep the best score and, as a backpointer, the piece that reached it; the paths are read backwards, all words
at a time.

Unigram models: the score is the sum of the pieces' scores. BPE models: a piece's score is its merge rank, and a path is
what the merges would make when each two neighbours stay apart, that is, when joining their characters again by rank
gives these two pieces. So there a piece only follows a best path whose last piece it stays apart from (`_apart`); one path
is left for each prefix, and its ids are those of the merges. `_apart` undoes the merges on both sides of the
border from the latest on: the border holds if the two symbols at it never join before one of them is undone. A task
remembers the answers for `2 ** PAIR_BITS` pairs. Words longer than `LONG` characters take the same steps one word at a time.

A text is cut before each run of U+2581: no piece has that mark after another character (checked when the model is
read), so no piece spans two words, and each distinct word is encoded once a task: words meet their ids by 64-bit hashes
in sorted arrays, with length and first bytes compared. Characters without a piece become byte pieces, or the unknown
piece where the model has none.

Defined results: null and empty texts give no ids and decode to ""; very long texts and words are encoded whole; null and
repeated ids pass through, a row each; an empty table gives no rows; extra columns aren't read; with the model's
identity normaliser, decoding gives back the text (a text's own U+2581 comes back as a space, as in the library). The
vocabulary comes by broadcast: its size is the model file's.
"""

from __future__ import annotations

import pickle
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesnp import Lookup, chunks, word_hashes

MARK = "▁"
LONG = 48
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
#: Distinct words whose ids a task keeps; beyond that it starts again.
MEMO_WORDS = 400_000
#: Characters of words that a Viterbi takes at a time.
STEP = 200_000
#: A task keeps whether pieces stay apart for at most 2 ** PAIR_BITS pairs of them, a pair in a slot of its hash.
PAIR_BITS = 20
NO_PATH = "a word has no path: the model's pieces aren't those of merges by rank"


def _fields(buf: bytes):
    """(field number, wire type, value) of a protocol-buffer message."""
    at, end = 0, len(buf)

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = buf[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        elif kind == 5:
            value = buf[at : at + 4]
            at += 4
        elif kind == 1:
            value = buf[at : at + 8]
            at += 8
        else:
            size = varint()
            value = buf[at : at + size]
            at += size
        yield key >> 3, kind, value


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)  # 1 normal, 2 unknown, 3 control, 4 user, 6 byte
    kind: int = 1  # 1 unigram, 2 bpe
    dummy_prefix: bool = True
    squeeze: bool = True  # remove extra white space
    byte_fallback: bool = False
    unk: int = 0


def read_model(data: bytes) -> Model:
    """The parts of a model file that encoding needs. Only the identity normaliser is supported."""
    m = Model()
    for number, _, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, 1
            for n, _, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append(piece)
            m.scores.append(score)
            m.kinds.append(kind)
        elif number == 2:
            for n, _, v in _fields(value):
                if n == 3:
                    m.kind = v
                elif n == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for n, _, v in _fields(value):
                if n == 1 and v not in (b"identity", b""):
                    raise ValueError(f"normaliser {v!r} is not supported")
                if n == 3:
                    m.dummy_prefix = bool(v)
                elif n == 4:
                    m.squeeze = bool(v)
    m.unk = m.kinds.index(2) if 2 in m.kinds else 0
    return m


def _symbols(model: Model) -> dict[str, int]:
    """Pieces that text can become: normal and user-defined ones."""
    out = {model.pieces[i]: i for i, k in enumerate(model.kinds) if k in (1, 4)}
    if any(MARK in p.lstrip(MARK) for p in out):
        raise ValueError("a piece has the word mark inside")
    return out


def _parts(model: Model, id_of: dict[str, int]):
    """(pairs, rank, left, right) of a BPE model: the pairs of symbols that make a piece, {left << 32 | right: piece};
    and of each piece its merge order (-1: a character, never made) and the two symbols that its last merge joins.
    A piece that its own characters' merges don't give has order -2."""
    base = len(model.pieces)
    symbol = lambda s: id_of.get(s, base + ord(s) if len(s) == 1 else None)
    pairs = {}
    for text, i in id_of.items():
        for cut in range(1, len(text)):
            a, b = symbol(text[:cut]), symbol(text[cut:])
            if a is not None and b is not None:
                pairs[a << 32 | b] = i
    order = {i: k for k, i in enumerate(sorted({-s for s in model.scores}))}
    rank = np.array([order[-s] for s in model.scores], dtype=np.int64)
    left, right = np.full(base, -1, np.int64), np.full(base, -1, np.int64)
    for text, i in id_of.items():
        if len(text) == 1:
            rank[i] = -1
            continue
        row = [symbol(c) for c in text]
        while len(row) > 1:
            found = [(rank[p], k, p) for k in range(len(row) - 1) if (p := pairs.get(row[k] << 32 | row[k + 1])) is not None]
            if not found:
                break
            _, k, p = min(found)
            if len(row) == 2:
                left[i], right[i] = row
            row[k : k + 2] = [p]
        if row != [i]:
            rank[i] = -2
    return pairs, rank, left, right


def prepare(model: Model) -> dict:
    """The tables that encoding and decoding need, as plain arrays and values."""
    id_of = _symbols(model)
    out = {"base": len(model.pieces), "pieces": model.pieces, "kinds": model.kinds, "unk": model.unk, "dummy_prefix": model.dummy_prefix, "squeeze": model.squeeze, "byte_fallback": model.byte_fallback, "bpe": model.kind == 2, "score": np.array(model.scores)}
    out["byte_id"] = {int(model.pieces[i][3:5], 16): i for i, k in enumerate(model.kinds) if k == 6}
    used = [s for s, k in zip(model.scores, model.kinds, strict=True) if k in (1, 4)]
    out["unknown_score"] = (min(used) if used else 0.0) - 10.0
    if out["bpe"]:
        pairs, rank, left, right = _parts(model, id_of)
        keys = np.fromiter(pairs, np.int64, len(pairs))
        out |= {"pair_keys": keys, "pair_rank": rank[np.fromiter(pairs.values(), np.int64, len(pairs))], "rank": rank, "left": left, "right": right}
    nodes, piece = {}, [-1]
    for text, i in id_of.items():
        if out["bpe"] and out["rank"][i] == -2:
            continue
        at = 0
        for c in text:
            at = nodes.setdefault(at << 21 | ord(c), len(piece))
            if at == len(piece):
                piece.append(-1)
        piece[at] = i
    out |= {"trie_keys": np.fromiter(nodes, np.int64, len(nodes)), "trie_piece": np.array(piece, dtype=np.int64)}
    return out


class Encoder:
    """Encodes texts with the tables of `prepare`, and decodes ids."""

    def __init__(self, tables: dict):
        self.t = tables
        self.byte_of = {i: b for b, i in tables["byte_id"].items()}
        self.trie = Lookup(tables["trie_keys"], np.arange(1, len(tables["trie_piece"])))
        self.score = np.append(tables["score"], tables["unknown_score"])  # the last one is any bare character's, also below
        if tables["bpe"]:
            self.pairs = Lookup(tables["pair_keys"], tables["pair_rank"])
            self.rank, self.left, self.right = (np.append(tables[x], -1) for x in ("rank", "left", "right"))
            self.seen = np.full(1 << PAIR_BITS, -1, dtype=np.int64)
        self.forget()

    def forget(self) -> None:
        """Words seen: sorted hashes, a check for each, and where its ids lie."""
        self.keys, self.marks = np.zeros(0, U64), np.zeros(0, U64)
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    # Viterbi

    def _apart(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether piece u, then piece v, stay two under the merges. Orders count double; of two equal ones the left
        merge comes first."""
        base = self.t["base"]
        out = np.ones(len(u), dtype=bool)
        live, a, b = np.arange(len(u)), u, v
        until = np.full(len(u), np.iinfo(np.int64).max)
        while len(live):
            rank, joined = self.pairs.find(a << 32 | b)
            joined &= 2 * rank < until
            out[live[joined]] = False
            ia, ib = np.minimum(a, base), np.minimum(b, base)
            ra, rb = self.rank[ia], self.rank[ib]
            go = ~joined & (np.maximum(ra, rb) >= 0)
            live, a, b, ia, ib, ra, rb = (x[go] for x in (live, a, b, ia, ib, ra, rb))
            undo_left = ra > rb
            until = np.where(undo_left, 2 * ra, 2 * rb + 1)
            a, b = np.where(undo_left, self.right[ia], a), np.where(undo_left, b, self.left[ib])
        return out

    def _stay(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """`_apart`, worked out for pairs that aren't remembered; before a word's first piece u is -1."""
        key = u << 32 | v
        slot = (key.astype(U64) * U64(_BASE) >> U64(64 - PAIR_BITS)).astype(np.int64)
        kept = self.seen[slot]
        out = (kept & 1 == 1) | (u < 0)
        new = np.flatnonzero((kept >> 1 != key) & (u >= 0))
        if len(new):
            pairs, place = np.unique(key[new], return_inverse=True)
            out[new] = self._apart(pairs >> 32, pairs & 0xFFFFFFFF)[place]
            self.seen[slot[new]] = key[new] << 1 | out[new]
        return out

    def _found(self, codes: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces in words: first character, size and symbol of each, by rising size. rest: characters from each one to its word's end."""
        at, node, size, out = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0, []
        while len(at):
            node, hit = self.trie.find(node << 21 | codes[at + size])
            symbol = self.t["trie_piece"][node]
            size += 1
            if size == 1:
                symbol = np.where(symbol < 0, self.t["base"] + codes, symbol)
            good = symbol >= 0
            out.append((at[good], np.full(int(good.sum()), size), symbol[good]))
            hit &= rest[at] > size
            at, node = at[hit], node[hit]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _viterbi(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best paths of words (codes: their characters, one word after another): symbols, and how many each word has.

        A character without a piece is the symbol base + its code point. A word of k characters has k + 1 prefixes, which
        lie one after another; the places of its characters are those of the prefixes that end before them.
        """
        n, base = len(lengths), self.t["base"]
        codes = codes.astype(np.int64)
        word = np.repeat(np.arange(n), lengths)
        bound = np.cumsum(lengths)
        rest = bound[word] - np.arange(len(codes))
        first, size, symbol = self._found(codes, rest)
        end = (lengths[word] - rest)[first] + size
        order = np.argsort(end.astype(np.int16), kind="stable")  # so sizes still rise at each place
        bounds = np.cumsum(np.bincount(end))
        size, symbol = size[order], symbol[order]
        start = (first + word[first])[order]
        score = self.score[np.minimum(symbol, base)]
        whole = bound + np.arange(n)  # prefixes that are whole words
        best = np.full(len(codes) + n, -np.inf)
        best[whole - lengths] = 0.0
        back, piece = np.zeros(len(best), np.int64), np.full(len(best), -1, np.int64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            at, k, sym, value = start[a:b], size[a:b], symbol[a:b], score[a:b]
            if self.t["bpe"]:
                keep = self._stay(piece[at], sym)
                at, k, sym, value = at[keep], k[keep], sym[keep], value[keep]
            to, value = at + k, value + best[at]
            np.maximum.at(best, to, value)
            top = value == best[to]
            back[to[top]], piece[to[top]] = k[top], sym[top]  # sizes rise, so the longest of equal scores stays
        if not np.isfinite(best[whole]).all():
            raise ValueError(NO_PATH)
        on, at, zero = np.zeros(len(best), dtype=bool), whole, whole - lengths
        while len(at):
            on[at] = True
            at = at - back[at]
            go = at > zero
            at, zero = at[go], zero[go]
        return piece[on], np.add.reduceat(on, whole - lengths, dtype=np.int64)

    def _viterbi_long(self, codes: np.ndarray) -> np.ndarray:
        """The same for one long word: symbols."""
        t, base = self.t, self.t["base"]
        if not hasattr(self, "id_of"):
            self.id_of = {t["pieces"][i]: i for i in t["trie_piece"].tolist() if i >= 0}
            self.longest = max(map(len, self.id_of), default=1)
            self.stay: dict[tuple[int, int], bool] = {}
        text = codes.astype("<u4").tobytes().decode("utf-32-le", "replace")
        best, last, back = [0.0], [-1], [0]
        for j in range(1, len(text) + 1):
            top = (-np.inf, 0, 0)
            known = False
            for size in range(1, min(j, self.longest) + 1):
                sym = self.id_of.get(text[j - size : j])
                if size == 1:
                    known = sym is not None
                    score = t["score"][sym] if known else t["unknown_score"]
                    sym = sym if known else base + ord(text[j - 1])
                elif sym is None:
                    continue
                else:
                    score = t["score"][sym]
                before = last[j - size]
                if t["bpe"] and before >= 0:
                    if (before, sym) not in self.stay:
                        self.stay[before, sym] = bool(self._apart(np.array([before]), np.array([sym]))[0])
                    if not self.stay[before, sym]:
                        continue
                if score + best[j - size] >= top[0]:  # of equal scores the longest last piece, as in `_viterbi`
                    top = (score + best[j - size], size, sym)
            best.append(top[0])
            back.append(top[1])
            last.append(top[2])
        out, j = [], len(text)
        if not np.isfinite(best[j]):
            raise ValueError(NO_PATH)
        while j:
            out.append(last[j])
            j -= back[j]
        return np.array(out[::-1], dtype=np.int64)

    # Words

    def _spelled(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids from symbols: a bare character becomes its bytes' pieces, or runs of them the unknown piece."""
        t, bare = self.t, symbols >= self.t["base"]
        if not bare.any():
            return symbols.astype(np.int32), counts
        word = np.repeat(np.arange(len(counts)), counts)
        if not t["byte_fallback"]:
            again = bare[1:] & bare[:-1] & (word[1:] == word[:-1])
            keep = np.concatenate([[True], ~again])
            return np.where(bare, t["unk"], symbols)[keep].astype(np.int32), np.bincount(word[keep], minlength=len(counts))
        kinds, place = np.unique(symbols[bare], return_inverse=True)
        spelled = [[t["byte_id"][b] for b in chr(k - t["base"]).encode("utf-8", "replace")] for k in kinds.tolist()]
        sizes = np.ones(len(symbols), np.int64)
        sizes[bare] = np.array([len(s) for s in spelled])[place]
        out = np.repeat(symbols, sizes)
        first = np.cumsum(sizes) - sizes
        for k in range(4):
            more = np.array([s[k] if k < len(s) else -1 for s in spelled])[place]
            out[first[bare][more >= 0] + k] = more[more >= 0]
        return out.astype(np.int32), np.bincount(np.repeat(word, sizes), minlength=len(counts))

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of each word's ids) of words given by their bytes; a space stands for the mark."""
        sizes = end - start
        at = np.cumsum(sizes) - sizes
        raw = data[np.arange(int(sizes.sum())) + np.repeat(start - at, sizes)]
        try:
            codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
            lengths = np.add.reduceat((raw & 0xC0) != 0x80, at).astype(np.int64) if len(raw) else np.zeros(0, np.int64)
        except UnicodeDecodeError:
            texts = [raw[a : a + k].tobytes().decode("utf-8", "replace") for a, k in zip(at.tolist(), sizes.tolist(), strict=True)]
            codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
            lengths = np.array([len(x) for x in texts], dtype=np.int64)
        codes = np.where(codes == 32, ord(MARK), codes)
        first = np.cumsum(lengths) - lengths
        short = np.flatnonzero(lengths <= LONG)
        order = [x for x in np.split(short, np.flatnonzero(np.diff(np.cumsum(lengths[short]) // STEP)) + 1) if len(x)]
        parts = []
        for part in order:
            of = lengths[part]
            symbols, counts = self._viterbi(codes[np.arange(int(of.sum())) + np.repeat(first[part] - (np.cumsum(of) - of), of)], of)
            parts.append(self._spelled(symbols, counts))
        for k in np.flatnonzero(lengths > LONG):
            symbols = self._viterbi_long(codes[first[k] : first[k] + lengths[k]])
            order.append(np.array([k]))
            parts.append(self._spelled(symbols, np.array([len(symbols)])))
        order = np.concatenate(order) if order else np.zeros(0, np.int64)
        flat, counts = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        begin = (np.cumsum(counts) - counts)[np.argsort(order)]
        counts = counts[np.argsort(order)]
        out = np.cumsum(counts) - counts
        return flat[np.arange(len(flat)) + np.repeat(begin - out, counts)], counts

    def normalised(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets with a text's own marks as spaces, runs of spaces squeezed and the prefix set, if the model asks."""

        def without(gone):
            before = np.concatenate([[0], np.cumsum(gone)])
            return data[~gone], off - before[off]

        if len(data) > 2:
            own = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
            if len(own):
                data = data.copy()
                data[own] = 32
                gone = np.zeros(len(data), dtype=bool)
                gone[own + 1] = gone[own + 2] = True
                data, off = without(gone)
        if self.t["squeeze"]:
            for _ in range(2):  # a space after a space or at a row's start, then one at its end
                edge = np.zeros(len(data) + 1, dtype=bool)
                edge[off] = True
                space = data == 32
                gone = space & (edge[:-1] | np.concatenate([[False], space[:-1]])) if _ == 0 else space & edge[1:]
                data, off = without(gone)
        if self.t["dummy_prefix"]:
            sizes = np.diff(off)
            shift = np.cumsum(sizes > 0)
            out = np.full(len(data) + (int(shift[-1]) if len(shift) else 0), 32, dtype=np.uint8)
            out[np.arange(len(data)) + np.repeat(shift, sizes)] = data
            data, off = out, off + np.concatenate([[0], shift])
        return data, off

    def ids(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, bounds by row) of the texts of a chunk."""
        data, off = self.normalised(data, off)
        rows = len(off) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[off] = True
        space = data == 32
        start = np.flatnonzero(edge[:-1] | (space & ~np.concatenate([[False], space[:-1]])))
        end = np.concatenate([start[1:], [len(data)]])
        keys, marks = _word_hashes(data, start, end)
        kinds, first, place = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(kinds) > MEMO_WORDS:
            self.forget()
        at = np.minimum(np.searchsorted(self.keys, kinds), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[at] != kinds) if len(self.keys) else np.arange(len(kinds))
        if len(new):
            flat, counts = self.words(data, start[first[new]], end[first[new]])
            begin = len(self.flat) + np.cumsum(counts) - counts
            self.flat = np.concatenate([self.flat, flat])
            into = np.searchsorted(self.keys, kinds[new])
            self.keys, self.marks, self.start, self.size = (np.insert(x, into, y) for x, y in ((self.keys, kinds[new]), (self.marks, marks[first[new]]), (self.start, begin), (self.size, counts)))
        at = np.searchsorted(self.keys, kinds)[place]
        begin, sizes, flat = self.start[at], self.size[at], self.flat
        other = np.flatnonzero(self.marks[at] != marks)  # another word has the same hash: encoded by itself
        if len(other):
            more, counts = self.words(data, start[other], end[other])
            begin[other], sizes[other] = len(flat) + np.cumsum(counts) - counts, counts
            flat = np.concatenate([flat, more])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = flat[np.arange(int(ends[-1])) + np.repeat(begin - ends[:-1], sizes)]
        return out, ends[np.searchsorted(start, off)]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        out = []
        for _, data, off in chunks(pa.array(texts, pa.string())):
            flat, bounds = self.ids(data, off)
            out += [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return out

    def decode(self, ids: list[int]) -> str:
        t = self.t
        out: list[bytes] = []
        for i in ids:
            kind = t["kinds"][i]
            if kind == 6:
                out.append(bytes([self.byte_of[i]]))
            elif kind == 2:
                out.append(" ⁇ ".encode())
            elif kind != 3:
                out.append(t["pieces"][i].encode("utf-8"))
        text = b"".join(out).decode("utf-8", errors="replace").replace(MARK, " ")
        return text[1:] if t["dummy_prefix"] and text.startswith(" ") else text


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 bits for each word, and its length and first eight bytes as a check."""
    keys = word_hashes(data, start, end)
    size = (end - start).astype(U64)
    marks = size * U64(0x9E3779B97F4A7C15)
    for k in range(8):
        inside = start + k < end
        marks[inside] ^= data[start[inside] + k].astype(U64) << U64(8 * k)
    return keys, marks


def _encode_rows(shared):
    def run(batches):
        enc = Encoder(pickle.loads(shared.value))
        for b in batches:
            for at, data, off in chunks(b.column(1)):
                flat, bounds = enc.ids(data, off)
                yield pa.record_batch([b.column(0).slice(at, len(off) - 1).cast(pa.int64()), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))], names=["doc_id", "n_tokens", "ids"])

    return run


def _model_broadcast(df: DataFrame, model_path: str):
    """The model's tables for the executors, pickled plain values. The path may be local to the driver or one that Spark reads."""
    spark = df.sparkSession
    try:
        with open(model_path, "rb") as f:
            data = f.read()
    except OSError:
        data = bytes(spark.read.format("binaryFile").load(model_path).select("content").first()[0])
    return spark.sparkContext.broadcast(pickle.dumps(prepare(read_model(data))))


def encode(docs: DataFrame, model_path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens and ids for each row of docs."""
    picked = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return picked.mapInArrow(_encode_rows(_model_broadcast(docs, model_path)), "doc_id long, n_tokens long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text from doc_id and ids."""
    model = _model_broadcast(encoded, model_path)

    def run(batches):
        enc = Encoder(pickle.loads(model.value))
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([enc.decode(x or []) for x in b.column(1).to_pylist()], type=pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")

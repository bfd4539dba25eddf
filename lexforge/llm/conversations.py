"""Conversation structure repair (operator 11): weighted finite-state composition and a topological shortest path.

A conversation's turns are an input acceptor, a chain with a symbol a turn (role initial and fault). An edit transducer keeps,
reroles, deletes and inserts, each arc with a weight (cost, label); a role-grammar acceptor takes `(s?(ua)+)?`. The three are
composed lazily: only states (turn, grammar state) that a chain reaches are made. The shortest distance to the end is found in
reverse topological order over lexicographic weights: least cost, then ASCII-least label string. Strings are compared by rank: two
differ in their next labels or in the rank of what follows, so a state holds a cost and a rank and no string. A layer of states,
its costs less the least one, is one of a small set, and each (layer, symbol) is worked out once.

Identical turns are summed before they are shuffled, and first occurrences are partial sums. A conversation's symbols (a byte a turn)
meet in one place, as its audit is one value; its texts don't: they stream, in order, through the running hash.

Defined results: a null role or text counts as one space, so such a text is blank; null turns come first; turns that share a
number are taken by role, then by their text's SHA-256, and identical ones are copies of the first; a null conv_id is a conversation
of its own; a conversation may have 2^31 edits, as its audit is one string; an empty table gives no rows; very long texts are read
whole; extra columns aren't read. A conversation that damage has emptied keeps its row: zeros, an empty audit, the hash of no bytes.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .joins import ref, skew_left_join
from .text import SPACE

OK, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = "sua"
ROLES = {"u": b"user", "a": b"assistant"}
#: (cost, label) of the edits; what an undeleted truncated turn adds.
KEEP, REROLE, DELETE, INSERT, SHORT = (0, "K"), (3, "R"), (4, "D"), (3, "I"), 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role grammar: state -> {role initial: next state}; the states where a conversation may end.
GRAMMAR = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
FINAL = (START, ASSISTANT)
LEGAL = ("su", "ua", "au")
DECIDED = "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def edits(initial: str, fault: int) -> list[tuple[int, str, str]]:
    """(cost, label, output; empty for a deletion) of the transducer's arcs for one turn."""
    out = [(*DELETE, "")]
    if fault in (OK, TRUNCATED):
        more = SHORT if fault == TRUNCATED else 0
        out += [(KEEP[0] + more, KEEP[1], initial), *((REROLE[0] + more, REROLE[1], role) for role in ROLES)]
    return out


class Composition:
    """The composed machine's layers, made as they are met.

    A layer gives each grammar state (cost above the layer's least, rank of its label string); `step[layer, symbol]` is the layer before
    a turn: its number, the least cost, and for each state (labels up to the turn's own, grammar state after it).
    """

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.layers: list[tuple] = []
        self.step: dict[tuple[int, int], tuple] = {}
        self.steps: list[tuple] = []
        self.end = self._before({s: (0, (), ("", s)) for s in FINAL})

    def _before(self, best: dict[int, tuple]) -> tuple[int, int, list]:
        """Insertions before what `best` says of each state: (cost, key, (labels, next state)). Two in a row are enough, as a
        third leads to a state that was there. A key orders label strings: labels, then the rank of what follows."""
        full = []
        for s in GRAMMAR:
            found, at, cost, labels = [], s, 0, ()
            for _ in range(3):
                if at in best:
                    c, key, (after, then) = best[at]
                    found.append((cost + c, (*labels, *key), ("".join(labels) + after, then)))
                at = next(t for role, t in GRAMMAR[at].items() if role in ROLES)
                cost, labels = cost + INSERT[0], (*labels, INSERT[1])
            full.append(min(found, key=lambda x: x[:2]))
        least, keys = min(c for c, _, _ in full), sorted({k for _, k, _ in full})
        layer = tuple((c - least, keys.index(k)) for c, k, _ in full)
        if layer not in self.number:
            self.number[layer] = len(self.layers)
            self.layers.append(layer)
        return self.number[layer], least, [choice for _, _, choice in full]

    def before(self, layer: int, symbol: int) -> int:
        """The number of the step that takes a turn before `layer`."""
        if (layer, symbol) not in self.step:
            after, best = self.layers[layer], {}
            for s, arcs in GRAMMAR.items():
                found = []
                for cost, label, out in edits("suao"[symbol // 4], symbol % 4):
                    then = s if not out else arcs.get(out)
                    if then is not None:
                        found.append((cost + after[then][0], (label, after[then][1]), (label, then)))
                best[s] = min(found, key=lambda x: x[:2])
            self.step[layer, symbol] = len(self.steps)
            self.steps.append(self._before(best))
        return self.step[layer, symbol]

    def shortest(self, symbols: bytes) -> tuple[int, str]:
        """(least cost, audit) of a conversation: distances from the last turn to the first, then the path from the start."""
        layer, cost, _ = self.end
        back = array("L")
        for symbol in reversed(symbols):
            back.append(k := self.before(layer, symbol))
            layer, least, _ = self.steps[k]
            cost += least
        cost += self.layers[layer][START][0]
        state, labels = START, []
        for k in reversed(back):
            some, state = self.steps[k][2][state]
            labels.append(some)
        return cost, "".join(labels) + self.end[2][state][0]


def illegal_pairs(symbols: bytes) -> int:
    """Adjacent turns whose role initials aren't su, ua or au."""
    role = np.frombuffer(symbols, dtype=np.uint8) // 4
    legal = np.zeros((4, 4), dtype=bool)
    for a, b in LEGAL:
        legal[INITIALS.index(a), INITIALS.index(b)] = True
    return int((~legal[role[:-1], role[1:]]).sum())


class Repaired:
    """The hash of a repaired conversation, turn by turn."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.hash, self.any = audit, 0, START, hashlib.sha256(), False

    def _emit(self, role: bytes, text: bytes) -> None:
        self.hash.update((b"\n" if self.any else b"") + role + b":")
        self.hash.update(text)
        self.any = True
        self.state = GRAMMAR[self.state][role[:1].decode()]

    def _expected(self) -> bytes:
        return next(ROLES[r] for r in GRAMMAR[self.state] if r in ROLES)

    def _insertions(self) -> None:
        while self.audit[self.at : self.at + 1] == INSERT[1]:
            self._emit(self._expected(), b"")
            self.at += 1

    def turn(self, role: bytes, text: bytes, copies: int) -> None:
        for _ in range(copies):
            self._insertions()
            label = self.audit[self.at]
            self.at += 1
            if label != DELETE[1]:
                self._emit(role if label == KEEP[1] else self._expected(), text)

    def hexdigest(self) -> str:
        self._insertions()
        return self.hash.hexdigest()


def damaged(rows: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text and m (times the turn stands there, adjacent) of the rows that damage leaves."""
    blank = F.lit(" ")
    part = lambda c: F.coalesce(ref(c).cast("string"), blank)
    d = F.crc32(F.concat(part(id_col), F.lit(":"), part(turn)).cast("binary")) % 20
    words = part(text)
    out = rows.select(
        ref(id_col).cast("long").alias("conv_id"), ref(turn).cast("long").alias("turn"), F.when(d == 4, F.lit("user")).otherwise(part(role)).alias("role"),
        F.when(d == 1, F.lit("")).when(d == 2, F.regexp_replace(words, "[.!?]", "")).otherwise(words).alias("text"),
        F.when(d == 0, 0).when(d == 3, 2).otherwise(1).alias("m"),
    )
    return out.filter("m > 0")


def _fault(text: Column) -> Column:
    """The fault that a text shows by itself."""
    return F.when(~text.rlike(r"[^\x20\x09-\x0D]"), BLANK).when(~text.rlike(rf"[.!?](?:{SPACE})?\z"), TRUNCATED).otherwise(OK)


ORDER = (F.asc_nulls_first, "conv_id"), (F.asc_nulls_first, "turn"), (F.asc, "role"), (F.asc, "hash")


def _in_order(extra=()) -> list[Column]:
    first, *rest = [way(c) for way, c in ORDER]
    return [first, *extra, *rest]


def _runs(ids: pa.Array):
    """(first, end) of each run of equal ids, nulls being equal."""
    value, null = np.asarray(ids.fill_null(0)), np.asarray(ids.is_null())
    edge = np.flatnonzero((value[1:] != value[:-1]) | (null[1:] != null[:-1])) + 1
    at = [0, *edge.tolist(), len(value)]
    return zip(at[:-1], at[1:], strict=True)


def decisions(turns: DataFrame) -> DataFrame:
    """conv_id, fault counts, illegal pairs, cost and audit of each conversation.

    turns: conv_id, turn, role, hash, symbol, m; pieces of ordered turns become byte strings before a conversation's meet.
    """

    def pieces(batches):
        for b in batches:
            symbol, m = np.asarray(b.column("symbol"), dtype=np.uint8), np.asarray(b.column("m"))
            for i, j in _runs(b.column("conv_id")) if b.num_rows else ():
                if m[i:j].max() == 1:
                    made = symbol[i:j].tobytes()
                else:
                    again = np.repeat(symbol[i:j], m[i:j])
                    copy = np.ones(len(again), dtype=bool)
                    copy[np.cumsum(m[i:j]) - m[i:j]] = False
                    made = np.where(copy & (again % 4 != BLANK), again // 4 * 4 + DUPLICATE, again).astype(np.uint8).tobytes()
                yield pa.record_batch([*(b.column(c).slice(i, 1) for c in ("conv_id", "turn", "role", "hash")), pa.array([made], pa.binary())], names=["conv_id", "turn", "role", "hash", "symbols"])

    def solve(batches):
        machine, own, held = Composition(), None, []

        def row():
            symbols = b"".join(held)
            cost, audit = machine.shortest(symbols)
            faults = np.bincount(np.frombuffer(symbols, dtype=np.uint8) % 4, minlength=4).tolist()
            return (own[0], faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], illegal_pairs(symbols), cost, audit)

        def table(rows):
            return pa.record_batch([pa.array(c, pa.string() if i == 6 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names=["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

        for b in batches:
            rows = []
            for name, symbols in zip(b.column("conv_id").to_pylist(), b.column("symbols").to_pylist(), strict=True):
                if own is not None and own[0] != name:
                    rows.append(row())
                    held.clear()
                own = (name,)
                held.append(symbols)
            if rows:
                yield table(rows)
        if own is not None:
            yield table([row()])

    parts = turns.repartitionByRange(*_in_order()).sortWithinPartitions(*_in_order())
    made = parts.mapInArrow(pieces, "conv_id long, turn long, role string, hash binary, symbols binary")
    return made.repartition("conv_id").sortWithinPartitions(*_in_order()).mapInArrow(solve, DECIDED)


def _streamed(batches):
    """Rows of each conversation in order: one that it exists (kind 0), its gaps (1), its decision (2), its turns (3)."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    zeros = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": ""}
    own, told, hashed = None, dict(zeros), Repaired("")

    def table(rows):
        kind = lambda c: pa.string() if c in ("audit", "repaired_sha256") else pa.int64()
        return pa.record_batch([pa.array([r[c] for r in rows], kind(c)) for c in names], names=names)

    def row():
        return told | {"conv_id": own[0], "repaired_sha256": hashed.hexdigest()}

    for b in batches:
        done = []
        kinds, roles, texts, copies = (b.column(c).to_pylist() for c in ("kind", "role", "text", "m"))
        for i, name in enumerate(b.column("conv_id").to_pylist()):
            if own is None or own[0] != name:
                if own is not None:
                    done.append(row())
                own, told, hashed = (name,), dict(zeros), Repaired("")
            if kinds[i] == 3:
                hashed.turn(roles[i], texts[i], copies[i])
            elif kinds[i] == 2:
                told |= {c: b.column(c)[i].as_py() for c in zeros if c != "gaps"}
                hashed = Repaired(told["audit"])
            elif kinds[i] == 1:
                told["gaps"] = b.column("gaps")[i].as_py()
        if done:
            yield table(done)
    if own is not None:
        yield table([row()])


def repair(rows: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation of `rows`, which are taken as they stand: see SCHEMA."""
    return _repair(rows, rows, id_col, turn, role, text)


def repair_damaged(rows: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`repair` of the rows after damage, with a row for each conversation there was before."""
    return _repair(damaged(rows, id_col, turn, role, text), rows, "conv_id", "turn", "role", "text", id_col)


def _repair(rows: DataFrame, every: DataFrame, id_col: str, turn: str, role: str, text: str, every_id: str | None = None) -> DataFrame:
    spark = rows.sparkSession
    blank = F.lit(" ")
    plain = rows.select(
        ref(id_col).cast("long").alias("conv_id"), ref(turn).cast("long").alias("turn"), F.coalesce(ref(role).cast("string"), blank).alias("role"),
        F.coalesce(ref(text).cast("string"), blank).alias("text"), (F.col("m") if rows is not every else F.lit(1)).cast("long").alias("m"),
    )
    with Scratch(spark) as scratch:
        summed = plain.groupBy("conv_id", "turn", "role", "text").agg(F.sum("m").alias("m"))
        h = F.unhex(F.sha2(F.col("text"), 256))
        turns = scratch.write(summed.withColumn("hash", h).withColumn("fault", _fault(F.col("text"))), "turns")
        owner = F.concat_ws("|", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role").cast("string"), F.col("role"), F.hex("hash"))
        thin = turns.select("conv_id", "turn", "role", "hash", "m", "fault", F.unhex(F.sha2(owner, 256)).alias("same"))
        again = thin.groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("turn").isNull()).alias("unnumbered"), F.min("turn").alias("first")).filter("n > 1")
        known = skew_left_join(thin, scratch.write(again, "again"), "same", "n", turns.count())
        later = F.col("turn").isNotNull() & F.col("n").isNotNull() & (F.col("unnumbered") | (F.col("turn") > F.col("first")))
        fault = F.when(F.col("fault") == BLANK, BLANK).when(later, DUPLICATE).otherwise(F.col("fault"))
        initial = F.left("role", F.lit(1))
        code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
        decided = scratch.write(decisions(known.select("conv_id", "turn", "role", "hash", (code * 4 + fault).cast("int").alias("symbol"), "m")), "decided")
        # distinct turns by a sum of their own: a hot conversation meets as one row a task
        numbers = turns.filter("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(F.count("one").alias("k"), F.min("turn").alias("least"), F.max("turn").alias("most"))
        wide = lambda c: F.col(c).cast("decimal(38,0)")
        gaps = numbers.select("conv_id", F.least(wide("most") - wide("least") + 1 - wide("k"), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long").alias("gaps"))
        exist = every.select(ref(every_id or id_col).cast("long").alias("conv_id")).distinct()
        kind = lambda df, k: df.withColumn("kind", F.lit(k))
        together = kind(exist, 0)
        for more in (kind(gaps, 1), kind(decided, 2), kind(turns.select("conv_id", "turn", F.col("role"), "hash", F.col("text"), "m"), 3)):
            together = together.unionByName(more, allowMissingColumns=True)
        ordered = together.repartition("conv_id").sortWithinPartitions(*_in_order([F.asc("kind")]))
        return scratch.keep(ordered.withColumns({"role": F.col("role").cast("binary"), "text": F.col("text").cast("binary")}).mapInArrow(_streamed, SCHEMA), "repaired")

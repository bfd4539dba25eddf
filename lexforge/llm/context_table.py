"""Context-tree weighting with every context that was seen, in a table cut by context.

A gram is one number: the byte before the coded one on top, then the one before that and so on for `depth` bytes, and the
coded byte lowest. So sorted grams have equal contexts side by side at every depth. Grams whose SPLIT nearest bytes are
equal share a bucket, so a bucket holds whole subtrees from depth SPLIT on; the contexts above (at most 65,793 at SPLIT 3,
however much is read) are joined on the driver. A byte is eight binary nodes; a node that training hasn't seen has counts
0, estimate one half and weight one, so that it may be held or left out without a difference.
"""

from __future__ import annotations

import numpy as np

from .bytesnp import _mix
from .estimates import KT

SPLIT = 3
BUCKETS = 512
PIECE = 400_000


def bucket(grams: np.ndarray, depth: int) -> np.ndarray:
    return (_mix((grams >> 8 * (depth + 1 - min(SPLIT, depth))) + 1) % np.uint64(BUCKETS)).astype(np.int32)


def sum_runs(keys: np.ndarray, *values: np.ndarray):
    """Distinct keys in order with their values' sums; quick where keys come in sorted runs."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], *(np.add.reduceat(v[order], starts) for v in values)


class Nodes:
    """The nodes of bit k at one depth, of sorted entries (context << 8 | byte) with counts: counts, the first entry of
    each, and the node of each entry."""

    def __init__(self, entries: np.ndarray, n: np.ndarray, k: int):
        pre = entries >> (8 - k)
        new = np.concatenate([[True], pre[1:] != pre[:-1]])
        self.first = np.flatnonzero(new)
        self.of = np.cumsum(new) - 1
        total = np.add.reduceat(n, self.first)
        self.n1 = np.add.reduceat(n * (entries >> (7 - k) & 1), self.first)
        self.n0 = total - self.n1
        #: (context << 8 | node number) of each.
        self.key = (entries[self.first] >> 8) << 8 | (1 << k) - 1 + (pre[self.first] & (1 << k) - 1)


class Subtrees:
    """Weighed contexts of depths SPLIT to depth of sorted, distinct grams; grams with count 0 are asked for only."""

    def __init__(self, grams: np.ndarray, n: np.ndarray, depth: int, kt: KT):
        self.depths = range(SPLIT, depth + 1)
        self.bits = grams & 255
        self.nodes: list[list[Nodes]] = []  # by depth, then bit
        self.at: list[list[np.ndarray]] = []  # node of each gram
        for d in self.depths:
            entries = (grams >> 8 * (depth - d + 1)) << 8 | self.bits
            order = np.argsort(entries, kind="stable")
            sorted_, counts = entries[order], n[order]
            row, at = [], []
            for k in range(8):
                x = Nodes(sorted_, counts, k)
                place = np.empty(len(grams), np.int32)
                place[order] = x.of
                x.first, x.of = order[x.first], None
                row.append(x)
                at.append(place)
            self.nodes.append(row)
            self.at.append(at)
        for k in range(8):
            weighted = None
            for i in range(len(self.nodes) - 1, -1, -1):
                x = self.nodes[i][k]
                own = kt.log(x.n0, x.n1)
                if weighted is None:
                    x.share, weighted = None, own
                else:
                    child = self.nodes[i + 1][k]
                    below = np.bincount(self.at[i][k][child.first], weights=weighted, minlength=len(own))
                    x.share = 1 / (1 + np.exp(-np.clip(own - below, -60, 60)))
                    weighted = np.logaddexp(own, below) - np.log(2)
            self.nodes[0][k].weighted = weighted

    def rows(self):
        """(parent node's key, sum of weighted) for the depth above SPLIT."""
        every = [(_parent(x.key), x.weighted) for x in self.nodes[0]]
        return sum_runs(np.concatenate([k for k, _ in every]), np.concatenate([w for _, w in every]))

    def logs(self, upper: list[tuple]) -> np.ndarray:
        """Natural log of the probability of each gram's byte after its context, as float32."""
        p = np.ones(len(self.bits))
        for k in range(8):
            given = carry = None
            for i, d in enumerate(self.depths):
                x = self.nodes[i][k]
                if i:
                    up = self.at[i - 1][k][x.first]
                    given, carry = given[up], carry[up]
                else:
                    given, carry = above(upper, x.key)
                estimate = (x.n1 + 0.5) / (x.n0 + x.n1 + 1.0)
                if x.share is None:
                    given = given + carry * estimate
                else:
                    given, carry = given + carry * x.share * estimate, carry * (1 - x.share)
            one = np.clip(given, 1e-12, 1 - 1e-12)[self.at[-1][k]]
            p *= np.where(self.bits >> (7 - k) & 1, one, 1 - one)
        return np.log(p).astype(np.float32)


def _parent(key: np.ndarray) -> np.ndarray:
    """The key of the same node in the context of one byte less: contexts have their nearest byte on top."""
    return (key >> 16) << 8 | key & 255


def above(upper: list[tuple], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(given, carry) of the parents of nodes at depth SPLIT (or len(upper)), from spread levels (keys, given, carry)."""
    given, carry = np.zeros(len(key)), np.ones(len(key))
    for d, (keys, g, c) in enumerate(upper):
        asked = key >> 8
        own = (asked >> 8 * (len(upper) - d)) << 8 | key & 255
        at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
        hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
        given, carry = np.where(hit, g[at] if len(keys) else 0, given + 0.25 * carry), np.where(hit, c[at] if len(keys) else 0, 0.5 * carry)
    return given, carry


def top(grams: np.ndarray, n: np.ndarray, below: tuple[np.ndarray, np.ndarray]) -> list[tuple]:
    """Spread levels (keys, given, carry) above SPLIT, from grams of SPLIT - 1 context bytes and the byte, and the sums of
    the subtrees' weighted logs by node."""
    kt, levels = KT(), []
    for d in range(SPLIT):
        entries, counts = sum_runs((grams >> 8 * (SPLIT - d)) << 8 | grams & 255, n)
        parts = [Nodes(entries, counts, k) for k in range(8)] if len(entries) else []
        keys, n0, n1 = (np.concatenate([getattr(x, c) for x in parts]) if parts else np.zeros(0, np.int64) for c in ("key", "n0", "n1"))
        order = np.argsort(keys)
        levels.append((keys[order], n0[order], n1[order]))
    shares = []
    for d in range(SPLIT - 1, -1, -1):
        keys, n0, n1 = levels[d]
        own = kt.log(n0, n1)
        under = np.bincount(np.searchsorted(keys, below[0]), weights=below[1], minlength=len(keys)) if len(keys) else np.zeros(0)
        shares.append(1 / (1 + np.exp(-np.clip(own - under, -60, 60))))
        weighted = np.logaddexp(own, under) - np.log(2)
        below = sum_runs(_parent(keys), weighted)
    out = []
    for d, share in enumerate(reversed(shares)):
        keys, n0, n1 = levels[d]
        given, carry = above(out, keys) if d else (np.zeros(len(keys)), np.ones(len(keys)))
        estimate = (n1 + 0.5) / (n0 + n1 + 1.0)
        out.append((keys, given + carry * share * estimate, carry * (1 - share)))
    return out


def pieces(grams: np.ndarray, depth: int):
    """Slices of about PIECE sorted grams that cut no subtree."""
    edges = np.flatnonzero(np.diff(grams >> 8 * (depth + 1 - SPLIT))) + 1
    a = 0
    while a < len(grams):
        later = np.searchsorted(edges, a + PIECE)
        b = int(edges[later]) if later < len(edges) else len(grams)
        yield slice(a, b)
        a = b

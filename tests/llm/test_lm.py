"""LM scoring against context-tree weighting and add-one counts in plain loops."""

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from lexforge.llm import lm_scoring
from lexforge.llm.context_table import Subtrees, sum_runs
from lexforge.llm.estimates import KT, log_kt

from fixtures import SCHEMA, corpus, low, words


def stream(text, depth):
    return b"\n" * depth + "".join(w + " " for w in words(low(text))).encode() + b"\n"


class Plain:
    """Weighted probabilities by recursion over dictionaries: counts[node][context] = [zeros, ones]."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for t in texts:
            s = stream(t, depth)
            for i in range(depth, len(s)):
                for node, bit in self.bits(s[i]):
                    for d in range(depth + 1):
                        context = s[i - d : i]
                        self.counts[node, context][bit] += 1
                        if d:
                            self.children[node, context[1:]].add(context)
        self.memo = {}

    @staticmethod
    def bits(byte):
        return [((k, byte >> (8 - k)), byte >> (7 - k) & 1) for k in range(8)]

    def kt(self, n0, n1):
        return math.lgamma(n0 + 0.5) + math.lgamma(n1 + 0.5) - math.lgamma(n0 + n1 + 1) - math.log(math.pi)

    def weighted(self, node, context):
        if (node, context) not in self.memo:
            own = self.kt(*self.counts.get((node, context), (0, 0)))
            if len(context) < self.depth:
                below = sum(self.weighted(node, c) for c in sorted(self.children.get((node, context), ())))
                own = np.logaddexp(own, below) - math.log(2)
            self.memo[node, context] = own
        return self.memo[node, context]

    def log_bit(self, node, history, bit):
        """Log of the weighted probability with the bit less that without it: only the path changes."""
        change = None
        for d in range(self.depth, -1, -1):
            context = history[len(history) - d :]
            n = list(self.counts.get((node, context), (0, 0)))
            n[bit] += 1
            own, old = self.kt(*n), self.weighted(node, context)
            if d < self.depth:
                below = sum(self.weighted(node, c) for c in sorted(self.children.get((node, context), ()))) + change
                own = np.logaddexp(own, below) - math.log(2)
            change = own - old
        return change

    def score(self, text):
        s = stream(text, self.depth)
        return sum(self.log_bit(node, s[i - self.depth : i], bit) for i in range(self.depth, len(s)) for node, bit in self.bits(s[i])) / math.log(10)


def test_scores_equal_plain_context_tree_weighting(spark):
    rows = [(1, "the cat sat on the mat the cat", True), (2, "a cat é 中 sat", True), (3, "the bat sat on a cat quux", False), (4, "", True), (5, None, False), (6, "The CAT sat", False)]
    plain = Plain([t or "" for _, t, y in rows if y], 4)
    df = spark.createDataFrame(rows, "doc_id long, text string, y boolean")
    got = {r["doc_id"]: r for r in lm_scoring.score(df.repartition(3), F.col("y"), depth=4).collect()}
    for i, t, _ in rows:
        want = plain.score(t or "")
        assert abs(got[i]["score"] - want) < 1e-4 * max(1, -want)
        assert got[i]["n_bytes"] == len(stream(t or "", 4)) - 4


def test_base_and_counts(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, F.col("doc_id") % 3 != 0).collect()}
    toks = {r[0]: words(low(r[1])) + ["\n"] for r in corpus()}
    count = Counter(w for i, t in toks.items() if i % 3 for w in t)
    total = sum(count.values())
    for i, t in toks.items():
        base = sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in t)
        assert abs(got[i]["base_score"] - base) < 1e-6 * max(1, -base)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(t), sum(count[w] > 0 for w in t), total)


def test_bytes_after_a_context_sum_to_one():
    rng = np.random.default_rng(5)
    seen, n = sum_runs(rng.integers(97, 101, 3000) << 24 | rng.integers(97, 101, 3000) << 16 | rng.integers(97, 101, 3000) << 8 | rng.integers(97, 103, 3000), np.ones(3000, np.int64))
    context = int(seen[7]) >> 8 << 8
    asked, m = sum_runs(np.concatenate([seen, context + np.arange(256)]), np.concatenate([n, np.zeros(256, np.int64)]))
    logs = Subtrees(asked, m, 3, KT()).logs([(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))] * 3)
    assert abs(np.exp(logs[asked >> 8 == context >> 8].astype(float)).sum() - 1) < 1e-5


def test_estimate_of_large_counts():
    want = [math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for a, b in ((0, 0), (3, 9), (20000, 5), (70000, 90000))]
    assert np.allclose(log_kt(np.array([0, 3, 20000, 70000]), np.array([0, 9, 5, 90000])), want, rtol=1e-10)


def test_a_rare_source_keeps_its_contexts(spark):
    """However much text another source adds."""
    rare = [(i, "zyx qwv zyx kjh", True) for i in range(3)]
    hot = [(10 + i, "the same line again " * 800, True) for i in range(60)]
    of = lambda rows: {r["doc_id"]: r["score"] for r in lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string, t boolean"), F.col("t")).collect()}
    alone, mixed = of(rare), of([*rare, *hot])
    assert mixed[0] > 1.6 * alone[0]

"""Operators on small fixtures: brute force, exact round trips, models in plain loops."""

import hashlib
import html
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexforge.llm import exact_dedup, html_extract, jaccard_join, language_id, mixing, packing, quality_rules, sentencepiece_np, toxicity
from lexforge.llm.bytesnp import Lookup, chunks
from lexforge.session import Scratch

from fixtures import SCHEMA, components_by_force, corpus, low, words

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


# Jaccard join


def joined(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect()), key=repr)


def test_jaccard_join_equals_brute_force(docs):
    assert joined(docs) == sorted(components_by_force([(r[0], r[1]) for r in corpus()]), key=repr)


def test_jaccard_join_of_large_groups(spark):
    """Lists over LONG: near copies of one text, and short texts around one passage."""
    rng = random.Random(2)
    vocab = ["v%d" % i for i in range(5000)]
    base, passage = [rng.choice(vocab) for _ in range(60)], [rng.choice(vocab) for _ in range(50)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = rng.choice(vocab)
        rows.append((i, " ".join(w)))
    for i in range(120, 200):
        rows.append((i, " ".join([rng.choice(vocab) for _ in range(rng.randint(0, 12))] + passage)))
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(components_by_force(rows), key=repr)


def test_jaccard_join_of_null_and_repeated_ids(spark):
    rng = random.Random(8)
    text = lambda: " ".join("u%d" % rng.randrange(900) for _ in range(30))
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a), (2, b), (2, c), (3, c), (None, a), (None, d), (None, d), (1 << 60, d + " x"), ((1 << 60) + 1, b), (9, None), (9, "")]
    assert joined(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(components_by_force(rows), key=repr)


def test_jaccard_lists_settle_block_by_block(monkeypatch):
    """Lists are the same however little a task holds at a time."""
    rng = np.random.default_rng(1)
    sig, doc = rng.integers(0, 40, 4000).astype(np.uint64) << np.uint64(50), rng.integers(0, 3000, 4000)
    found = []
    for block in (100, 1 << 20):
        monkeypatch.setattr(jaccard_join, "BLOCK", block)
        packed = [jaccard_join._packed(sig[a : a + 50], doc[a : a + 50], 8, 6) for a in range(0, 4000, 50)]
        rows = [r for b in jaccard_join._meet(iter(packed)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        found.append(sorted({r[:3] for r in rows if r[0] == 1}))
    lists = {s: sorted(set(doc[sig == s].tolist())) for s in set(sig.tolist())}
    assert found[0] == found[1] == sorted((1, int(np.uint64(s).astype(np.int64)), d) for s, ds in lists.items() if len(ds) > jaccard_join.LONG for d in ds)


def test_too_few_segments_take_another_seed(docs, monkeypatch):
    real = jaccard_join.signatures
    monkeypatch.setattr(jaccard_join, "signatures", lambda s, edges, seed=0: None if seed == 0 and len(s) % 7 == 0 else real(s, edges, seed))
    assert joined(docs) == sorted(components_by_force([(r[0], r[1]) for r in corpus()]), key=repr)


# Exact dedup, quality rules


def test_exact_dedup(spark, docs):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    got = {r["doc_id"]: r for r in exact_dedup.dedup(docs, index).collect()}
    groups = {}
    for r in corpus():
        groups.setdefault(low(r[1]), []).append(r[0])
    for t, members in groups.items():
        for i in members:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(members), len(members), i == max(members))
            assert bytes(got[i]["digest"]).hex() == hashlib.sha256(t.encode()).hexdigest()
    again = exact_dedup.dedup(docs.filter("doc_id < 50"), index)
    assert again.filter("kept").count() == 0
    index.drop()


def test_a_batch_that_runs_again_keeps_its_rows(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b"), (4, "c")], "doc_id long, text string")
    rows = lambda df: sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect())
    first = rows(exact_dedup.dedup(docs, exact_dedup.DigestIndex(spark, path, 3), batch="b1"))
    assert first == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True), (4, 4, 1, True)]
    spark.conf.set("spark.sql.shuffle.partitions", "7")  # another setting doesn't change the index
    try:
        index = exact_dedup.DigestIndex(spark, path)
        assert index.buckets == 3
        assert rows(exact_dedup.dedup(docs, index, batch="b1")) == first
        assert index.read().count() == 3
        later = spark.createDataFrame([(9, "B"), (8, "d")], "doc_id long, text string")
        assert rows(exact_dedup.dedup(later, index, batch="b2")) == [(8, 8, 1, True), (9, 3, 1, False)]
        assert rows(exact_dedup.dedup(docs, index)) == [(i, k, n, False) for i, k, n, _ in first]  # other rows, all known
        index.close()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path, 4)


def test_a_batch_of_which_a_part_was_appended(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i % 7}") for i in range(30)], "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", 2)
    whole = exact_dedup.DigestIndex(spark)
    want = sorted(map(tuple, exact_dedup.dedup(docs, whole, batch="b").select("doc_id", "keep_id", "group_size", "kept").collect()))
    index.append(whole.read().filter("keep_id % 2 = 0"))
    whole.drop()
    got = exact_dedup.dedup(docs, index, batch="b").select("doc_id", "keep_id", "group_size", "kept").collect()
    assert sorted(map(tuple, got)) == want and index.read().count() == 7


def plain_counts(t):
    t = t or ""
    w = words(t)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    stop = {y for x in quality_rules.STOP_WORDS for y in (x, x.capitalize())}
    m = {"n_words": len(w), "word_chars": sum(map(len, w)), "n_repeat_words": len(covered), "n_dup_lines": len(lines) - len(set(lines)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t))}
    ratio = lambda a, b: a / b if b else 0.0
    r = {
        "n_words": len(w),
        "mean_word_chars": ratio(m["word_chars"], len(w)),
        "symbol_ratio": ratio(m["n_symbols"], m["word_chars"]),
        "capital_ratio": ratio(len(re.findall("[A-Z]", t)), m["word_chars"]),
        "stop_ratio": ratio(sum(x in stop for x in w), len(w)),
        "dup_line_ratio": ratio(m["n_dup_lines"], len(lines)),
        "bullet_ratio": ratio(sum(bool(re.match(r"[\x20\x09]*[-*•◦]", x)) for x in lines), len(lines)),
        "ellipsis_ratio": ratio(sum(bool(re.search(r"(?:\.\.\.|…)[\x20\x09\r]*$", x)) for x in lines), len(lines)),
    }
    m["base_failed"] = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    m["kept"] = not m["base_failed"] and all((lo is None or r[k] >= lo) and (hi is None or r[k] <= hi) for _, k, lo, hi in quality_rules.RULES)
    return m


def test_quality_rules_counts(spark, docs):
    extra = [(900, "a b c a b c x\nyy\n\nyy\n #* | <b> \n", "en", "s", 1, "x"), (901, "the a b " * 9000, "en", "s", 1, "x"), (902, "- the of A " * 30, "en", "s", 1, "x")]
    rows = quality_rules.annotate(docs.unionByName(spark.createDataFrame(extra, SCHEMA))).collect()
    texts = {r[0]: r[1] for r in [*corpus(), *extra]}
    for r in rows:
        want = plain_counts(texts[r["doc_id"]])
        assert {k: r["quality"][k] for k in want} == want
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_quality_rules_plan_has_no_user_function(docs):
    plan = quality_rules.keep_good(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    # The verdict isn't pushed below the projection that makes the arrays: words are split once.
    assert plan.count("split(") <= 4


# Mixing


def plain_targets(sizes, weights=(3, 1, 2)):
    """{source: target}; sources in code-point order, null last."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, budget = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in target]
        left = budget - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        above = [s for s in free if share[s] > 2 * sizes[s]]
        if not above:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in above}
        if len(target) == len(order):
            return target


def test_mix_meets_targets(docs):
    rows = mixing.mix(docs).collect()
    source, size = {r[0]: r[3] for r in corpus()}, {r[0]: len(words(r[1])) for r in corpus()}
    totals = Counter()
    for i, s in source.items():
        totals[s] += size[i]
    want = plain_targets(totals)
    taken = Counter()
    for r in rows:
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], totals[source[r["doc_id"]]])
        assert abs(r["target"] - want[source[r["doc_id"]]]) < 1e-6 * max(1, r["target"])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    assert len(rows) == len(size)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(tuple, mixing.mix(docs.repartition(5)).collect())) == sorted(map(tuple, rows))


def test_level_over_many_sources(spark):
    rng = random.Random(4)
    sizes = {"s%03d" % i: rng.choice([0, 1, 5, 40, 900]) for i in range(200)}
    want = plain_targets(sizes)
    with Scratch(spark) as scratch:
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "src string, source_size long"), scratch).collect()
    assert all(abs(r["target"] - want[r["src"]]) < 1e-6 * max(1, want[r["src"]]) for r in got) and len(got) == 200


def test_fit_comes_as_near_as_any_subset():
    rng = random.Random(7)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(3, 60), rng.randint(1, 5))))
        counts = np.array([rng.randint(0, 4) for _ in lengths])
        budget = rng.randint(0, int((lengths * counts).sum()) + 3)
        best = max(s for c in itertools.product(*(range(k + 1) for k in counts)) if (s := int((lengths * c).sum())) <= budget)
        take = mixing.fit(lengths, counts, budget)
        assert (take <= counts).all() and (take >= 0).all() and int((lengths * take).sum()) == best


def test_fit_with_few_long_lengths():
    """Documents longer than the knapsack's reach: the greedy steps leave less than the shortest of them."""
    lengths, counts = np.array([90_000, 250_000, 700_000]), np.array([400, 300, 200])
    budget = int((lengths * counts).sum()) // 2 + 12_345
    take = mixing.fit(lengths, counts, budget)
    assert 0 <= budget - int((lengths * take).sum()) < 90_000 and (take <= counts).all()


# SentencePiece


def encoder():
    return sentencepiece_np.Encoder(sentencepiece_np.prepare(sentencepiece_np.read_model(open(MODEL, "rb").read())))


def test_sentencepiece_equals_library(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    enc = encoder()
    rng = random.Random(1)
    texts = ["", " ", "  a", "x▁y Å \x00z", "a" * 400, "中文字符" * 40, "the " * 90, "😀é", " " * 30 + "x", "▁ ▁▁x", "\n\t\n", "e" * 3000] + ["".join(rng.choice("ab cdeé \n\t中▁😀ing") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    texts += ["".join(rng.choice("etaoinsrhl ") for _ in range(rng.randint(0, 400))) for _ in range(500)]
    ids = enc.encode(texts)
    assert ids == sp.encode(texts)
    assert [enc.decode(x) for x in ids] == [sp.decode(x) for x in ids]
    got = sentencepiece_np.encode(docs, MODEL)
    back = {r["doc_id"]: r["text"] for r in sentencepiece_np.decode(got, MODEL).collect()}
    assert back == {r[0]: r[1] or "" for r in corpus()}


def test_words_of_all_lengths_take_one_viterbi_and_a_pair_is_worked_out_once(monkeypatch):
    import sentencepiece

    rng, calls, pairs = random.Random(2), [], []
    viterbi, apart = sentencepiece_np.Encoder._viterbi, sentencepiece_np.Encoder._apart
    monkeypatch.setattr(sentencepiece_np.Encoder, "_viterbi", lambda self, *a: calls.append(1) or viterbi(self, *a))
    monkeypatch.setattr(sentencepiece_np.Encoder, "_apart", lambda self, u, v: pairs.extend(zip(u.tolist(), v.tolist(), strict=True)) or apart(self, u, v))
    enc = encoder()
    batches = [["".join(rng.choice("etaoinsrhlé中") for _ in range(k)) for k in range(1, 40)] for _ in range(4)]
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert [enc.encode(x) for x in batches] == [sp.encode(x) for x in batches]
    assert len(calls) == len(batches)
    assert len(pairs) < 1.01 * len(set(pairs))  # two pairs may have one slot


def test_pairs_with_one_slot_are_told_apart(monkeypatch):
    texts = ["the reading of interesting strings", "singing rings", "the strings"] * 2
    plain = encoder().encode(texts)
    monkeypatch.setattr(sentencepiece_np, "PAIR_BITS", 1)
    enc = encoder()
    assert enc.encode(texts) == plain and enc.encode(texts[::-1]) == plain[::-1]


def test_models_of_merges_equal_plain_merges():
    rng = random.Random(4)
    for _ in range(20):
        pieces = ["▁", "a", "b", "c"]
        for _ in range(rng.randint(1, 25)):
            both = rng.choice(pieces) + rng.choice(pieces)
            if both not in pieces and "▁" not in both[1:] and len(both) < 9:
                pieces.append(both)
        m = sentencepiece_np.Model(pieces=["<unk>", *pieces], scores=[0.0, *(-float(k) for k in range(len(pieces)))], kinds=[2] + [1] * len(pieces), kind=2)
        enc = sentencepiece_np.Encoder(sentencepiece_np.prepare(m))

        def merged(word):
            row = list(word)
            while found := [(pieces.index(row[k] + row[k + 1]), k) for k in range(len(row) - 1) if row[k] + row[k + 1] in pieces]:
                _, k = min(found)
                row[k : k + 2] = [row[k] + row[k + 1]]
            return [1 + pieces.index(p) for p in row]

        texts = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 60))) for _ in range(60)]
        assert enc.encode(texts) == [merged("▁" + x) for x in texts]


def test_a_model_without_a_path_is_an_error():
    pieces = {"▁": -1.0, "a": -1.0, "b": -3.0, "bb": -2.0, "bba": -1.0, "aab": -1.0}  # bba's rank comes before that of bb, of which it is made
    m = sentencepiece_np.Model(pieces=["<unk>", *pieces], scores=[0.0, *pieces.values()], kinds=[2] + [1] * len(pieces), kind=2)
    enc = sentencepiece_np.Encoder(sentencepiece_np.prepare(m))
    for word in ("bbbba", "bbbba" * 12):
        with pytest.raises(ValueError, match="no path"):
            enc.encode([word])


def test_words_are_told_apart_where_hashes_agree(monkeypatch):
    plain, texts = encoder().encode(["alpha beta alphx", "beta gamma"]), ["alpha beta alphx", "beta gamma"]
    real = sentencepiece_np._word_hashes
    monkeypatch.setattr(sentencepiece_np, "_word_hashes", lambda *a: (real(*a)[0] % np.uint64(2), real(*a)[1]))
    enc = encoder()
    assert enc.encode(texts) == plain and enc.encode(texts[::-1]) == plain[::-1]


def test_unigram_viterbi_finds_the_best_path():
    pieces = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -2.2, "▁a": -3.5, "ba": -3.0, "▁ab": -9.0}
    m = sentencepiece_np.Model(pieces=["<unk>", *pieces], scores=[0.0, *pieces.values()], kinds=[2] + [1] * len(pieces), kind=1, dummy_prefix=True, squeeze=True)
    enc = sentencepiece_np.Encoder(sentencepiece_np.prepare(m))

    def best(word):
        out = {0: (0.0, [])}
        for j in range(1, len(word) + 1):
            out[j] = max((out[i][0] + pieces[word[i:j]], out[i][1] + [m.pieces.index(word[i:j])]) for i in range(j) if i in out and word[i:j] in pieces)
        return out[len(word)][0]

    for word in ("ab", "abba", "babab", "aabbaabb", "ab" * 40):
        assert abs(sum(m.scores[i] for i in enc.encode([word])[0]) - best("▁" + word)) < 1e-9
    assert enc.encode(["az", "  a   a "]) == [[5, 0], [5, 5]]


def test_equal_scores_go_to_the_longest_last_piece_at_every_length():
    pieces = {"▁": -1.0, "a": -2.0, "b": -2.5, "ab": -4.5}
    m = sentencepiece_np.Model(pieces=["<unk>", *pieces], scores=[0.0, *pieces.values()], kinds=[2] + [1] * len(pieces), kind=1, dummy_prefix=True, squeeze=True)
    enc = sentencepiece_np.Encoder(sentencepiece_np.prepare(m))
    for k in (1, 5, 20, 30, 60):
        assert enc.encode(["ab" * k]) == [[1] + [4] * k]


def test_lookup_equals_a_dictionary():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 62, 5000))
    table = Lookup(keys, np.arange(len(keys)))
    asked = np.concatenate([keys[::3], rng.integers(0, 1 << 62, 500)])
    value, found = table.find(asked)
    want = {int(k): i for i, k in enumerate(keys)}
    assert [(int(v), bool(f)) for v, f in zip(value, found, strict=True)] == [(want.get(int(k), 0), int(k) in want) for k in asked]
    assert not Lookup(keys[:0], keys[:0]).find(asked)[1].any()


# Packing


def test_packing_round_trip(docs):
    packed = packing.pack_documents(docs, RANKS, width=64, shard_tokens=5000)
    enc = packing._encoding(open(RANKS, "rb").read())
    back = {r["doc_id"]: r["ids"] for r in packing.unpack(packed).collect()}
    assert back == {r[0]: enc.encode_ordinary(r[1] or "") + [packing.END_ID] for r in corpus()}
    for r in packed.collect():
        assert len(r["ids"]) == len(r["positions"]) == 256 and r["cu_seqlens"][-1] == r["n_tokens"] <= 64


def test_pack_is_best_fit_decreasing():
    rng = random.Random(3)
    sizes = [rng.randint(1, 50) for _ in range(400)]
    rooms, want = [], []
    for i in sorted(range(400), key=lambda i: -sizes[i]):
        fits = [r for r in rooms if r >= sizes[i]]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - sizes[i])
        else:
            rooms.append(50 - sizes[i])
            want.append(i)
    assert len(packing.pack(sizes, 50)) == len(want)


# Toxicity


def plain_ratios(rows, discount, least):
    """{word: log ratio} in plain loops: the class is the history that backs off to what the discount takes from both."""
    by = [Counter(), Counter()]
    for text, y in rows:
        by[0 if y else 1].update(set(re.findall("[a-z]+", text.lower())))
    vocab = set(by[0]) | set(by[1])
    free = {w: min(by[0][w], discount) + min(by[1][w], discount) for w in vocab}
    weight = sum(free.values()) / (sum(by[0].values()) + sum(by[1].values()))
    p = []
    for counts in by:
        own = {w: max(counts[w] - discount, 0) for w in vocab}
        p.append({w: (1 - weight) * own[w] / sum(own.values()) + weight * free[w] / sum(free.values()) for w in vocab})
    ratio = {w: math.log(p[0][w] / p[1][w]) for w in vocab}
    return {w: math.copysign(max(abs(r) - least, 0), r) for w, r in ratio.items()}


def toxic_rows(n=200, seed=4):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice("alpha beta gamma delta rho".split()) for _ in range(40)) + (" vile scum vile" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(n)]


def test_kneser_ney_equals_plain_loops():
    rows = [(t, y) for _, t, y in toxic_rows(60)] + [("alpha omega once", 0), ("Once SIGMA vile", 1)]
    docs = []
    for _, data, off in chunks(pa.array([t for t, _ in rows])):
        w, p, first = toxicity.tokens(data, off)
        docs += [(w[a:b], p[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    for discount, least in ((0.75, 0.0), (2.0, 0.5)):
        model = toxicity.KneserNey(toxicity.Counts(docs, np.array([y for _, y in rows])), discount, least, order=1)
        want = plain_ratios(rows, discount, least)
        for (t, _), (w, p) in zip(rows, docs, strict=True):
            got = model.evidence(w, p, np.array([0, len(w)]))[0]
            each = [want[x] for x in re.findall("[a-z]+", t.lower())]
            assert abs(got - sum(each) / len(each)) < 1e-9


def test_toxicity_learns_words(spark):
    df = spark.createDataFrame(toxic_rows(), "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.filter("doc_id < 140").select("doc_id", "toxic"))
    more = spark.createDataFrame([(900, None, 0), (901, "", 0), (902, "12 — 34", 0)], df.schema)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df.unionByName(more), model).collect()}
    assert all((got[i] >= 0.7) == bool(y) for i, _, y in toxic_rows())
    assert got[900] == got[901] == got[902] <= 0.5


def test_words_are_letters():
    (_, data, off), = chunks(pa.array(["ÉTÉ “naïve” a1b·c × x", ""]))
    w, _, first = toxicity.tokens(data, off)
    (_, data, off), = chunks(pa.array(["été naïve a b c x"]))
    assert w.tolist() == toxicity.tokens(data, off)[0].tolist() and first.tolist() == [0, 6, 6]


# Language ID


def test_gradients_equal_differences():
    net = language_id.BiGRU.new(3, 4)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(97, 103, (6, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    _, grad = net.gradients(x, y)
    for k, g in grad.items():
        for _ in range(6):
            i = (int(rng.choice(x.ravel())) if k[0] == "x" else int(rng.integers(g.shape[0])), *(int(rng.integers(s)) for s in g.shape[1:]))
            net.w[k][i] += 1e-5
            up = net.gradients(x, y)[0]
            net.w[k][i] -= 2e-5
            down = net.gradients(x, y)[0]
            net.w[k][i] += 1e-5
            assert abs((up - down) / 2e-5 - g[i]) < 1e-7


def test_every_byte_is_pooled_once():
    """Windows equal the network run over each window with its context, byte by byte."""
    net = language_id.BiGRU.new(3, 4)
    rng = np.random.default_rng(2)
    texts = ["".join(chr(c) for c in rng.integers(97, 123, k)) for k in (0, 1, 111, 112, 113, 500)]
    (_, data, off), = chunks(pa.array(texts))
    got = language_id.pooled(net, data, off)
    for t, mean in zip(texts, got, strict=True):
        c, w, total = language_id.CONTEXT, language_id.WINDOW, np.zeros(3)
        whole = -(-len(t) // w) * w
        padded = np.frombuffer((" " * c + t + " " * (whole - len(t) + c)).encode(), np.uint8)
        for a in range(0, len(t), w):
            lp = net.log_probs(padded[a : a + w + 2 * c][:, None])[c : c + min(w, len(t) - a), 0]
            total += lp.sum(axis=0)
        assert np.allclose(mean, total / max(1, len(t)), atol=1e-4)


def test_language_id(spark):
    rng = random.Random(6)
    syll = {"xx": "tha ing er ou wh".split(), "yy": "ção ñe éu ll qua".split()}
    rows = [(i, " ".join("".join(rng.choice(syll[k]) for _ in range(rng.randint(1, 3))) for _ in range(12)), k) for i, k in enumerate(["xx", "yy"] * 80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df.filter("doc_id < 100"), steps=150)
    more = spark.createDataFrame([(900, None, None), (901, "12 34 !", None), (902, "", None), (903, "—…", None)], df.schema)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(df.unionByName(more), model).collect()}
    assert sum(got[i] == k for i, _, k in rows) >= 0.95 * len(rows)
    assert got[900] == got[901] == got[902] == got[903] == "und"


def test_many_languages_are_cut_to_the_most_frequent(spark, monkeypatch):
    from lexforge.llm import sampling

    monkeypatch.setattr(sampling, "MAX_CLASSES", 2)
    rows = [(i, "l%d" % (0 if i < 9 else 1 if i < 14 else i)) for i in range(20)]
    got = sampling.sample_ids(spark.createDataFrame(rows, "doc_id long, lang string"), "lang", 4)
    assert Counter(y for _, y in got) == {"l0": 4, "l1": 4}
    assert got == sampling.sample_ids(spark.createDataFrame(rows[::-1], "doc_id long, lang string").repartition(3), "lang", 4)


# HTML


@pytest.fixture(scope="module")
def html_model():
    return html_extract.train()


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    for _ in range(5):
        n = 7
        parent = np.array([-1] + [int(rng.integers(0, i)) for i in range(1, n)])
        depth = np.zeros(n, np.int64)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
        kind = rng.integers(0, html_extract.EDGE_KINDS, n)
        m = html_extract.TreeModel()
        m.w, m.edge = rng.standard_normal(html_extract.N_FEATURES), rng.standard_normal(m.edge.shape)
        x = rng.standard_normal((n, html_extract.N_FEATURES)) * 0.3
        weight = {}
        for y in itertools.product((0, 1), repeat=n):
            weight[y] = math.exp(sum((x[i] @ m.w) * y[i] + (m.edge[kind[i], y[parent[i]], y[i]] if i else 0) for i in range(n)))
        z = sum(weight.values())
        p, pair, log_z = m.marginals(x, parent, depth, kind)
        assert abs(log_z - math.log(z)) < 1e-9
        for i in range(n):
            assert abs(p[i] - sum(v for y, v in weight.items() if y[i]) / z) < 1e-9
            if i:
                assert abs(pair[i, 1, 0] - sum(v for y, v in weight.items() if y[parent[i]] and not y[i]) / z) < 1e-9


def test_html_text(html_model):
    page = '<html><head><title>t</title><script>x="<p>no</p>"</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><article><h1>Head &amp; line</h1><p>One  two<b>three</b><br>four.<p>Second\n block with some more words, as texts have.</article><div class="comments"><h3>Comments</h3><p>Nice one, thanks for it.</p></div><footer>&copy; site</footer></body></html>'
    assert html_extract.extract(html_model, [page, None, ""]) == ["Head & line One twothree four. Second block with some more words, as texts have.", "", ""]
    test = [html_extract.parse(p, True) for p in html_extract.labelled_pages(40, seed=77)]
    p, _, _ = html_model.marginals(*html_extract.features(test))
    labels = [1 if i == 0 else int(x or 0) for t in test for i, x in enumerate(t.marked)]
    assert sum((a > 0.5) == b for a, b in zip(p, labels, strict=True)) >= 0.95 * len(labels)


NAMES = "notice-period tags-history form-of-verb share-price header-note social-policy popular-music ad-hoc comment-on-law".split()
BLOCK = "Every contract ends after thirty days, unless both sides agree in writing to go on. That holds for all of them."


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("tag", ["p", "div", "section", "h2"])
def test_a_name_alone_drops_no_article_block(html_model, name, tag):
    inner = f"<p>{BLOCK}" if tag == "section" else BLOCK
    page = f"<body><nav><ul><li><a href=/>Home</a></li><li><a href=/b>B</a></li></ul></nav><article><h1>Head</h1><p>First words of it.</p><{tag} class='{name}'>{inner}</{tag}><p>Last words.</p></article><footer>site</footer></body>"
    assert html_extract.extract(html_model, [page]) == [f"Head First words of it. {BLOCK} Last words."]


def test_headers_and_drawings_of_an_article(html_model):
    body = "<header class=entry-header><h1>Big head</h1><p>By a writer</p></header><p>Area <svg><text>x squared</text></svg>, <canvas>fallback words</canvas> and <math><semantics><mi>y</mi><annotation>y</annotation></semantics></math>.</p>"
    page = f"<header><div>Site name here</div><ul><li><a href=x>Home</a></li></ul></header><article>{body}</article>"
    assert html_extract.extract(html_model, [page]) == ["Big head By a writer Area x squared, fallback words and yy."]


@pytest.mark.parametrize("block", ["<div class='share-buttons'><a href=x>Share</a> <a href=y>Tweet</a></div>", "<section id=comments><p>I like it very much, thank you for the text.</p></section>", "<aside class=related><h3>Related</h3><ul><li><a href=a>One</a></li></ul></aside>", "<div class=ad>Buy now, buy this fine thing.</div>", "<div class='cookie-notice'>We use cookies on this page for your comfort.</div>"])
def test_blocks_in_an_article_that_are_none_of_it(html_model, block):
    page = f"<article><h1>Head</h1><p>Text of some length follows here, as it does.</p>{block}<p>More of it.</p></article>"
    assert html_extract.extract(html_model, [page]) == ["Head Text of some length follows here, as it does. More of it."]


def test_all_pages_give_their_article(html_model, spark):
    rows = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    for page, got in zip(rows, html_extract.extract(html_model, rows), strict=True):
        want = html.unescape(re.sub("<[^>]*>", " ", re.search("<article>(.*?)</article>", page, re.S)[1]))
        assert "".join(got.split()) == "".join(want.split())


def test_odd_markup_keeps_the_text(html_model):
    body = "<p>The paragraph that follows has enough words to be a text of its own.</p>"
    for page, want in (
        ("İ" * 30 + "<script>x</script>" + body, "İ" * 30 + " "),
        ("<STYLE>a</sTyLe >" + body, ""),
        ("<p>a < b and c <d> e</p>" + body, "a < b and c e "),
        ('<p title="a > b">x</p>' + body, "x "),
        ("<!-- <p>no</p> -->" + body, ""),
        ("<p>E = <math><mi>m</mi><mo>c</mo></math></p>" + body, "E = mc "),
    ):
        assert html_extract.extract(html_model, ["<article>" + page + "</article>"])[0] == want + html.unescape(re.sub("<[^>]*>", "", body))
    assert html_extract.extract(html_model, ["no tags, only a line of text < here"]) == ["no tags, only a line of text < here"]


@pytest.mark.parametrize("page", ["<b </" * 20000, '<b "' * 20000 + ">", "<b '" * 30000, "<div>" * 20000 + "x", "<div>" * 3000 + "</x>" * 20000, "<script>" * 20000, "<!--" * 20000, "<" * 100000])
def test_scanning_takes_linear_time(html_model, page):
    import time

    start = time.time()
    html_extract.extract(html_model, [page])
    assert time.time() - start < 15

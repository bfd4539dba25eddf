"""A small corpus with exact and near copies, nulls and blanks, and plain versions of what operators count."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _m string"


def corpus(n=120, seed=5):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(400)] + ["the", "of", "and", "It", "été"]
    rows = []
    for i in range(n):
        k = rng.choice([0, 1, 3, 4, 5, 6, 30, 80, 200, 700])
        rows.append([i, " ".join(rng.choice(vocab) for _ in range(k)), "en", "s%d" % (i % 4)])
    for i in range(n, 2 * n):  # exact and near copies
        words = rng.choice(rows)[1].split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append([i, rng.choice([" ", "\n", "\t "]).join(words), "en", "s%d" % (i % 4)])
    rows += [[2 * n, None, None, None], [2 * n + 1, "", "fr", None], [2 * n + 2, " \n ", None, "s1"]]
    return [(a, b, c, d, len(b or ""), "x") for a, b, c, d in rows]


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def shingles(t):
    w = words(low(t))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components_by_force(rows):
    """{row: (set size, smallest named id in reach)} of rows (id, text); rows of one id are one node."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            same = rows[a][0] is not None and rows[a][0] == rows[b][0]
            if same or sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(b)] = find(a)
    names = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            names[find(i)] = min(names.get(find(i), name), name)
    return [(name, len(sets[i]), names.get(find(i))) for i, (name, _) in enumerate(rows)]

"""Quality rules (operator 5): a threshold table compiled into one projection, without user functions.

Defined results: a null text has no words, counts of zero, and fails; ties and repeated rows are judged row by row;
an empty table gives an empty table; null and repeated ids play no part; extra columns pass through untouched, whatever
their names: the result's struct is the last column, named `quality`, or `quality_` and so on where that is taken, and
columns on the way get names that no input column has. A very long text is measured whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import fresh, ref
from .text import SPACE, words

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is for that it on with as was are by this be at from or an a which not have "
    "le la les de des du et un une en est que qui dans pour par sur avec au pas ce il elle se "
    "der die das und ist von zu den mit im ein eine nicht auf für des dem sich auch als an "
    "el los las y que del se por con para una su al lo como más o pero sus"
).split()

#: (rule, measure, least, most): a document is kept when every measure is inside its bounds; None is no bound.
RULES = (
    ("word_count", "n_words", 50, None),
    ("word_length", "mean_word_chars", 2.0, 15.0),
    ("symbols", "symbol_ratio", None, 0.10),
    ("capitals", "capital_ratio", None, 0.50),
    ("stop_words", "stop_ratio", 0.005, None),
    ("repeated_lines", "dup_line_ratio", None, 0.70),
    ("bullet_lines", "bullet_ratio", None, 0.90),
    ("ellipsis_lines", "ellipsis_ratio", None, 0.50),
)


def _let(value: Column, body) -> Column:
    """Bind value once for use inside lambdas: a one-element array, transformed."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _once(value: Column) -> Column:
    """value, behind a condition that always holds but that the optimizer takes for random.

    A later filter on the verdict would else be pushed below the projection that makes the arrays, with their
    expressions written out inside each lambda, where they'd be evaluated again for every element.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def _repeat_words(ws: Column) -> Column:
    """Words inside 3-word windows that the text holds twice or more.

    Windows get a 64-bit hash. Few repeated hashes are looked up window by window; where there are many, sorting
    (hash, place) puts equal windows side by side, so the work stays n log n in a text of any length.
    """
    n = F.size(ws)
    hashes = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get(ws, i - 1), F.get(ws, i), F.get(ws, i + 1)))

    def covered(starts: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))))

    def by_lookup(h: Column, again: Column) -> Column:
        return covered(F.array_compact(F.transform(h, lambda x, i: F.when(F.array_contains(again, x), i))))

    def by_sort(h: Column) -> Column:
        beside = lambda s: F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)))
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return covered(F.transform(_let(pairs, beside), lambda x: x["p"]))

    def count(h: Column) -> Column:
        again = _let(F.sort_array(h), lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(x == F.get(s, i - 1), F.lit(False)))))
        many = F.size(F.array_distinct(h)) < n - 2
        return F.when(~many, F.lit(0)).otherwise(_let(again, lambda a: F.when(F.size(a) <= 64, by_lookup(h, a)).otherwise(by_sort(h))))

    return F.when(n < 4, F.lit(0)).otherwise(_let(hashes, count))


def measures(text: Column, w: Column, lines: Column) -> dict[str, Column]:
    """Counts of a text over its words w and its lines with a word; see RULES for the ratios built on them."""
    t = F.coalesce(text, F.lit(""))
    n = F.size
    stop = {x for x in STOP_WORDS} | {x.capitalize() for x in STOP_WORDS}
    return {
        "n_words": n(w).cast("long"),
        "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long"),
        "n_dup_lines": (n(lines) - n(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": _repeat_words(w).cast("long"),
        "n_capitals": (F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))).cast("long"),
        "n_stop_words": n(F.filter(w, lambda x: x.isin(*sorted(stop)))).cast("long"),
        "n_lines": n(lines).cast("long"),
        "n_bullet_lines": n(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09]*[-*•◦]"))).cast("long"),
        "n_ellipsis_lines": n(F.filter(lines, lambda x: x.rlike(r"(?:\.\.\.|…)[\x20\x09\r]*$"))).cast("long"),
    }


def ratios(m: Column) -> dict[str, Column]:
    """The measures that rules bound, from the struct of counts."""
    ratio = lambda a, b: F.coalesce(F.try_divide(m[a].cast("double"), m[b]), F.lit(0.0))
    return {
        "n_words": m["n_words"].cast("double"),
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "word_chars"),
        "capital_ratio": ratio("n_capitals", "word_chars"),
        "stop_ratio": ratio("n_stop_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "bullet_ratio": ratio("n_bullet_lines", "n_lines"),
        "ellipsis_ratio": ratio("n_ellipsis_lines", "n_lines"),
    }


def failed_rules(m: Column, rules=RULES) -> Column:
    """Names of the rules that a row's measures break, from the table."""
    r = ratios(m)
    broken = []
    for name, measure, least, most in rules:
        parts = ([r[measure] < F.lit(float(least))] if least is not None else []) + ([r[measure] > F.lit(float(most))] if most is not None else [])
        broken.append(F.when(reduce(lambda a, b: a | b, parts), F.lit(name)))
    return F.array_compact(F.array(*broken))


def annotate(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """docs with a struct `quality` as last column: the measures, failed_rules, base_failed and kept.

    base_failed: n_words < 50, or 100 * n_repeat_words > 50 * n_words. kept: not base_failed and no rule broken.
    """
    w, l, m, f, quality = (fresh(docs.columns, x) for x in ("_words", "_lines", "_measures", "_failed", "quality"))
    own = [ref(c) for c in docs.columns]
    base = (ref(m)["n_words"] < 50) | (100 * ref(m)["n_repeat_words"] > 50 * ref(m)["n_words"])
    lines = F.filter(F.split(F.coalesce(ref(text), F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = measures(ref(text), ref(w), ref(l))
    return (
        docs.select(*own, _once(words(ref(text))).alias(w), _once(lines).alias(l))
        .select(*own, _once(F.struct(*(v.alias(k) for k, v in counts.items()))).alias(m))
        .select(*own, ref(m), failed_rules(ref(m), rules).alias(f))
        .select(*own, F.struct(*(ref(m)[k].alias(k) for k in counts), ref(f).alias("failed_rules"), base.alias("base_failed"), (~base & (F.size(ref(f)) == 0)).alias("kept")).alias(quality))
    )


def keep_good(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The rows of docs that pass, with their own columns."""
    rows = annotate(docs, rules, text)
    quality = rows.columns[-1]
    return rows.filter(ref(quality)["kept"]).drop(ref(quality))

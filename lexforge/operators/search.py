"""Stem search: conjunction of terms with alternatives, scores, best paragraphs per article, tiered order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.textfn import occurrences, searchable, typed


def score_paragraphs(paras: DataFrame, terms: list[list[list[str]]], text: str, title: str | None = None) -> DataFrame:
    """Paragraphs that match every term, with `score`.

    A term is a list of alternatives, an alternative a list of stems that stand in the paragraph or its title; the first
    alternative that holds is chosen. One chosen stem at least is in the paragraph. score: occurrences of the chosen
    stems in the paragraph, and 2 for each of them in the title. Stems and texts are compared as `searchable`.
    """
    terms = [[[typed(s) for s in alt] for alt in alternatives] for alternatives in terms]
    body, head = searchable(F.col(text)), searchable(F.coalesce(F.col(title), F.lit(""))) if title else F.lit("")
    rows = paras.withColumn("_b", body).withColumn("_h", head)
    holds: list[Column] = []
    score, inside = F.lit(0).cast("long"), F.lit(False)
    for alternatives in terms:
        tests = [reduce(lambda a, b: a & b, [F.col("_b").contains(s) | F.col("_h").contains(s) for s in alt]) for alt in alternatives]
        holds.append(reduce(lambda a, b: a | b, tests))
        s, i = F.lit(0).cast("long"), F.lit(False)
        for test, alt in reversed(list(zip(tests, alternatives, strict=True))):
            points = reduce(lambda a, b: a + b, [occurrences(F.col("_b"), x) + F.when(F.col("_h").contains(x), 2).otherwise(0) for x in alt])
            s, i = F.when(test, points).otherwise(s), F.when(test, reduce(lambda a, b: a | b, [F.col("_b").contains(x) for x in alt])).otherwise(i)
        score, inside = score + s, inside | i
    return rows.filter(reduce(lambda a, b: a & b, holds)).filter(inside).withColumn("score", score).drop("_b", "_h")


def top_per_article(hits: DataFrame, article: str, position: str, k: int = 3) -> DataFrame:
    w = Window.partitionBy(article).orderBy(F.col("score").desc(), position)
    return hits.withColumn("rnk", F.row_number().over(w).cast("long")).filter(F.col("rnk") <= k)


def best_articles(hits: DataFrame, article: str, tier: Column, limit: int, bonus: Column | None = None) -> DataFrame:
    """The first `limit` articles by tier, then score (best paragraph and bonus), then id."""
    best = hits.groupBy(article).agg(F.min(tier).alias("tier"), (F.max("score") + F.max(bonus if bonus is not None else F.lit(0))).alias("best"))
    return best.orderBy("tier", F.col("best").desc(), article).limit(limit)


def top_articles(hits: DataFrame, article: str, position: str, tier: Column, limit: int, k: int = 3) -> DataFrame:
    """The best k paragraphs of the first `limit` articles in one pass; rows of article, rnk, position, score.

    A window with a limit keeps k rows an article in each task before an article's rows meet, so one with most of the
    hits sends no more than another; the sum that follows stays on the same partitions. `tier` is an article's.
    """
    rows = hits.select(article, position, "score", tier.alias("tier"))
    w = Window.partitionBy(article).orderBy(F.col("score").desc(), position)
    top = rows.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= k)
    best = top.groupBy(article).agg(F.min("tier").alias("tier"), F.max("score").alias("best"), F.collect_list(F.struct("rnk", position, "score")).alias("top"))
    first = best.orderBy("tier", F.col("best").desc(), article).limit(limit)
    return first.select(article, F.explode("top").alias("x")).select(article, F.col("x.rnk").cast("long").alias("rnk"), F.col(f"x.{position}").alias(position), "x.score")


def listing(hits: DataFrame, article: str, tier: Column, limit: int, more: int = 20) -> DataFrame:
    """The first `limit` articles and the next `more`: place, whether shown, how many articles match at all, and a limit
    that would show three times as many. Only limit + more rows are numbered."""
    best = hits.groupBy(article).agg(F.min(tier).alias("tier"), F.max("score").alias("best"))
    first = best.orderBy("tier", F.col("best").desc(), article).limit(limit + more)
    found = best.agg(F.count(F.lit(1)).alias("found"))
    place = F.row_number().over(Window.orderBy("tier", F.col("best").desc(), article)).cast("long")
    rows = first.withColumn("place", place).join(F.broadcast(found))
    return rows.withColumn("shown", F.col("place") <= limit).withColumn("suggested", F.least("found", F.lit(3 * limit)))


def alternatives(terms: DataFrame, term: str, groups: DataFrame, least: int = 4) -> DataFrame:
    """(term, stem): a term and the members of each synonym group (group, stem) that it belongs to: it starts with a member of
    one word, or, with `least` letters or more, a member starts with it. Members meet terms by their prefixes, exploded,
    so no pair of all terms and members is made."""
    words = groups.filter(~F.col("stem").contains(" "))
    heads = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.substring(c, 1, n)))
    one = terms.select(F.col(term).alias("term")).filter(F.length(term) > 0).distinct()
    longer = one.select("term", heads(F.col("term")).alias("stem")).join(words, "stem").select("term", "group")
    shorter = words.filter(F.length("stem") > 0).select("group", heads(F.col("stem")).alias("term")).join(one.filter(F.length("term") >= least), "term").select("term", "group")
    return longer.unionByName(shorter).distinct().join(groups, "group").select("term", "stem").unionByName(one.select("term", F.col("term").alias("stem"))).distinct()

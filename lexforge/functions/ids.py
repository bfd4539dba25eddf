"""The id grammar `scope:article[.part][#k][~quoted][@k]` as expressions, and joins along its hierarchy.

`within` (equal, or below at a mark) is never a prefix comparison of all pairs: ancestors are exploded and joined by
equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def article(local: Column) -> Column:
    return F.element_at(F.split(local, "[.#~@]", 2), 1)


def numbered(local: Column) -> Column:
    """The part before unnumbered, quoted and repeat marks."""
    return F.element_at(F.split(local, "[#~@]", 2), 1)


def scope(gid: Column) -> Column:
    return F.element_at(F.split(gid, ":", 2), 1)


def ancestors(gid: Column) -> Column:
    """All prefixes of an id that end before a mark, and the id itself, shortest first."""
    steps = F.regexp_extract_all(gid, F.lit("(^[^.#~@]+|[.#~@][^.#~@]*)"), 1)
    grow = lambda a, x: F.array_append(a, F.concat(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")), x))
    return F.aggregate(steps, F.array().cast("array<string>"), grow)


def within_join(inner: DataFrame, outer: DataFrame, inner_id: str, outer_id: str) -> DataFrame:
    """Pairs of rows where inner's id is outer's or below it."""
    up = inner.withColumn("_anc", F.explode(ancestors(F.col(inner_id))))
    return up.join(outer, up["_anc"] == outer[outer_id]).drop("_anc")


def longest_prefix(cited: DataFrame, known: DataFrame, keys: list[str], cited_id: str, known_id: str, out: str) -> DataFrame:
    """keys and the longest id on the way to a cited one that is known or has something known below it: candidate prefixes,
    a semi-join, the longest. Citations without one have no row."""
    candidates = cited.select(*keys, F.explode(ancestors(F.col(cited_id))).alias("_cand"))
    have = known.select(F.explode(ancestors(F.col(known_id))).alias("_cand")).distinct()
    return candidates.join(have, "_cand", "left_semi").groupBy(*keys).agg(F.max_by("_cand", F.length("_cand")).alias(out))


def deepest_known(cited: DataFrame, known: DataFrame, keys: list[str], cited_id: str, known_id: str, out: str) -> DataFrame:
    """keys and the longest id on the way to a cited one that is itself known, whatever is missing in between: candidate
    prefixes, a semi-join, the longest. Citations without one have no row."""
    candidates = cited.select(*keys, F.explode(ancestors(F.col(cited_id))).alias("_cand"))
    have = known.select(F.col(known_id).alias("_cand")).distinct()
    return candidates.join(have, "_cand", "left_semi").groupBy(*keys).agg(F.max_by("_cand", F.length("_cand")).alias(out))


def related_join(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """Pairs of rows of which either id is within the other; equal ids give one row."""
    down = within_join(b, a, b_id, a_id).filter(F.col(a_id) != F.col(b_id)).select(*a.columns, *b.columns)
    return within_join(a, b, a_id, b_id).select(*a.columns, *b.columns).unionByName(down)

"""Joins that hold when one key has a third of all rows, and row filters by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with at least this share of the left rows counts as hot; so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
#: Ids up to this number (8 bytes each) may be broadcast; more take a shuffled join.
BROADCAST_IDS = 1_000_000


def fresh(columns: list[str], name: str) -> str:
    """name, with underscores added until no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def ref(name: str) -> Column:
    """The top-level column of that very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def odd_ids(rows: DataFrame, id_col: str) -> bool:
    """Whether an id is null or stands in more than one row."""
    return rows.groupBy(ref(id_col).alias("id")).agg(F.count(F.lit(1)).alias("k")).filter("k > 1 OR id IS NULL").limit(1).count() > 0


def skew_left_join(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """left LEFT JOIN right on key, where right has one row a key and `weight`, the key's rows in left.

    Keys with 1/1000 of the rows or more, at most 1000 of them, are broadcast, so their left rows stay where they are;
    all others meet by sort-merge. No row is lost: a left row goes one way or the other.
    """
    hot = right.filter(F.col(weight) * HOT_SHARE >= max(total, 1)).filter(F.col(weight) > 1)
    cold = right.filter(~((F.col(weight) * HOT_SHARE >= max(total, 1)) & (F.col(weight) > 1)))
    hot_keys = hot.select(F.col(key).alias("_hot"))
    values = [c for c in right.columns if c != key]
    a = left.join(F.broadcast(hot), key)
    b = left.join(F.broadcast(hot_keys), F.col(key) == F.col("_hot"), "left_anti").join(cold.hint("merge"), key, "left")
    cols = [*left.columns, *values]
    return a.select(*cols).unionByName(b.select(*cols))


def without_ids(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs less the rows whose id is in `dropped` (one column of distinct ids). Null ids stay.

    The number of dropped ids is counted: a small set is broadcast and no text moves; a larger one takes a shuffle.
    """
    name = fresh(docs.columns, "_dropped")
    d = dropped.select(ref(dropped.columns[0]).alias(name))
    d = F.broadcast(d) if dropped.count() <= BROADCAST_IDS else d.hint("merge")
    return docs.join(d, ref(id_col) == ref(name), "left_anti")

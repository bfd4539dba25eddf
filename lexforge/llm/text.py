"""Shared text expressions: ASCII-white-space words, ASCII lower case, crc32 folds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that separates words: space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Array of `[^\\x20\\x09-\\x0D]+` of a text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def fold_of(doc_id: Column, k: int) -> Column:
    """crc32 of the id's decimal digits, modulo k; a null id counts as an empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k).cast("int")

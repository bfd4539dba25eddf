"""Text functions: folding, stems, counts, snippets, word bags. All are expressions; none is a user function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accented letters and their plain forms (Greek with final sigma, and Latin), position by position.
FOLD_FROM = "άέήίόύώϊΐϋΰςáàâäãåçéèêëíìîïñóòôöõúùûüÿ"
FOLD_TO = "αεηιουωιιυυσaaaaaaceeeeiiiinooooouuuuy"
#: Latin capitals and small letters that look Greek, and the Greek ones (folded).
LOOKALIKE_FROM, LOOKALIKE_TO = "abehikmnoptxyz", "αβεηικμνορτχυζ"
_GREEK = str.maketrans(LOOKALIKE_FROM, LOOKALIKE_TO)


def fold(x: Column) -> Column:
    """Lower case without accents; a character stays one character, so offsets hold."""
    return F.translate(F.lower(x), FOLD_FROM, FOLD_TO)


def searchable(x: Column) -> Column:
    """fold, then Latin look-alikes as Greek letters."""
    return F.translate(F.lower(x), FOLD_FROM + LOOKALIKE_FROM, FOLD_TO.translate(_GREEK) + LOOKALIKE_TO)


def typed(x: str) -> str:
    """searchable of what a user types."""
    return x.lower().translate(str.maketrans(FOLD_FROM, FOLD_TO)).translate(_GREEK)


def occurrences(x: Column, stem: str) -> Column:
    """How often stem stands in x, without overlaps."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(stem), F.lit("")))) / len(stem)).cast("long")


def snippet(x: Column, at: Column, size: int = 260) -> Column:
    """Up to `size` characters of x around the 1-based offset `at`, from a word's start to a word's end, with an ellipsis
    where text is left out; shorter texts whole. An offset of 0 or null starts at the text's start."""
    space = F.lit(" ")
    early = F.greatest(F.lit(0), F.coalesce(at, F.lit(0)) - 1 - size // 3)
    word = F.when(early > 0, F.call_function("locate", space, x, early + 1)).otherwise(0)
    start = F.when(word > 0, word).otherwise(early)
    part = F.substr(x, start + 1, F.lit(size))
    last = F.length(part) - F.instr(F.reverse(part), " ")
    full = start + F.length(part) >= F.length(x)
    cut = F.when(full | (F.instr(part, " ") == 0) | (last == 0), part).otherwise(F.substr(part, F.lit(1), last))
    some = F.concat(F.when(start > 0, "…").otherwise(""), cut, F.when(full, "").otherwise("…"))
    return F.when(F.length(x) <= size, x).otherwise(some)


def lines(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """One row for each non-blank line: the kept columns, para_pos (0-based among all lines) and txt, trimmed."""
    rows = docs.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("para_pos", "txt"))
    return rows.withColumn("txt", F.trim("txt")).filter("txt <> ''")


def bag(rows: DataFrame, *keys: str, text: str = "txt", pattern: str = "[a-z]{2,}") -> DataFrame:
    """Word bag: keys, word, n."""
    found = rows.select(*keys, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"({pattern})"), 1)).alias("word"))
    return found.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))


def lacking(expected: DataFrame, got: DataFrame) -> DataFrame:
    """word and how many of its n in one bag the other lacks."""
    have = got.select("word", F.col("n").alias("_have"))
    return expected.join(have, "word", "left").select("word", F.greatest(F.col("n") - F.coalesce("_have", F.lit(0)), F.lit(0)).alias("missing"))


def natural_key(x: Column) -> Column:
    """Sort key of an id: runs of digits as numbers before other runs as text."""
    parts = F.regexp_extract_all(x, F.lit(r"(\d+|[^\d]+)"), 1)
    number = lambda p: F.when(p.rlike(r"^\d"), p.cast("long"))
    return F.transform(parts, lambda p: F.struct((~p.rlike(r"^\d")).alias("is_text"), F.coalesce(number(p), F.lit(0)).alias("num"), p.alias("txt")))


def pages(sizes: Column, limit: int = 12_000) -> Column:
    """The page of each line, from 1: a line that would pass the limit begins the next page; a longer one fills its own."""
    start = F.struct(F.lit(0).cast("long").alias("page"), F.lit(2**60).cast("long").alias("used"), F.array().cast("array<bigint>").alias("out"))

    def step(s: Column, n: Column) -> Column:
        turn = s["used"] + n > limit
        page = F.when(turn, s["page"] + 1).otherwise(s["page"])
        return F.struct(page.alias("page"), F.when(turn, n).otherwise(s["used"] + n).alias("used"), F.array_append(s["out"], page).alias("out"))

    return F.aggregate(sizes, start, step)["out"]

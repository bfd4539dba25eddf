"""Words and lines of a page as text, and the clauses inside it."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.greek import numeral

#: Points: words nearer than TOUCH are one; a raised, smaller word nearer than RAISED belongs to the one before it.
TOUCH, RAISED, SMALLER = 0.15, 0.5, 0.8


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """Letters with their accents as one character each; marks that stay alone go."""
    return text.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFC", x) if not unicodedata.combining(c)))


def superscript(x1: Column, y0: Column, y1: Column, nx0: Column, ny0: Column, ny1: Column) -> Column:
    """Whether a word (n…) is a superscript of the one before: near, higher up and smaller."""
    return (nx0 - x1 >= 0) & (nx0 - x1 < RAISED) & (ny0 < y0) & (ny1 - ny0 < SMALLER * (y1 - y0))


def line_text(words: DataFrame, line: list[str], text: str = "text") -> DataFrame:
    """The text of each line from its words (x0, y0, x1, y1): words that touch, and superscripts, join the word before."""
    w = Window.partitionBy(*line).orderBy("x0", "x1", text)
    before = {c: F.lag(c).over(w) for c in ("x1", "y0", "y1")}
    rows = words.select("*", *(v.alias(f"_{c}") for c, v in before.items()))
    glued = (F.abs(F.col("x0") - F.col("_x1")) < TOUCH) | superscript(F.col("_x1"), F.col("_y0"), F.col("_y1"), F.col("x0"), F.col("y0"), F.col("y1"))
    piece = F.concat(F.when(F.col("_x1").isNull() | glued, "").otherwise(" "), F.col(text))
    rows = rows.select(*line, F.struct("x0", "x1", F.col(text).alias("t"), piece.alias("p")).alias("_w"))
    return rows.groupBy(*line).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_w")), lambda x: x["p"]), "").alias("line"))


def split_clauses(text: Column) -> Column:
    """A paragraph cut where the next clause stands on the same line: after `β)` only `γ)` begins another."""
    label = lambda x: numeral(F.regexp_extract(x, r"^([α-ω]{1,3})\)", 1))
    pieces = F.split(text, r"(?<=[.·;:])\s+(?=[α-ω]{1,3}\)\s)")
    start = F.struct(F.lit(None).cast("int").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        first, goes_on = F.size(s["out"]) == 0, F.coalesce(label(x) == s["at"] + 1, F.lit(False))
        joined = F.concat(F.slice(s["out"], 1, F.greatest(F.lit(0), F.size(s["out"]) - 1)), F.array(F.concat_ws(" ", F.try_element_at(s["out"], F.lit(-1)), x)))
        return F.struct(F.when(first | goes_on, label(x).cast("int")).otherwise(s["at"]).alias("at"), F.when(first | goes_on, F.array_append(s["out"], x)).otherwise(joined).alias("out"))

    return F.aggregate(pieces, start, step)["out"]


def misprint(gid: Column, text: Column) -> Column:
    """The decimal number that a quoted paragraph prints, where its id corrects it; null otherwise."""
    local = F.element_at(F.split(gid, "~"), -1)
    shown = F.regexp_extract(F.ltrim(F.regexp_replace(text, "^«+", "")), r"^(\d+(?:\.\d+)+)\.?(?=\s|$)", 1)
    wrong = gid.contains("~") & ~local.contains("#") & (shown != "") & local.contains(".") & ~F.element_at(F.split(local, "@"), 1).endswith(shown)
    return F.when(wrong, shown)


def rows_by_anchor(items: DataFrame, page: list[str], y: str, order: str, slack: float = 1.5, out: str = "row") -> DataFrame:
    """(page, order, row): items of a page from top to bottom; one starts a row where it lies more than `slack` below the
    first item of the row before. A page's items meet in one array, which a printed page bounds."""
    start = F.struct(F.lit(None).cast("double").alias("y"), F.lit(-1).alias("row"), F.array().cast(f"array<struct<id: {items.schema[order].dataType.simpleString()}, row: int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        same = F.coalesce(x["y"] - s["y"] <= slack, F.lit(False))
        row = F.when(same, s["row"]).otherwise(s["row"] + 1)
        return F.struct(F.when(same, s["y"]).otherwise(x["y"]).alias("y"), row.alias("row"), F.array_append(s["out"], F.struct(x["id"].alias("id"), row.alias("row"))).alias("out"))

    pages = items.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(F.col(y).cast("double").alias("y"), F.col(order).alias("id")))).alias("_items"))
    return pages.select(*page, F.explode(F.aggregate("_items", start, step)["out"]).alias("_x")).select(*page, F.col("_x.id").alias(order), F.col("_x.row").alias(out))


def merged_fragments(rows: DataFrame, line: list[str], x0: str, x1: str, gap: float = 10) -> DataFrame:
    """Fragments of a row as lines: line keys, first and last edge, how many; a gap over `gap` after all before it parts two."""
    before = Window.partitionBy(*line).orderBy(x0, x1).rowsBetween(Window.unboundedPreceding, -1)
    started = rows.withColumn("_reach", F.max(x1).over(before)).withColumn("_new", F.coalesce(F.col(x0) - F.col("_reach") > gap, F.lit(True)).cast("int"))
    numbered = started.withColumn("_run", F.sum("_new").over(Window.partitionBy(*line).orderBy(x0, x1).rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*line, "_run").agg(F.min(x0).alias(x0), F.max(x1).alias(x1), F.count(F.lit(1)).alias("n")).drop("_run")


def without_noise_layer(words: DataFrame, page: list[str], height: str, noise: Column, least: int = 20, share: float = 0.5) -> DataFrame:
    """words less those of a page's noise layer: heights at which at least `least` words, and `share` of them, are noise."""
    layer = words.groupBy(*page, height).agg(F.count_if(noise).alias("_n"), F.count(F.lit(1)).alias("_all")).filter((F.col("_n") >= least) & (F.col("_n") >= share * F.col("_all"))).select(*page, height)
    return words.join(layer, [*page, height], "left_anti")


def image_notes(pages: DataFrame, images: DataFrame, item: list[str], page: str) -> DataFrame:
    """item and what its text lacks: `all` where all of its pages are images, `part` where some are; others have no row."""
    hit = pages.select(*item, page).distinct().join(images.select(*item, page).distinct().withColumn("_image", F.lit(1)), [*item, page], "left")
    n = hit.groupBy(*item).agg(F.count(F.lit(1)).alias("_n"), F.count("_image").alias("_i")).filter("_i > 0")
    return n.select(*item, F.when(F.col("_i") == F.col("_n"), "all").otherwise("part").alias("lacks"))

"""A code's base text: section paths from a stack of headings, articles aligned with the contents, what is missing and why.

The stack is windows: an article's heading of a level is the last one of that level, unless a heading of a higher level has come
since. Windows and arrays are over one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Levels of section headings by their first word; any other is of the lowest.
HEADING_LEVELS = {"ΜΕΡΟΣ": 2, "ΤΜΗΜΑ": 3, "ΚΕΦΑΛΑΙΟ": 4}
LOWEST = 4


def section_paths(articles: DataFrame, text: list[str], order: str, headings: str, levels: dict[str, int] = HEADING_LEVELS, lowest: int = LOWEST) -> DataFrame:
    """articles with `path`: the section headings that an article stands under, highest first."""
    rows = articles.select(*text, order, F.posexplode_outer(headings).alias("_k", "_h"))
    known = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])
    level = F.coalesce(F.try_element_at(known, F.substring_index("_h", " ", 1)), F.lit(lowest))
    rows = rows.withColumns({"_level": F.when(F.col("_h").isNotNull(), level), "_at": F.struct(F.col(order).alias("o"), F.coalesce("_k", F.lit(-1)).alias("k"))})
    upto = Window.partitionBy(*text).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda test, value: F.last(F.when(test, value), ignorenulls=True).over(upto)
    held = []
    for n in sorted({*levels.values(), lowest}):
        mine = last(F.col("_level") == n, F.struct(F.col("_at").alias("at"), F.col("_h").alias("h")))
        higher = last(F.col("_level") < n, F.col("_at"))
        held.append(F.when(higher.isNull() | (mine["at"] > higher), mine["h"]))
    rows = rows.withColumn("_path", F.array_compact(F.array(*held)))
    paths = rows.groupBy(*text, order).agg(F.max_by("_path", "_at").alias("path"))
    return articles.join(paths, [*text, order])


def aligned(articles: DataFrame, contents: DataFrame, text: list[str], number: str, title: str, page: str, paragraphs: str) -> DataFrame:
    """Articles by number, with those of the contents that weren't found, and `missing`.

    articles: text, number (a whole number), title, page, paragraphs (array of texts); contents: text, number, title. A title that
    the entry ends with, or whose first paragraph completes the entry, takes the entry's; that paragraph goes. Every
    number up to the last one found has a row: a missing one has the entry's title and the page of the article before it.
    """
    entry = contents.groupBy(*text, number).agg(F.min_by(title, F.length(title)).alias("_entry"))
    span = articles.groupBy(*text).agg(F.max(number).alias("_last"))
    every = span.select(*text, F.explode(F.sequence(F.lit(1), F.col("_last").cast("int"))).alias(number))
    rows = every.join(articles.withColumn("_found", F.lit(True)), [*text, number], "left").join(entry, [*text, number], "left")
    full, own, first = F.col("_entry"), F.col(title), F.try_element_at(paragraphs, F.lit(1))
    ends = full.endswith(own) & (own != "")
    spilled = (own != "") & ~ends & full.eqNullSafe(F.concat_ws(" ", own, first))
    missing = F.col("_found").isNull()
    before = Window.partitionBy(*text).orderBy(number)
    near = F.coalesce(page, F.last(page, ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.first(page, ignorenulls=True).over(before.rowsBetween(1, Window.unboundedFollowing)))
    return rows.withColumns({
        title: F.when(missing | ends | spilled, F.coalesce(full, own, F.lit(""))).otherwise(own),
        page: near,
        paragraphs: F.when(missing, F.array().cast("array<string>")).when(spilled, F.slice(F.col(paragraphs), F.lit(2), F.size(paragraphs))).otherwise(F.col(paragraphs)),
        "missing": missing,
    }).drop("_found", "_entry")


def gaps(articles: DataFrame, images: DataFrame, text: list[str], number: str, page: str) -> DataFrame:
    """articles with `image_pages` (pages from its own to the next article's that hold an image, of `images`: text, page) and `gap`:
    `missing_text` where an article that wasn't found has such pages, `not_parsed` where it has none."""
    after = F.coalesce(F.lead(page).over(Window.partitionBy(*text).orderBy(number)), F.col(page))
    spread = articles.select(*text, number, page, after.alias("_after")).select(*text, number, F.explode(F.sequence(F.col(page), F.greatest("_after", page))).alias("_page"))
    held = images.select(*text, F.col(page).alias("_page")).distinct()
    shown = spread.join(held, [*text, "_page"]).groupBy(*text, number).agg(F.array_sort(F.collect_list("_page")).alias("image_pages"))
    rows = articles.join(shown, [*text, number], "left")
    return rows.withColumn("gap", F.when(F.col("missing") & F.col("image_pages").isNotNull(), "missing_text").when(F.col("missing"), "not_parsed"))

"""Reading order by geometry: lines from words, columns from gaps, bands cut by full-width lines. No user function.

A page's words and lines are bounded by the paper, so windows and arrays are by page or line. Coordinates are points from the
top left corner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import TOUCH, superscript

#: Fixed values, in points: the least gap between two columns, how far the left one may end beyond the middle, slack at the edge.
COLUMN_GAP, PAST_MIDDLE, SLACK = 10, 10, 2
#: Fixed values, as shares of the page: the running header, the least width of a line that sets the right column's edge.
HEADER, LONG_LINE = 0.095, 0.2


def lines_of_words(words: DataFrame, page: list[str], line: str, width: str, height: str, text: str = "text") -> DataFrame:
    """page, width, height, x0, y0, x1, y1, text of each line. A line whose words stand on both sides of the page's middle, with a gap
    there that is wider than any column's and than twice its usual word space, is two lines."""
    word = F.struct("x0", "x1", F.col(text).alias("t"), "y0", "y1")
    rows = words.groupBy(*page, line).agg(F.sort_array(F.collect_list(word)).alias("ws"), F.first(width).alias(width), F.first(height).alias(height))
    ws, half = F.col("ws"), F.col(width) / 2
    gap = lambda i: F.get(ws, i + 1)["x0"] - F.get(ws, i)["x1"]
    places = F.sequence(F.lit(0), F.size(ws) - 2)
    gaps = F.array_sort(F.transform(places, gap))
    usual = F.coalesce(F.get(gaps, F.floor((F.size(ws) - 2) / 2).cast("int")), F.lit(0.0))
    # The usual space is asked last, for the one gap that may be the columns'.
    apart = F.filter(places, lambda i: (F.get(ws, i)["x1"] < half) & (half < F.get(ws, i + 1)["x0"]) & (gap(i) > COLUMN_GAP) & (gap(i) > 2 * usual))
    # Few lines have words on both sides, and only those are looked at word by word.
    cut = F.when((F.array_min("ws.x1") < half) & (half < F.array_max("ws.x0")) & (F.size(ws) > 1), F.array_min(apart) + 1)
    parts = F.when(F.col("cut").isNull(), F.array(ws)).otherwise(F.array(F.slice(ws, F.lit(1), F.col("cut")), F.slice(ws, F.col("cut") + 1, F.size(ws))))
    each = rows.withColumn("cut", cut).select(*page, width, height, F.explode(parts).alias("ws"))

    def piece(w: Column, i: Column) -> Column:
        before = F.get(F.col("ws"), i - 1)
        glued = (F.abs(w["x0"] - before["x1"]) < TOUCH) | superscript(before["x1"], before["y0"], before["y1"], w["x0"], w["y0"], w["y1"])
        return F.concat(F.when((i == 0) | glued, "").otherwise(" "), w["t"])

    edges = [f(f"ws.{c}").alias(c) for f, c in ((F.array_min, "x0"), (F.array_min, "y0"), (F.array_max, "x1"), (F.array_max, "y1"))]
    return each.select(*page, width, height, *edges, F.array_join(F.transform("ws", piece), "").alias("text"))


def columns(lines: DataFrame, page: list[str], width: str, height: str) -> DataFrame:
    """lines without the running header and what lies off the page, with `col`: L, R, or S for a line across both columns. Where most
    lines are across, the page has one column."""
    w, middle = F.col(width), F.col(width) / 2 - 5
    body = lines.filter((F.col("y1") >= F.col(height) * HEADER) & (F.col("x0") >= -SLACK) & (F.col("x1") <= w + SLACK))
    right = F.col("x0") > middle
    long = right & (F.col("x1") - F.col("x0") > w * LONG_LINE)
    left_end = F.when((F.col("x0") < middle) & (F.col("x1") < w / 2 + PAST_MIDDLE), F.round("x1"))
    whole = Window.partitionBy(*page)
    # Windows, as a join with the pages' edges would read and build all lines twice.
    rows = body.withColumns({"_end": F.mode(left_end, True).over(whole), "_first": F.min(F.when(long, F.col("x0"))).over(whole), "_any": F.min(F.when(right, F.col("x0"))).over(whole), "_w": F.max(w).over(whole)})
    after = F.min(F.when(long & (F.col("x0") > F.col("_end")), F.col("x0"))).over(whole)
    rows = rows.withColumn("_edge", F.coalesce(after, "_first", "_any", "_w"))
    limit = F.col("_edge") - SLACK
    rows = rows.withColumn("_side", F.when(F.col("x1") < limit, "L").when(F.col("x0") >= limit, "R").otherwise("S"))
    across = F.avg((F.col("_side") == "S").cast("int")).over(whole) > 0.5
    return rows.withColumn("col", F.when(across, "S").otherwise(F.col("_side"))).drop("_end", "_first", "_any", "_w", "_edge", "_side")


def reading_order(lines: DataFrame, page: list[str], width: str, height: str) -> DataFrame:
    """lines with `col` and `seq`, their place on the page from 1: a full-width line ends a band; in a band the left column
    comes before the right one."""
    down = Window.partitionBy(*page).orderBy("y0", "x0", "x1", "text")
    rows = columns(lines, page, width, height).withColumn("_band", F.sum((F.col("col") == "S").cast("int")).over(down.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.when(F.col("col") == "S", 0).when(F.col("col") == "L", 1).otherwise(2)
    order = Window.partitionBy(*page).orderBy("_band", rank, "y0", "x0", "x1", "text")
    return rows.withColumn("seq", F.row_number().over(order)).drop("_band")


def text_edges(lines: DataFrame, issue: list[str], page: str, least: int = 12, reach: float = 3) -> DataFrame:
    """lines with `left` and `right`, the text edges of their page and column: the lines that end within `reach` of the rightmost end
    are full, and the first of their starts is the left edge. A column of fewer than `least` lines takes the commonest
    edges of the pages of its parity, if any page there has enough."""
    key = [*issue, page, "col"]
    ends = Window.partitionBy(*key)
    full = F.when(F.col("x1") > F.max("x1").over(ends) - reach, F.col("x0"))
    own = lines.withColumn("_full", full).groupBy(*key).agg(F.min("_full").alias("_l"), F.max("x1").alias("_r"), F.count(F.lit(1)).alias("_n"))
    side = [*issue, F.pmod(F.col(page), F.lit(2)).alias("_odd"), "col"]
    usual = own.filter(F.col("_n") >= least).groupBy(*side).agg(F.mode(F.struct(F.round("_l", 1).alias("l"), F.round("_r", 1).alias("r")), True).alias("_usual"))
    both = own.withColumn("_odd", F.pmod(F.col(page), F.lit(2))).join(usual, [*issue, "_odd", "col"], "left")
    few = (F.col("_n") < least) & F.col("_usual").isNotNull()
    edges = both.select(*key, F.when(few, F.col("_usual.l")).otherwise(F.col("_l")).alias("left"), F.when(few, F.col("_usual.r")).otherwise(F.col("_r")).alias("right"))
    return lines.join(edges, key)

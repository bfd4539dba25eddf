"""Operators over articles, their paragraphs and the acts that change them. All are joins, windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids


def first_seen(rows: DataFrame, keys: list[str], value: str, order: list[str], out: str) -> DataFrame:
    """The distinct values of each group in the order in which they first stand there, as an array."""
    once = rows.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_at"))
    return once.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(value).alias("v")))), lambda x: x["v"]).alias(out))


def share_in_order(rows: DataFrame, keys: list[str], position: str, hit: Column, least: float, out: str) -> DataFrame:
    """Whether at least a share of each group's rows, but its first one, are hits; a group of one row is none."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(position)) > 1
    marked = rows.withColumn("_later", first).groupBy(*keys).agg(F.count_if("_later").alias("_n"), F.count_if(F.col("_later") & hit).alias("_hits"))
    return marked.select(*keys, ((F.col("_n") > 0) & (F.col("_hits") >= least * F.col("_n"))).alias(out))


def top_numbers(gid: Column) -> Column:
    """The first-level paragraph number of a local id; null where it has none."""
    return F.nullif(F.regexp_extract(gid, r"^[^.]*\.(\d+)", 1), F.lit(""))


def commencement_ranges(rules: DataFrame, act: str, number: str) -> DataFrame:
    """For each commencement article the articles that it governs: after the one before it, up to its own."""
    w = Window.partitionBy(act).orderBy(number)
    return rules.withColumn("first", F.coalesce(F.lag(number).over(w) + 1, F.lit(1))).withColumnRenamed(number, "last")


def split_at_gap(words: DataFrame, line: str, left: str, right: str, middle: Column, least: float) -> DataFrame:
    """words with `side`: 0 before and 1 from the first gap on that holds the middle, is wider than `least` and than twice the
    line's lower median gap."""
    w = Window.partitionBy(line).orderBy(left, right)
    gaps = words.withColumn("_before", F.lag(right).over(w)).withColumn("_gap", F.col(left) - F.col("_before"))
    usual = gaps.groupBy(line).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY _gap)").alias("_usual"))
    wide = (F.col("_gap") > F.greatest(F.lit(float(least)), 2 * F.col("_usual"))) & (F.col("_before") < middle) & (middle < F.col(left))
    marked = gaps.join(usual, line).withColumn("side", F.max(F.coalesce(wide, F.lit(False)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.drop("_before", "_gap", "_usual")


def in_regions(items: DataFrame, page: str, top: str, regions: DataFrame, region_top: str, region_bottom: str, slack: float = 2, ties: tuple[str, ...] = ()) -> DataFrame:
    """items with `inside`: whether one starts inside a region of its page, or above it and runs past its foot. An item lasts
    to the next one's start on its page, and to the foot where there is none. Of items that start at one height, `ties` tells
    which is next; without it any may be."""
    w = Window.partitionBy(page).orderBy(top, *ties)
    ends = items.withColumn("_end", F.lead(top).over(w))
    r = regions.groupBy(page).agg(F.collect_list(F.struct(F.col(region_top).alias("t"), F.col(region_bottom).alias("b"))).alias("_regions"))
    hit = lambda x: ((F.col(top) >= x["t"] - slack) & (F.col(top) <= x["b"] + slack)) | ((F.col(top) < x["t"]) & (F.coalesce(F.col("_end") > x["b"], F.lit(True))))
    return ends.join(r, page, "left").withColumn("inside", F.coalesce(F.exists("_regions", hit), F.lit(False))).drop("_end", "_regions")


def refers_to_hits(refs: DataFrame, hits: DataFrame, act: str, article: str, cited: str) -> DataFrame:
    """Articles that cite a hit article of their own act, without being one: two equi-joins within the act."""
    found = refs.join(hits.select(act, F.col(article).alias(cited)), [act, cited], "left_semi").select(act, article).distinct()
    return found.join(hits.select(act, article), [act, article], "left_anti")


def choose(articles: DataFrame, act: str, article: str, direct: str, title_hit: str, commences: Column, refs: DataFrame, cited: str) -> DataFrame:
    """Articles that stay, with `match`: the direct reason; in an act with a `number` hit also articles that cite one
    (`related`) and commencement articles; all of an act without any reason whose title is a hit (`title`)."""
    hits = articles.filter(F.col(direct) == "number").select(act, article)
    related = refers_to_hits(refs, hits, act, article, cited).withColumn("_related", F.lit(True))
    rows = articles.join(related, [act, article], "left")
    whole = Window.partitionBy(act)
    cites = F.coalesce(F.bool_or(F.col(direct) == "number").over(whole), F.lit(False))
    rows = rows.withColumn("_cites", cites)
    reason = F.coalesce(direct, F.when(F.col("_cites") & F.col("_related"), "related"), F.when(F.col("_cites") & commences, "commencement"))
    rows = rows.withColumn("match", reason)
    none = ~F.bool_or(F.col("match").isNotNull()).over(whole)
    rows = rows.withColumn("match", F.coalesce("match", F.when(none & F.col(title_hit), "title")))
    return rows.filter("match IS NOT NULL").drop("_related", "_cites")


def cut_at(rows: DataFrame, keys: list[str], position: str, foreign: Column) -> DataFrame:
    """rows before each group's first foreign one that isn't its first row."""
    w = Window.partitionBy(*keys)
    place = F.row_number().over(w.orderBy(position)).alias("_p")
    marked = rows.select("*", place)
    end = F.min(F.when(foreign & (F.col("_p") > 1), F.col("_p"))).over(w)
    return marked.withColumn("_end", end).filter("_end IS NULL OR _p < _end").drop("_p", "_end")


def restated_part(rows: DataFrame, keys: list[str], gid: str, wanted: Column) -> DataFrame:
    """Of a restating article's paragraphs, those without a quote and those whose quoted id is the wanted one or below it;
    all of them where no quoted id is."""
    quoted = F.when(F.instr(gid, "~") > 0, F.element_at(F.split(gid, "~", 2), 2))
    fits = F.coalesce(F.array_contains(ids.ancestors(quoted), wanted), F.lit(False))
    some = F.bool_or(fits).over(Window.partitionBy(*keys))
    return rows.withColumn("_some", some).filter(~F.col("_some") | quoted.isNull() | fits).drop("_some")


def latest_of(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The value of each group's last row."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(out))


def earliest_match(rows: DataFrame, keys: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """The first non-null value of each group by date; groups without one have no row."""
    return rows.withColumn("_v", value).filter("_v IS NOT NULL").groupBy(*keys).agg(F.min_by("_v", F.struct(*order)).alias(out))


def attach_list(rows: DataFrame, edges: DataFrame, key: str, other: str, order: str, out: str) -> DataFrame:
    """rows with the array of each one's edges in order; empty where there is none."""
    refs = edges.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, other))), lambda x: x[other]).alias(out))
    return rows.join(refs, key, "left").withColumn(out, F.coalesce(out, F.array().cast(refs.schema[out].dataType)))


def status(provisions: DataFrame, pointers: DataFrame, key: str) -> DataFrame:
    """provisions with the number of their amendments, the latest date, and a line that says so."""
    p = pointers.groupBy(key).agg(F.count(F.lit(1)).alias("amended"), F.max("published").alias("latest"))
    text = F.when(F.col("amended").isNull(), "Status: no amendment.").otherwise(F.concat(F.lit("Status: amended "), F.col("amended").cast("string"), F.lit(" time(s), latest "), F.coalesce(F.date_format("latest", "yyyy-MM-dd"), F.lit("date unknown")), F.lit(".")))
    return provisions.join(p, key, "left").withColumn("line", text).withColumn("amended", F.coalesce("amended", F.lit(0).cast("long")))


def by_label(labels: DataFrame, cells: DataFrame, page: str, y: str, slack: float = 3) -> DataFrame:
    """The cells of each table row: a cell belongs to the last label that starts at most `slack` below it. Labels and cells
    meet in one window by page, so no pair is made; cells above the first label belong to none."""
    marks = labels.select(page, F.col(y).cast("double").alias("_y"), F.lit(0).alias("_cell"), F.col("label"), F.lit(None).cast("string").alias("text"))
    both = marks.unionByName(cells.select(page, (F.col(y) + slack).cast("double").alias("_y"), F.lit(1).alias("_cell"), F.lit(None).cast("string").alias("label"), "text"))
    w = Window.partitionBy(page).orderBy("_y", "_cell", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = both.withColumn("label", F.last("label", True).over(w)).filter("_cell = 1 AND label IS NOT NULL")
    return rows.groupBy(page, "label").agg(F.array_sort(F.collect_list(F.struct("_y", "text"))).alias("c")).select(page, "label", F.array_join("c.text", " | ").alias("cells"))


def divide(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The keys that have every value there is: relational division by counts of distinct pairs."""
    need = rows.select(value).distinct().agg(F.count(F.lit(1)).alias("_need"))
    have = rows.select(key, value).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("_have"))
    return have.join(F.broadcast(need), F.col("_have") == F.col("_need")).select(key)


def route(rows: DataFrame, keys: list[str], rules: dict[str, Column], out: str) -> DataFrame:
    """A row for each rule that holds; a row may go to several."""
    names = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return rows.select(*keys, F.explode(names).alias(out))


def in_force(published: Column, months: int = 3) -> Column:
    """The day on which a decree starts, so many months after its release."""
    return F.add_months(published, months)


def crosswalk(rows: DataFrame, order: list[str], sources: str, place: str) -> DataFrame:
    """The different (source, place) links of rows with an array of sources, with the place in the order at which each stands
    first; a row names its first source only where `sources` repeats."""
    links = rows.select(F.struct(*order).alias("_at"), F.explode(F.array_distinct(sources)).alias("source"), F.col(place).alias("place"))
    return links.groupBy("source", "place").agg(F.min("_at").alias("first_at"))

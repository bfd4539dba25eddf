"""Documents from rows: nested issues, the article index, Markdown, maps of links, paths of a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) with n = 1; a key that stands twice is an error when the rows are read."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return n.select(key, F.when(F.col("n") == 1, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("repeated id "), F.col(key).cast("string")))).alias("n"))


def issues(paragraphs: DataFrame) -> DataFrame:
    """file and its articles, each with its paragraphs, in printed order. An issue's size is a printed document's."""
    one = paragraphs.groupBy("file", "article").agg(F.min("art_pos").alias("art_pos"), F.first("title").alias("title"), F.array_sort(F.collect_list(F.struct("para_pos", F.col("gid").alias("id"), "text"))).alias("paragraphs"))
    return one.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("art_pos", "article", "title", "paragraphs"))).alias("articles"))


def flat_text(articles: Column) -> Column:
    """All titles and texts of an issue's articles, a space between."""
    return F.array_join(F.transform(articles, lambda a: F.concat_ws(" ", a["title"], F.array_join(a["paragraphs"]["text"], " "))), " ")


def article_index(paragraphs: DataFrame, pointers: DataFrame, article_of: Column) -> DataFrame:
    """For each article: title, place, paragraphs, amendments, and the earliest repeal (undated ones last, then by id)."""
    arts = paragraphs.groupBy("article").agg(F.min("art_pos").alias("at"), F.min("title").alias("title"), F.count(F.lit(1)).alias("n_paragraphs"))
    first = F.min(F.when(F.col("kind") == "repeal", F.struct(F.coalesce("published", F.lit("9999-12-31").cast("date")).alias("d"), "by")))
    p = pointers.groupBy(article_of.alias("article")).agg(F.count(F.lit(1)).alias("amended"), first["by"].alias("repealed_by"))
    return arts.join(p, "article", "left").withColumn("amended", F.coalesce("amended", F.lit(0).cast("long")))


def markdown(rows: DataFrame, document: str, order: list[str], path: str, title: str, text: str) -> DataFrame:
    """A document's lines: its section where that changes, its article where that changes, and the texts."""
    w = Window.partitionBy(document).orderBy(*order)
    new = lambda c: ~F.col(c).eqNullSafe(F.lag(c).over(w)) | (F.row_number().over(w) == 1)
    head = F.when(new(path) & F.col(path).isNotNull(), F.concat(F.lit("## "), path, F.lit("\n")))
    article = F.when(new(title), F.concat(F.lit("### "), title, F.lit("\n")))
    lines = rows.select(document, F.struct(*order, F.concat(F.coalesce(head, F.lit("")), F.coalesce(article, F.lit("")), F.col(text), F.lit("\n")).alias("_line")).alias("_x"))
    return lines.groupBy(document).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["_line"]), "").alias("markdown"))


def nested(rows: DataFrame, outer: str, inner: str, value: str, out: str) -> DataFrame:
    """outer and a map of inner to its sorted distinct values."""
    lists = rows.groupBy(outer, inner).agg(F.array_sort(F.collect_set(value)).alias("_v"))
    return lists.groupBy(outer).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(inner, "_v")))).alias(out))


def tree_paths(rows: DataFrame, tree: str, order: list[str], depth: str, label: str, levels: int, out: str) -> DataFrame:
    """The path to each node of trees in preorder: the last label at each depth above it, and its own."""
    w = Window.partitionBy(tree).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = [F.when(F.lit(k) <= F.col(depth), F.last(F.when(F.col(depth) == k, F.col(label)), True).over(w)) for k in range(levels)]
    return rows.withColumn(out, F.concat_ws(" / ", *above))

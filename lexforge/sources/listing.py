"""Staged listings: the archive's answers about a year's issues, and a PDF tool's listing of images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANSWER = "status string, message string, data string"
RECORD = "array<struct<search_DocumentNumber: string, search_ID: string, search_PublicationDate: string, search_IssueDate: string, search_Pages: string>>"
#: Points; smaller images are logos and stamps.
LEAST_IMAGE = 50


def issues(answers: DataFrame, year: str, body: str) -> DataFrame:
    """One row for each issue of a year: number, search_id, published, issued (only where it differs), pages.

    An answer holds its records as JSON inside a string; of records of one number the last stands. An answer whose status
    isn't ok is an error.
    """
    a = answers.withColumn("_a", F.from_json(body, ANSWER))
    data = F.when(F.col("_a.status") == "ok", F.col("_a.data")).otherwise(F.raise_error(F.concat(F.lit("listing: "), F.coalesce("_a.message", F.lit("no answer")))))
    rows = a.select(year, F.posexplode(F.from_json(data, RECORD)).alias("_pos", "r")).withColumn("number", F.col("r.search_DocumentNumber").cast("int"))
    last = rows.withColumn("_last", F.row_number().over(Window.partitionBy(year, "number").orderBy(F.col("_pos").desc()))).filter("_last = 1")
    day = lambda c: F.to_date(F.element_at(F.split(c, " "), 1), "M/d/yyyy")
    published, masthead = day(F.col("r.search_PublicationDate")), day(F.nullif(F.col("r.search_IssueDate"), F.lit("")))
    return last.select(year, "number", F.col("r.search_ID").cast("long").alias("search_id"), published.alias("published"), F.when(masthead != published, masthead).alias("issued"), F.coalesce(F.col("r.search_Pages").try_cast("int"), F.lit(0)).alias("pages"))


def image_pages(lines: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Pages with a figure or a scanned table, from the lines of an image listing (page, number, type, width, height, …,
    x-ppi, y-ppi in the 13th and 14th column): images of LEAST_IMAGE points or more both ways."""
    f = F.split(F.trim(line), r"\s+")
    number = lambda i: F.try_element_at(f, F.lit(i)).try_cast("double")
    points = lambda size, ppi: F.coalesce(F.try_divide(number(size), number(ppi)) * 72 >= LEAST_IMAGE, F.lit(False))
    return lines.filter((F.size(f) > 13) & (F.try_element_at(f, F.lit(3)) == "image") & points(4, 13) & points(5, 14)).select(*keys, number(1).cast("int").alias("page")).distinct()

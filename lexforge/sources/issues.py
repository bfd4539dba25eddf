"""Issue documents: nested JSON files of acts, articles and paragraphs, read with one explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARAGRAPH = "struct<id string, page int, quoted boolean, printed string, text string>"
ARTICLE = f"struct<article string, label string, title string, page int, headings array<string>, path array<string>, scope string, match string, cut string, image_pages array<int>, paragraphs array<{PARAGRAPH}>>"
ACT = f"struct<act string, title string, signed string, text array<struct<page int, text string>>, articles array<{ARTICLE}>>"
ISSUE = f"title string, fek string, file string, acts_in_issue array<string>, published date, issued date, source string, search_id bigint, pages int, cites string, extract string, review boolean, act string, articles array<{ARTICLE}>, acts array<{ACT}>"


def read_issues(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file; a base text with one act at top level gets it as `acts` too."""
    rows = spark.read.schema(ISSUE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    single = F.array(F.struct("act", "title", F.lit(None).cast("string").alias("signed"), F.lit(None).cast("array<struct<page:int,text:string>>").alias("text"), "articles"))
    return rows.withColumn("acts", F.coalesce("acts", single)).drop("act", "articles").withColumn("id", F.regexp_extract("file", r"([^/]+?)(?:\.\w+)?$", 1))


def articles(issues: DataFrame) -> DataFrame:
    acts = issues.select("file", "published", F.posexplode("acts").alias("act_pos", "a"))
    return acts.select("file", "published", "act_pos", F.col("a.act").alias("act"), F.posexplode("a.articles").alias("art_pos", "x")).select("file", "published", "act_pos", "act", "art_pos", "x.*")


def paragraphs(issues: DataFrame) -> DataFrame:
    """One row for each paragraph in printed order, with its global id."""
    rows = articles(issues).select("file", "published", "act", "article", "art_pos", F.posexplode("paragraphs").alias("para_pos", "p"))
    return rows.select("file", "published", "act", "article", "art_pos", "para_pos", F.concat(F.regexp_extract("file", r"([^/]+?)(?:\.\w+)?$", 1), F.lit(":"), "p.id").alias("gid"), "p.*")


def merge_copies(rows: DataFrame, order: str) -> DataFrame:
    """Articles of copies of one issue: the first copy of each (file, act, article) stays."""
    w = Window.partitionBy("file", "act", "article").orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def write_issues(rows: DataFrame, path: str) -> None:
    rows.write.json(path)

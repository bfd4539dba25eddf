"""Queries of crosswalk tables and base texts: orders as articles of a code whose tables are printed in files of 400 order keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import base_text, crosswalk
from ..session import materialize, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
LAW, FILE = "4067/2012", 400


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """k (order), p (place of the line in it), a, s, y of each line, n lines of the order, whether its first entry is printed early."""
    own = Window.partitionBy("l_orderkey")
    place = F.row_number().over(own.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), place.alias("p"), (F.col("l_partkey") % 60 + 1).alias("a"), F.col("l_suppkey").alias("s"), (F.col("l_partkey") % 12 + 2005).alias("y"), F.count(F.lit(1)).over(own).alias("n"))
    li = li.withColumn("doc", F.floor(F.col("k") / FILE))
    heads = li.filter("p = 1").withColumn("before", F.lag("n").over(Window.partitionBy("doc").orderBy("k"))).select("k", ((F.col("k") % 5 == 0) & (F.col("n") > 1) & (F.col("before") > 1)).alias("early"))
    return li.join(heads.select("k", F.coalesce("early", F.lit(False)).alias("early")), "k")


def crosswalk_lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(lines of the printed tables, their errata). Entries wrap over two lines, with another column far to the right; even articles have
    their number on the line after the label; every seventh one misprints the law in its first entry."""
    rows = _numbered(spark, d)
    text = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    misprint = (F.col("k") % 7 == 0) & (F.col("p") == 1) & ~F.col("early")
    law = F.when(misprint, "4064/2012").otherwise(LAW)
    entry = text("Παρ. ", F.col("p"), " Παρ. ", F.col("s"), " του άρθρου ", F.col("a"))
    more = text("του ν. ", law, ", όπως τροποποιήθηκε με το άρθρο ", F.col("p"), " του ν. ", F.col("s") + 4100, "/", F.col("y"), " (Α΄ 5).")
    label = F.when(F.col("k") % 2 == 0, F.array(F.lit("Άρθρο"))).otherwise(F.array(text("Άρθρο ", F.col("k"))))
    number = F.when(F.col("k") % 2 == 0, text(F.col("k"), "  ")).otherwise("   ")
    first = F.when(F.col("early"), F.col("p") == 2).otherwise(F.col("p") == 1)  # the entry after the label
    wide = F.concat(F.rpad(F.concat(F.when(first, number).otherwise("   "), entry), 108, " "), F.lit("Άρθρο 9 παλαιού κώδικα"))
    printed = F.concat(F.when(first, label).otherwise(F.array().cast("array<string>")), F.array(wide, F.lit("   ΕΦΗΜΕΡΙΔΑ ΤΗΣ ΚΥΒΕΡΝΗΣΕΩΣ 99"), F.concat(F.lit("    "), more)))
    # an early entry stands before its label, at the end of the article before
    at = F.col("k") * 1000 + F.when(F.col("early") & (F.col("p") == 1), -500).otherwise(F.col("p") * 10)
    lines = rows.select("doc", at.alias("at"), F.posexplode(printed).alias("i", "text")).select("doc", (F.col("at") + F.col("i")).alias("at"), "text")
    errata = rows.filter(misprint).select(F.col("k").cast("string").alias("article"), F.lit(1).alias("seq"), text("του άρθρου ", F.col("a"), " του ν. 4064/2012").alias("wrong"), text("του άρθρου ", F.col("a"), " του ν. ", LAW).alias("right"))
    return lines, errata


_LINES = """n AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS p, l_partkey % 60 + 1 AS a, l_suppkey AS s, l_partkey % 12 + 2005 AS y FROM lineitem)"""


@query(f"""WITH {_LINES} SELECT k::VARCHAR AS code_article, p::INTEGER AS seq, p::VARCHAR AS code_paragraph, 'Παρ. ' || p AS code_label, 'Παρ. ' || s || ' του άρθρου ' || a || ' του ν. {LAW}, όπως τροποποιήθηκε με το άρθρο ' || p || ' του ν. ' || (s + 4100) || '/' || y || ' (Α΄ 5).' AS source,
a || '.' || s AS codified, CASE WHEN y >= 2012 THEN (s + 4100) || '/' || y || ':' || p ELSE '' END AS amended_by FROM n""")
def crosswalk_entries(spark, d):
    """The printed table's entries, and the provisions each names: what it codifies and what has changed that since."""
    lines, errata = crosswalk_lines(spark, d)
    printed = materialize(spark, crosswalk.articles(lines, ["doc"], "at", "text"), "crosswalk-articles")  # the errata's check reads it too
    table_ = crosswalk.with_errata(printed, errata)
    rows = crosswalk.provisions(crosswalk.entries(table_, ["doc"]), ["doc"], LAW, 2012)
    return rows.select("code_article", "seq", "code_paragraph", "code_label", "source", F.array_join("codified", ",").alias("codified"), F.array_join(F.transform("amended_by", lambda x: F.concat(x["law"], F.lit(":"), x["article"])), ",").alias("amended_by"))


_HEADS = f"""o AS (SELECT o_orderkey AS k, o_orderkey // {FILE} AS doc, CASE WHEN o_orderkey % 31 = 0 THEN ['ΜΕΡΟΣ ' || o_orderkey] ELSE [] END || CASE WHEN o_orderkey % 11 = 0 THEN ['ΤΜΗΜΑ ' || o_orderkey] ELSE [] END || CASE WHEN o_orderkey % 4 = 0 THEN ['ΚΕΦΑΛΑΙΟ ' || o_orderkey] ELSE [] END AS hs FROM orders)"""


@query(f"""WITH {_HEADS}, m AS (SELECT doc, k, max(CASE WHEN k % 31 = 0 THEN k END) OVER w AS m, max(CASE WHEN k % 11 = 0 THEN k END) OVER w AS t, max(CASE WHEN k % 4 = 0 THEN k END) OVER w AS c FROM o WINDOW w AS (PARTITION BY doc ORDER BY k ROWS UNBOUNDED PRECEDING))
SELECT k, concat_ws(' > ', 'ΜΕΡΟΣ ' || m, CASE WHEN m IS NULL OR t >= m THEN 'ΤΜΗΜΑ ' || t END, CASE WHEN c >= greatest(coalesce(m, 0), coalesce(t, 0)) THEN 'ΚΕΦΑΛΑΙΟ ' || c END) AS path FROM m""")
def section_paths(spark, d):
    """The headings that each article stands under: a part ends the chapters before it."""
    k = F.col("o_orderkey")
    some = lambda n, word: F.when(k % n == 0, F.array(F.concat(F.lit(word + " "), k.cast("string")))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "orders").select(F.floor(k / FILE).alias("doc"), k.alias("k"), F.concat(some(31, "ΜΕΡΟΣ"), some(11, "ΤΜΗΜΑ"), some(4, "ΚΕΦΑΛΑΙΟ")).alias("headings"))
    return base_text.section_paths(rows, ["doc"], "k", "headings").select("k", F.array_join("path", " > ").alias("path"))


@query("""WITH o AS (SELECT o_custkey AS doc, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), r AS (SELECT *, i % 4 = 2 AND i < n AS gone, (i * 2)::BIGINT AS pg FROM o),
l AS (SELECT *, CASE WHEN gone THEN lag(pg) OVER w ELSE pg END AS page FROM r WINDOW w AS (PARTITION BY doc ORDER BY i)), x AS (SELECT *, lead(page) OVER (PARTITION BY doc ORDER BY i) AS nx FROM l),
g AS (SELECT *, list_filter(range(page, greatest(page, coalesce(nx, page)) + 1), lambda p: p % 3 = 0 AND p <= 2 * n) AS im FROM x)
SELECT doc, i::INTEGER AS number, CASE WHEN gone OR i % 4 <> 0 THEN 'Θέμα πρώτο ' || k ELSE 'Άλλο ' || k END AS title, page, gone AS missing, CASE WHEN gone THEN 0 WHEN i % 4 = 3 THEN 1 ELSE 2 END AS paragraphs, array_to_string(im, ',') AS images, CASE WHEN gone AND len(im) > 0 THEN 'missing_text' WHEN gone THEN 'not_parsed' END AS gap FROM g""")
def base_articles(spark, d):
    """A customer's orders as a text: some articles aren't found, some titles lack their first line or spill into a paragraph."""
    own = Window.partitionBy("o_custkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").cast("string").alias("k"), F.row_number().over(own.orderBy("o_orderkey")).cast("int").alias("number"), F.count(F.lit(1)).over(own).alias("n"))
    i = F.col("number")
    gone = (i % 4 == 2) & (i < F.col("n"))
    text = lambda x: F.concat(F.lit(x), F.col("k"))
    title = F.when(i % 4 == 1, text("πρώτο ")).when(i % 4 == 3, "Θέμα").when(i % 4 == 0, text("Άλλο ")).otherwise(text("Θέμα πρώτο "))
    paragraphs = F.array(F.when(i % 4 == 3, text("πρώτο ")).otherwise(text("Κείμενο ")), F.lit("Τέλος."))
    found = o.filter(~gone).select("doc", "number", title.alias("title"), (i * 2).cast("long").alias("page"), paragraphs.alias("paragraphs"))
    contents = o.select("doc", "number", text("Θέμα πρώτο ").alias("title"))
    images = o.groupBy("doc").agg(F.max("n").alias("n")).select("doc", F.explode(F.sequence(F.lit(1).cast("long"), 2 * F.col("n"))).alias("page")).filter("page % 3 = 0")
    rows = base_text.gaps(base_text.aligned(found, contents, ["doc"], "number", "title", "page", "paragraphs"), images, ["doc"], "number", "page")
    return rows.select("doc", "number", "title", "page", "missing", F.size("paragraphs").alias("paragraphs"), F.coalesce(F.array_join("image_pages", ","), F.lit("")).alias("images"), "gap")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)

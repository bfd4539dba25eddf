"""The commands and checks on the test tables: orders as articles, lines as paragraphs, parts as their crosswalk."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..operators import validation
from ..session import table
from .api import Corpus

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def corpus(spark: SparkSession, d: str) -> Corpus:
    li, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    gid = F.concat(F.lit("nok:"), "l_orderkey", F.lit("."), "l_linenumber")
    paragraphs = li.select(F.col("l_returnflag").alias("dataset"), F.concat(F.lit("F"), F.col("l_orderkey") % 100).alias("file"), (F.col("l_orderkey") % 100 == 0).alias("base"), F.col("l_orderkey").cast("string").alias("article"), F.concat(F.lit("order "), "l_orderkey").alias("title"), F.col("l_orderkey").alias("art_pos"), F.col("l_linenumber").alias("para_pos"), gid.alias("gid"), F.concat(F.lit("part "), "l_partkey", F.lit(" from "), "l_suppkey").alias("text"), F.to_date("l_shipdate").alias("published"))
    k = F.col("o_orderkey")
    target = F.concat(F.lit("nok:"), (k % 40).cast("string"))
    below = lambda x, n: F.concat(x, F.lit("."), n.cast("string"))
    targets = F.when(k % 3 == 0, F.array(below(target, k % 4 + 1), below(target, k % 5 + 1)))
    by = F.concat(F.lit("nok:"), k.cast("string"))
    texts = F.when(k % 2 == 0, F.array(below(by, F.lit(1)), below(by, F.lit(3))))
    pointers = orders.select(target.alias("target"), targets.alias("targets"), by.alias("by"), texts.alias("paragraphs"), F.lit("amend").alias("kind"), F.col("o_orderstatus").alias("status"), F.to_date("o_orderdate").alias("published"), F.lit(False).alias("restates"), F.when(k % 7 == 0, F.concat(F.lit("nok:"), (k + 40).cast("string"))).alias("superseded_by"))
    links = li.select(gid.alias("a"), F.concat(F.lit("code:"), "l_partkey").alias("b"))
    sections = orders.select(k.cast("string").alias("article"), F.col("o_orderpriority").alias("path"))
    rules = orders.filter(k % 50 == 0).select(by.alias("article"), k.alias("number"), F.col("o_orderpriority").alias("rule"), F.to_date("o_orderdate").alias("from_date"), F.lit(None).cast("date").alias("from_issued"))
    part = table(spark, d, "part")
    sources = part.select(F.concat(F.lit("code:"), "p_partkey").alias("place"), F.col("p_brand").alias("label"), F.col("p_name").alias("source"))
    return Corpus(paragraphs, pointers, links, sections, rules, sources)


PARAS = "p AS (SELECT l_returnflag AS dataset, 'F' || (l_orderkey % 100) AS file, l_orderkey % 100 = 0 AS base, l_orderkey::VARCHAR AS article, l_orderkey AS art_pos, l_linenumber AS para_pos, 'nok:' || l_orderkey || '.' || l_linenumber AS gid, 'part ' || l_partkey || ' from ' || l_suppkey AS text FROM lineitem)"
POINTERS = "q0 AS (SELECT o_orderkey AS k, 'nok:' || (o_orderkey % 40) AS target, CASE WHEN o_orderkey % 3 = 0 THEN ['nok:' || (o_orderkey % 40) || '.' || (o_orderkey % 4 + 1), 'nok:' || (o_orderkey % 40) || '.' || (o_orderkey % 5 + 1)] ELSE [] END AS targets, 'nok:' || o_orderkey AS by_id, o_orderstatus AS status, o_orderdate::DATE AS published, CASE WHEN o_orderkey % 7 = 0 THEN 'nok:' || (o_orderkey + 40) END AS sup FROM orders)"


@query(f"WITH {PARAS} SELECT dataset, count(DISTINCT file)::BIGINT - max(base::INTEGER) AS issues FROM p GROUP BY dataset")
def command_info(spark, d):
    return corpus(spark, d).info()


@query(f"WITH {PARAS}, h AS (SELECT *, ((length(text) - length(replace(text, 'part 1', ''))) // 6 + (length(text) - length(replace(text, 'from 1', ''))) // 6)::BIGINT AS score, file || ':' || article AS key FROM p WHERE contains(text, 'part 1') AND contains(text, 'from 1')), b AS (SELECT key, max(score) AS best FROM h GROUP BY key ORDER BY best DESC, key LIMIT 8), r AS (SELECT h.*, row_number() OVER (PARTITION BY key ORDER BY score DESC, para_pos, gid, text) AS rnk FROM h) SELECT b.best, r.key, count(*)::BIGINT AS shown, sum(score)::BIGINT AS score FROM r JOIN b USING (key) WHERE rnk <= 3 GROUP BY ALL")
def command_search(spark, d):
    rows = corpus(spark, d).search([[["part 1"]], [["from 1"]]])
    return rows.groupBy("best", "key").agg(F.count(F.lit(1)).alias("shown"), F.sum("score").alias("score"))


@query(f"WITH {PARAS} SELECT count(DISTINCT (file, article))::BIGINT AS articles, count(*)::BIGINT AS paragraphs FROM p WHERE contains(text, 'part 1') AND contains(text, 'from 1')")
def command_found(spark, d):
    return corpus(spark, d).found([[["part 1"]], [["from 1"]]])


@query(f"WITH {PARAS} SELECT file, art_pos, para_pos, gid, text FROM p WHERE article = '7'")
def command_read(spark, d):
    return corpus(spark, d).read("nok:7")


@query(f"WITH {PARAS} SELECT DISTINCT gid FROM p WHERE article = '7'")
def command_nearest(spark, d):
    """An unknown line of a known order: the lines there are."""
    return corpus(spark, d).nearest("nok:7.99")


_MINE = f"{PARAS}, {POINTERS}, c AS (SELECT * FROM q0 WHERE target = 'nok:7' AND published <= DATE '1997-01-01' AND (len(targets) = 0 OR list_contains(targets, 'nok:7.2'))), m AS (SELECT *, coalesce(sup IN (SELECT by_id FROM c), false) AS hidden FROM c)"


@query(f"""WITH {_MINE}, g AS (SELECT m.by_id, coalesce(min(o_orderkey) FILTER (o_orderkey >= m.k), max(o_orderkey)) AS g FROM m, orders WHERE o_orderkey % 50 = 0 AND NOT hidden GROUP BY m.by_id)
SELECT 0 AS part, NULL::DATE AS published, NULL AS by_id, NULL AS status, NULL AS targets, NULL AS rule, NULL::DATE AS starts, gid, text FROM p WHERE gid = 'nok:7.2' OR gid LIKE 'nok:7.2.%'
UNION ALL SELECT DISTINCT 1, m.published, m.by_id, status, array_to_string(targets, ','), o_orderpriority, o_orderdate::DATE, p.gid, p.text FROM m JOIN g ON g.by_id = m.by_id JOIN orders ON o_orderkey = g.g LEFT JOIN p ON m.by_id = 'nok:' || p.article AND (m.k % 2 = 1 OR p.para_pos IN (1, 3)) WHERE NOT hidden""")
def command_history(spark, d):
    """The amendments of one provision: pointers with several targets or none, their own paragraphs, and when each starts."""
    return corpus(spark, d).history("nok:7.2", "1997-01-01").select("part", "published", F.col("by").alias("by_id"), "status", F.array_join("targets", ",").alias("targets"), "rule", "starts", "gid", "text")


@query(f"WITH {_MINE} SELECT count(*) FILTER (NOT hidden)::BIGINT AS amended, max(published) FILTER (NOT hidden) AS latest, count(*) FILTER (hidden)::BIGINT AS hidden FROM m HAVING count(*) > 0")
def command_status(spark, d):
    return corpus(spark, d).status("nok:7.2", "1997-01-01")


@query("SELECT DISTINCT 'code:' || p_partkey AS place, p_brand AS label, p_name AS source FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_orderkey = 7")
def command_trace_sources(spark, d):
    """The crosswalk's rows of the places that an article is linked to."""
    return corpus(spark, d).trace_sources("nok:7")


@query(f"WITH {POINTERS} SELECT target, by_id, published FROM q0 WHERE published >= DATE '1998-01-01' AND (sup IS NULL OR sup NOT IN (SELECT by_id FROM q0))")
def command_changes(spark, d):
    return corpus(spark, d).changes("1998-01-01").select("target", F.col("by").alias("by_id"), "published")


@query("SELECT DISTINCT 'code:' || l_partkey AS \"at\", 'nok:' || l_orderkey || '.' || l_linenumber AS other FROM lineitem WHERE l_partkey = 5")
def command_trace(spark, d):
    return corpus(spark, d).trace("code:5")


@query("WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'), o AS (SELECT k, o_orderpriority AS path, lag(o_orderpriority) OVER (ORDER BY k) AS before FROM a LEFT JOIN orders ON o_orderkey = k) SELECT k::VARCHAR AS article, path, CASE WHEN path IS DISTINCT FROM before THEN path END AS heading FROM o")
def command_toc(spark, d):
    return corpus(spark, d).toc("R").select("article", "path", "heading")


# Checks


RULES = {"capitals": ("error", "[A-Z]{6,}"), "digits in a word": ("warning", "[a-z][0-9]+[a-z]"), "doubled mark": ("warning", "[.,;]{2,}"), "control": ("error", "[\\x00-\\x08]")}


@query("""WITH n AS (SELECT unnest([CASE WHEN regexp_matches(text, '[A-Z]{6,}') THEN 'error:capitals' END, CASE WHEN regexp_matches(text, '[a-z][0-9]+[a-z]') THEN 'warning:digits in a word' END, CASE WHEN regexp_matches(text, '[.,;]{2,}') THEN 'warning:doubled mark' END, CASE WHEN regexp_matches(text, '[\\x00-\\x08]') THEN 'error:control' END]) AS r FROM documents),
s AS (SELECT l_linenumber - lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_partkey, l_linenumber) AS step FROM lineitem),
u AS (SELECT r FROM n WHERE r IS NOT NULL UNION ALL SELECT 'error:repeated id' FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'warning:number out of sequence' FROM s WHERE step NOT IN (0, 1) UNION ALL SELECT 'error:dangling reference' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT split_part(r, ':', 1) AS severity, split_part(r, ':', 2) AS rule, count(*)::BIGINT AS n FROM u GROUP BY ALL""")
def issue_checks(spark, d):
    """Noise in texts, repeated ids, numbers out of sequence and dangling references, counted by rule."""
    docs, li = table(spark, d, "documents"), table(spark, d, "lineitem")
    key = F.concat(F.lit("o:"), "l_orderkey", F.lit("."), "l_linenumber")
    doc = F.col("doc_id").cast("string")
    return validation.report(
        validation.noise(docs, doc, "text", RULES),
        validation.repeated(li, key),
        validation.out_of_sequence(li, "l_orderkey", ["l_shipdate", "l_partkey", "l_linenumber"], "l_linenumber", key),
        validation.dangling(docs, "doc_id", table(spark, d, "labels"), "doc_id", doc),
    )


@query("SELECT user_id, ts::DATE AS day, count(*) FILTER (value > 60)::BIGINT AS n FROM events GROUP BY ALL HAVING count(*) FILTER (value > 60) >= 3")
def flagged_pages(spark, d):
    ev = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return validation.flagged_pages(ev, ["user_id", "day"], F.col("value") > 60, 3)


@query("""WITH e AS (SELECT user_id, event_id // 50 AS page, value AS lo, value + 10 AS hi FROM events), o AS (SELECT user_id, page, min(lo) AS l, max(hi) AS r, count(*) AS n FROM e GROUP BY ALL), u AS (SELECT user_id, page % 2 AS odd, min(lo) AS ul, max(hi) AS ur FROM e GROUP BY ALL)
SELECT user_id, page, CASE WHEN n < 4 THEN ul ELSE l END AS lo, CASE WHEN n < 4 THEN ur ELSE r END AS hi FROM o JOIN u USING (user_id) WHERE u.odd = o.page % 2""")
def page_margins(spark, d):
    e = table(spark, d, "events").select("user_id", F.floor(F.col("event_id") / 50).alias("page"), F.col("value").alias("lo"), (F.col("value") + 10).alias("hi"))
    return validation.margins(e, ["user_id", "page"], "lo", "hi", 4)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus = 'F'")
def scope_filter(spark, d):
    """Paragraphs of a base text, or of the issues' closed lines: one filter that reaches the scan."""
    li = table(spark, d, "lineitem")
    base = F.col("l_returnflag") == "R"
    return li.filter(F.when(base, True).otherwise(F.col("l_linestatus") == "F")).select("l_orderkey", "l_linenumber")


@query("""WITH n AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS j FROM lineitem WHERE l_returnflag = 'N') SELECT 'o:' || o_orderkey AS asked, 'o:' || k || '.' || j AS rest FROM orders JOIN n ON k = o_orderkey""")
def uncodified(spark, d):
    """Provisions that a crosswalk leaves out, related to each order."""
    rest = table(spark, d, "lineitem").filter("l_returnflag = 'N'").select(F.concat(F.lit("o:"), "l_orderkey", F.lit("."), "l_linenumber").alias("rest")).distinct()
    asked = table(spark, d, "orders").select(F.concat(F.lit("o:"), "o_orderkey").alias("asked"))
    return ids.related_join(asked, rest, "asked", "rest")


@query("""WITH c AS (SELECT event_id, user_id, event_type = 'error' AS cap FROM events), g AS (SELECT *, sum(cap::INTEGER) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS t FROM c) SELECT user_id, t::BIGINT AS tab, min(event_id) AS first, max(event_id) AS last FROM g WHERE t > 0 GROUP BY ALL""")
def caption_ranges(spark, d):
    """A table lasts from its caption to the row before the next one."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = table(spark, d, "events").withColumn("tab", F.sum((F.col("event_type") == "error").cast("int")).over(w).cast("long"))
    return rows.filter("tab > 0").groupBy("user_id", "tab").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"))


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)

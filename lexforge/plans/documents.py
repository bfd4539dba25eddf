"""Listings, pages and whole documents on the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import assemble, layout, ledger, provisions, search, validation
from ..session import table
from ..sources import issues, listing
from ..streaming import discovery
from .catalog import FOLD_SQL, PARAS_SQL, paras
from .commands import PARAS, corpus

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT year(o_orderdate)::INTEGER AS year, o_orderkey::INTEGER AS number, o_custkey AS search_id, o_orderdate::DATE AS published, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE - 1 END AS issued, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE (o_orderkey % 90)::INTEGER END AS pages FROM orders")
def listed_issues(spark, d):
    """Answers with two records for each number; the last stands."""
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    us = lambda c: F.date_format(c, "M/d/yyyy")
    k = F.col("o_orderkey")
    record = lambda i, day, pages: F.struct(k.cast("string").alias("search_DocumentNumber"), i.alias("search_ID"), F.concat(us(day), F.lit(" 00:00:00")).alias("search_PublicationDate"), F.when(k % 3 == 0, us(F.date_sub(day, 1))).when(k % 3 == 1, us(day)).otherwise("").alias("search_IssueDate"), pages.alias("search_Pages"))
    records = F.array(record(F.lit("1"), F.date_add("day", 9), F.lit("7")), record(F.col("o_custkey").cast("string"), F.col("day"), F.when(k % 4 == 0, "").otherwise((k % 90).cast("string"))))
    answers = o.select(F.year("day").alias("year"), F.to_json(F.struct(F.lit("ok").alias("status"), F.to_json(records).alias("data"))).alias("body"))
    return listing.issues(answers, "year", "body")


@query("SELECT DISTINCT p_type, p_size AS page FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0 AND least((p_partkey % 400) / 150.0, 300 / 150.0) * 72 >= 50")
def image_pages(spark, d):
    """Rows of an image listing: every fifth is a mask, every seventh has no resolution."""
    k = F.col("p_partkey")
    line = F.format_string("  %d  0 %s %d 300 gray 1 8 jpeg no 5 0 %d 150 10K 1%%", F.col("p_size"), F.when(k % 5 == 0, "smask").otherwise("image"), k % 400, F.when(k % 7 == 0, 0).otherwise(150))
    return listing.image_pages(table(spark, d, "part").select("p_type", line.alias("line")), ["p_type"], "line")


_WORDS = "w AS (SELECT l_orderkey, l_linenumber * 10.0 AS x0, l_linenumber * 10.0 + CASE WHEN l_partkey % 3 = 0 THEN 10 WHEN l_partkey % 3 = 1 THEN 9.7 ELSE 8 END AS x1, CASE WHEN l_suppkey % 2 = 0 THEN 1.0 ELSE 0.5 END AS y0, CASE WHEN l_suppkey % 2 = 0 THEN 9.0 ELSE 5.0 END AS y1, l_partkey::VARCHAR AS t FROM lineitem)"


@query(f"""WITH {_WORDS}, b AS (SELECT *, lag(x1) OVER v AS px, lag(y0) OVER v AS p0, lag(y1) OVER v AS p1 FROM w WINDOW v AS (PARTITION BY l_orderkey ORDER BY x0, x1, t)),
p AS (SELECT *, CASE WHEN px IS NULL OR abs(x0 - px) < 0.15 OR (x0 - px >= 0 AND x0 - px < 0.5 AND y0 < p0 AND y1 - y0 < 0.8 * (p1 - p0)) THEN '' ELSE ' ' END || t AS piece FROM b) SELECT l_orderkey, string_agg(piece, '' ORDER BY x0, x1, t, piece) AS line FROM p GROUP BY l_orderkey""")
def line_texts(spark, d):
    """Parts as the words of an order's line; every third touches the next, others are raised or apart."""
    n, k, even = F.col("l_linenumber") * F.lit(10.0), F.col("l_partkey") % 3, F.col("l_suppkey") % 2 == 0
    words = table(spark, d, "lineitem").select("l_orderkey", n.alias("x0"), (n + F.when(k == 0, 10).when(k == 1, 9.7).otherwise(8)).alias("x1"), F.when(even, 1.0).otherwise(0.5).alias("y0"), F.when(even, 9.0).otherwise(5.0).alias("y1"), F.col("l_partkey").cast("string").alias("text"))
    return layout.line_text(words, ["l_orderkey"])


@query("SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'α) ένα.|β) δύο ' || p_partkey || '.|γ) τρία' WHEN 1 THEN 'α) ένα. γ) δύο ' || p_partkey || '.|β) τρία' ELSE 'ένα. β) δύο ' || p_partkey || '. γ) τρία' END AS clauses FROM part")
def inline_clauses(spark, d):
    k = F.col("p_partkey")
    text = F.concat(F.when(k % 3 == 0, "α) ένα. β) δύο ").when(k % 3 == 1, "α) ένα. γ) δύο ").otherwise("ένα. β) δύο "), k, F.when(k % 3 == 1, ". β) τρία").otherwise(". γ) τρία"))
    return table(spark, d, "part").select(k.alias("k"), F.array_join(layout.split_clauses(text), "|").alias("clauses"))


@query("SELECT file, act, article, arg_min(l_partkey, (l_shipdate, l_partkey, l_suppkey, l_extendedprice)) AS l_partkey FROM (SELECT 'F' || (l_orderkey % 100) AS file, l_orderkey AS act, l_linenumber AS article, * FROM lineitem) GROUP BY ALL")
def merged_articles(spark, d):
    """Copies of an issue's articles: the first copy of each (file, act, article) stays."""
    rows = table(spark, d, "lineitem").select(F.concat(F.lit("F"), F.col("l_orderkey") % 100).alias("file"), F.col("l_orderkey").alias("act"), F.col("l_linenumber").alias("article"), "l_partkey", F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice").alias("rank"))
    return issues.merge_copies(rows, "rank").select("file", "act", "article", "l_partkey")


@query("SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN '6.' || p_size END AS shown FROM part")
def misprints(spark, d):
    """Quoted paragraphs: one printed with another number, one with its own, one unnumbered."""
    k, n = F.col("p_partkey"), F.col("p_size")
    gid = F.when(k % 3 == 2, "26.2~6#1").when(k % 3 == 1, F.concat(F.lit("26.2~6."), n, F.lit("@2"))).otherwise(F.concat(F.lit("26.2~6."), n + 100))
    return table(spark, d, "part").select(k.alias("k"), layout.misprint(gid, F.concat(F.lit("«6."), n, F.lit(". Μετάδοση"))).alias("shown"))


@query("SELECT p_partkey AS k, nfc_normalize(p_name || ' ά' || p_size) AS text FROM part")
def composed_letters(spark, d):
    """An accent after its letter, and one alone, which goes."""
    text = F.concat(F.lit("́"), F.col("p_name"), F.lit(" ά"), F.col("p_size"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), layout.composed(text).alias("text"))


@query(f"WITH {PARAS}, a AS (SELECT file, article, min(art_pos) AS ap FROM p GROUP BY ALL), t AS (SELECT p.file, a.ap, p.article, string_agg(text, ' ' ORDER BY para_pos, gid, text) AS body FROM p JOIN a USING (file, article) GROUP BY ALL) SELECT file, count(*)::INTEGER AS n_articles, md5(string_agg('order ' || article || ' ' || body, ' ' ORDER BY ap)) AS digest FROM t GROUP BY file")
def assembled_issues(spark, d):
    """Paragraphs nested to documents, and their texts in order."""
    return assemble.issues(corpus(spark, d).paragraphs).select("file", F.size("articles").alias("n_articles"), F.md5(assemble.flat_text(F.col("articles"))).alias("digest"))


@query("WITH a AS (SELECT l_orderkey AS k, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL), q AS (SELECT o_orderkey % 40 AS k, count(*)::BIGINT AS amended, arg_min('nok:' || o_orderkey, (o_orderdate::DATE, 'nok:' || o_orderkey)) FILTER (o_orderstatus = 'F') AS rep FROM orders GROUP BY ALL) SELECT a.k::VARCHAR AS article, a.k AS at, 'order ' || a.k AS title, n AS n_paragraphs, coalesce(amended, 0) AS amended, rep AS repealed_by FROM a LEFT JOIN q USING (k)".replace(" AS at,", ' AS "at",'))
def article_index(spark, d):
    c = corpus(spark, d)
    pointers = c.pointers.withColumn("kind", F.when(F.col("status") == "F", "repeal").otherwise("amend"))
    return assemble.article_index(c.paragraphs, pointers, F.regexp_extract("target", r"^nok:(\d+)", 1))


@query("SELECT count(*)::BIGINT AS n FROM orders")
def unique_ids(spark, d):
    """Every id counted once; a repeated one would stop the query."""
    return assemble.unique(table(spark, d, "orders"), "o_orderkey").agg(F.sum("n").alias("n"))


@query("""WITH l AS (SELECT l_orderkey % 100 AS doc, l_orderkey AS art, l_linenumber AS pos, l_partkey::VARCHAR AS txt, o_orderpriority AS path FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey),
h AS (SELECT *, row_number() OVER w AS r, lag(path) OVER w AS bp, lag(art) OVER w AS ba FROM l WINDOW w AS (PARTITION BY doc ORDER BY art, pos, txt)) SELECT doc, string_agg(CASE WHEN path IS NOT NULL AND (r = 1 OR path IS DISTINCT FROM bp) THEN '## ' || path || chr(10) ELSE '' END || CASE WHEN r = 1 OR art <> ba THEN '### order ' || art || chr(10) ELSE '' END || txt || chr(10), '' ORDER BY art, pos, txt) AS markdown FROM h GROUP BY doc""")
def rendered_documents(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") % 100).alias("doc"), F.col("l_orderkey").alias("art"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").cast("string").alias("txt"), F.concat(F.lit("order "), "l_orderkey").alias("title"))
    rows = li.join(table(spark, d, "orders").select(F.col("o_orderkey").alias("art"), F.col("o_orderpriority").alias("path")), "art", "left")
    return assemble.markdown(rows, "doc", ["art", "pos", "txt"], "path", "title", "txt")


@query("SELECT l_suppkey, l_linenumber, string_agg(DISTINCT l_partkey::VARCHAR, ',' ORDER BY l_partkey::VARCHAR) AS parts FROM lineitem GROUP BY ALL")
def nested_links(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", F.col("l_partkey").cast("string").alias("p"))
    return assemble.nested(rows, "l_suppkey", "l_linenumber", "p", "m").select("l_suppkey", F.explode("m").alias("l_linenumber", "parts")).withColumn("parts", F.array_join("parts", ","))


@query("""WITH e AS (SELECT user_id, event_id, event_id % 3 AS depth, event_type || event_id AS lab FROM events), l AS (SELECT *, last_value(CASE WHEN depth = 0 THEN lab END IGNORE NULLS) OVER w AS l0, last_value(CASE WHEN depth = 1 THEN lab END IGNORE NULLS) OVER w AS l1 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, concat_ws(' / ', CASE WHEN depth >= 0 THEN l0 END, CASE WHEN depth >= 1 THEN l1 END, CASE WHEN depth >= 2 THEN lab END) AS path FROM l""")
def tree_paths(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") % 3).alias("depth"), F.concat("event_type", F.col("event_id").cast("string")).alias("lab"))
    return assemble.tree_paths(ev, "user_id", ["event_id"], "depth", "lab", 3, "path").select("event_id", "path")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE, CASE WHEN length(o_orderkey::VARCHAR) < 4 THEN lpad(o_orderkey::VARCHAR, 4, '0') ELSE o_orderkey::VARCHAR END, o_orderkey)::BIGINT AS place FROM orders")
def change_order(spark, d):
    """By day, then by the article's number as text of four places; a longer one isn't cut."""
    k = F.col("o_orderkey").cast("string")
    padded = F.when(F.length(k) < 4, F.lpad(k, 4, "0")).otherwise(k)
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.to_date("o_orderdate"), padded, "o_orderkey")).cast("long").alias("place"))


@query(f"""WITH {PARAS_SQL}, h AS (SELECT doc_id, (length(f) - length(replace(f, 'tion', ''))) // 4 AS score FROM (SELECT doc_id, {FOLD_SQL.format('txt')} AS f FROM paras) WHERE contains(f, 'tion')), b AS (SELECT doc_id, max(score) AS best, count(*) OVER ()::BIGINT AS found FROM h GROUP BY doc_id),
r AS (SELECT *, row_number() OVER (ORDER BY best DESC, doc_id)::BIGINT AS place FROM b) SELECT doc_id, place, place <= 8 AS shown, found, least(found, 24) AS suggested FROM r WHERE place <= 28""")
def search_remainder(spark, d):
    """The eight shown, the next twenty by name, how many there are, and a limit to ask for (the listing is the feature)."""
    hits = search.score_paragraphs(paras(spark, d), [[["tion"]]], "txt")
    return search.listing(hits, "doc_id", F.lit(0), 8).select("doc_id", "place", "shown", "found", "suggested")


_ANCHOR = """WITH RECURSIVE n AS (SELECT user_id, ts::DATE AS day, event_id, value, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY value, event_id) AS rn FROM events),
r AS (SELECT user_id, day, event_id, rn, value AS anchor, 0 AS row_no FROM n WHERE rn = 1 UNION ALL SELECT n.user_id, n.day, n.event_id, n.rn, CASE WHEN n.value - anchor <= 20 THEN anchor ELSE n.value END, CASE WHEN n.value - anchor <= 20 THEN row_no ELSE row_no + 1 END FROM r JOIN n ON n.user_id = r.user_id AND n.day = r.day AND n.rn = r.rn + 1)"""


def _rows(spark, d):
    ev = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_id", "value")
    return ev, layout.rows_by_anchor(ev, ["user_id", "day"], "value", "event_id", 20, "row_no")


@query(f"{_ANCHOR} SELECT user_id, day, event_id, row_no FROM r")
def anchored_rows(spark, d):
    """Events of a user's day as a page's fragments, their value as height."""
    return _rows(spark, d)[1]


@query(f"""{_ANCHOR}, f AS (SELECT user_id, day, row_no, event_id % 500 AS x0, event_id % 500 + 30 AS x1 FROM r), g AS (SELECT *, max(x1) OVER (PARTITION BY user_id, day, row_no ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f),
k AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 - reach > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, day, row_no ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, day, row_no, min(x0) AS x0, max(x1) AS x1, count(*)::BIGINT AS n FROM k GROUP BY user_id, day, row_no, run""")
def merged_fragments(spark, d):
    rows = _rows(spark, d)[1].select("user_id", "day", "row_no", (F.col("event_id") % 500).alias("x0"), (F.col("event_id") % 500 + 30).alias("x1"))
    return layout.merged_fragments(rows, ["user_id", "day", "row_no"], "x0", "x1")


@query("WITH h AS (SELECT user_id, event_type, count(*) FILTER (value > 100) AS n, count(*) AS c FROM events GROUP BY ALL) SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.user_id = e.user_id AND h.event_type = e.event_type AND n >= 5 AND n >= 0.5 * c)")
def clean_layers(spark, d):
    return layout.without_noise_layer(table(spark, d, "events"), ["user_id"], "event_type", F.col("value") > 100, 5).select("event_id")


@query("WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), i AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R'), n AS (SELECT p.l_orderkey, count(*) AS c, count(i.l_orderkey) AS k FROM p LEFT JOIN i USING (l_orderkey, l_linenumber) GROUP BY ALL) SELECT l_orderkey, CASE WHEN c = k THEN 'all' ELSE 'part' END AS lacks FROM n WHERE k > 0")
def image_notes(spark, d):
    li = table(spark, d, "lineitem")
    return layout.image_notes(li, li.filter("l_returnflag = 'R'"), ["l_orderkey"], "l_linenumber")


@query("WITH w AS (SELECT l_suppkey AS k, l_linenumber AS word, count(*) AS n FROM lineitem GROUP BY ALL), g AS (SELECT l_suppkey AS k, l_linenumber AS word, count(*) AS n FROM lineitem WHERE l_quantity > 3 GROUP BY ALL), b AS (SELECT w.k, sum(w.n) AS total, sum(greatest(w.n - coalesce(g.n, 0), 0))::BIGINT AS missing FROM w LEFT JOIN g USING (k, word) GROUP BY w.k) SELECT k, missing FROM b WHERE missing > 5 AND missing > 0.01 * total")
def coverage(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("word"), "l_quantity")
    return validation.coverage(li, li.filter("l_quantity > 3"), "k", "word")


@query("""WITH f AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events WHERE event_type <> 'signup'), k AS (SELECT user_id, ts::DATE AS d, bool_or(event_type = 'purchase') AS p, bool_or(event_type = 'error') AS e FROM events WHERE event_type <> 'signup' GROUP BY ALL), l AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events WHERE event_type = 'signup')
SELECT coalesce(k.user_id, l.user_id) AS user_id, coalesce(k.d, l.d) AS d, CASE WHEN k.d IS NOT NULL AND l.d IS NOT NULL THEN 'confirmed' WHEN k.d IS NULL THEN 'listed' WHEN p THEN 'unchecked' WHEN e THEN 'repeal' ELSE 'matcher' END AS status FROM k FULL OUTER JOIN l ON k.user_id = l.user_id AND k.d = l.d""")
def reconcile_reasons(spark, d):
    ev = table(spark, d, "events").select("user_id", F.to_date("ts").alias("d"), "event_type")
    is_any = lambda t: F.bool_or(F.col("event_type") == t)
    found = ev.filter("event_type <> 'signup'").groupBy("user_id", "d").agg(is_any("purchase").alias("p"), is_any("error").alias("e"))
    listed = ev.filter("event_type = 'signup'").select("user_id", "d").distinct()
    return ledger.reconcile_reasons(found, listed, ["user_id", "d"], {"unchecked": F.col("p"), "repeal": F.col("e")}, "matcher")


@query("""WITH r AS (SELECT l_orderkey, unnest(list_distinct(['s' || l_suppkey, 's' || (l_partkey % 50)])) AS source, 'p' || (l_partkey % 100) AS place FROM lineitem) SELECT source, place, min(l_orderkey) AS at_order FROM r GROUP BY ALL""")
def crosswalk_links(spark, d):
    s = lambda c: F.concat(F.lit("s"), c.cast("string"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array(s(F.col("l_suppkey")), s(F.col("l_partkey") % 50)).alias("sources"), F.concat(F.lit("p"), F.col("l_partkey") % 100).alias("place"))
    return provisions.crosswalk(rows, ["l_orderkey", "l_linenumber"], "sources", "place").select("source", "place", F.col("first_at.l_orderkey").alias("at_order"))


@query("""WITH t AS (SELECT DISTINCT lower(substr(p_name, 1, 3 + p_size % 6)) AS term FROM part WHERE length(p_name) > 0), g AS (SELECT DISTINCT p_brand AS grp, lower(split_part(p_name, ' ', 1 + p_partkey % 2)) AS stem FROM part), hit AS (SELECT DISTINCT t.term, g.grp FROM t JOIN g ON g.stem <> '' AND g.stem NOT LIKE '% %' AND (starts_with(t.term, g.stem) OR (length(t.term) >= 4 AND starts_with(g.stem, t.term))))
SELECT DISTINCT term, stem FROM hit JOIN g USING (grp) UNION SELECT term, term FROM t""")
def search_alternatives(spark, d):
    """Beginnings of names as terms, the words of a brand's names as a synonym group."""
    p = table(spark, d, "part")
    terms = p.select(F.lower(F.substr("p_name", F.lit(1), 3 + F.col("p_size") % 6)).alias("term"))
    groups = p.select(F.col("p_brand").alias("group"), F.lower(F.split_part("p_name", F.lit(" "), (1 + F.col("p_partkey") % 2).cast("int"))).alias("stem")).distinct()
    return search.alternatives(terms, "term", groups)


@query("""WITH y AS (SELECT DISTINCT year(o_orderdate)::INTEGER AS year FROM orders), s AS (SELECT year(o_orderdate)::INTEGER AS year, count(*) FILTER (o_totalprice < 1100) AS failures FROM orders GROUP BY ALL) SELECT year FROM y WHERE year NOT IN (SELECT year FROM s WHERE failures = 0 AND year % 2 = 1 AND year < 1998)""")
def years_to_scan(spark, d):
    """Odd years were scanned with today's needles, even ones with others; 1998 is this year."""
    o = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    state = o.groupBy("year").agg(F.count_if(F.col("o_totalprice") < 1100).alias("failures")).withColumn("needles", F.when(F.col("year") % 2 == 1, F.array(F.lit("b"), F.lit("a"))))
    return discovery.years_to_scan(o.select("year").distinct(), state, ["a", "b"], 1998)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)

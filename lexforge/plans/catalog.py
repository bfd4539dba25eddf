"""The query catalogue on the test tables: a Spark plan and an equivalent DuckDB statement for each name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, textfn
from ..operators import ledger, provisions, search, sequences
from ..streaming import discovery
from ..session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

LICENCE = "(?i)licen[sc]e"
EMAIL = "[A-Za-z0-9._-]+@[A-Za-z0-9.-]+"
TIERS = "CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'es' THEN 2 ELSE 3 END"
KEY = ["l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
FOLD_SQL = f"translate(lower({{}}), '{textfn.FOLD_FROM}', '{textfn.FOLD_TO}')"
PARAS_SQL = """paras AS (SELECT doc_id, lang, source, (i - 1)::BIGINT AS para_pos, trim(ls[i], ' ') AS txt FROM (SELECT *, string_split(text, chr(10)) AS ls
  FROM documents), unnest(range(1, len(ls) + 1)) AS u(i) WHERE trim(ls[i], ' ') <> '')"""
PTR_SQL = """ev AS (SELECT user_id, ts::DATE AS d, event_type, (json_extract(props, '$.k')::BIGINT % 5) AS target FROM events WHERE event_type IN ('purchase', 'signup', 'error')),
ptr AS (SELECT user_id, d, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds, bool_or(event_type = 'signup') AS restates,
  list_sort(list_distinct(list(target))) AS targets, CASE WHEN bool_or(event_type = 'purchase') THEN 'confirmed' WHEN bool_or(event_type = 'error') THEN 'repeal' ELSE 'matcher' END AS status
  FROM ev GROUP BY ALL)"""
SUP_SQL = PTR_SQL + """, sup AS (SELECT p.user_id, p.d, min(q.d) AS superseded_on FROM ptr p JOIN ptr q ON p.user_id = q.user_id AND q.d > p.d
  AND q.status = 'confirmed' AND (q.restates OR list_has_all(q.targets, p.targets)) WHERE p.status = 'matcher' GROUP BY ALL)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def paras(spark: SparkSession, d: str) -> DataFrame:
    return textfn.lines(table(spark, d, "documents"), "doc_id", "lang", "source").withColumn("para_pos", F.col("para_pos").cast("long"))


def pointers(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").filter(F.col("event_type").isin("purchase", "signup", "error"))
    ev = ev.select("user_id", F.to_date("ts").alias("d"), "event_type", (F.get_json_object("props", "$.k").cast("long") % 5).alias("target"))
    is_any = lambda t: F.bool_or(F.col("event_type") == t)
    status = F.when(is_any("purchase"), "confirmed").when(is_any("error"), "repeal").otherwise("matcher")
    return ev.groupBy("user_id", "d").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), is_any("signup").alias("restates"), F.array_sort(F.collect_set("target")).alias("targets"), status.alias("status"))


def superseded_pointers(spark: SparkSession, d: str) -> DataFrame:
    covers = lambda p, q: q("restates") | F.forall(p("targets"), lambda t: F.array_contains(q("targets"), t))
    return ledger.superseded_on(pointers(spark, d), "user_id", "d", F.col("status") == "matcher", F.col("status") == "confirmed", covers)


def line_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").withColumn("gid", F.concat(F.lit("o:"), "l_orderkey", F.lit("."), "l_linenumber"))


# Text and search


@query(f"WITH {PARAS_SQL} SELECT doc_id, lang, para_pos, txt FROM paras")
def explode_lines(spark, d):
    return paras(spark, d).select("doc_id", "lang", "para_pos", "txt")


@query(f"SELECT doc_id, {FOLD_SQL.format('text')} AS folded FROM documents")
def fold_text(spark, d):
    return table(spark, d, "documents").select("doc_id", textfn.fold(F.col("text")).alias("folded"))


@query("SELECT source, lang, count(*)::BIGINT AS n, count(DISTINCT text)::BIGINT AS n_texts FROM documents GROUP BY ALL")
def corpus_counts(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("text").alias("n_texts"))


_HITS = f"""hits AS (SELECT *, {TIERS} AS tier FROM (SELECT doc_id, lang, para_pos, f, ((length(f) - length(replace(f, 'tion', ''))) // 4 + (length(f) - length(replace(f, 'ment', ''))) // 4)::BIGINT AS score
  FROM (SELECT *, {FOLD_SQL.format('txt')} AS f FROM paras) WHERE contains(f, 'tion') AND contains(f, 'ment')))"""


@query(f"""WITH {PARAS_SQL}, {_HITS}, best AS (SELECT doc_id, min(tier) AS t, max(score) AS b FROM hits GROUP BY doc_id ORDER BY t, b DESC, doc_id LIMIT 8)
SELECT doc_id, rnk, para_pos, score FROM (SELECT doc_id, para_pos, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, para_pos)::BIGINT AS rnk FROM hits) WHERE rnk <= 3 AND doc_id IN (SELECT doc_id FROM best)""")
def stem_search(spark, d):
    """Top-3 lines of the best 8 documents (the listing's limit is the feature)."""
    hits = search.score_paragraphs(paras(spark, d), [[["tion"]], [["ment"]]], "txt")
    return search.top_articles(hits, "doc_id", "para_pos", F.expr(TIERS), 8).select("doc_id", "rnk", "para_pos", "score")


@query(f"""WITH {PARAS_SQL}, f AS (SELECT *, {FOLD_SQL.format('txt')} AS f FROM paras)
SELECT doc_id, para_pos, (CASE WHEN contains(f, 'ation') THEN (length(f) - length(replace(f, 'ation', ''))) // 5 ELSE (length(f) - length(replace(f, 'ung', ''))) // 3 + (length(f) - length(replace(f, 'keit', ''))) // 4 END)::BIGINT AS score
FROM f WHERE contains(f, 'ation') OR (contains(f, 'ung') AND contains(f, 'keit'))""")
def search_synonyms(spark, d):
    """One term with a second alternative of two stems."""
    return search.score_paragraphs(paras(spark, d), [[["ation"], ["ung", "keit"]]], "txt").select("doc_id", "para_pos", "score")


_PAGES = """pg AS (SELECT page_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, regexp_extract_all(html, '<p>([^<]*)', 1) AS ps FROM pages),
pp AS (SELECT page_id, title, (i - 1)::BIGINT AS para_pos, lower(ps[i]) AS txt FROM pg, unnest(range(1, len(ps) + 1)) AS u(i))"""


def page_paragraphs(spark, d):
    p = table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), F.posexplode(F.regexp_extract_all("html", F.lit("<p>([^<]*)"), 1)).alias("para_pos", "txt"))
    return p.withColumn("para_pos", F.col("para_pos").cast("long")).withColumn("txt", F.lower("txt"))


@query(f"""WITH {_PAGES} SELECT page_id, (max((length(txt) - length(replace(txt, 'ation', ''))) // 5 + CASE WHEN contains(title, 'ation') THEN 2 ELSE 0 END) + max(CASE WHEN contains(title, 'ation') THEN 10 ELSE 0 END))::BIGINT AS score
FROM pp WHERE contains(txt, 'ation') GROUP BY page_id""")
def search_title_bonus(spark, d):
    hits = search.score_paragraphs(page_paragraphs(spark, d), [[["ation"]]], "txt", "title")
    return hits.groupBy("page_id").agg((F.max("score") + F.max(F.when(F.col("title").contains("ation"), 10).otherwise(0))).cast("long").alias("score"))


@query(f"""WITH {PARAS_SQL}, h AS (SELECT doc_id, para_pos, txt, greatest(0, instr(lower(txt), 'tion') - 1 - 86) AS early FROM paras WHERE contains(lower(txt), 'tion')),
s AS (SELECT *, CASE WHEN early > 0 AND instr(substr(txt, early + 1), ' ') > 0 THEN early + instr(substr(txt, early + 1), ' ') ELSE early END AS start FROM h), c AS (SELECT *, substr(txt, start + 1, 260) AS part FROM s),
e AS (SELECT *, start + length(part) >= length(txt) AS whole, length(part) - instr(reverse(part), ' ') AS last FROM c)
SELECT doc_id, para_pos, CASE WHEN length(txt) <= 260 THEN txt ELSE CASE WHEN start > 0 THEN '…' ELSE '' END || CASE WHEN whole OR instr(part, ' ') = 0 OR last = 0 THEN part ELSE substr(part, 1, last) END || CASE WHEN whole THEN '' ELSE '…' END END AS snip FROM e""")
def search_snippet(spark, d):
    h = paras(spark, d).withColumn("at", F.instr(F.lower("txt"), "tion")).filter("at > 0")
    return h.select("doc_id", "para_pos", textfn.snippet(F.col("txt"), F.col("at")).alias("snip"))


@query(f"""SELECT doc_id, len(regexp_extract_all(text, '{LICENCE}'))::BIGINT AS n_licence, len(regexp_extract_all(text, '{EMAIL}'))::BIGINT AS n_email, len(regexp_extract_all(text, '[0-9]+'))::BIGINT AS n_numbers,
regexp_matches(text, '{LICENCE}') AND NOT regexp_matches(text, '{EMAIL}') AS review FROM documents""")
def needle_counts(spark, d):
    counts = discovery.needle_counts(table(spark, d, "documents").select("doc_id", "text"), {"n_licence": LICENCE, "n_email": EMAIL, "n_numbers": "[0-9]+"})
    return counts.withColumn("review", (F.col("n_licence") > 0) & (F.col("n_email") == 0))


@query(f"""WITH n AS (SELECT doc_id, regexp_matches(text, '{LICENCE}') AS lic, regexp_matches(text, '{EMAIL}') AS mail, contains(text, '|') AS tab FROM documents)
SELECT doc_id, 'licence' AS dataset FROM n WHERE lic UNION ALL SELECT doc_id, 'contact' FROM n WHERE mail UNION ALL SELECT doc_id, 'table' FROM n WHERE tab""")
def issue_routing(spark, d):
    """A document may go to several datasets."""
    t = F.col("text")
    return provisions.route(table(spark, d, "documents"), ["doc_id"], {"licence": t.rlike(LICENCE), "contact": t.rlike(EMAIL), "table": t.contains("|")}, "dataset")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def false_match_anti(spark, d):
    bad = table(spark, d, "labels").filter("quality = 0").select("doc_id")
    return table(spark, d, "documents").select("doc_id", "source").join(bad, "doc_id", "left_anti")


@query("""SELECT md5(text) AS text_key, min(doc_id) AS doc_id, count(*)::BIGINT AS copies, array_to_string(list_sort(list_distinct(list(source))), ' or ') AS sources FROM documents GROUP BY text""")
def merge_copies(spark, d):
    g = table(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("text_key")).groupBy("text_key")
    return g.agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.array_join(F.array_sort(F.collect_set("source")), " or ").alias("sources"))


# Ids


@query("""SELECT l_orderkey, l_linenumber, 'o:' || l_orderkey AS ancestor FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'o:' || l_orderkey || '.' || l_linenumber FROM lineitem""")
def id_ancestors(spark, d):
    return line_ids(spark, d).select("l_orderkey", "l_linenumber", F.explode(ids.ancestors(F.col("gid"))).alias("ancestor"))


@query("""SELECT 'o:' || o_orderkey AS outer_id, count(*)::BIGINT AS n_within, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def within_join_all(spark, d):
    """Lines within every order."""
    outer = table(spark, d, "orders").select(F.concat(F.lit("o:"), "o_orderkey").alias("outer_id"))
    got = ids.within_join(line_ids(spark, d).select("gid", "l_quantity"), outer, "gid", "outer_id")
    return got.groupBy("outer_id").agg(F.count(F.lit(1)).alias("n_within"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem), b AS (SELECT o_orderkey AS k, NULL AS n FROM orders UNION ALL SELECT k, n FROM a)
SELECT 'o:' || a.k || '.' || a.n AS gid, 'o:' || b.k || coalesce('.' || b.n, '') AS other FROM a JOIN b ON a.k = b.k AND (b.n IS NULL OR a.n = b.n)""")
def related_join_all(spark, d):
    """Every line's id against every order's and every line's."""
    a = line_ids(spark, d).select("gid").distinct()
    b = table(spark, d, "orders").select(F.concat(F.lit("o:"), "o_orderkey").alias("other")).unionByName(a.select(F.col("gid").alias("other")))
    return ids.related_join(a, b, "gid", "other")


@query("""SELECT o_orderkey, 'o:' || o_orderkey AS wanted FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""")
def locate_miss(spark, d):
    have = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return table(spark, d, "orders").join(have, "o_orderkey", "left_anti").select("o_orderkey", F.concat(F.lit("o:"), "o_orderkey").alias("wanted"))


@query("""SELECT p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey)::BIGINT AS rnk FROM part""")
def natural_sort(spark, d):
    """Ids p:<n> in natural order (numbers as numbers) within a type."""
    gid = F.concat(F.lit("p:"), "p_partkey")
    return table(spark, d, "part").select("p_partkey", F.row_number().over(Window.partitionBy("p_type").orderBy(textfn.natural_key(gid))).cast("long").alias("rnk"))


@query("""SELECT 'o:' || l_orderkey || '.' || l_linenumber || CASE WHEN k > 1 THEN '@' || k ELSE '' END AS gid FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS k FROM lineitem)""")
def repeat_ids(spark, d):
    k = F.row_number().over(Window.partitionBy("gid").orderBy(*KEY))
    return line_ids(spark, d).withColumn("k", k).select(F.concat("gid", F.when(F.col("k") > 1, F.concat(F.lit("@"), "k")).otherwise("")).alias("gid"))


@query("""WITH c AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), want AS (SELECT l_orderkey, l_linenumber + 1 AS n FROM c)
SELECT w.l_orderkey, w.n::BIGINT AS wanted, CASE WHEN c.l_orderkey IS NULL THEN 'o:' || w.l_orderkey ELSE 'o:' || w.l_orderkey || '.' || w.n END AS resolved FROM want w LEFT JOIN c ON c.l_orderkey = w.l_orderkey AND c.l_linenumber = w.n""")
def longest_prefix_resolve(spark, d):
    """The deepest existing id on the way to a cited one: candidate prefixes, semi-join, longest."""
    have = line_ids(spark, d).select("l_orderkey", "l_linenumber", "gid").distinct()
    cited = have.select("l_orderkey", (F.col("l_linenumber") + 1).cast("long").alias("wanted")).withColumn("cited", F.concat(F.lit("o:"), "l_orderkey", F.lit("."), "wanted"))
    return ids.longest_prefix(cited, have, ["l_orderkey", "wanted"], "cited", "gid", "resolved")


# Ledger


@query(f"WITH {PTR_SQL} SELECT user_id, d, kinds, restates, array_to_string(targets, ',') AS targets, status FROM ptr")
def ledger_group(spark, d):
    return pointers(spark, d).withColumn("targets", F.array_join(F.transform("targets", lambda x: x.cast("string")), ","))


@query(f"WITH {SUP_SQL} SELECT user_id, d, superseded_on FROM sup")
def superseded(spark, d):
    return superseded_pointers(spark, d).filter("superseded_on IS NOT NULL").select("user_id", "d", "superseded_on")


@query(f"WITH {SUP_SQL} SELECT user_id, d, status FROM ptr LEFT JOIN sup USING (user_id, d) WHERE d <= DATE '2024-01-15' AND (superseded_on IS NULL OR superseded_on > DATE '2024-01-15')")
def history_as_of(spark, d):
    return ledger.as_of(superseded_pointers(spark, d), "d", "2024-01-15").select("user_id", "d", "status")


@query(f"WITH {SUP_SQL} SELECT user_id, d, status, row_number() OVER (PARTITION BY user_id ORDER BY d)::BIGINT AS place FROM ptr LEFT JOIN sup USING (user_id, d) WHERE d >= DATE '2024-01-10' AND superseded_on IS NULL")
def changes_since(spark, d):
    rows = superseded_pointers(spark, d).filter("superseded_on IS NULL AND d >= DATE '2024-01-10'")
    return rows.select("user_id", "d", "status", F.row_number().over(Window.partitionBy("user_id").orderBy("d")).cast("long").alias("place"))


@query("""WITH a AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events WHERE event_type = 'purchase'), b AS (SELECT DISTINCT user_id, ts::DATE AS d FROM events WHERE event_type = 'signup')
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.d, b.d) AS d, CASE WHEN a.d IS NOT NULL AND b.d IS NOT NULL THEN 'confirmed' WHEN a.d IS NOT NULL THEN 'unchecked' ELSE 'listed' END AS status FROM a FULL OUTER JOIN b ON a.user_id = b.user_id AND a.d = b.d""")
def reconcile_status(spark, d):
    ev = table(spark, d, "events").select("user_id", F.to_date("ts").alias("d"), "event_type")
    of = lambda t: ev.filter(F.col("event_type") == t).select("user_id", "d").distinct()
    return ledger.reconcile(of("purchase"), of("signup"), ["user_id", "d"])


@query(f"WITH {PTR_SQL} SELECT user_id, min(d) AS first_repeal, count(*)::BIGINT AS n FROM ptr WHERE status = 'repeal' GROUP BY user_id")
def repeal_first(spark, d):
    return pointers(spark, d).filter("status = 'repeal'").groupBy("user_id").agg(F.min("d").alias("first_repeal"), F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT user_id, event_id FROM events WHERE event_type = 'click'), p AS (SELECT user_id, event_id FROM events WHERE event_type = 'purchase')
SELECT * FROM (SELECT c.user_id, c.event_id, coalesce((SELECT min(p.event_id) FROM p WHERE p.user_id = c.user_id AND p.event_id >= c.event_id), (SELECT max(p.event_id) FROM p WHERE p.user_id = c.user_id)) AS rule_event_id FROM c) WHERE rule_event_id IS NOT NULL""")
def governing_commencement(spark, d):
    ev = table(spark, d, "events")
    of = lambda t: ev.filter(F.col("event_type") == t).select("user_id", "event_id")
    return ledger.forward_asof(of("click"), of("purchase"), "user_id", "event_id", "event_id", "rule_event_id")


@query("""SELECT event_id, (ts::DATE + (json_extract(props, '$.k')::INTEGER % 30))::DATE AS from_date, (ts::DATE + INTERVAL 3 MONTH)::DATE AS in_force FROM events WHERE event_type = 'signup'""")
def start_dates(spark, d):
    day = F.to_date("ts")
    return table(spark, d, "events").filter("event_type = 'signup'").select("event_id", F.date_add(day, (F.get_json_object("props", "$.k").cast("int") % 30)).alias("from_date"), provisions.in_force(day).alias("in_force"))


# Graph and completeness


@query("""SELECT DISTINCT l_partkey AS p_partkey, l_suppkey AS s_suppkey, n_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey""")
def trace_two_hop(spark, d):
    links = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    place = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    return links.join(place, "s_suppkey").select("p_partkey", "s_suppkey", "n_name")


@query("""SELECT l_orderkey, (l_linenumber + i)::BIGINT AS cited FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), unnest(range(0, 3)) AS u(i)""")
def xref_expand_all(spark, d):
    """The ranges of every line."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return rows.select("l_orderkey", F.explode(F.sequence(F.col("l_linenumber").cast("long"), (F.col("l_linenumber") + 2).cast("long"))).alias("cited"))


@query("""WITH b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS word FROM benchmark), dw AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS word FROM documents)
SELECT item_id, doc_id, count(*)::BIGINT AS n FROM b JOIN dw USING (word) GROUP BY ALL""")
def mention_join(spark, d):
    """Documents that name a long word of a benchmark item: exploded mentions and an equi-join, no pattern per row."""
    of = lambda t, k: table(spark, d, t).select(k, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{9,})"), 1))).alias("word"))
    return of("benchmark", "item_id").join(of("documents", "doc_id"), "word").groupBy("item_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_suppkey FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY l_suppkey HAVING count(DISTINCT l_returnflag || l_linestatus) = (SELECT count(DISTINCT l_returnflag || l_linestatus) FROM lineitem)""")
def chapter_division(spark, d):
    """Relational division: suppliers that have every (flag, status) there is."""
    return provisions.divide(table(spark, d, "lineitem").withColumn("k", F.concat("l_returnflag", "l_linestatus")), "l_suppkey", "k")


@query("""SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 20""")
def not_codified(spark, d):
    have = table(spark, d, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 20").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").join(have, "p_partkey", "left_anti")


@query("""SELECT 'label' AS source, doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)""")
def completeness_gaps(spark, d):
    def gap(name, have, want, key):
        return have.join(want, have[key] == want["_w"], "left_anti").select(F.lit(name).alias("source"), F.col(key).alias("id"))

    of = lambda t, c: table(spark, d, t).select(F.col(c).alias("_w"))
    parts = [gap("label", table(spark, d, "documents"), of("labels", "doc_id"), "doc_id"), gap("customer", table(spark, d, "customer"), of("orders", "o_custkey"), "c_custkey"), gap("supplier", table(spark, d, "supplier"), of("lineitem", "l_suppkey"), "s_suppkey")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT 'error' AS severity, 'orphan line' AS rule, count(*)::BIGINT AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'warning', 'repeated id', count(*)::BIGINT FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'error', 'negative price', count(*)::BIGINT FROM lineitem WHERE l_extendedprice < 0""")
def integrity_violations(spark, d):
    li, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    n = lambda df, s, r: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("severity"), F.lit(r).alias("rule"), "n")
    orphan = li.join(orders, li["l_orderkey"] == orders["o_orderkey"], "left_anti")
    again = li.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    return n(orphan, "error", "orphan line").unionByName(n(again, "warning", "repeated id")).unionByName(n(li.filter("l_extendedprice < 0"), "error", "negative price"))


# Quality


@query("""WITH e AS (SELECT w AS word, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS w FROM benchmark) GROUP BY ALL), g AS (SELECT w AS word, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS w FROM conversations) GROUP BY ALL)
SELECT word, greatest(e.n - coalesce(g.n, 0), 0)::BIGINT AS missing FROM e LEFT JOIN g USING (word)""")
def word_bag_diff(spark, d):
    e, g = (textfn.bag(table(spark, d, t).withColumnRenamed("text", "txt")) for t in ("benchmark", "conversations"))
    return textfn.lacking(e, g)


@query("""SELECT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS word FROM benchmark) EXCEPT SELECT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS word FROM documents)""")
def invented_words(spark, d):
    e, g = (textfn.bag(table(spark, d, t).withColumnRenamed("text", "txt")).select("word") for t in ("benchmark", "documents"))
    return e.join(g, "word", "left_anti")


@query("""WITH dw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS word FROM documents), bw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS word FROM benchmark)
SELECT word FROM bw WHERE word NOT IN (SELECT word FROM dw) AND EXISTS (SELECT 1 FROM unnest(range(2, length(word) - 1)) AS u(k) WHERE substr(word, 1, k) IN (SELECT word FROM dw) AND substr(word, k + 1) IN (SELECT word FROM dw))""")
def fragment_forgive(spark, d):
    """Missing words that are a known prefix and a known suffix."""
    known, want = (textfn.bag(table(spark, d, t).withColumnRenamed("text", "txt")).select("word") for t in ("documents", "benchmark"))
    miss = want.join(known, "word", "left_anti").filter(F.length("word") >= 4)
    cut = miss.withColumn("k", F.explode(F.sequence(F.lit(2), F.length("word") - 2)))
    cut = cut.select("word", F.substr("word", F.lit(1), F.col("k")).alias("a"), F.substr("word", F.col("k") + 1).alias("b"))
    return cut.join(known.withColumnRenamed("word", "a"), "a", "left_semi").join(known.withColumnRenamed("word", "b"), "b", "left_semi").select("word").distinct()


NOISE = {"control": "[\\x01-\\x08]", "runs": "(aaa|eee|ooo|!!|##)", "pipes": "[|]", "caps": "[A-Z]{12,}", "merged": "[a-z]{24,}"}


@query(f"WITH {PARAS_SQL} " + " UNION ALL ".join(f"SELECT doc_id, para_pos, '{k}' AS rule FROM paras WHERE regexp_matches(txt, '{v}')" for k, v in NOISE.items()))
def noise_rules(spark, d):
    found = F.array_compact(F.array(*(F.when(F.col("txt").rlike(v), F.lit(k)) for k, v in NOISE.items())))
    return paras(spark, d).select("doc_id", "para_pos", F.explode(found).alias("rule"))


@query("""SELECT doc_id, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{16,}')) AS w FROM documents) GROUP BY doc_id""")
def merged_words(spark, d):
    return textfn.bag(table(spark, d, "documents"), "doc_id", text="text", pattern="[a-z]{16,}").groupBy("doc_id").agg(F.sum("n").alias("n"))


# Windows

_FULL = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"


@query(f"""SELECT l_orderkey, l_linenumber, prev FROM (SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY {_FULL}) AS prev FROM lineitem) WHERE l_linenumber - prev NOT IN (0, 1)""")
def sequence_gaps(spark, d):
    return sequences.jumps(table(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", *KEY], "l_linenumber", "prev").select("l_orderkey", "l_linenumber", "prev")


@query("""SELECT user_id, event_id, prev FROM (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE value < prev""")
def order_backwards(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").withColumn("prev", F.lag("value").over(w)).filter("value < prev").select("user_id", "event_id", "prev")


@query(f"""SELECT l_orderkey, pos, coalesce(last_value(CASE l_returnflag WHEN 'A' THEN true WHEN 'R' THEN false END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS inside
FROM (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_FULL})::BIGINT AS pos FROM lineitem)""")
def quote_state(spark, d):
    li = table(spark, d, "lineitem").withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", *KEY)).cast("long"))
    return sequences.quote_state(li, ["l_orderkey"], ["pos"], F.col("l_returnflag") == "A", F.col("l_returnflag") == "R").select("l_orderkey", "pos", "inside")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER w AS section, CASE WHEN event_type = 'signup' THEN NULL ELSE last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w END AS sub FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def heading_carry(spark, d):
    at = lambda t: F.when(F.col("event_type") == t, F.col("event_id"))
    rows = sequences.carry_forward(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], at("signup"), "section")
    rows = sequences.carry_forward(rows, ["user_id"], ["ts", "event_id"], at("purchase"), "sub")
    return rows.select("event_id", "section", F.when(F.col("event_type") != "signup", F.col("sub")).alias("sub"))


@query("""WITH s AS (SELECT l_orderkey, min(l_linenumber) AS lo, max(l_linenumber) AS hi FROM lineitem GROUP BY ALL), e AS (SELECT l_orderkey, unnest(range(lo, hi + 1))::INTEGER AS l_linenumber FROM s)
SELECT e.l_orderkey, e.l_linenumber, c.l_orderkey IS NULL AS missing FROM e LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) c ON c.l_orderkey = e.l_orderkey AND c.l_linenumber = e.l_linenumber""")
def gap_fill(spark, d):
    return sequences.fill_gaps(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("""SELECT conv_id, turn, lead(turn, 1, turn) OVER (PARTITION BY conv_id ORDER BY turn) AS last_page FROM (SELECT DISTINCT conv_id, turn FROM conversations)""")
def page_range(spark, d):
    return sequences.last_page(table(spark, d, "conversations").select("conv_id", "turn").distinct(), ["conv_id"], "turn", "last_page")


@query("""SELECT user_id, island, count(*)::BIGINT AS n FROM (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 12 HOUR THEN 1 ELSE 0 END AS b FROM events)) GROUP BY ALL""")
def gap_islands(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = table(spark, d, "events").withColumn("_gap", F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w), F.lit(0)) > 12 * 3600 * 1000000)
    return sequences.islands(ev, ["user_id"], ["ts", "event_id"], F.col("_gap")).groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH i AS (SELECT l_suppkey, l_orderkey AS lo, l_orderkey + l_linenumber AS hi FROM lineitem), r AS (SELECT *, max(hi) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
k AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 20 THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS run FROM r) SELECT l_suppkey, min(lo) AS lo, max(hi) AS hi, count(*)::BIGINT AS n FROM k GROUP BY l_suppkey, run""")
def interval_merge(spark, d):
    i = table(spark, d, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("lo"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("hi"))
    return sequences.merge_intervals(i, ["l_suppkey"], "lo", "hi", 20)


@query("""SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn RANGE UNBOUNDED PRECEDING)::BIGINT AS band FROM conversations""")
def reading_bands(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w).alias("band"))


@query("SELECT p_brand, quantile_disc(p_size, 0.5) AS median_size, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY p_brand")
def lower_median(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY p_size)").cast("int").alias("median_size"), F.min("p_size").alias("lo"), F.max("p_size").alias("hi"))


@query("""SELECT p_brand, p_size, n FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS r FROM (SELECT p_brand, p_size, count(*)::BIGINT AS n FROM part GROUP BY ALL)) WHERE r = 1""")
def mode_edge(spark, d):
    return sequences.mode(table(spark, d, "part"), ["p_brand"], "p_size")


@query("""SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_marker FROM events""")
def next_marker(spark, d):
    return sequences.next_value(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")), "next_marker").select("event_id", "next_marker")


# Listings


@query("""SELECT 0 AS depth, r_name AS path FROM region UNION ALL SELECT 1, r_name || ' / ' || n_name FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 2, r_name || ' / ' || n_name || ' / ' || s_name FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey""")
def toc_tree(spark, d):
    r, n, s = (table(spark, d, t) for t in ("region", "nation", "supplier"))
    rn = r.join(n, F.col("n_regionkey") == F.col("r_regionkey"))
    rns = rn.join(s, F.col("s_nationkey") == F.col("n_nationkey"))
    row = lambda df, k, *c: df.select(F.lit(k).alias("depth"), F.concat_ws(" / ", *c).alias("path"))
    return row(r, 0, "r_name").unionByName(row(rn, 1, "r_name", "n_name")).unionByName(row(rns, 2, "r_name", "n_name", "s_name"))


@query("""SELECT conv_id, string_agg('**' || role || '** ' || text, chr(10) ORDER BY turn, role, text) AS markdown FROM conversations GROUP BY conv_id""")
def render_markdown(spark, d):
    line = F.concat(F.lit("**"), "role", F.lit("** "), "text")
    rows = table(spark, d, "conversations").filter("text IS NOT NULL AND role IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))).alias("ls"))
    return rows.select("conv_id", F.array_join("ls.line", "\n").alias("markdown"))


@query("""WITH b AS (SELECT source, doc_id // 1024 AS block, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS h FROM documents GROUP BY ALL) SELECT source, sha256(string_agg(h, '' ORDER BY block)) AS digest FROM b GROUP BY source""")
def digest(spark, d):
    """A digest by source: of the digests of its blocks of 1,024 ids in order, so no task gathers a whole source's documents."""
    joined = lambda x: F.sha2(F.array_join(F.array_sort(F.collect_list(x)).getField("h"), ""), 256)
    rows = table(spark, d, "documents").select("source", F.floor(F.col("doc_id") / 1024).alias("block"), F.struct("doc_id", F.sha2("text", 256).alias("h")).alias("x"))
    blocks = rows.groupBy("source", "block").agg(joined("x").alias("h"))
    return blocks.groupBy("source").agg(joined(F.struct("block", "h")).alias("digest"))


@query("""SELECT dataset, count(*)::BIGINT - 1 AS issues FROM (SELECT source AS dataset, doc_id FROM documents UNION SELECT 'lang-' || lang, doc_id FROM documents) GROUP BY dataset""")
def info_counts(spark, d):
    member = F.array_union(F.array("source"), F.array(F.concat(F.lit("lang-"), "lang")))
    return table(spark, d, "documents").select(F.explode(member).alias("dataset")).groupBy("dataset").agg((F.count(F.lit(1)) - 1).alias("issues"))


# Sequences, streams, pages


@query(f"""WITH n AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_quantity, {_FULL})::BIGINT AS pos FROM lineitem),
h AS (SELECT l_suppkey, l_orderkey, min(pos) AS fp, arg_min(l_linenumber, pos) AS f, max(CASE WHEN l_linenumber <> 1 THEN pos END) AS lo FROM n GROUP BY ALL),
g AS (SELECT *, lead(l_orderkey) OVER w AS nx, lead(f) OVER w AS nf FROM h WINDOW w AS (PARTITION BY l_suppkey ORDER BY fp))
SELECT n.l_suppkey, n.pos, CASE WHEN l_linenumber = 1 AND n.pos > lo AND nf > 1 THEN nx ELSE n.l_orderkey END AS repaired FROM n JOIN g ON g.l_suppkey = n.l_suppkey AND g.l_orderkey = n.l_orderkey""")
def boundary_repair(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_quantity", "l_linenumber", *KEY)
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.row_number().over(w).cast("long").alias("pos"))
    return sequences.repair_boundaries(rows, ["l_suppkey"], "l_orderkey", "l_linenumber", "pos").select("l_suppkey", "pos", "repaired")


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{LICENCE}'))::BIGINT AS licence, len(regexp_extract_all(text, '{EMAIL}'))::BIGINT AS mail FROM documents")
def discovery_stream(spark, d):
    """The documents as a file-source stream, scanned until nothing is left: equal to the batch result."""
    schema = table(spark, d, "documents").schema
    found = discovery.scan_stream(spark, d, "documents.parquet", schema, {"licence": LICENCE, "mail": EMAIL})
    return found.select("doc_id", "licence", "mail")


@query("""WITH old AS (SELECT source, doc_id, 'old' AS seen FROM documents WHERE lang <> 'de'), new AS (SELECT source, doc_id, 'new' AS seen FROM documents WHERE source IN ('src1', 'src2'))
SELECT * FROM old WHERE source NOT IN (SELECT source FROM new) UNION ALL SELECT * FROM new""")
def rescan_upsert(spark, d):
    docs = table(spark, d, "documents")
    old = docs.filter("lang <> 'de'").select("source", "doc_id", F.lit("old").alias("seen"))
    return discovery.upsert(old, docs.filter("source IN ('src1', 'src2')").select("source", "doc_id", F.lit("new").alias("seen")), "source")


@query(f"""WITH RECURSIVE {PARAS_SQL}, n AS (SELECT doc_id, length(txt)::BIGINT + 1 AS size, row_number() OVER (PARTITION BY doc_id ORDER BY para_pos) AS k FROM paras),
p AS (SELECT doc_id, k, 1::BIGINT AS page, size AS used FROM n WHERE k = 1 UNION ALL SELECT n.doc_id, n.k, CASE WHEN p.used + n.size > 2000 THEN p.page + 1 ELSE p.page END, CASE WHEN p.used + n.size > 2000 THEN n.size ELSE p.used + n.size END FROM p JOIN n ON n.doc_id = p.doc_id AND n.k = p.k + 1)
SELECT doc_id, page, count(*)::BIGINT AS n_lines FROM p GROUP BY doc_id, page""")
def pagination(spark, d):
    """Greedy pages of 2,000 characters: a fold over a document's line sizes."""
    sizes = F.transform(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.length(x).cast("long") + 1)
    pages = table(spark, d, "documents").select("doc_id", F.explode(textfn.pages(sizes, 2000)).alias("page"))
    return pages.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_lines"))


def _others():
    from . import codes, commands, documents, printed, provisions

    return (provisions, commands, documents, printed, codes)


def queries():
    return dict(QUERIES) | {k: q for m in _others() for k, q in m.queries().items()}


def oracle_sql():
    return dict(ORACLES) | {k: q for m in _others() for k, q in m.oracle_sql().items()}

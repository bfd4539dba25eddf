"""Queries of the operators over provisions on the test tables: texts and ids are written from a table's rows, and the SQL
computes from the same rows what the operators have to find in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import amend, greek, ids, phrases
from ..operators import numbering, provisions
from ..session import spread, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def parts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("n"), "p_name", "p_brand", "p_type"))


def _pick(values: list[str], at) -> F.Column:
    return F.element_at(F.array(*(F.lit(x) for x in values)), (at + 1).cast("int"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _fill(template: str, **columns) -> F.Column:
    """A text with {names} replaced by columns."""
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before), columns[name].cast("string")]
    return F.concat(*out, F.lit(rest))


# Ids and labels

TYPED = ["b", "beta", "β΄", "Β", "id", "st", "ks", "stigma", "th", "v", "ιστ", "Ά", "kappa", "mz", "p", "zeta"]
NORMAL = ["β", "β", "β", "β", "ιδ", "στ", "ξ", "στ", "θ", "β", "ιστ", "α", "κ", "μζ", "π", "ζ"]


@query(f"""SELECT p_partkey AS k, CASE p_size % 6 WHEN 0 THEN 'code:' || p_partkey || '.' || p_size || '.' || {_sql_list(NORMAL)}[1 + p_partkey % 16] WHEN 1 THEN 'nok:' || p_partkey || upper({_sql_list(NORMAL)}[1 + p_partkey % 16])
WHEN 2 THEN 'fire:' || upper({_sql_list(NORMAL)}[1 + p_partkey % 16]) || p_partkey || '.' || p_size WHEN 3 THEN 'FEK-A-' || p_partkey || '-2020:120#1~' || p_size WHEN 4 THEN 'fire:Π-' || upper({_sql_list(NORMAL)}[1 + p_partkey % 16]) END AS gid FROM part""")
def normal_ids(spark, d):
    """Typed ids of every kind; p_size % 6 = 5 gives one that can't be read."""
    p = parts(spark, d).withColumn("t", _pick(TYPED, F.col("k") % 16))
    kinds = [" CODE:{k}.{n}.{t}", "nok:{k}{t}", "Fire:{one}{k}.{n}", "fek-a-{k}-2020:120#1 ~{n}", "fire:p-{t}", "nok:{k}..{t}"]
    made = [_fill(x, k=F.col("k"), n=F.col("n"), t=F.col("t"), one=F.col("t")) for x in kinds]
    # A chapter is one letter: longer spellings are written as their Greek letter here.
    made[2] = _fill(kinds[2], k=F.col("k"), n=F.col("n"), one=_pick(NORMAL, F.col("k") % 16))
    typed = F.element_at(F.array(*made), (F.col("n") % 6 + 1).cast("int"))
    return p.select("k", greek.normalize(typed).alias("gid"))


ORACLES["normal_ids"] = ORACLES["normal_ids"].replace("WHEN 2 THEN 'fire:'", f"WHEN 2 THEN CASE WHEN length({_sql_list(NORMAL)}[1 + p_partkey % 16]) > 1 THEN NULL ELSE 'fire:'").replace("|| p_partkey || '.' || p_size WHEN 3", "|| p_partkey || '.' || p_size END WHEN 3")


@query("SELECT p_partkey AS k, p_partkey % 4 IN (0, 3) AS valid FROM part")
def valid_ids(spark, d):
    p = parts(spark, d)
    made = [_fill(x, k=F.col("k")) for x in ("code:{k}.β", "code:{k}.b", "foo:{k}", "nok:{k}Α")]
    return p.select("k", greek.is_normal(F.element_at(F.array(*made), (F.col("k") % 4 + 1).cast("int"))).alias("valid"))


CITED = [("{k}.{n}.{u}#2~1", "άρθ. {k} παρ. {n} περ. {u}΄"), ("Α{k}.{n}.{u}", "άρθ. {k} Κεφ. Α΄ παρ. {k}.{n} περ. {u}΄"), ("{k}.{n}Α", "άρθ. {k} παρ. {n}Α"), ("{k}.{n}.4", "άρθ. {k} παρ. {n} περ. 4"), ("{k}.{n}.{u}.2.{v}", "άρθ. {k} παρ. {n} περ. {u}΄ υποπερ. 2.{v}΄"), ("{k}.{u}", "άρθ. {k} περ. {u}΄"), ("Β{k}", "άρθ. {k} Κεφ. Β΄"), ("Β{k}.{n}.2.{u}.{v}", "άρθ. {k} Κεφ. Β΄ παρ. {k}.{n}.2 περ. {u}΄ υποπερ. {v}΄")]


def _sql_fill(template: str) -> str:
    for name in "knmpquvw":
        template = template.replace("{" + name + "}", f"' || {name} || '")
    return "'" + template + "'"


@query(f"""WITH p AS (SELECT p_partkey AS k, p_size AS n, {_sql_list(greek.UNITS)}[1 + p_partkey % 9] AS u, {_sql_list(greek.UNITS)}[1 + (p_partkey + 1) % 9] AS v FROM part)
SELECT k, CASE k % 8 {" ".join(f"WHEN {i} THEN {_sql_fill(want)}" for i, (_, want) in enumerate(CITED))} END || ' ν. 5306/2026 (ΦΕΚ Α΄ 88/2026)' AS cited FROM p""")
def cited_provisions(spark, d):
    """Ids of every shape: letters after numbers, numbers as clauses, sub-clauses, chapters with decimal paragraphs."""
    names = {"k": F.col("k"), "n": F.col("n"), "u": _pick(greek.UNITS, F.col("k") % 9), "v": _pick(greek.UNITS, (F.col("k") + 1) % 9)}
    local = F.element_at(F.array(*(_fill(x, **names) for x, _ in CITED)), (F.col("k") % 8 + 1).cast("int"))
    return parts(spark, d).select("k", greek.cite(local, F.lit("Ν. 5306/2026"), F.lit("Α΄ 88/2026")).alias("cited"))


@query("SELECT p_partkey AS k, p_size AS n FROM part")
def numerals(spark, d):
    """Greek numerals written from tens and units, read back."""
    n = F.col("n")
    tens, units = F.when(n < 10, "").otherwise(_pick(greek.TENS, F.greatest(F.lit(0), F.floor(n / 10) - 1))), F.when(n % 10 == 0, "").otherwise(_pick(greek.UNITS, F.greatest(F.lit(0), n % 10 - 1)))
    return parts(spark, d).select("k", greek.numeral(F.concat(tens, units)).cast("int").alias("n"))


_ONES = ["πρώτο", "δεύτερο", "τρίτο", "τέταρτο", "πέμπτο", "έκτο", "έβδομο", "όγδοο", "ένατο"]
_TENS = ["δέκατο", "εικοστό", "τριακοστό", "τεσσαρακοστό", "πεντηκοστό"]


@query("SELECT p_partkey AS k, p_size::VARCHAR AS article FROM part")
def ordinals(spark, d):
    """Ordinals in words, read back; 11 and 12 are words of their own."""
    n = F.col("n")
    ones = F.when(n % 10 == 0, F.lit(None)).otherwise(_pick(_ONES, F.greatest(F.lit(0), n % 10 - 1)))
    tens = F.when(n < 10, F.lit(None)).otherwise(_pick(_TENS, F.greatest(F.lit(0), F.floor(n / 10) - 1)))
    words = F.when(n == 11, "ενδέκατο").when(n == 12, "δωδέκατο").otherwise(F.concat_ws(" ", tens, ones))
    return parts(spark, d).select("k", greek.ordinal(words).alias("article"))


LISTS = ["{n}, {m} και {p}", "{n} έως {m}", "{n}α και {m}", "{u}), {v}) και {w}'", "{u}΄, {n} και το {w}’", "{n}Α, και {m}", "{u} έως {w}", "καθώς και"]


@query(f"""WITH p AS (SELECT p_partkey AS k, p_size AS n, p_size + p_partkey % 9 AS m, p_size + 60 AS p, {_sql_list(greek.UNITS)}[1 + p_partkey % 7] AS u, {_sql_list(greek.UNITS)}[2 + p_partkey % 7] AS v, {_sql_list(greek.UNITS)}[3 + p_partkey % 7] AS w FROM part),
t AS (SELECT k, CASE k % 8 {" ".join(f"WHEN {i} THEN {_sql_fill(x.replace(chr(39), chr(39) * 2))}" for i, x in enumerate(LISTS))} END AS txt FROM p),
o AS (SELECT k, contains(txt, 'έως') AS ranged, list_filter(regexp_extract_all(replace(txt, 'έως', ' '), '[0-9]+[α-ωΑ-Ω]?|[α-ωά-ώ]+'), lambda x: regexp_matches(x, '^[0-9]') OR x IN ({", ".join(f"'{x}'" for x in greek.NUMERALS)})) AS xs FROM t),
e AS (SELECT k, CASE WHEN NOT ranged THEN list_transform(xs, lambda x: regexp_replace(x, '^([0-9]+)([α-ω])$', '\\1.\\2')) WHEN regexp_matches(xs[1], '^[0-9]') THEN list_transform(range(xs[1]::BIGINT, xs[2]::BIGINT + 1), lambda x: x::VARCHAR) ELSE list_slice({_sql_list(greek.UNITS)}, list_position({_sql_list(greek.UNITS)}, xs[1]), list_position({_sql_list(greek.UNITS)}, xs[2])) END AS xs FROM o)
SELECT k, array_to_string(xs, ',') AS labels FROM e""")
def label_lists(spark, d):
    """Lists with brackets, marks and letters after numbers, ranges, and one without labels; the SQL reads the same texts."""
    k = F.col("k")
    names = {"n": F.col("n"), "m": F.col("n") + k % 9, "p": F.col("n") + 60} | {x: _pick(greek.UNITS, k % 7 + i) for i, x in enumerate("uvw")}
    made = F.element_at(F.array(*(_fill(x, **names) for x in LISTS)), (k % 8 + 1).cast("int"))
    return parts(spark, d).select("k", F.array_join(amend.labels(made), ",").alias("labels"))


@query("""WITH r AS (SELECT p_partkey AS k, p_size AS lo, p_size + p_partkey % 70 - 5 AS hi FROM part)
SELECT k, CASE WHEN hi >= lo AND hi - lo <= 49 THEN array_to_string(range(lo, hi + 1), ',') ELSE lo || ',' || hi END AS articles, CASE WHEN hi >= lo AND hi - lo <= 30 THEN hi - lo + 1 ELSE 2 END AS n_cited, CASE WHEN hi >= lo AND hi - lo <= 49 THEN hi - lo + 1 ELSE 0 END AS n_ranged FROM r""")
def number_ranges(spark, d):
    """Ranges under their caps: up to 49 apart or the ends, up to 30 or the ends, up to 49 or none."""
    lo, hi = F.col("n"), (F.col("n") + F.col("k") % 70 - 5).cast("int")
    return parts(spark, d).select("k", F.array_join(phrases.span(lo, hi, 49), ",").alias("articles"), F.size(phrases.span(lo, hi, 30)).alias("n_cited"), F.size(phrases.span(lo, hi, 49, False)).alias("n_ranged"))


# Sentences

LAW = r"(?:(?:του|στον)\s+)?ν\.\s*4067/2012"
#: sentence, kind, target pattern, restates
SENTENCES = [
    ("Η περ. {u}΄ της παρ. {n} του άρθρου {k} του ν. 4067/2012 (Α΄ 79) αντικαθίσταται ως εξής: «Νέο κείμενο.»", "amend", "{k}.{n}.{u}", False),
    ("Στο άρθρο {k} του ν. 4067/2012 προστίθεται παρ. {n} ως εξής: «{n}. Καταργείται το παλιό.»", "amend", "{k}.{n}", False),
    ("Το άρθρο {k} του ν. 4067/2012 αντικαθίσταται ως εξής:", "amend", "{k}", True),
    ("Καταργείται η παρ. {n} του άρθρου {k} του ν. 4067/2012.", "repeal", "{k}.{n}", False),
    ("Οι άδειες τροποποιούνται σύμφωνα με την παρ. {n} του άρθρου {k} του ν. 4067/2012 και εκδίδονται.", None, None, None),
    ("Στο άρθρο {k} του ν. 4067/2012 προστίθεται περ. {u} ως εξής:", "amend", "{k}.{u}", False),
    ("Τα έργα της παρ. {n} ορίζονται. Αντικαθίσταται το πρώτο εδάφιο της παρ. {n} του άρθρου {k} του ν. 4067/2012.", "amend", "{k}.{n}", False),
    ("Οι παρ. {n} και {m} του άρθρου {k} του ν. 4067/2012 τροποποιούνται ως εξής:", "amend", "{k}.{n},{k}.{m}", False),
    ("Οι περ. {u}) και {v}) της παρ. {n} του άρθρου {k} του ν. 4067/2012 αντικαθίστανται ως εξής:", "amend", "{k}.{n}.{u},{k}.{n}.{v}", False),
    ("Η περ. {u}' της παρ. {n}Α του άρθρου {k} του ν. 4067/2012 διαγράφεται.", "amend", "{k}.{n}Α.{u}", False),
    ("Οι παρ. {n} έως {p} του άρθρου {k} του ν. 4067/2012 αναστέλλονται.", "amend", "{k}.{n},{k}.{q},{k}.{p}", False),
    ("Η παρ. {n} του άρθρου {k} του ν. 4067/2012 ισχύει " + "και για κάθε άλλη περιοχή της χώρας " * 12 + "χωρίς να τροποποιείται.", None, None, None),
    ("Στον ν. 4067/2012 (Α΄ 79) προστίθεται άρθρο {k}Α με τίτλο «Νέο».", "amend", "{k}Α", False),
]


def written(spark, d) -> DataFrame:
    """A sentence of one of eight kinds for each part: article 1 to 60, paragraph 1 to 50."""
    p = parts(spark, d).select(F.col("k").alias("id"), (F.col("k") % 60 + 1).alias("k"), "n", (F.col("n") + 50).alias("m"), (F.col("n") + 2).alias("p"), (F.col("n") + 1).alias("q"), _pick(greek.UNITS, F.col("k") % 9).alias("u"), _pick(greek.UNITS, (F.col("k") + 1) % 9).alias("v"), (F.floor(F.col("k") / 7) % len(SENTENCES)).cast("int").alias("kind_of"))
    made = [_fill(s, k=F.col("k"), n=F.col("n"), m=F.col("m"), **{x: F.col(x) for x in "upqv"}) for s, *_ in SENTENCES]
    return p.withColumn("text", F.element_at(F.array(*made), F.col("kind_of") + 1))


WRITTEN_SQL = f"""w AS (SELECT p_partkey AS id, p_partkey % 60 + 1 AS k, p_size AS n, p_size + 50 AS m, p_size + 2 AS p, p_size + 1 AS q, {_sql_list(greek.UNITS)}[1 + p_partkey % 9] AS u, {_sql_list(greek.UNITS)}[1 + (p_partkey + 1) % 9] AS v, (p_partkey // 7) % {len(SENTENCES)} AS kind_of FROM part),
x AS (SELECT id, kind_of, CASE kind_of {" ".join(f"WHEN {i} THEN '{s[1]}'" for i, s in enumerate(SENTENCES) if s[1])} END AS kind, CASE kind_of {" ".join(f"WHEN {i} THEN {_sql_fill(s[2])}" for i, s in enumerate(SENTENCES) if s[1])} END AS targets, kind_of = 2 AS restates, CASE WHEN kind_of = 12 THEN k || 'Α' ELSE k::VARCHAR END AS article FROM w)"""


@query(f"WITH {WRITTEN_SQL} SELECT id, article, kind, array_to_string(list_sort(string_split(targets, ',')), ',') AS targets, restates FROM x WHERE kind IS NOT NULL")
def amending_sentences(spark, d):
    rows = written(spark, d).select("id", F.explode(amend.amendments(F.col("text"), LAW)).alias("x"))
    return rows.select("id", "x.article", "x.kind", F.array_join("x.targets", ",").alias("targets"), "x.restates")


@query(f"WITH {WRITTEN_SQL}, t AS (SELECT *, id % 10 AS source, unnest(string_split(targets, ',')) AS target FROM x WHERE kind IS NOT NULL) SELECT article, source, count(DISTINCT id)::INTEGER AS n, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, string_agg(DISTINCT target, ',' ORDER BY target) AS targets, bool_or(restates) AS restates FROM t GROUP BY article, source")
def matcher_pointers(spark, d):
    rows = amend.matcher(written(spark, d).withColumn("source", F.col("id") % 10), ["source"], "id", "text", LAW)
    return rows.select("article", "source", F.size("paragraphs").alias("n"), F.array_join("kinds", ",").alias("kinds"), F.array_join("targets", ",").alias("targets"), "restates")


@query("""WITH r AS (SELECT p_partkey AS id, 1 + p_partkey % 40 AS a, p_size AS p FROM part), known AS (SELECT DISTINCT 'code:' || a AS gid FROM r WHERE a <= 30 UNION SELECT DISTINCT 'code:' || a || '.' || p FROM r WHERE a <= 30 AND p % 2 = 0)
SELECT id, CASE WHEN ('code:' || a || '.' || p) IN (SELECT gid FROM known) THEN 'code:' || a || '.' || p ELSE 'code:' || a END AS dst FROM r WHERE id % 5 <> 0 AND a <= 30""")
def cross_references(spark, d):
    """References resolved to the deepest id there is; every fifth one is to another law."""
    r = parts(spark, d).select(F.col("k").alias("id"), (1 + F.col("k") % 40).alias("a"), F.col("n").alias("p"))
    text = F.concat(_fill("Όπως ορίζεται στην παρ. {p} του άρθρου {a}", a=F.col("a"), p=F.col("p")), F.when(F.col("id") % 5 == 0, " του ν. 1577/1985 (Α΄ 210).").otherwise(" του παρόντος Κώδικα."))
    found = r.select("id", F.explode(amend.references(text)).alias("x")).select("id", F.col("x.article").alias("article"), F.col("x.para").alias("para"))
    steps = F.array(F.concat(F.lit("code:"), "article"), F.concat(F.lit("code:"), "article", F.lit("."), "para"))
    known = r.filter("a <= 30").select(F.explode(F.array(_fill("code:{a}", a=F.col("a")), F.when(F.col("p") % 2 == 0, _fill("code:{a}.{p}", a=F.col("a"), p=F.col("p"))))).alias("gid")).filter("gid IS NOT NULL")
    return amend.resolve(found.withColumn("steps", steps), known, ["id"], "steps", "gid", "dst")


@query("""WITH p AS (SELECT p_partkey AS k, 1 + p_partkey % 40 AS a, 1 + (p_partkey // 3) % 45 AS b, p_size AS n, 1 + p_partkey % 50 AS q FROM part), ids AS (SELECT DISTINCT a, n FROM p), arts AS (SELECT DISTINCT a FROM p),
r AS (SELECT a, n, a AS ra, q AS rq FROM p WHERE k % 5 = 0 UNION ALL SELECT a, n, b, q FROM p WHERE k % 5 = 1 UNION ALL SELECT a, n, unnest(range(b, b + 3)), NULL FROM p WHERE k % 5 = 3 UNION ALL SELECT a, n, b, NULL FROM p WHERE k % 5 = 4),
f AS (SELECT DISTINCT r.a, r.n, r.ra, i.n AS rq FROM r SEMI JOIN arts ON arts.a = r.ra LEFT JOIN ids AS i ON i.a = r.ra AND i.n = r.rq)
SELECT DISTINCT 'code:' || a || '.' || n AS src, 'code:' || ra || CASE WHEN rq IS NULL THEN '' ELSE '.' || rq END AS dst FROM f WHERE NOT (a = ra AND (rq IS NULL OR rq = n))""")
def reference_links(spark, d):
    """References of paragraphs to their own article, to another, to another law, to a range, and in a chain; those to the
    paragraph itself or to its article are none."""
    k = F.col("k")
    p = parts(spark, d).select("k", (1 + k % 40).alias("a"), (1 + F.floor(k / 3) % 45).alias("b"), "n", (1 + k % 50).alias("q"))
    made = ["Κατά την παρ. {q} του παρόντος, ισχύουν.", "Όπως η παρ. {q} του άρθρου {b} ορίζει.", "Κατά το άρθρο {b} του ν. 1577/1985 και το άρθρο {q} του ίδιου νόμου.", "Τα άρθρα {b} έως {c} του παρόντος Κώδικα.", "Οι παρ. 1 και 2 του άρθρου {b}, η παρ. {q} του παρόντος Τμήματος."]
    text = F.element_at(F.array(*(_fill(x, q=F.col("q"), b=F.col("b"), c=F.col("b") + 2) for x in made)), (k % 5 + 1).cast("int"))
    rows = p.select(_fill("code:{a}.{n}", a=F.col("a"), n=F.col("n")).alias("gid"), text.alias("text"))
    return amend.cross_references(rows, "gid", "text")


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 3 AS c, 1 + p_partkey % 25 AS a, p_size AS n, 1 + (p_partkey // 5) % 25 AS b, 1 + (p_partkey // 3) % 60 AS q FROM part), ids AS (SELECT DISTINCT ['Α', 'Β', 'Γ'][1 + c] AS ch, a, n FROM p), arts AS (SELECT DISTINCT ch, a FROM ids),
r AS (SELECT ['Α', 'Β', 'Γ'][1 + c] AS ch, a, n, ['Α', 'Β', 'Γ'][1 + c] AS rc, b AS ra, q AS rq FROM p WHERE k % 5 = 0 UNION ALL SELECT ['Α', 'Β', 'Γ'][1 + c], a, n, 'Β', b, q FROM p WHERE k % 5 = 1 UNION ALL SELECT ['Α', 'Β', 'Γ'][1 + c], a, n, 'Γ', unnest([b, b + 1]), NULL FROM p WHERE k % 5 = 2 UNION ALL SELECT ['Α', 'Β', 'Γ'][1 + c], a, n, 'Α', b, NULL FROM p WHERE k % 5 = 3),
f AS (SELECT DISTINCT r.ch, r.a, r.n, r.rc, r.ra, i.n AS rq FROM r SEMI JOIN arts ON arts.ch = r.rc AND arts.a = r.ra LEFT JOIN ids AS i ON i.ch = r.rc AND i.a = r.ra AND i.n = r.rq)
SELECT 'fire:' || ch || a || '.' || n AS src, 'fire:' || rc || ra || CASE WHEN rq IS NULL THEN '' ELSE '.' || rq END AS dst FROM f WHERE NOT (ch = rc AND a = ra AND (rq IS NULL OR rq = n))""")
def fire_links(spark, d):
    """Decimal references with two levels too many, chapters named or understood, and other acts'."""
    k = F.col("k")
    p = parts(spark, d).select("k", _pick(["Α", "Β", "Γ"], k % 3).alias("ch"), (1 + k % 25).alias("a"), "n", (1 + F.floor(k / 5) % 25).alias("b"), (1 + F.floor(k / 3) % 60).alias("q"))
    made = ["Κατά την παρ. {b}.{q}.7.1 του άρθρου {b}, ισχύουν.", "Όπως η παράγραφος {b}.{q}. του Κεφαλαίου Β΄ ορίζει.", "Κατά τα άρθρα {b} και {c} του Κεφαλαίου Γ, όχι του άρθρου {b}.", "Το άρθρο {b} των Γενικών Διατάξεων.", "Το άρθρο {b} του Κεφαλαίου Α΄ του π.δ. 71/1988 και η παρ. {b}.{q} του ν. 1/1990."]
    text = F.element_at(F.array(*(_fill(x, q=F.col("q"), b=F.col("b"), c=F.col("b") + 1) for x in made)), (k % 5 + 1).cast("int"))
    return amend.fire_links(p.select(_fill("fire:{ch}{a}.{n}", ch=F.col("ch"), a=F.col("a"), n=F.col("n")).alias("gid"), text.alias("text")), "gid", "text")


@query("""WITH p AS (SELECT p_partkey AS k, p_partkey // 60 AS act, 1 + p_partkey % 60 AS a, 1 + p_size AS b FROM part), r AS (SELECT act, a, unnest(range(b, b + 4)) AS cited FROM p WHERE k % 4 = 0 UNION ALL SELECT act, a, b FROM p WHERE k % 4 = 2 UNION ALL SELECT act, a, unnest([b, b + 5]) FROM p WHERE k % 4 = 3), h AS (SELECT act, a FROM p WHERE k % 13 = 0)
SELECT DISTINCT r.act, r.a::VARCHAR AS article FROM r SEMI JOIN h ON h.act = r.act AND h.a = r.cited ANTI JOIN h AS g ON g.act = r.act AND g.a = r.a""")
def related_articles(spark, d):
    """Articles that refer to a hit article of their own act: a law that is named claims the numbers joined before it."""
    k = F.col("k")
    p = parts(spark, d).select("k", F.floor(k / 60).alias("act"), (1 + k % 60).cast("string").alias("article"), (1 + F.col("n")).alias("b"))
    made = ["Κατά τα άρθρα {b} έως και {to} του παρόντος.", "Τα άρθρα {b} έως {to} και το άρθρο {to} του ν. 719/1977 ισχύουν.", "Το άρθρο {b} ισχύει. Κατά το «άρθρο {to}» και το άρθρο 9 του Ποινικού Κώδικα.", "Τα άρθρα {b} και {five}α."]
    text = F.element_at(F.array(*(_fill(x, b=F.col("b"), to=F.col("b") + 3, five=F.col("b") + 5) for x in made)), (k % 4 + 1).cast("int"))
    refs = amend.internal_refs(p.withColumn("text", text), ["act", "article"], "text")
    hits = p.filter(k % 13 == 0).select("act", "article")
    return provisions.refers_to_hits(refs, hits, "act", "article", "cited")


@query("SELECT p_partkey AS k, p_name AS term, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS also FROM part")
def glossary_terms(spark, d):
    text = F.concat(F.col("n").cast("string"), F.lit(". «"), "p_name", F.when(F.col("k") % 2 == 0, F.concat(F.lit(" ("), "p_brand", F.lit(")"))).otherwise(""), F.lit("»: ό,τι ορίζεται εδώ."))
    return parts(spark, d).select("k", amend.definition(text).alias("x")).select("k", "x.term", "x.also")


_GREEK_WORDS = ["εξώστης", "πιλοτή", "μάντρα", "πισίνα", "δώμα", "όροφος", "κτίριο"]
_GREEK_STEMS = ["εξωστ", "πιλοτ", "μαντρ", "πισιν", "δωμα", "οροφ", "κτιρι"]


@query(f"""SELECT p_partkey AS k, {_sql_list(_GREEK_STEMS)}[1 + p_partkey % 7] || ' ' || {_sql_list(_GREEK_STEMS)}[1 + p_size % 7] AS stems FROM part""")
def stems(spark, d):
    phrase = F.concat(F.lit("Ο "), _pick(_GREEK_WORDS, F.col("k") % 7), F.lit(" και "), _pick(_GREEK_WORDS, F.col("n") % 7), F.lit(" 12"))
    return parts(spark, d).select("k", phrases.stem(phrase).alias("stems"))


@query(f"""SELECT DISTINCT {_sql_list(_GREEK_STEMS)}[1 + p_partkey % 7] AS also, {_sql_list(_GREEK_STEMS)}[1 + p_size % 7] AS term FROM part WHERE p_partkey % 3 <> 0""")
def synonym_groups(spark, d):
    """Every third term has an abbreviation, which is no synonym."""
    p = parts(spark, d).select(_pick(_GREEK_WORDS, F.col("n") % 7).alias("term"), F.when(F.col("k") % 3 == 0, "Σ.Δ.").otherwise(_pick(_GREEK_WORDS, F.col("k") % 7)).alias("also"))
    return amend.synonym_groups(p, "term", "also")


STARTS = ["Η ισχύς του παρόντος αρχίζει από τη δημοσίευσή του στην Εφημερίδα της Κυβερνήσεως (π.δ. 1/1990).", "1. Η ισχύς του παρόντος αρχίζει από τη δημοσίευσή του, εκτός αν ορίζεται άλλως.", "Η ισχύς αρχίζει δέκα ({days}) ημέρες μετά τη δημοσίευσή του. Άλλως ισχύει το άρθρο 3.", "Με απόφαση του Υπουργού ορίζεται η έναρξη."]


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'publication' WHEN 1 THEN 'publication-unless' WHEN 2 THEN 'publication' ELSE 'text' END AS rule,
CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN (o_orderdate::DATE + (o_orderkey % 30)::INTEGER) ELSE o_orderdate::DATE END AS from_date, CASE o_orderkey % 4 WHEN 3 THEN NULL WHEN 2 THEN (o_orderdate::DATE + (o_orderkey % 30)::INTEGER - 5) ELSE (o_orderdate::DATE - 5) END AS from_issued FROM orders""")
def commencement_rules(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"))
    made = [_fill(x, days=(F.col("k") % 30)) for x in STARTS]
    text = F.element_at(F.array(*made), (F.col("k") % 4 + 1).cast("int"))
    return o.select("k", greek.commencement(text, F.col("day"), F.lit(1), F.date_sub("day", 5)).alias("c")).select("k", "c.rule", "c.from_date", "c.from_issued")


@query("""WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_shipdate, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS pos FROM lineitem)
SELECT l_orderkey, pos::INTEGER AS pos, l_orderkey || '.' || ((pos - 1) // 3 + 1) || CASE (pos - 1) % 3 WHEN 0 THEN '' WHEN 1 THEN '.α' ELSE CASE WHEN ((pos - 1) // 3) % 2 = 0 THEN '#1' ELSE '.α#1' END END AS pid FROM l""")
def paragraph_numbers(spark, d):
    """An order as an article: each three lines are a numbered paragraph, a clause of it, and a text without a number, which
    belongs to the paragraph where the clause ends a sentence and to the clause where it doesn't."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    rows = table(spark, d, "lineitem").select("l_orderkey", F.row_number().over(w).alias("pos"))
    para = F.floor((F.col("pos") - 1) / 3) + 1
    text = F.when(F.col("pos") % 3 == 1, F.concat(para.cast("string"), F.lit(". Όροι:"))).when(F.col("pos") % 3 == 2, F.when(para % 2 == 1, "α) ένα.").otherwise("α) ένα")).otherwise("κείμενο")
    rows = rows.withColumn("article", F.col("l_orderkey").cast("string")).withColumn("txt", text)
    return numbering.number(rows, ["l_orderkey"], "article", "pos", "txt").select("l_orderkey", "pos", "pid")


# Texts, titles, headers


@query("""SELECT o_orderkey AS k, 'FEK-A-' || (o_orderkey % 5000 + 1) || '-' || year(o_orderdate) AS fek, '01/' || year(o_orderdate) || '/' || year(o_orderdate) || '01' || lpad((o_orderkey % 5000 + 1)::VARCHAR, 5, '0') || '.pdf' AS path FROM orders""")
def issue_links(spark, d):
    n, y = F.col("o_orderkey") % 5000 + 1, F.year("o_orderdate")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), phrases.fek_id(n, y).alias("fek"), phrases.fek_path(n, y, F.lit(1)).alias("path"))


@query("SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 < 2 THEN (o_orderkey % 5000) || '/' || year(o_orderdate) END AS law, CASE o_orderkey % 3 WHEN 0 THEN 'ν. ' || (o_orderkey % 5000) || '/' || year(o_orderdate) WHEN 1 THEN 'π.δ. ' || (o_orderkey % 5000) || '/' || year(o_orderdate) ELSE 'Απόφαση' END AS label FROM orders")
def law_labels(spark, d):
    o = table(spark, d, "orders").withColumn("law", F.concat((F.col("o_orderkey") % 5000).cast("string"), F.lit("/"), F.year("o_orderdate")))
    act = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("Ν. "), "law")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Π.Δ. "), "law")).otherwise("Απόφαση")
    return o.select(F.col("o_orderkey").alias("k"), phrases.law_of(act).alias("law"), phrases.act_label(act).alias("label"))


@query("SELECT p_partkey AS k, p_partkey % 4 <> 3 AS same FROM part")
def title_match(spark, d):
    """Titles with all words, one of three, only common ones, and none in common."""
    made = [("Όροι δόμησης κτιρίων", "Όροι δόμησης κτιρίων {k}"), ("Ειδικές ρυθμίσεις οικοπέδων", "Γενικά περί οικοπέδων"), ("Τροποποίηση άρθρου", "Τροποποίηση άρθρου {k}"), ("Όροι δόμησης", "Μεταβατικές διατάξεις")]
    pick = lambda side: F.element_at(F.array(*(_fill(m[side], k=F.col("k")) for m in made)), (F.col("k") % 4 + 1).cast("int"))
    return parts(spark, d).select("k", phrases.same_title(pick(0), pick(1)).alias("same"))


@query("SELECT p_partkey AS k, trim(replace(p_name, 'widget', 'wid' || 'get')) || ' ' || p_type AS title FROM part")
def plain_titles(spark, d):
    broken = F.concat(F.lit("  "), F.regexp_replace("p_name", "widget", "wid- get"), F.lit("  \n "), "p_type", F.lit(" "))
    return parts(spark, d).select("k", phrases.plain_title(broken).alias("title"))


@query("SELECT p_partkey AS k, 'Το ' || p_name || ' του ν. 4014/2011 - ' || p_type AS text FROM part")
def joined_lines(spark, d):
    """A word cut by a hyphen, a law's number cut at its slash, and a dash that stays."""
    half = F.floor(F.length("p_name") / 2).cast("int")
    lines = F.array(F.lit(""), F.concat(F.lit("Το "), F.col("p_name")), F.lit("του ν. 4014/"), F.lit("2011 -"), F.col("p_type"))
    cut = F.when(F.substr("p_name", half, F.lit(2)).rlike("^[a-z]{2}$"), F.array(F.lit(""), F.concat(F.lit("Το "), F.substr("p_name", F.lit(1), half), F.lit("-")), F.substr("p_name", half + 1), F.lit("του ν. 4014/"), F.lit("2011 -"), F.col("p_type")))
    return parts(spark, d).select("k", phrases.joined(F.coalesce(cut, lines)).alias("text"))


@query("SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 'ΤΜΗΜΑ VII ' WHEN 1 THEN 'ΑΡΘΡΟ ' WHEN 2 THEN 'MWh ' ELSE 'ΝΟΚ/ab ' END || p_partkey AS text FROM part")
def greek_lookalikes(spark, d):
    made = ["ΤΜΗΜΑ VΙΙ {k}", "AΡΘΡO {k}", "MWh {k}", "NΟK/ab {k}"]
    return parts(spark, d).select("k", phrases.greek_lookalikes(F.element_at(F.array(*(_fill(x, k=F.col("k")) for x in made)), (F.col("k") % 4 + 1).cast("int"))).alias("text"))


@query("SELECT p_partkey AS k, p_partkey || '�' || p_size AS text FROM part")
def glyphs(spark, d):
    """Digits as glyph codes from 0x3EC, and a code without a character."""
    codes = {chr(0x3EC + i): str(i) for i in range(10)}
    glyph = F.translate(F.concat(F.col("k").cast("string"), F.lit("!"), F.col("n").cast("string")), "0123456789", "".join(codes))
    return parts(spark, d).select("k", phrases.decoded(glyph, codes).alias("text"))


@query("""SELECT p_partkey AS k, '---' || chr(10) || 'title: "' || p_name || '"' || chr(10) || CASE WHEN p_partkey % 2 = 0 THEN 'size: ' || p_size || chr(10) ELSE '' END || 'tags: ["' || p_brand || '", "' || p_type || '"]' || chr(10) || '---' || chr(10) AS header FROM part""")
def frontmatter(spark, d):
    header = phrases.frontmatter(title__text=F.col("p_name"), size__number=F.when(F.col("k") % 2 == 0, F.col("n")), tags__list=F.array("p_brand", "p_type"))
    return parts(spark, d).select("k", header.alias("header"))


@query("SELECT o_orderkey AS k, strftime(o_orderdate, '%Y-%m-%d') || '  Ν. 1/2020  ' || o_orderkey || '  amend' || CASE WHEN o_orderkey % 2 = 0 THEN ' (gives the full new text)' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' → ' || o_custkey || ', ' || o_orderstatus END || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ' [' || o_orderpriority || ']' END AS line FROM orders")
def amendment_lines(spark, d):
    k = F.col("o_orderkey")
    aims = F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("o_custkey").cast("string"), "o_orderstatus"))
    line = phrases.amendment_line(F.to_date("o_orderdate"), F.lit("Ν. 1/2020"), k.cast("string"), F.lit("amend"), aims, F.when(k % 5 != 0, F.col("o_orderpriority")), k % 2 == 0)
    return table(spark, d, "orders").select(k.alias("k"), line.alias("line"))


# Lists and groups


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS first_at FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ',' ORDER BY first_at) AS kinds FROM f GROUP BY user_id""")
def first_seen_kinds(spark, d):
    return provisions.first_seen(table(spark, d, "events"), ["user_id"], "event_type", ["event_id"], "kinds").withColumn("kinds", F.array_join("kinds", ","))


@query("SELECT o_custkey, string_agg(o_orderkey, ', ' ORDER BY o_orderkey) FILTER (r <= 8) || CASE WHEN max(r) > 8 THEN ' …' ELSE '' END AS names FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) GROUP BY o_custkey")
def first_names(spark, d):
    """The first eight orders of a customer; only those are gathered."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("r")).filter("r <= 9")
    return rows.groupBy("o_custkey").agg(phrases.listed(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string"))).alias("names"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS kind, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def status_counts(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1 AS later FROM events) SELECT user_id, count(*) FILTER (later) > 0 AND count(*) FILTER (later AND value < 100) >= 0.5 * count(*) FILTER (later) AS in_order FROM r GROUP BY user_id""")
def rows_in_order(spark, d):
    return provisions.share_in_order(table(spark, d, "events"), ["user_id"], "event_id", F.col("value") < 100, 0.5, "in_order")


@query("SELECT l_orderkey, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS numbers FROM lineitem GROUP BY l_orderkey")
def top_numbers(spark, d):
    """First-level numbers of ids such as 7.3.α and 7.3#1; a bare article has none."""
    made = [_fill(x, o=F.col("l_orderkey"), n=F.col("l_linenumber")) for x in ("{o}.{n}", "{o}.{n}.α", "{o}.{n}#1", "{o}")]
    rows = table(spark, d, "lineitem").select("l_orderkey", F.explode(F.array(*made)).alias("gid"))
    return rows.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(provisions.top_numbers(F.col("gid")))), ",").alias("numbers"))


@query("SELECT user_id, coalesce(lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) + 1, 1) AS first, event_id AS last FROM events WHERE event_type = 'signup'")
def commencement_ranges(spark, d):
    rules = table(spark, d, "events").filter("event_type = 'signup'").select("user_id", "event_id")
    return provisions.commencement_ranges(rules, "user_id", "event_id").withColumn("first", F.col("first").cast("long")).select("user_id", "first", "last")


@query("""WITH w AS (SELECT user_id, event_id, value AS lo, value + 0.5 AS hi FROM events), g AS (SELECT *, lag(hi) OVER (PARTITION BY user_id ORDER BY lo, hi) AS b FROM w),
u AS (SELECT user_id, quantile_disc(lo - b, 0.5) AS usual FROM g WHERE b IS NOT NULL GROUP BY user_id), f AS (SELECT g.*, coalesce(lo - b > greatest(10, 2 * usual) AND b < 100 AND 100 < lo, false) AS wide FROM g LEFT JOIN u USING (user_id))
SELECT event_id, max(wide::INTEGER) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS side FROM f WHERE user_id IN (SELECT user_id FROM u)""")
def gap_split(spark, d):
    """Words of a line by user, from left to right; the line's middle is 100. Lines of one word have no gap and no row."""
    words = table(spark, d, "events").select("user_id", "event_id", F.col("value").alias("lo"), (F.col("value") + 0.5).alias("hi"))
    several = words.groupBy("user_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("user_id")
    return provisions.split_at_gap(words.join(several, "user_id", "left_semi"), "user_id", "lo", "hi", F.lit(100.0), 10).select("event_id", "side")


@query("""WITH i AS (SELECT user_id, event_id, value AS top, lead(value) OVER (PARTITION BY user_id ORDER BY value) AS nx FROM events WHERE event_type <> 'error'), r AS (SELECT user_id, value AS t, value + 20 AS b FROM events WHERE event_type = 'error')
SELECT event_id, EXISTS (SELECT 1 FROM r WHERE r.user_id = i.user_id AND ((top >= t - 2 AND top <= b + 2) OR (top < t AND coalesce(nx > b, true)))) AS inside FROM i""")
def table_members(spark, d):
    ev = table(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    regions = ev.filter("event_type = 'error'").select("user_id", F.col("value").alias("t"), (F.col("value") + 20).alias("b"))
    return provisions.in_regions(ev.filter("event_type <> 'error'"), "user_id", "value", regions, "t", "b", ties=("event_id",)).select("event_id", "inside")


@query("SELECT l_partkey AS k FROM lineitem UNION SELECT p_partkey FROM part")
def key_union(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")).union(table(spark, d, "part").select("p_partkey")).distinct()


@query("SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'")
def shared_keys(spark, d):
    of = lambda f: table(spark, d, "lineitem").filter(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("k"))
    return of("R").intersect(of("A"))


@query("""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, turn, role, text) AS pos, text FROM (SELECT DISTINCT conv_id, 0 AS part, 0 AS turn, '' AS role, 'conversation ' || conv_id AS text FROM conversations UNION ALL SELECT conv_id, 1, turn, role, text FROM conversations)""")
def ordered_concat(spark, d):
    """A title first, then the turns."""
    c = table(spark, d, "conversations")
    title = c.select("conv_id").distinct().select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("turn"), F.lit("").alias("role"), F.concat(F.lit("conversation "), "conv_id").alias("text"))
    both = title.unionByName(c.select("conv_id", F.lit(1).alias("part"), "turn", "role", "text"))
    w = Window.partitionBy("conv_id").orderBy("part", "turn", F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
    return both.select("conv_id", F.row_number().over(w).cast("long").alias("pos"), "text")


# Acts and articles


@query("SELECT o_orderkey, l_linenumber, c.first AS rule FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN (SELECT l_orderkey AS k, min(l_linenumber) AS first FROM lineitem GROUP BY l_orderkey) c ON c.k = o_orderkey")
def commencement_of(spark, d):
    """Each line with the commencement line of its own order."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    rules = lines.groupBy("o_orderkey").agg(F.min("l_linenumber").alias("rule"))
    return table(spark, d, "orders").select("o_orderkey").join(lines, "o_orderkey").join(rules, "o_orderkey")


@query("SELECT o_orderkey, coalesce(string_agg(l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS refs FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def reference_blocks(spark, d):
    """Each order with its references in order; empty where it has none."""
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_partkey").cast("string").alias("dst"), F.struct("l_linenumber", "l_partkey").alias("at"))
    return provisions.attach_list(table(spark, d, "orders").select("o_orderkey"), edges, "o_orderkey", "dst", "at", "refs").withColumn("refs", F.array_join("refs", ","))


@query("SELECT c_custkey, count(o_orderkey)::BIGINT AS amended, CASE WHEN count(o_orderkey) = 0 THEN 'Status: no amendment.' ELSE 'Status: amended ' || count(o_orderkey) || ' time(s), latest ' || strftime(max(o_orderdate), '%Y-%m-%d') || '.' END AS line FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def status_lines(spark, d):
    pointers = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.to_date("o_orderdate").alias("published"))
    return provisions.status(table(spark, d, "customer").select("c_custkey"), pointers, "c_custkey").select("c_custkey", "amended", "line")


_CHOSEN = """a AS (SELECT DISTINCT l_orderkey AS act, l_linenumber AS art FROM lineitem), h AS (SELECT act, art, CASE WHEN act % 5 = 0 THEN NULL WHEN art = 1 THEN 'number' WHEN art = 6 THEN 'name' END AS direct FROM a)"""


@query(f"""WITH {_CHOSEN}, c AS (SELECT *, bool_or(direct = 'number') OVER (PARTITION BY act) AS cites FROM h), m AS (SELECT *, coalesce(direct, CASE WHEN cites AND art = 3 THEN 'related' END, CASE WHEN cites AND art = 7 THEN 'commencement' END) AS m0 FROM c),
f AS (SELECT *, coalesce(m0, CASE WHEN NOT bool_or(m0 IS NOT NULL) OVER (PARTITION BY act) AND act % 10 = 0 THEN 'title' END) AS match FROM m) SELECT act, art, match FROM f WHERE match IS NOT NULL""")
def chosen_articles(spark, d):
    """Orders as acts, lines as articles: line 1 is a hit (not in every fifth order), line 3 cites line 1, line 7 is the
    commencement article; every tenth order's title is a hit."""
    a = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("act"), F.col("l_linenumber").alias("art")).distinct()
    direct = F.when(F.col("act") % 5 == 0, F.lit(None).cast("string")).when(F.col("art") == 1, "number").when(F.col("art") == 6, "name")
    a = a.withColumn("direct", direct).withColumn("title_hit", F.col("act") % 10 == 0)
    refs = a.filter("art = 3").select("act", "art", F.lit(1).alias("cited"))
    return provisions.choose(a, "act", "art", "direct", "title_hit", F.col("art") == 7, refs, "cited").select("act", "art", "match")


@query("""WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS p, event_type = 'error' AS bad FROM events) SELECT event_id FROM (SELECT *, min(CASE WHEN bad AND p > 1 THEN p END) OVER (PARTITION BY user_id) AS e FROM r) WHERE e IS NULL OR p < e""")
def cut_articles(spark, d):
    return provisions.cut_at(table(spark, d, "events"), ["user_id"], "event_id", F.col("event_type") == "error").select("event_id")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_linenumber > 2 AS quoted, l_linenumber IN (4, 5) AS fits FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) SELECT l_orderkey, l_linenumber FROM (SELECT *, bool_or(fits) OVER (PARTITION BY l_orderkey) AS any_fits FROM r) WHERE NOT any_fits OR NOT quoted OR fits""")
def restated_parts(spark, d):
    """Lines 1 and 2 are the amending text, the others quote paragraphs: 4 and 5 text of 6.7, the rest of 6.70 and others."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    n = F.col("l_linenumber")
    gid = F.when(n <= 2, F.concat(F.lit("26."), n.cast("string"))).when(n == 4, "26.2~6.7").when(n == 5, "26.2~6.7#3").otherwise("26.2~6.70")
    return provisions.restated_part(rows.withColumn("gid", gid), ["l_orderkey"], "gid", F.lit("6.7")).select("l_orderkey", "l_linenumber")


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS k FROM orders GROUP BY o_custkey")
def by_law(spark, d):
    """The last writer of each key wins."""
    return provisions.latest_of(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey", "k")


@query("SELECT o_custkey, arg_min('Τίτλος ' || o_orderkey, (o_orderdate, o_orderkey)) AS title FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def added_titles(spark, d):
    """The title in the earliest quoted new article; an order's text quotes one where its status is F."""
    text = F.when(F.col("o_orderstatus") == "F", _fill("Προστίθεται άρθρο 10Α: «Άρθρο 10Α Τίτλος {k} 1. Κείμενο»", k=F.col("o_orderkey"))).otherwise("Άλλο κείμενο")
    title = F.nullif(F.regexp_extract(text, r"«\s*Άρθρο\s+10Α\s+([^«»\d][^«»]*?)\s*(?:\d+\.\s|»|$)", 1), F.lit(""))
    return provisions.earliest_match(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], title, "title")


@query("SELECT conv_id, label, string_agg(text, ' | ' ORDER BY y, text) AS cells FROM (SELECT c.conv_id, c.turn + 3.0 AS y, c.text, (SELECT max_by(l.lab, l.turn) FROM (SELECT DISTINCT conv_id, turn, 'row ' || turn AS lab FROM conversations WHERE role = 'user') l WHERE l.conv_id = c.conv_id AND l.turn <= c.turn + 3) AS label FROM conversations c WHERE role <> 'user') WHERE label IS NOT NULL GROUP BY conv_id, label")
def rows_by_label(spark, d):
    """User turns are a table's labels, the others its cells, by their turn."""
    c = table(spark, d, "conversations")
    labels = c.filter("role = 'user'").select("conv_id", "turn").distinct().select("conv_id", "turn", F.concat(F.lit("row "), "turn").alias("label"))
    return provisions.by_label(labels, c.filter("role <> 'user'").select("conv_id", "turn", "text"), "conv_id", "turn")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)

"""Queries of printed issues: a customer's orders set as the articles of a two-column issue, word by word, and read back.

A page has four articles, two above and two below a line across both columns; each page has a running header. Words come with
their coordinates and in no order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import columns, printed
from ..session import materialize, shuffle_partitions, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Points: page size, left edges of the columns and their width, width of a letter, height of a line.
WIDTH, HEIGHT, LEFT, RIGHT, MEASURE, LETTER, STEP = 600, 850, 50, 310, 240, 4, 12
ACROSS, UPPER, LOWER = 400, 150, 420


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _line(text: Column, y: Column, start: Column, how: str, measure: int = MEASURE) -> Column:
    """A line: its text and where it stands: `centre`, `full` (justified), `indent` (the same, after an indent) or `short`."""
    return F.struct(text.alias("text"), y.cast("double").alias("y"), start.cast("double").alias("start"), F.lit(how).alias("how"), F.lit(measure).alias("measure"))


def _words(lines: DataFrame) -> DataFrame:
    """The words of lines with their coordinates."""
    text, how, measure = F.col("text"), F.col("how"), F.col("measure")
    rows = lines.withColumn("words", F.split(text, " "))
    letters = F.length(F.replace(text, F.lit(" "), F.lit(""))) * LETTER
    shift = F.when(how == "indent", 10).otherwise(0)
    gap = F.when(how.isin("centre", "short"), float(LETTER)).otherwise((measure - shift - letters) / (F.size("words") - 1))
    x = F.col("start") + F.when(how == "centre", (measure - F.length(text) * LETTER) / 2).otherwise(shift)
    rows = rows.withColumns({"x": x, "gap": gap}).select("*", F.posexplode("words").alias("i", "w"))
    # Letters of the words before: their text without its spaces.
    before = F.when(F.col("i") == 0, 0).otherwise(F.length(F.call_function("substring_index", text, F.lit(" "), F.col("i"))) - (F.col("i") - 1))
    x0 = F.col("x") + before * LETTER + F.col("i") * F.col("gap")
    return rows.select("issue", "page", "line", x0.alias("x0"), F.col("y").alias("y0"), (x0 + F.length("w") * LETTER).alias("x1"), (F.col("y") + 10).alias("y1"), F.col("w").alias("text"))


def printed_words(spark: SparkSession, d: str) -> DataFrame:
    """issue, page, line, x0, y0, x1, y1, text, width, height of each word."""
    k = F.row_number().over(Window.partitionBy("issue").orderBy("o"))
    # Dealt by issue while rows are short: words, lines and pages of an issue stay in its task, and no shuffle carries them.
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("issue"), F.col("o_orderkey").alias("o")).repartition(shuffle_partitions(spark), "issue")
    o = orders.select("issue", "o", k.alias("k"))
    o = o.withColumn("page", (F.floor((F.col("k") - 1) / 4) + 1).cast("int")).withColumn("slot", (F.col("k") - 1) % 4)
    left, top = F.when(F.col("slot") % 2 == 0, LEFT).otherwise(RIGHT), F.when(F.col("slot") < 2, UPPER).otherwise(LOWER)
    name, issue, page = (F.col(c).cast("string") for c in ("o", "issue", "page"))
    article = [
        (F.concat(F.lit("Άρθρο "), F.col("k").cast("string")), "centre"),
        (F.concat(F.lit("Θέμα "), name), "centre"),
        (F.concat(F.lit("1. Το έργο "), name, F.lit(" γίνεται στην περιο-")), "indent"),
        (F.concat(F.lit("χή "), issue, F.lit(" και αλλού, σύμφωνα με τον ν. 4014/")), "full"),
        (F.lit("2011 και όσα ορίζονται."), "short"),
        (F.lit("2. Προστίθεται στο τέλος άρθρο ως εξής: «"), "indent"),
        (F.lit("Άρθρο 9977"), "centre"),
        (F.concat(F.lit("Νέο κείμενο "), name, F.lit(".»")), "short"),
    ]
    lines = [_line(text, top + STEP * i, left, how) for i, (text, how) in enumerate(article)]
    first = F.col("k") == 1
    opening = [(F.concat(F.lit("ΝΟΜΟΣ ΥΠ’ ΑΡΙΘ. "), issue), 86), (F.concat(F.lit("Περί έργων "), issue), 98), (F.lit("Ο ΠΡΟΕΔΡΟΣ"), 110), (F.lit("ΤΗΣ ΕΛΛΗΝΙΚΗΣ ΔΗΜΟΚΡΑΤΙΑΣ"), 122)]
    some = lambda when, line: F.when(when, line)
    lines += [some(first, _line(text, F.lit(y), F.lit(LEFT), "centre")) for text, y in opening]
    lines.append(some(F.col("slot") == 0, _line(F.concat(F.lit("ΚΕΦΑΛΑΙΟ "), page), F.lit(136), F.lit(LEFT), "centre")))
    lines.append(some(F.col("slot") == 0, _line(F.concat(F.lit("ΕΦΗΜΕΡΙΔΑ ΤΗΣ ΚΥΒΕΡΝΗΣΕΩΣ "), page), F.lit(20), F.lit(LEFT), "centre", 500)))
    lines.append(some(F.col("slot") == 1, _line(F.concat(F.lit("Πλαίσιο "), page, F.lit(" με όλα όσα ισχύουν και για τις δύο στήλες.")), F.lit(ACROSS), F.lit(LEFT), "full", 500)))
    rows = o.select("issue", "page", F.posexplode(F.array(*lines)).alias("place", "x"), "k").filter("x IS NOT NULL").select("issue", "page", (F.col("k") * 100 + F.col("place")).alias("line"), "x.*")
    return _words(rows).withColumns({"width": F.lit(float(WIDTH)), "height": F.lit(float(HEIGHT))})


def printed_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = columns.lines_of_words(printed_words(spark, d), ["issue", "page"], "line", "width", "height")
    return columns.reading_order(lines, ["issue", "page"], "width", "height")


_ARTICLES = "a AS (SELECT o_custkey AS issue, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders), p AS (SELECT *, ((k - 1) // 4 + 1)::INTEGER AS page, (k - 1) % 4 AS slot FROM a)"


@query(f"""WITH {_ARTICLES}, l AS (SELECT issue, page, slot, unnest([{{'i': 0, 't': 'Άρθρο ' || k}}, {{'i': 1, 't': 'Θέμα ' || o}}, {{'i': 2, 't': '1. Το έργο ' || o || ' γίνεται στην περιο-'}}, {{'i': 3, 't': 'χή ' || issue || ' και αλλού, σύμφωνα με τον ν. 4014/'}}, {{'i': 4, 't': '2011 και όσα ορίζονται.'}}, {{'i': 5, 't': '2. Προστίθεται στο τέλος άρθρο ως εξής: «'}}, {{'i': 6, 't': 'Άρθρο 9977'}}, {{'i': 7, 't': 'Νέο κείμενο ' || o || '.»'}}]) AS x FROM p),
u AS (SELECT issue, page, CASE WHEN slot % 2 = 0 THEN 'L' ELSE 'R' END AS col, slot // 2 * 2 AS band, CASE WHEN slot % 2 = 0 THEN 1 ELSE 2 END AS side, 10 + x.i AS pos, x.t AS text FROM l
UNION ALL SELECT issue, page, 'L', 0, 1, i, t FROM (SELECT issue, page, unnest([0, 1, 2, 3]) AS i, unnest(['ΝΟΜΟΣ ΥΠ’ ΑΡΙΘ. ' || issue, 'Περί έργων ' || issue, 'Ο ΠΡΟΕΔΡΟΣ', 'ΤΗΣ ΕΛΛΗΝΙΚΗΣ ΔΗΜΟΚΡΑΤΙΑΣ']) AS t FROM p WHERE k = 1) UNION ALL SELECT issue, page, 'L', 0, 1, 4, 'ΚΕΦΑΛΑΙΟ ' || page FROM p WHERE slot = 0 UNION ALL SELECT issue, page, 'S', 1, 0, 0, 'Πλαίσιο ' || page || ' με όλα όσα ισχύουν και για τις δύο στήλες.' FROM p WHERE slot = 1),
c AS (SELECT issue, page, count(*) FILTER (slot = 1) AS n FROM p GROUP BY ALL)
SELECT issue, page, row_number() OVER (PARTITION BY issue, page ORDER BY band, side, pos)::INTEGER AS seq, col, text FROM u""")
def reading_columns(spark, d):
    """Each line's column and place: the left column before the right one, above and below the line across."""
    return printed_lines(spark, d).select("issue", "page", "seq", "col", "text")


@query(f"""WITH {_ARTICLES}, r AS (SELECT issue, page, k, o, slot, max(slot) OVER (PARTITION BY issue, page) AS last FROM p)
SELECT issue, 'ν.' AS kind, issue::VARCHAR AS act_number, 'Περί έργων ' || issue AS act_title, NULL AS number, NULL AS title, '' AS headings, 0 AS para, 1 AS page, false AS quoted, 'ΤΗΣ ΕΛΛΗΝΙΚΗΣ ΔΗΜΟΚΡΑΤΙΑΣ' AS text FROM r WHERE k = 1
UNION ALL SELECT issue, 'ν.', issue::VARCHAR, 'Περί έργων ' || issue, k::VARCHAR, 'Θέμα ' || o, CASE WHEN slot = 0 THEN 'ΚΕΦΑΛΑΙΟ ' || page ELSE '' END, 0, page, false, '1. Το έργο ' || o || ' γίνεται στην περιοχή ' || issue || ' και αλλού, σύμφωνα με τον ν. 4014/2011 και όσα ορίζονται.' FROM r
UNION ALL SELECT issue, 'ν.', issue::VARCHAR, 'Περί έργων ' || issue, k::VARCHAR, 'Θέμα ' || o, CASE WHEN slot = 0 THEN 'ΚΕΦΑΛΑΙΟ ' || page ELSE '' END, 1, page, false, '2. Προστίθεται στο τέλος άρθρο ως εξής: « Άρθρο 9977 Νέο κείμενο ' || o || '.»' || CASE WHEN slot = 1 THEN ' Πλαίσιο ' || page || ' με όλα όσα ισχύουν και για τις δύο στήλες.' ELSE '' END FROM r""")
def printed_issues(spark, d):
    """Words to acts, articles and paragraphs: quoted headings stay text, a chapter's heading goes to the article after it."""
    lines = columns.text_edges(materialize(spark, printed_lines(spark, d), "printed-lines"), ["issue"], "page")
    rows = printed.parse_issues(lines, ["issue"])
    return rows.select("issue", "kind", "act_number", "act_title", "number", "title", F.coalesce(F.array_join("headings", "|"), F.lit("")).alias("headings"), "para", "page", "quoted", "text")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)

"""A printed crosswalk read from the lines of its table: articles of a code, their paragraphs, and the provisions they come from.

Lines carry the article of the last label; an article's lines are one text, corrected by an overlay of errata of which each must
apply exactly once; the text is cut into entries, an entry without a label of its own continues the one before, and a first entry that
the print puts before its article's label goes to that article. The entries of one article's text and the references of one entry are
read in Arrow batches; all else are DataFrame operations. A window goes over one document, an array over one article.
"""

from __future__ import annotations

import re
from itertools import takewhile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import amend, citations

#: What makes a line part of the page and not of the table; words that begin an entry; words that begin a source.
PAGE_WORDS = ("ΕΦΗΜΕΡΙΔΑ ΤΗΣ ΚΥΒΕΡΝΗΣΕΩΣ", "Τεύχος A’", "ΚΩΔΙΚΟΠΟΙ")
PAGE_LINES = ("E", "ΔΙΑΤΑΞΗ")
ENTRY = "Παρ Περ Άρθρο Τρίτο Πρώτο Δεύτερο Το Η Οι Τα Εδάφ Υποπερ".split()
SOURCE = "Παρ Περ Άρθρο Υποπερ Εδάφ Τα Το Η Οι Πρώτο Δεύτερο Τρίτο Τέταρτο Τελευταίο Εισαγωγικό περ".split()
#: Where the last column may begin, and the least width of the gap before it.
LAST_COLUMN, GAP = 100, 4


def table_lines(lines: DataFrame, text: str) -> DataFrame:
    """lines of the table alone, without the last column, control characters as spaces."""
    t = F.col(text)
    wide = F.length(t) > LAST_COLUMN + GAP
    cut = F.rtrim(F.when(wide, F.regexp_replace(t, rf"(?s)^(.{{{LAST_COLUMN}}}.*?)\s{{{GAP},}}\S.*$", "$1")).otherwise(t))

    def kept(line: Column) -> Column:
        plain = F.trim(line)
        page = (plain == "") | plain.isin(*PAGE_LINES) | plain.rlike(r"^\d{4}$")
        for words in PAGE_WORDS:
            page = page | line.contains(words)
        return ~page

    # An array of one line or none: a filter would go below the cut, and compute it for each of its tests.
    plain = F.transform(F.filter(F.array(cut), kept), lambda x: F.translate(x, "".join(chr(i) for i in range(32)), " " * 32))
    return lines.withColumn(text, F.explode(plain))


def articles(lines: DataFrame, doc: list[str], order: str, text: str) -> DataFrame:
    """doc, place, article, text: each label `Άρθρο N` with the lines up to the next one, in order. The number may stand at the
    start of a later line of its own article."""
    t = F.col(text)
    upto = Window.partitionBy(*doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = table_lines(lines, text).withColumn("_label", t.startswith("Άρθρο") & t.rlike(r"^Άρθρο\s*(\d|\s|$)"))
    rows = rows.withColumn("place", F.sum(F.col("_label").cast("int")).over(upto)).filter("place > 0")
    # No line holds a line break, so an article is one text, its label on the first line.
    parts = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), t.alias("t"))))
    whole = rows.groupBy(*doc, "place").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("_lines"))
    number = F.regexp_extract("_lines", r"^Άρθρο[^\S\n]*(\d*)", 1)
    whole = whole.withColumns({"_number": number, "_body": F.regexp_replace("_lines", r"^Άρθρο[^\S\n]*\d*", "")})
    late = F.col("_number") == ""
    name = F.when(late, F.nullif(F.regexp_extract("_body", r"\n(\d+)(?!\S)", 1), F.lit(""))).otherwise(F.col("_number"))
    body = F.when(late, F.regexp_replace("_body", r"(?s)^(.*?\n)\d+(?!\S)", "$1")).otherwise(F.col("_body"))
    joined = F.trim(F.regexp_replace(body, r"\s+", " "))
    return whole.select(*doc, "place", name.alias("article"), F.regexp_replace(joined, r"(?<=[.)]) E (?=(?:Παρ|Περ|Άρθρο)(?!\p{L}))", " ").alias("text")).filter("article IS NOT NULL")


def _times(text: Column, part: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def errata_problems(table: DataFrame, errata: DataFrame) -> DataFrame:
    """Errata (article, seq, wrong, right) that don't stand exactly once in their article's text, with `hits`."""
    met = errata.join(table.select("article", "text"), "article", "left")
    hits = F.sum(F.coalesce(_times(F.col("text"), F.col("wrong")), F.lit(0))).alias("hits")
    return met.groupBy("article", "seq", "wrong", "right").agg(hits).filter("hits <> 1")


def with_errata(table: DataFrame, errata: DataFrame) -> DataFrame:
    """table with each erratum applied, in the order of `seq`; an error where one doesn't stand exactly once."""
    bad = errata_problems(table, errata).orderBy("article", "seq").first()
    if bad is not None:
        raise ValueError(f"article {bad['article']}: {bad['wrong']!r} stands {bad['hits']} times")
    mine = errata.groupBy("article").agg(F.array_sort(F.collect_list(F.struct("seq", "wrong", "right"))).alias("_errata"))
    fixed = F.aggregate(F.coalesce("_errata", F.array().cast("array<struct<seq:int,wrong:string,right:string>>")), F.col("text"), lambda t, e: F.replace(t, e["wrong"], e["right"]))
    return table.join(mine, "article", "left").withColumn("text", fixed).drop("_errata")


def _word(text: str) -> str:
    """The letters that a text begins with."""
    return "".join(takewhile(str.isalpha, text))


def _sentences(text: str) -> list[str]:
    """A text cut after full stops before words that begin an entry."""
    out: list[list[str]] = []
    for x in re.split(r"(?<=\.)\s+", text, flags=re.ASCII):
        bare = bool(out) and out[-1] in (["Παρ."], ["Περ."])  # its number stands at the end
        if not out or _word(x) in ENTRY and not bare:
            out.append([x])
        else:
            out[-1].append(x)
    return [" ".join(x) for x in out]


def _labelled(sentence: str) -> tuple[str | None, str | None, str]:
    """(label, paragraph, source) of a sentence: `Παρ. 4 Παρ. 5 του …`, `Περ. α) έως ιδ) Άρθρο …`, or a label whose number stands at
    the sentence's end; label and paragraph are None where it begins with the source."""
    w = sentence.split(" ")
    if w[0] not in ("Παρ.", "Περ."):
        return None, None, sentence
    second, third, fifth = (w[k] if k < len(w) else "" for k in (1, 2, 4))
    if _word(second) in ("Παρ", "Περ", "Άρθρο") and re.search(r"^[0-9]+[Α-Ω]?$", w[-1]):
        para, source = w[-1], w[1:-1]
    elif third == "έως" and _word(fifth) in SOURCE:
        para, source = " ".join(w[1:4]), w[4:]
    elif _word(third) in SOURCE and not (second.endswith(".") and _word(second) in SOURCE):
        para, source = second, w[2:]
    else:
        return None, None, sentence
    return f"{w[0]} {para}", para, " ".join(source)


def _read(text: str) -> list[dict]:
    """label, paragraph, n (the number that the paragraph begins with) and source of each entry; one without a label continues the
    one before."""
    out: list[dict] = []
    label = para = n = None
    for s in _sentences(text):
        own, its, source = _labelled(s)
        if own is not None:
            label, para, digits = own, its, re.match(r"[0-9]+", its)
            n = int(digits[0]) if digits and int(digits[0]) < 1 << 31 else None
        out.append({"label": label, "paragraph": para, "n": n, "source": source.strip(" ")})
    return out


def entries(table: DataFrame, doc: list[str]) -> DataFrame:
    """doc, code_article, seq, code_paragraph, code_label, source of each entry, in the print's order."""
    e = F.col("_entries")
    rows = table.select(*doc, "place", "article", amend._batched(_read, "array<struct<label:string,paragraph:string,n:int,source:string>>", F.col("text")).alias("_entries"))
    first = F.get(F.filter("_entries.n", F.isnotnull), F.lit(0))
    end = F.array_max(F.transform(e, lambda x, i: F.when(~x["n"].eqNullSafe(F.lit(1)), i)))
    rows = rows.withColumns({"_end": end, "_most": F.array_max("_entries.n"), "_first": first})
    order = Window.partitionBy(*doc).orderBy("place")
    rows = rows.withColumns({"_next": F.lead("article").over(order), "_next_place": F.lead("place").over(order), "_next_first": F.lead("_first").over(order)})
    both = rows.select("*", F.posexplode("_entries").alias("at", "x")).drop("_entries")
    moved = F.coalesce((F.col("x.n") == 1) & (F.col("at") > F.col("_end")) & (F.col("_most") > 1) & (F.col("_next_first") > 1), F.lit(False))
    both = both.withColumns({"code_article": F.when(moved, F.col("_next")).otherwise(F.col("article")), "_place": F.when(moved, F.col("_next_place")).otherwise(F.col("place"))})
    # A moved entry stands before those of its new article.
    seq = F.row_number().over(Window.partitionBy(*doc, "_place").orderBy("place", "at"))
    return both.select(*doc, "code_article", seq.alias("seq"), F.col("x.paragraph").alias("code_paragraph"), F.col("x.label").alias("code_label"), F.col("x.source").alias("source"))


def provisions(rows: DataFrame, keys: list[str], law: str, first_year: int) -> DataFrame:
    """rows with `codified` (the provisions of `law`, n/yyyy, that the source names first) and `amended_by` (article and law of
    what has changed them since `first_year`)."""
    head = F.substring_index("source", law, 1)
    named = F.when(F.col("source").contains(law), F.concat(head, F.lit(law)))
    rest = F.when(F.col("source").contains(law), F.substr("source", F.length(head) + len(law) + 1))
    later = amend._batched(lambda x: citations.laws_named(x, law, first_year), "array<struct<law:string,article:string>>", rest)
    return rows.withColumns({"codified": F.coalesce(amend.law_references(F.lower(named), law), F.array().cast("array<string>")), "amended_by": later})

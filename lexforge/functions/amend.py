"""What the sentences of an amending text do and to which provisions, and what a text refers to.

`citations` reads one text; here it runs in Arrow batches, and the joins and sums around it are DataFrame operations.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import citations, ids

CHANGE = "array<struct<article:string,kind:string,targets:array<string>,restates:boolean>>"
CITED = "array<struct<article:string,para:string,clause:string>>"
STRINGS = "array<string>"


def _batched(read, kind: str, text: Column) -> Column:
    """read(text) of each text of a batch; nulls are passed on."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(read)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)(text)


def labels(text: Column) -> Column:
    """Numbers and numerals of a list such as `2 και 4` or `α), β) και γ'`; `3α` is 3.α; other words go.

    `2 έως 5` is 2, 3, 4, 5, and so with numerals; ends that don't rise or lie 50 or more apart stay the two ends.
    """
    return _batched(citations.label_list, STRINGS, text)


def title_kind(title: Column) -> Column:
    return _batched(lambda x: citations.title_change(x or ""), "string", title)


def amendments(text: Column, law: str) -> Column:
    """Array of (article, kind, targets, restates) of a text's references to articles of a law (a pattern of its names) in
    amending sentences. A list of articles names them whole; `Στον <law> προστίθεται άρθρο 20Α` names the new article."""
    return _batched(lambda x: citations.amendments(x, re.compile(law)), CHANGE, text)


def matcher(paragraphs: DataFrame, source: list[str], gid: str, text: str, law: str) -> DataFrame:
    """Pointers: for each article of the law and amending source its paragraphs, kinds, targets and whether one restates it."""
    rows = paragraphs.select(*source, gid, F.explode(amendments(F.col(text), law)).alias("x")).select(*source, gid, "x.*")
    flat = rows.groupBy("article", *source).agg(F.collect_set(gid).alias("paragraphs"), F.collect_set("kind").alias("kinds"), F.flatten(F.collect_set("targets")).alias("targets"), F.bool_or("restates").alias("restates"))
    return flat.select("article", *source, *(F.array_sort(F.array_distinct(c)).alias(c) for c in ("paragraphs", "kinds", "targets")), "restates")


def references(text: Column) -> Column:
    """Array of (article, para, clause) that a text of the act itself refers to; those of another act are left out. The
    article is empty where the text names its own (`παρ. 3 του παρόντος`)."""
    return _batched(citations.references, CITED, text)


def law_references(text: Column, law: str) -> Column:
    """`article` or `article.paragraph` of each reference to provisions of `law` (n/yyyy)."""
    return _batched(lambda x: citations.law_references(x, law), STRINGS, text)


def resolve(cited: DataFrame, known: DataFrame, key: list[str], steps: str, gid: str, out: str) -> DataFrame:
    """cited rows with the deepest id of their `steps` (array of ids, each below the one before) that exists, where all above
    it exist too; rows whose first step doesn't exist go."""
    rows = cited.select(*key, F.posexplode(steps).alias("_at", "_step"))
    found = rows.join(known.select(F.col(gid).alias("_step"), F.lit(True).alias("_known")).distinct(), "_step", "left")
    stop = found.groupBy(*key).agg(F.min(F.when(F.col("_known").isNull(), F.col("_at"))).alias("_stop"), F.collect_list(F.struct("_at", "_step")).alias("_steps"))
    last = F.array_max(F.filter("_steps", lambda x: F.col("_stop").isNull() | (x["_at"] < F.col("_stop"))))
    return stop.withColumn(out, last["_step"]).filter(F.col(out).isNotNull()).select(*key, out)


def cross_references(paragraphs: DataFrame, gid: str, text: str) -> DataFrame:
    """src, dst: the deepest provision there is of each that a paragraph of the same scope refers to. Provisions within the
    paragraph, or that it is within, are none."""
    me = F.col(gid)
    found = paragraphs.select(me.alias("src"), F.explode(references(F.col(text))).alias("x"))
    own = F.element_at(F.split(F.element_at(F.split("src", ":", 2), 2), "[.#~@]", 2), 1)
    first = F.concat(ids.scope(F.col("src")), F.lit(":"), F.when(F.col("x.article") == "", own).otherwise(F.col("x.article")))
    para, clause = F.col("x.para"), F.col("x.clause")
    second = F.when(para != "", F.concat(first, F.lit("."), para)).otherwise(first)
    steps = F.array_distinct(F.array(first, second, F.when(clause != "", F.concat(second, F.lit("."), clause)).otherwise(second)))
    rows = found.select("src", steps.alias("steps")).distinct()
    links = resolve(rows.withColumn("at", F.array_join("steps", " ")), paragraphs.select(F.explode(ids.ancestors(me)).alias("_gid")), ["src", "at"], "steps", "_gid", "dst").select("src", "dst").distinct()
    apart = ~F.array_contains(ids.ancestors(F.col("src")), F.col("dst")) & ~F.array_contains(ids.ancestors(F.col("dst")), F.col("src"))
    return links.filter(apart)


def fire_links(paragraphs: DataFrame, gid: str, text: str) -> DataFrame:
    """src, dst: references between paragraphs of the fire code (`fire:Α5.3.2`), each to the deepest paragraph that there is on the
    way to it, or to its article; those to a part of the paragraph, or to what it is a part of, are none."""
    local = F.element_at(F.split(gid, ":", 2), 2)
    read = F.pandas_udf(_fire_read, STRINGS)
    cited = paragraphs.select(F.col(gid).alias("src"), F.explode(read(F.col(text), F.left(local, F.lit(1)))).alias("x")).select("src", F.concat(F.lit("fire:"), "x").alias("cited")).distinct()
    articles = paragraphs.select(F.element_at(ids.ancestors(F.col(gid)), 1).alias("known"))
    known = paragraphs.select(F.col(gid).alias("known")).unionByName(articles)
    links = ids.deepest_known(cited, known, ["src", "cited"], "cited", "known", "dst").select("src", "dst").distinct()
    apart = ~F.array_contains(ids.ancestors(F.col("src")), F.col("dst")) & ~F.array_contains(ids.ancestors(F.col("dst")), F.col("src"))
    return links.filter(apart)


def _fire_read(texts: pd.Series, chapters: pd.Series) -> pd.Series:
    return pd.Series([citations.fire_references(t, c) for t, c in zip(texts, chapters, strict=True)], dtype=object)


def internal_refs(articles: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, cited: the articles of its own law that each article's own text refers to, but itself."""
    return articles.select(*keys, F.explode(_batched(citations.internal_numbers, STRINGS, F.col(text))).alias("cited")).distinct()


def synonym_groups(terms: DataFrame, term: str, also: str) -> DataFrame:
    """The different pairs of search stems of terms and their other names; abbreviations are none."""
    from .phrases import stem

    pairs = terms.filter(F.col(also).isNotNull() & ~F.col(also).rlike(r"[\d.]"))
    return pairs.select(stem(F.col(also)).alias("also"), stem(F.col(term)).alias("term")).distinct()


def definition(text: Column) -> Column:
    """(term, also) of a definition; null if it is none. Four forms, the first that fits: a numbered quoted term with another
    name in brackets before a colon; one without; a numbered or lettered term before a verb of defining; a term before a colon."""
    none = F.lit("")
    number = F.regexp_extract(text, r"^(\d+[Α-Ω]?\.|[α-ω]{1,3}\))\s*", 0)
    body = F.substr(text, F.length(number) + 1)
    quote = F.regexp_extract(body, "^«([^»]*)»", 1)
    after = F.ltrim(F.substr(body, F.length(quote) + 3))
    plain = body.startswith("«") == F.lit(False)
    verb = F.regexp_extract(body, r"^([^.:«»]*?)\s(?:είναι|νοείται|νοούνται|καλείται)(?![α-ωά-ώ])", 1)
    colon = F.when(F.instr(body, ":") > 0, F.substring_index(body, ":", 1)).otherwise(none)
    bracket = F.regexp_extract(F.coalesce(F.nullif(quote, none), F.nullif(verb, none), colon), r"\(([^()]*)\)\s*$", 1)

    def parts(whole: Column) -> Column:
        term = F.trim(F.when(bracket != "", F.substring_index(whole, "(", 1)).otherwise(whole))
        return F.struct(term.alias("term"), F.nullif(F.trim(bracket), none).alias("also"))

    fits = lambda whole, most: F.length(F.trim(F.substring_index(whole, "(", 1))).between(2, most)
    return (
        F.when((quote != "") & after.startswith(":") & fits(quote, 160), parts(quote))
        .when((number != "") & plain & (verb != "") & fits(verb, 100), parts(verb))
        .when((number == "") & plain & body.rlike("^[Α-ΩΆ-Ώ]") & ~colon.rlike("[.«»]") & fits(colon, 80) & body.contains(": "), parts(colon))
    )

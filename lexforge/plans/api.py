"""The commands over a corpus: info, search, read, history, changes, trace, toc. Each returns a DataFrame.

A corpus is four tables: paragraphs (dataset, file, base, article, title, art_pos, para_pos, gid, text, published), pointers
(target, by, kind, status, published, restates, superseded_by; if there, targets and paragraphs), links (a, b) and sections
(article, path). A pointer's `target` is an article, or a part of one; `targets` (array of ids) says which of its provisions are
meant, none being the article as a whole; `paragraphs` (array of ids) which texts of `by` make the change, none being all.
Three more tables may be given: commencement (article, number, rule, from_date, from_issued), sources (place, label,
source) and synonyms (group, stem).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.textfn import searchable, typed
from ..operators import ledger
from ..operators import search as find

#: Parts of a search: base texts by dataset, the issues, or all.
SCOPES = ("code", "nok", "fire", "issues", "all")
#: Places of a table of contents that are numbered together.
TOC_RANGE = 10_000


@dataclass
class Corpus:
    paragraphs: DataFrame
    pointers: DataFrame
    links: DataFrame
    sections: DataFrame
    commencement: DataFrame | None = None
    sources: DataFrame | None = None
    synonyms: DataFrame | None = None

    def _below(self, gid: str) -> Column:
        return F.array_contains(ids.ancestors(F.col("gid")), gid)

    def info(self) -> DataFrame:
        """dataset, issues: files besides the base text."""
        return self.paragraphs.groupBy("dataset").agg((F.countDistinct("file") - F.max(F.col("base").cast("int"))).alias("issues"))

    def search(self, terms: list[list[list[str]]], tier: Column | None = None, limit: int = 8, per_article: int = 3) -> DataFrame:
        """The best paragraphs of the best articles: tier, then 10 a term in the title and the best paragraph, then order."""
        hits = find.score_paragraphs(self.paragraphs.withColumn("key", F.concat_ws(":", "file", "article")), terms, "text", "title")
        title = searchable(F.coalesce("title", F.lit("")))
        bonus = sum((F.when(F.exists(F.array(*(F.forall(F.array(*(F.lit(typed(s)) for s in alt)), lambda s: F.contains(title, s)) for alt in alts)), lambda x: x), 10).otherwise(0) for alts in terms), F.lit(0))
        best = find.best_articles(hits, "key", F.lit(0) if tier is None else tier, limit, bonus)
        shown = find.top_per_article(hits.join(F.broadcast(best.select("key", "tier", "best")), "key"), "key", "para_pos", per_article)
        return shown.select("tier", "best", "key", "rnk", "gid", "score", "text")

    def terms(self, stems: list[str]) -> list[list[list[str]]]:
        """The stems of a search with the other members of their synonym groups: for each, alternatives of one or more stems."""
        asked = list(dict.fromkeys(s for x in stems if (s := typed(x.strip()))))
        out = {s: [[s]] for s in asked}
        if asked and self.synonyms is not None:
            rows = self.paragraphs.sparkSession.createDataFrame([(s,) for s in asked], "term string")
            for r in find.alternatives(rows, "term", self.synonyms).orderBy("term", "stem").collect():  # a few stems
                if (alt := r["stem"].split()) not in out[r["term"]]:
                    out[r["term"]].append(alt)
        return list(out.values())

    def within(self, scope: str) -> Corpus:
        """The corpus with the paragraphs of one part alone; the filter reaches the scan."""
        if scope not in SCOPES:
            raise ValueError(f"{scope!r} is none of {', '.join(SCOPES)}")
        base = F.col("base")
        rows = {"all": self.paragraphs, "issues": self.paragraphs.filter(~base)}.get(scope)
        return replace(self, paragraphs=self.paragraphs.filter(base & (F.col("dataset") == scope)) if rows is None else rows)

    def found(self, terms: list[list[list[str]]]) -> DataFrame:
        """(articles, paragraphs): how many match, shown or not."""
        hits = find.score_paragraphs(self.paragraphs, terms, "text", "title")
        return hits.agg(F.countDistinct("file", "article").alias("articles"), F.count(F.lit(1)).alias("paragraphs"))

    def _pointers(self) -> DataFrame:
        """Pointers with `article` (the article changed) and arrays `targets` and `paragraphs`, empty where all is meant."""
        p, none = self.pointers, F.array().cast("array<string>")
        whole = F.element_at(ids.ancestors(F.col("target")), 1)
        targets = F.coalesce("targets", none) if "targets" in p.columns else F.when(F.col("target") == whole, none).otherwise(F.array("target"))
        return p.withColumns({"article": whole, "targets": targets, "paragraphs": F.coalesce("paragraphs", none) if "paragraphs" in p.columns else none})

    def _concerning(self, gid: str, as_of: str | None = None) -> DataFrame:
        """Pointers that can change a provision: those of its article that mean the whole of it, a part of the provision or what it is a
        part of, published by a day or undated, with `hidden`: superseded by another of them."""
        up = ids.ancestors(F.lit(gid))
        whole = F.lit(gid) == F.element_at(up, 1)
        met = F.exists("targets", lambda t: F.array_contains(up, t) | F.array_contains(ids.ancestors(t), gid))
        p = self._pointers().filter((F.col("article") == F.element_at(up, 1)) & (whole | (F.size("targets") == 0) | met))
        if as_of:
            p = p.filter(F.col("published").isNull() | (F.col("published") <= F.lit(as_of).cast("date")))
        others = p.select(F.col("by").alias("_by")).distinct()
        return p.join(others, F.col("superseded_by") == F.col("_by"), "left").withColumn("hidden", F.col("_by").isNotNull()).drop("_by")

    def status(self, gid: str, as_of: str | None = None) -> DataFrame:
        """(amended, latest, hidden): the pointers that concern an id, the latest day, and how many superseded ones are left out;
        no rows where there is none."""
        mine = self._concerning(gid, as_of)
        return mine.agg(F.count_if(~F.col("hidden")).alias("amended"), F.max(F.when(~F.col("hidden"), F.col("published"))).alias("latest"), F.count_if("hidden").alias("hidden")).filter("amended + hidden > 0")

    def read(self, gid: str) -> DataFrame:
        """The paragraphs at or below an id, in printed order; no rows where there is no such id (see nearest)."""
        return self.paragraphs.filter(self._below(gid)).select("file", "art_pos", "para_pos", "gid", "text").orderBy("file", "art_pos", "para_pos")

    def nearest(self, gid: str, limit: int = 12) -> DataFrame:
        """Ids below the deepest ancestor of gid that has any: what `read` offers for an id that isn't there."""
        spark = self.paragraphs.sparkSession
        up = spark.range(1).select(F.explode(ids.ancestors(F.lit(gid))).alias("anc"))
        known = self.paragraphs.select("gid", F.explode(ids.ancestors(F.col("gid"))).alias("anc")).join(F.broadcast(up), "anc")
        deepest = known.agg(F.max_by("anc", F.length("anc")).alias("anc"))
        return known.join(F.broadcast(deepest), "anc").select("gid").distinct().orderBy("gid").limit(limit)

    def _visible(self, as_of: str | None) -> DataFrame:
        """Pointers as of a day: a superseded one goes only if what supersedes it is out by then."""
        p = self.pointers
        if as_of:
            p = p.filter(F.col("published").isNull() | (F.col("published") <= F.lit(as_of).cast("date")))
        left = p.select(F.col("by").alias("_by")).distinct()
        return p.join(left, F.col("superseded_by") == F.col("_by"), "left_anti")

    def _starts(self, pointers: DataFrame) -> DataFrame:
        """pointers with `rule`, `starts`, `from_issued` and `commencement`: the first commencement article at or after the amending
        article in its act, else the last one."""
        empty = {"commencement": F.lit(None).cast("string"), "rule": F.lit(None).cast("string"), "starts": F.lit(None).cast("date"), "from_issued": F.lit(None).cast("date")}
        if self.commencement is None:
            return pointers.withColumns(empty)
        number = F.coalesce(F.regexp_extract(ids.article(F.element_at(F.split("by", ":", 2), 2)), r"^(\d+)", 1).try_cast("long"), F.lit(0).cast("long"))
        rows = pointers.withColumns({"_scope": ids.scope(F.col("by")), "_n": number})
        rules = self.commencement.select(ids.scope(F.col("article")).alias("_scope"), F.col("number").cast("long").alias("_g"), F.col("article").alias("commencement"), "rule", F.col("from_date").alias("starts"), "from_issued")
        governed = ledger.forward_asof(rows.select("_scope", "_n").distinct(), rules.withColumnRenamed("_g", "_rn"), "_scope", "_n", "_rn", "_g")
        return rows.join(governed, ["_scope", "_n"], "left").join(rules, ["_scope", "_g"], "left").drop("_scope", "_n", "_g")

    def history(self, gid: str, as_of: str | None = None) -> DataFrame:
        """Base paragraphs (part 0), then the amendments that concern an id by date (undated first): what each means and when it
        starts, and its texts: those of its paragraphs, or of the amending article. Of an amendment that gives a whole article anew,
        only the quoted text of the part asked for, where there is any, and the amending words."""
        null = lambda kind: F.lit(None).cast(kind)
        said = {"kind": "string", "status": "string", "restates": "boolean", "targets": "array<string>", "rule": "string", "starts": "date", "commencement": "string"}
        base = self.read(gid).select(F.lit(0).alias("part"), null("date").alias("published"), null("string").alias("by"), *(null(k).alias(c) for c, k in said.items()), "gid", "text")
        mine = self._starts(self._concerning(gid, as_of).filter(~F.col("hidden")))
        asked = F.explode_outer(F.when(F.size("paragraphs") > 0, F.col("paragraphs")).otherwise(F.array("by"))).alias("_asked")
        texts = self.paragraphs.select(F.col("gid").alias("_gid"), "text", F.explode(ids.ancestors(F.col("gid"))).alias("_anc"))
        keep = ["published", "by", *said]
        rows = mine.select(*keep, asked).join(texts, F.col("_asked") == F.col("_anc"), "left").select(F.lit(1).alias("part"), *keep, F.col("_gid").alias("gid"), "text").distinct()
        local = gid.partition(":")[2]
        article, _, below = local.partition(".")
        if below:  # a part: cut what restates the article
            want = (article[1:] + "." if article[:1].isalpha() else "") + below
            quoted = F.col("gid").contains("~")
            fits = F.array_contains(ids.ancestors(F.concat(F.lit("q:"), F.substring_index(F.element_at(F.split("gid", "~", 2), -1), "~", 1))), f"q:{want}")
            rows = rows.withColumn("_fits", quoted & fits).withColumn("_any", F.max("_fits").over(Window.partitionBy("by", "published")))
            rows = rows.filter(F.coalesce(~F.col("restates") | ~F.col("_any") | ~quoted | F.col("_fits"), F.lit(True))).drop("_fits", "_any")
        return base.unionByName(rows).orderBy("part", F.col("published").asc_nulls_first(), "by", "gid")

    def changes(self, since: str) -> DataFrame:
        """Pointers published on or after a day that aren't superseded; undated ones don't show."""
        return self._visible(None).filter(F.col("published") >= F.lit(since).cast("date")).orderBy("published", "target")

    def trace(self, gid: str) -> DataFrame:
        """Both ends of the links related to an id."""
        one = self.paragraphs.sparkSession.createDataFrame([(gid,)], "asked string")
        l = self.links.select("a", "b")
        forth, back = ids.related_join(one, l, "asked", "a"), ids.related_join(one, l.select(F.col("b").alias("b"), F.col("a").alias("a")), "asked", "b")
        return forth.select(F.col("a").alias("at"), F.col("b").alias("other")).unionByName(back.select(F.col("b").alias("at"), F.col("a").alias("other"))).distinct()

    def trace_sources(self, gid: str) -> DataFrame:
        """place, label, source: the crosswalk's rows for the places that an id is, or is linked to."""
        spark = self.paragraphs.sparkSession
        asked = spark.createDataFrame([(gid,)], "asked string")
        linked = ids.related_join(asked, self.links.select("a", "b"), "asked", "a").select(F.col("b").alias("asked"))
        places = asked.unionByName(linked).distinct()
        return ids.related_join(places, self.sources, "asked", "place").select(*self.sources.columns).distinct()

    def toc(self, dataset: str, section: str | None = None) -> DataFrame:
        """Articles in order with their section; `heading` where the section changes.

        Places are numbered in ranges of `art_pos`, so no task holds a whole text: a range looks back to the last path of the one before it.
        """
        arts = self.paragraphs.filter(F.col("dataset") == dataset).groupBy("article").agg(F.min("art_pos").alias("art_pos"), F.first("title").alias("title"))
        rows = arts.join(self.sections, "article", "left")
        if section:
            rows = rows.filter(searchable(F.concat_ws(" ", "path", "title")).contains(typed(section)))
        place = F.struct("art_pos", "article")
        rows = rows.withColumn("_part", F.floor(F.col("art_pos") / TOC_RANGE))
        ends = rows.groupBy("_part").agg(F.max_by("path", place).alias("_last"))
        before = ends.withColumn("_before", F.lag("_last").over(Window.orderBy("_part")))
        own = Window.partitionBy("_part").orderBy("art_pos", "article")
        joined = rows.join(before.select("_part", "_before"), "_part")
        led = F.row_number().over(own) == 1
        previous = F.when(led, F.col("_before")).otherwise(F.lag("path").over(own))
        return joined.withColumn("heading", F.when(~F.col("path").eqNullSafe(previous), F.col("path"))).drop("_part", "_before").orderBy("art_pos", "article")

import datetime
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lexforge import cli
from lexforge.functions import textfn
from lexforge.plans.api import Corpus

D = datetime.date


@pytest.fixture(scope="module")
def corpus(spark):
    p = [
        ("nok", "B", True, "27", "Εξώστες", 0, 0, "nok:27.1", "Ο εξώστης ορίζεται.", D(2012, 4, 9)),
        ("nok", "B", True, "27", "Εξώστες", 0, 1, "nok:27.5", "Φυτεμένα δώματα.", D(2012, 4, 9)),
        ("nok", "B", True, "270", "Άλλο", 1, 0, "nok:270.1", "εξώστης και εξώστης", D(2012, 4, 9)),
        ("nok", "F1", False, "3", "Τροποποίηση", 0, 0, "FEK-A-1-2013:3.1", "Νέα παρ. 5.", D(2013, 1, 1)),
        ("nok", "F2", False, "4", "Τροποποίηση", 0, 0, "FEK-A-2-2016:4.1", "Νεότερη παρ. 5.", D(2016, 1, 1)),
    ]
    q = [("nok:27.5", "FEK-A-1-2013:3.1", "amend", "matcher", D(2013, 1, 1), False, "FEK-A-2-2016:4.1"), ("nok:27.5", "FEK-A-2-2016:4.1", "amend", "confirmed", D(2016, 1, 1), False, None)]
    return Corpus(
        spark.createDataFrame(p, "dataset string, file string, base boolean, article string, title string, art_pos int, para_pos int, gid string, text string, published date"),
        spark.createDataFrame(q, "target string, by string, kind string, status string, published date, restates boolean, superseded_by string"),
        spark.createDataFrame([("nok:27.5", "code:224.3")], "a string, b string"),
        spark.createDataFrame([("27", "Α"), ("270", "Β")], "article string, path string"),
    )


def test_commands(corpus):
    assert corpus.info().first()["issues"] == 2
    assert [r["gid"] for r in corpus.read("nok:27").collect()] == ["nok:27.1", "nok:27.5"]
    assert [r["gid"] for r in corpus.nearest("nok:27.9").collect()] == ["nok:27.1", "nok:27.5"]
    hits = corpus.search([[["εξωστ"]]]).collect()
    assert [(r["key"], r["best"]) for r in hits] == [("B:27", 13), ("B:270", 2)]
    assert [r["key"] for r in corpus.search([[["Εξώστ"]]]).collect()] == ["B:27", "B:270"]
    assert [r["article"] for r in corpus.toc("nok", "Εξώστ").collect()] == ["27"]
    assert [r["by"] for r in corpus.history("nok:27.5", "2015-01-01").collect()] == [None, "FEK-A-1-2013:3.1"]
    assert [r["by"] for r in corpus.history("nok:27").collect()][2:] == ["FEK-A-2-2016:4.1"]
    assert [r["by"] for r in corpus.changes("2013-01-01").collect()] == ["FEK-A-2-2016:4.1"]
    assert [tuple(r) for r in corpus.trace("code:224.3.β").collect()] == [("code:224.3", "nok:27.5")]
    assert {(r["article"], r["heading"]) for r in corpus.toc("nok").collect()} >= {("27", "Α"), ("270", "Β")}


def related(a, b):
    return a == b or any(x.startswith(y) and x[len(y)] in ".#~@" for x, y in ((a, b), (b, a)) if len(x) > len(y))


def concerned(pointers, gid, as_of):
    """Pointers of a provision in plain Python: (by, hidden)."""
    article = gid.split(".")[0]
    mine = [p for p in pointers if p["target"] == article and (gid == article or not p["targets"] or any(related(t, gid) for t in p["targets"])) and (not as_of or p["published"] is None or p["published"] <= as_of)]
    there = {p["by"] for p in mine}
    return sorted((p["by"], p["superseded_by"] in there) for p in mine)


def test_pointers_with_targets_paragraphs_and_starts(spark, corpus):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        a = f"nok:{rng.randint(1, 3)}"
        targets = rng.choice([None, [], [f"{a}.{rng.randint(1, 3)}"], [f"{a}.{rng.randint(1, 3)}.α", f"{a}.{rng.randint(1, 12)}"]])
        rows.append((a, targets, f"FEK-A-{i}-2013:{rng.randint(1, 9)}", rng.choice([None, [f"FEK-A-{i}-2013:1.1"]]), "amend", "s", rng.choice([None, D(2013, 1, 1 + i % 28)]), False, rng.choice([None, f"FEK-A-{rng.randint(0, 119)}-2013:{rng.randint(1, 9)}"])))
    schema = "target string, targets array<string>, by string, paragraphs array<string>, kind string, status string, published date, restates boolean, superseded_by string"
    pointers = spark.createDataFrame(rows, schema)
    c = replace(corpus, pointers=pointers)
    plain = [dict(zip([f.name for f in pointers.schema], r, strict=True)) for r in rows]
    for gid in ("nok:1", "nok:2.1", "nok:3.2.α", "nok:1.1#2"):
        for as_of in (None, "2013-01-14"):
            got = sorted((r["by"], r["hidden"]) for r in c._concerning(gid, as_of).select("by", "hidden").collect())
            assert got == concerned(plain, gid, as_of and D.fromisoformat(as_of))


def test_history_in_full(spark, corpus):
    p = [("nok", "F1", False, "3", "Τ", 0, i, f"FEK-A-1-2013:3{x}", x, D(2013, 1, 1)) for i, x in enumerate([".1", ".2", ".2~6", ".2~6.7", ".2~6.7#1", ".2~6.8"])]
    paragraphs = corpus.paragraphs.filter("file <> 'F1'").unionByName(spark.createDataFrame(p, corpus.paragraphs.schema))
    schema = "target string, targets array<string>, by string, paragraphs array<string>, kind string, status string, published date, restates boolean, superseded_by string"
    pointers = spark.createDataFrame([("nok:27", None, "FEK-A-1-2013:3", ["FEK-A-1-2013:3.2"], "amend", None, D(2013, 1, 1), True, None), ("nok:27", ["nok:27.9"], "FEK-A-2-2016:4", None, "amend", None, D(2016, 1, 1), False, None)], schema)
    rules = spark.createDataFrame([("FEK-A-1-2013:2", 2, "text", None, None), ("FEK-A-1-2013:9", 9, "publication", D(2013, 1, 5), None), ("FEK-A-1-2013:20", 20, "text", None, None), ("FEK-A-2-2016:1", 1, "publication", D(2016, 2, 2), None)], "article string, number int, rule string, from_date date, from_issued date")
    c = replace(corpus, paragraphs=paragraphs, pointers=pointers, commencement=rules)
    rows = c.history("nok:27.7").filter("part = 1").collect()
    assert [(r["gid"], r["starts"], r["commencement"]) for r in rows] == [(f"FEK-A-1-2013:3{x}", D(2013, 1, 5), "FEK-A-1-2013:9") for x in (".2", ".2~6", ".2~6.7", ".2~6.7#1", ".2~6.8")]  # nothing quoted is 27.7
    cut = replace(c, pointers=pointers.withColumn("target", F.lit("fire:Α6")), paragraphs=paragraphs).history("fire:Α6.7").filter("part = 1 AND by LIKE '%2013%'").collect()
    assert [r["gid"] for r in cut] == [f"FEK-A-1-2013:3{x}" for x in (".2", ".2~6.7", ".2~6.7#1")]
    assert [r["starts"] for r in c.history("nok:27.9").filter("by LIKE '%2016%'").collect()] == [D(2016, 2, 2)]


def test_search_with_synonyms_and_parts(spark, corpus):
    groups = spark.createDataFrame([("1", "μπαλκον"), ("1", "εξωστ")], "group string, stem string")
    c = replace(corpus, synonyms=groups)
    assert c.terms(["Μπαλκόνι", "  "]) == [[["μπαλκονι"], ["εξωστ"], ["μπαλκον"]]]
    assert {r["key"] for r in c.search(c.terms(["μπαλκόνι"])).collect()} == {"B:27", "B:270"}
    assert c.within("nok").paragraphs.count() == 3 and c.within("issues").paragraphs.count() == 2 and c.within("code").paragraphs.count() == 0
    with pytest.raises(ValueError):
        c.within("other")


def test_crosswalk_rows_of_a_place(spark, corpus):
    sources = spark.createDataFrame([("code:224.3", "Παρ. 3", "x"), ("code:224.4", "Παρ. 4", "y"), ("code:224", None, "z")], "place string, label string, source string")
    c = replace(corpus, sources=sources)
    assert {r["source"] for r in c.trace_sources("nok:27.5").collect()} == {"x", "z"} and {r["source"] for r in c.trace_sources("code:224.4").collect()} == {"y", "z"}


def test_command_line(corpus, capsys):
    assert cli.main(["read", "nok:27.5"], corpus) == 0
    assert capsys.readouterr().out.splitlines()[0] == "Status: amended 1 time(s), latest 2016-01-01. 1 superseded left out."
    assert cli.main(["read", "nok:27.9"], corpus) == 2 and "there are nok:27.1, nok:27.5" in capsys.readouterr().err
    assert cli.main(["read", "xyz"], corpus) == 2 and cli.main(["changes", "--since", "2013-13-01"], corpus) == 2
    capsys.readouterr()
    assert cli.main(["search", "εξωστ", "--in", "issues"], corpus) == 0 and cli.main(["search", "x", "--in", "any"], corpus) == 2 and cli.main(["search", " "], corpus) == 2
    capsys.readouterr()
    assert cli.main(["search", "εξωστ", "--limit", "1"], corpus) == 0
    assert capsys.readouterr().out.splitlines()[-1] == "1 more articles match"
    for args in (["info"], ["history", "nok:27", "--as-of", "2015-01-01"], ["changes"], ["trace", "code:224.3.b"], ["toc", "nok"]):
        assert cli.main(args, corpus) == 0 and capsys.readouterr().out


def test_pages_by_size(spark):
    sizes = spark.createDataFrame([([5, 5, 5, 20, 1],)], "s array<bigint>")
    assert sizes.select(textfn.pages(F.col("s"), 10).alias("p")).first()["p"] == [1, 1, 2, 3, 4]

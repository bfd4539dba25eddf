"""Crosswalk tables and base texts on small fixtures: errata that apply once, entries of every form, stacks of headings."""

import pytest

from lexforge.operators import base_text, crosswalk


def lines(spark, *texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc int, at int, line string")


TABLE = [
    "ΠΡΙΝ ΤΟΝ ΠΙΝΑΚΑ",
    "Άρθρο 1   Περ. α) έως ιδ) Άρθρο 1 του ν. 4447/2016, όπως ισχύει (Α΄ 241).",
    "   ΕΦΗΜΕΡΙΔΑ ΤΗΣ ΚΥΒΕΡΝΗΣΕΩΣ",
    "1234",
    "          Περ. ιε) Παρ. 5 του άρθρου 27" + " " * 80 + "Άρθρο 3 του βασικού",
    "          του ν. 4067/2012. Παρ. 8 του άρθρου 27 του ν. 4067/2012.",
    "          Περ. Παρ. 22 του άρθρου 2 του ν. 1577/1985. 40Α",
    "Άρθρο",
    "2         Παρ. 10 Το άρθρο 3 του ν. 4067/2012.",
    "          Παρ. 1 Παρ. 1 και 2 του άρθρου 13 του ν. 4067/2012, με το άρθρο 7 1 του ν. 4315/2014.",
    "Άρθρο 3   Παρ. 2 Άρθρο 3 του ν. 4067/2012. E Παρ. 3 Εδάφ. άλλο.",
]


def test_entries(spark):
    table = crosswalk.articles(lines(spark, *TABLE), ["doc"], "at", "line")
    got = [tuple(r)[1:] for r in crosswalk.entries(table, ["doc"]).orderBy("code_article", "seq").collect()]
    assert got == [
        ("1", 1, "α) έως ιδ)", "Περ. α) έως ιδ)", "Άρθρο 1 του ν. 4447/2016, όπως ισχύει (Α΄ 241)."),
        ("1", 2, "ιε)", "Περ. ιε)", "Παρ. 5 του άρθρου 27 του ν. 4067/2012."),
        ("1", 3, "ιε)", "Περ. ιε)", "Παρ. 8 του άρθρου 27 του ν. 4067/2012."),
        ("1", 4, "40Α", "Περ. 40Α", "Παρ. 22 του άρθρου 2 του ν. 1577/1985."),
        ("2", 1, "10", "Παρ. 10", "Το άρθρο 3 του ν. 4067/2012."),
        ("3", 1, "1", "Παρ. 1", "Παρ. 1 και 2 του άρθρου 13 του ν. 4067/2012, με το άρθρο 7 1 του ν. 4315/2014."),
        ("3", 2, "2", "Παρ. 2", "Άρθρο 3 του ν. 4067/2012."),
        ("3", 3, "3", "Παρ. 3", "Εδάφ. άλλο."),
    ]
    refs = crosswalk.provisions(crosswalk.entries(table, ["doc"]), ["doc"], "4067/2012", 2012).orderBy("code_article", "seq").collect()
    assert [r["codified"] for r in refs] == [[], ["27.5"], ["27.8"], [], ["3"], ["13.1", "13.2"], ["3"], []]
    assert [[tuple(x) for x in r["amended_by"]] for r in refs][5] == [("4315/2014", "7")]


def test_errata_apply_exactly_once(spark):
    table = crosswalk.articles(lines(spark, *TABLE), ["doc"], "at", "line")
    patch = lambda *rows: spark.createDataFrame(rows, "article string, seq int, wrong string, right string")
    good = patch(("1", 1, "Παρ. 8 του", "Παρ. 9 του"), ("1", 2, "Παρ. 9 του άρθρου 27", "Παρ. 9 του άρθρου 28"))
    with pytest.raises(ValueError, match="stands 0 times"):
        crosswalk.with_errata(table, good)  # the second counts on the printed text
    fixed = crosswalk.with_errata(table, patch(("1", 1, "Παρ. 8 του", "Παρ. 9 του"))).filter("article = '1'").first()["text"]
    assert "Παρ. 9 του άρθρου 27 του ν. 4067/2012." in fixed
    for bad in (("1", 1, "άρθρου 27", "x"), ("9", 1, "Παρ.", "x")):
        with pytest.raises(ValueError):
            crosswalk.with_errata(table, patch(bad))
    assert crosswalk.errata_problems(table, patch(("1", 1, "άρθρου 27", "x"))).first()["hits"] == 2


def plain_stack(articles, level):
    path, out = [], []
    for heads in articles:
        for h in heads:
            path = [x for x in path if level(x) < level(h)] + [h]
        out.append(list(path))
    return out


def test_section_paths(spark):
    arts = [[], ["ΜΕΡΟΣ Α", "ΤΜΗΜΑ 1"], ["ΚΕΦΑΛΑΙΟ i"], [], ["ΚΕΦΑΛΑΙΟ ii", "ΑΛΛΟ"], ["ΤΜΗΜΑ 2"], ["ΚΕΦΑΛΑΙΟ i", "ΜΕΡΟΣ Β"], ["ΚΕΦΑΛΑΙΟ x"], ["ΤΜΗΜΑ 3", "ΤΜΗΜΑ 4"]]
    rows = spark.createDataFrame([(1, i, h) for i, h in enumerate(arts)], "doc int, i int, heads array<string>")
    got = [r["path"] for r in base_text.section_paths(rows, ["doc"], "i", "heads").orderBy("i").collect()]
    assert got == plain_stack(arts, lambda h: base_text.HEADING_LEVELS.get(h.split()[0], base_text.LOWEST))


def test_contents_and_gaps(spark):
    found = spark.createDataFrame([(1, 1, "δόμησης", 1, ["α"]), (1, 2, "Όροι", 3, ["χρήσης", "β"]), (1, 5, "Ίδιος", 9, ["γ"])], "doc int, number int, title string, page int, paragraphs array<string>")
    contents = spark.createDataFrame([(1, 1, "Κανόνες δόμησης"), (1, 2, "Όροι χρήσης"), (1, 3, "Λείπει"), (1, 5, "Άλλος")], "doc int, number int, title string")
    images = spark.createDataFrame([(1, 8), (1, 3)], "doc int, page int")
    rows = base_text.gaps(base_text.aligned(found, contents, ["doc"], "number", "title", "page", "paragraphs"), images, ["doc"], "number", "page").orderBy("number").collect()
    assert [(r["title"], r["page"], r["paragraphs"], r["missing"], r["image_pages"], r["gap"]) for r in rows] == [
        ("Κανόνες δόμησης", 1, ["α"], False, [3], None), ("Όροι χρήσης", 3, ["β"], False, [3], None), ("Λείπει", 3, [], True, [3], "missing_text"), ("", 3, [], True, [3, 8], "missing_text"), ("Ίδιος", 9, ["γ"], False, None, None),
    ]


def test_a_table_is_read_once(spark):
    """Lines are cut once, before the tests of what is a page's, and entries aren't joined with themselves."""
    table = crosswalk.articles(lines(spark, *TABLE), ["doc"], "at", "line")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan(crosswalk.entries(table, ["doc"]))
    assert plan(crosswalk.table_lines(lines(spark, *TABLE), "line")).count(f".{{{crosswalk.LAST_COLUMN}}}") == 1

"""Nested issue documents: the explicit schema, both layouts, copies, and the JSON sink."""

import json


from lexforge.sources import issues

ISSUE = {"title": "ΦΕΚ", "fek": "Α΄ 1/2020", "file": "FEK-A-1-2020.pdf", "published": "2020-01-02", "acts": [{"act": "Ν. 1/2020", "title": "Νόμος", "articles": [{"article": "1", "title": "Α", "page": 1, "paragraphs": [{"id": "1.1", "text": "ένα", "page": 1}, {"id": "1.2", "text": "δύο", "page": 2, "quoted": True}]}]}]}
BASE = {"title": "Κώδικας", "fek": "Α΄ 88/2026", "file": "FEK-A-88-2026.pdf", "published": "2026-05-01", "act": "Ν. 5306/2026", "articles": [{"article": "1", "title": "Σκοπός", "page": 3, "paragraphs": [{"id": "1#1", "text": "κείμενο", "page": 3}]}]}


def test_both_layouts_and_the_sink(spark, tmp_path):
    for i, doc in enumerate((ISSUE, BASE)):
        (tmp_path / f"FEK-{i}.json").write_text(json.dumps(doc, ensure_ascii=False, indent=1))
    rows = issues.read_issues(spark, f"file://{tmp_path}/FEK-*.json")
    assert {r["id"] for r in rows.collect()} == {"FEK-A-1-2020", "FEK-A-88-2026"}
    got = [(r["gid"], r["act"], r["text"], r["quoted"]) for r in issues.paragraphs(rows).orderBy("gid").collect()]
    assert got == [("FEK-A-1-2020:1.1", "Ν. 1/2020", "ένα", None), ("FEK-A-1-2020:1.2", "Ν. 1/2020", "δύο", True), ("FEK-A-88-2026:1#1", "Ν. 5306/2026", "κείμενο", None)]
    issues.write_issues(rows, f"file://{tmp_path}/out")
    again = spark.read.schema(rows.schema).json(f"file://{tmp_path}/out")
    assert again.exceptAll(rows).count() == 0 and again.count() == 2


def test_the_first_copy_stays(spark):
    rows = spark.createDataFrame([("f", "a", "1", 2, "late"), ("f", "a", "1", 1, "first"), ("f", "a", "2", 3, "only")], "file string, act string, article string, rank int, text string")
    assert {(r["article"], r["text"]) for r in issues.merge_copies(rows, "rank").select("article", "text").collect()} == {("1", "first"), ("2", "only")}
    assert "rank" in issues.merge_copies(rows, "rank").columns

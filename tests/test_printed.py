"""Printed issues: words to lines, reading order, text edges, and the automaton on a fixture issue with its known articles."""

import pytest
from pyspark.sql import functions as F

from lexforge.operators import columns, printed
from lexforge.operators.printed import Line, Reader


def centre(text, page=1, width=240):
    size = 4 * len(text)
    return Line(page, (width - size) / 2, (width + size) / 2, 0, width, text)


def para(text, page=1, full=True):
    return Line(page, 10, 240 if full else 100, 0, 240, text)


def flush(text, page=1, full=True):
    return Line(page, 0, 240 if full else 100, 0, 240, text)


HEAD = [centre("ΝΟΜΟΣ ΥΠ’ ΑΡΙΘ. 4067"), centre("9 Απριλίου 2012"), centre("Νέος Οικοδομικός"), centre("Κανονισμός."), centre("Ο ΠΡΟΕΔΡΟΣ"), centre("ΤΗΣ ΕΛΛΗΝΙΚΗΣ ΔΗΜΟΚΡΑΤΙΑΣ"), para("Εκδίδομε τον ακόλουθο νόμο:", full=False)]


def articles(acts):
    return [(a.number, a.title, a.headings, [(q, t) for _, q, t in a.paragraphs]) for act in acts for a in act.articles]


def test_acts_titles_headings_and_paragraphs():
    lines = [
        *HEAD, centre("ΚΕΦΑΛΑΙΟ Α΄"), centre("ΓΕΝΙΚΕΣ ΔΙΑΤΑΞΕΙΣ"), centre("Άρθρο 1"), centre("Πεδίο εφαρμογής και"), centre("ορισμοί"), para("1. Οι διατάξεις εφαρ-"), flush("μόζονται κατά τον ν. 4014/"), flush("2011 παντού.", full=False), para("2. Εκτός αυτών.", full=False),
        centre("Άρθρο 2"), centre("Τροποποιήσεις", 2), para("Το άρθρο αλλάζει ως εξής: «"), centre("Άρθρο 9", 2), centre("Άλλος τίτλος", 2), para("1. Νέο κείμενο.", 2, False), para("2. Και άλλο.».", 2, False), para("Τέλος του άρθρου.", 2, False),
        centre("Άρθρο 2Α", 3), centre("Πρόσθετο", 3), para("Κείμενο.", 3, False), centre("Άρθρο 4", 3), centre("Έναρξη", 3), para("Ισχύει.", 3, False),
        para("Αθήνα, 9 Απριλίου 2012", 3, False), centre("Ο ΥΠΟΥΡΓΟΣ", 3), flush("ΟΝΟΜΑ ΕΠΩΝΥΜΟ", 3, False), centre("ΠΑΡΑΡΤΗΜΑ Ι", 4), centre("ΠΙΝΑΚΕΣ ΕΡΓΩΝ", 4), para("Πρώτη γραμμή.", 4, False),
    ]
    (act,) = acts = Reader(lines).read()
    assert (act.kind, act.number, act.title, act.signed) == ("ν.", "4067", "Νέος Οικοδομικός Κανονισμός.", "Αθήνα, 9 Απριλίου 2012")
    assert [t for _, _, t in act.preamble] == ["ΤΗΣ ΕΛΛΗΝΙΚΗΣ ΔΗΜΟΚΡΑΤΙΑΣ", "Εκδίδομε τον ακόλουθο νόμο:"]
    assert articles(acts) == [
        ("1", "Πεδίο εφαρμογής και ορισμοί", ["ΚΕΦΑΛΑΙΟ Α΄", "ΓΕΝΙΚΕΣ ΔΙΑΤΑΞΕΙΣ"], [(False, "1. Οι διατάξεις εφαρμόζονται κατά τον ν. 4014/2011 παντού."), (False, "2. Εκτός αυτών.")]),
        ("2", "Τροποποιήσεις", [], [(False, "Το άρθρο αλλάζει ως εξής: « Άρθρο 9 Άλλος τίτλος"), (True, "1. Νέο κείμενο."), (True, "2. Και άλλο.»."), (False, "Τέλος του άρθρου.")]),
        ("2Α", "Πρόσθετο", [], [(False, "Κείμενο.")]),
        ("4", "Έναρξη", [], [(False, "Ισχύει.")]),
        ("Π-Ι", "ΠΙΝΑΚΕΣ ΕΡΓΩΝ", [], [(False, "Πρώτη γραμμή.")]),
    ]
    assert act.articles[2].page == 3 and act.articles[-1].annex


def test_contents_decide_which_heading_counts():
    listed = [flush("ΠΙΝΑΚΑΣ ΠΕΡΙΕΧΟΜΕΝΩΝ"), flush("Άρθρο 1 Σκοπός του νόμου", full=False), flush("Άρθρο 2: Όροι δόμησης οικοπέδων", full=False)]
    body = [centre("Άρθρο 1"), centre("Σκοπός του νόμου"), para("Κείμενο ένα.", full=False), centre("Άρθρο 2"), centre("Ναυτιλιακά ζητήματα"), para("Άλλου νόμου.", full=False), centre("Άρθρο 2"), centre("Όροι δόμησης"), para("Κείμενο δύο.", full=False)]
    acts = Reader([*HEAD, *listed, *body]).read()
    assert [(n, t) for n, t, _, _ in articles(acts)] == [("1", "Σκοπός του νόμου"), ("2", "Όροι δόμησης")]
    assert [t for _, t in articles(acts)[0][3]] == ["Κείμενο ένα. Άρθρο 2 Ναυτιλιακά ζητήματα", "Άλλου νόμου."]


def test_a_ratified_act_has_its_own_articles():
    lines = [centre("ΠΡΑΞΗ ΝΟΜΟΘΕΤΙΚΟΥ ΠΕΡΙΕΧΟΜΕΝΟΥ"), centre("Κύρωση κώδικα"), centre("Ο ΠΡΟΕΔΡΟΣ"), centre("Άρθρο πρώτο"), centre("Κύρωση"), para("Κυρώνεται ο κώδικας ως εξής:", full=False)]
    lines += [centre("Άρθρο 1"), centre("Πρώτο του κώδικα"), para("Α.", full=False), centre("Άρθρο 2"), centre("Δεύτερο του κώδικα"), para("Β.", full=False), centre("Άρθρο δεύτερο"), centre("Έναρξη"), para("Ισχύει.", full=False)]
    acts = Reader(lines).read()
    assert [(a.kind, [x.number for x in a.articles]) for a in acts] == [("ΠΝΠ", ["1", "2"]), ("κώδ.", ["1", "2"])]
    assert [x.label for x in acts[0].articles] == ["πρώτο", "δεύτερο"] and acts[0].articles[1].title == "Έναρξη"


def test_parts():
    assert printed.number_of(["δέκατο", "τρίτο"]) == ("13", True, 2) and printed.number_of(["ενδέκατο"]) == ("11", True, 1) and printed.number_of(["12Α", "x"]) == ("12Α", False, 1) and printed.number_of(["12ΑΒ"]) is None
    assert [printed.marker(x) for x in ("1. Όταν", "ιδ) ναι", "2Α. α", "ν. 4067/2012", "Κείμενο", "και) όχι")] == ["1.", "ιδ)", "2Α.", "", "", ""]
    assert printed.alike("Τροποποίηση άρθρου", "Τροποποίηση άρθρου 5") and not printed.alike("Όροι δόμησης", "Μεταβατικές διατάξεις")
    assert Reader([]).read() == [] and Reader([flush("μόνο κείμενο")]).read() == []


WORDS = "page int, line int, x0 double, y0 double, x1 double, y1 double, text string, width double, height double"


@pytest.fixture(scope="module")
def words(spark):
    rows = []

    def line(k, x, y, *texts, page=1, gap=4.0, size=10.0):
        for t in texts:
            rows.append((page, k, float(x), float(y), x + 4.0 * len(t), y + size, t, 600.0, 850.0))
            x += 4.0 * len(t) + gap

    line(0, 250, 20, "ΕΦΗΜΕΡΙΔΑ")  # in the header
    for i in range(3):
        line(10 + i, 50, 100 + 12 * i, f"αριστερά{i}", "στήλη", "με", "κείμενο", "αρκετό", "και", "πλήρες")
        line(20 + i, 310, 100 + 12 * i, f"δεξιά{i}", "στήλη", "με", "κείμενο", "αρκετό", "και", "πλήρες")
    line(30, 50, 150, "Μία", "γραμμή", "σε", "όλο", "το", "πλάτος", "της", "σελίδας", "και", "πέρα", "από", "το", "μέσον", "της", "όλο")
    line(40, 50, 180, "κάτω", "αριστερά", "έως", "εδώ", "και", "όχι", "πιο", "πέρα")
    line(41, 310, 180, "κάτω", "δεξιά", "έως", "εδώ", "και", "όχι", "πιο", "πέρα")
    line(50, 50, 200, "δύο", "στήλες", "σε", "μία", "γραμμή", "του", "αρχείου", "που")
    rows.extend([(1, 50, 310.0, 200.0, 340.0, 210.0, "χωρίζει", 600.0, 850.0), (1, 50, 344.0, 200.0, 380.0, 210.0, "εδώ", 600.0, 850.0)])
    rows.extend([(1, 60, 50.0, 230.0, 54.0, 240.0, "6", 600.0, 850.0), (1, 60, 54.2, 228.0, 60.0, 234.0, "ον", 600.0, 850.0), (1, 60, 700.0, 230.0, 720.0, 240.0, "έξω", 600.0, 850.0)])
    line(70, 60, 100, "μόνο", "μία", "στήλη", "εδώ", "πέρα", "ως", "πέρα", "πλατιά", "και", "μεγάλη", "γραμμή", "του", "φύλλου", "αυτού", page=2)
    return spark.createDataFrame(rows, WORDS)


def test_reading_order(words):
    lines = columns.lines_of_words(words.filter("text <> 'έξω'"), ["page"], "line", "width", "height")
    got = columns.reading_order(lines, ["page"], "width", "height").orderBy("page", "seq").collect()
    assert [(r["col"], r["text"].split(" ")[0]) for r in got if r["page"] == 1] == [("L", "αριστερά0"), ("L", "αριστερά1"), ("L", "αριστερά2"), ("R", "δεξιά0"), ("R", "δεξιά1"), ("R", "δεξιά2"), ("S", "Μία"), ("L", "κάτω"), ("L", "δύο"), ("L", "6ον"), ("R", "κάτω"), ("R", "χωρίζει")]
    assert [(r["page"], r["col"]) for r in got if r["page"] == 2] == [(2, "L")]


def test_what_lies_off_the_page_goes(words):
    lines = columns.lines_of_words(words.filter("line IN (0, 60)"), ["page"], "line", "width", "height")
    assert [r["text"] for r in columns.columns(lines, ["page"], "width", "height").collect()] == ["6ον"]


def test_text_edges(spark):
    rows = [(p, "L", 50.0 + 10 * (i % 5 == 0), 290.0 - 60 * (i % 5 == 4)) for p in (1, 3) for i in range(15)] + [(5, "L", 70.0, 200.0), (2, "L", 40.0, 280.0)]
    lines = spark.createDataFrame([(7, *r) for r in rows], "issue int, page int, col string, x0 double, x1 double")
    got = {(r["page"], r["left"], r["right"]) for r in columns.text_edges(lines, ["issue"], "page").collect()}
    assert got == {(1, 50.0, 290.0), (3, 50.0, 290.0), (5, 50.0, 290.0), (2, 40.0, 280.0)}


def test_issues_as_groups(spark):
    lines = [(k, x.page, i, float(x.x0), float(x.x1), float(x.left), float(x.right), x.text) for k in (1, 2) for i, x in enumerate([*HEAD, centre("Άρθρο 1"), centre("Τίτλος"), para(f"Κείμενο {k}.", full=False)])]
    df = spark.createDataFrame(lines, "issue int, page int, seq int, x0 double, x1 double, left double, right double, text string").withColumn("x0", F.col("x0").cast("double"))
    got = printed.parse_issues(df, ["issue"]).filter("article IS NOT NULL").orderBy("issue").collect()
    assert [(r["issue"], r["number"], r["title"], r["para"], r["text"]) for r in got] == [(1, "1", "Τίτλος", 0, "Κείμενο 1."), (2, "1", "Τίτλος", 0, "Κείμενο 2.")]
    assert printed.parse_issues(df.limit(0), ["issue"]).count() == 0

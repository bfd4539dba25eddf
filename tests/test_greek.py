"""Labels, ids, sentences and definitions of Greek legal text: fixed cases with their known results."""

import datetime

import pytest
from pyspark.sql import functions as F

from lexforge.functions import amend, greek, phrases
from lexforge.operators import numbering

LAW = r"(?:(?:του|στον)\s+)?ν\.\s*4067/2012"


def column(spark, values, f, kind="string"):
    """f of each value of a column."""
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, x {kind}").select("i", f(F.col("x")).alias("y"))
    return [r["y"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


#: Typed ids and their normal forms.
NORMAL = {
    "code:224.3.b": "code:224.3.β", "CODE:224.3.beta": "code:224.3.β", "code:224.3.β΄": "code:224.3.β", " code:224.3.Β ": "code:224.3.β", "nok:11.6.id": "nok:11.6.ιδ", "nok:10a": "nok:10Α",
    "fek-a-108-2026:133.1": "FEK-A-108-2026:133.1", "FEK-A-245-2020:120#1~4": "FEK-A-245-2020:120#1~4", "fire:p-a": "fire:Π-Α", "fire:A5.3.7.1": "fire:Α5.3.7.1", "FIRE:b3.2.a": "fire:Β3.2.α",
    "code:1.x": "code:1.ξ", "nok:1.v": "nok:1.β", "code:2.stigma": "code:2.στ", "nok:11.7a": "nok:11.7Α", "nok:Π-Α": "nok:Π-Α", "code:3.ά)": "code:3.α", "fek-a-1-2026": "FEK-A-1-2026",
    "foo:1": None, "code:": None, "code:abc": None, "nok:27.zz9": None, "code:224.": None, "code:224..3": None, "code": None,
}


def test_normal_ids(spark):
    assert dict(zip(NORMAL, column(spark, list(NORMAL), greek.normalize), strict=True)) == NORMAL


#: Sentences, with the kind, targets and restating of their reference.
SENTENCES = [
    ("Η περ. ιδ΄ της παρ. 6 του άρθρου 11 του ν. 4067/2012 (Α΄ 79) αντικαθίσταται ως εξής:", "amend", ["11.6.ιδ"], False),
    ("Στο άρθρο 28 του ν. 4067/2012 προστίθεται παρ. 11 ως εξής:", "amend", ["28.11"], False),
    ("Το άρθρο 4 του ν. 4067/2012 αντικαθίσταται ως εξής:", "amend", ["4"], True),
    ("Οι παρ. 2 και 4 του άρθρου 27 του ν. 4067/2012 τροποποιούνται ως εξής:", "amend", ["27.2", "27.4"], False),
    ("Οι παρ. 2 έως 5 του άρθρου 27 του ν. 4067/2012 τροποποιούνται ως εξής:", "amend", ["27.2", "27.3", "27.4", "27.5"], False),
    ("Καταργείται η παρ. 4 του άρθρου 20 του ν. 4067/2012.", "repeal", ["20.4"], False),
    ("Στο άρθρο 28 του ν. 4067/2012 προστίθεται περ. γ ως εξής:", "amend", ["28.γ"], False),
    ("Οι άδειες εκδίδονται σύμφωνα με την παρ. 2 του άρθρου 6 του ν. 4067/2012.", None, None, None),
    ("Οι όροι τροποποιούνται, όπως ορίζονται σύμφωνα με την παρ. 2 του άρθρου 6 του ν. 4067/2012, κάθε έτος.", None, None, None),
    ("Οι περ. α) και β) της παρ. 3 του άρθρου 5 του ν. 4067/2012 τροποποιούνται ως εξής:", "amend", ["5.3.α", "5.3.β"], False),
    ("Η περ. ιδ' της παρ. 6 του άρθρου 11 του ν. 4067/2012 αντικαθίσταται ως εξής:", "amend", ["11.6.ιδ"], False),
    ("Η περ. ιδ’ της παρ. 7Α του άρθρου 11 του ν. 4067/2012 αντικαθίσταται ως εξής:", "amend", ["11.7Α.ιδ"], False),
    ("Στον ν. 4067/2012 (Α΄ 79) προστίθεται άρθρο 20Α ως εξής:", "amend", ["20Α"], False),
    ("Το άρθρο 9 του ν. 4067/2012 ισχύει " + "και για κάθε άλλη περιοχή " * 17 + "χωρίς να τροποποιείται.", None, None, None),
    ("Στο άρθρο 36 του ν. 4067/2012, το άρθρο 36 διαμορφώνεται ως εξής:", "amend", ["36"], True),
    ("Στο άρθρο 23 παρ. δ΄ του ν. 4067/2012 προστίθενται νέες περ. α) και β).", "amend", ["23.δ", "23.δ.α", "23.δ.β"], False),
    ("Το άρθρο 3 προβλέπει «το άρθρο 4 του ν. 4067/2012 αντικαθίσταται ως εξής».", None, None, None),
]


def test_amending_sentences(spark):
    got = column(spark, [s for s, *_ in SENTENCES], lambda x: amend.amendments(x, LAW))
    for (_, kind, targets, restates), found in zip(SENTENCES, got, strict=True):
        assert [(r["kind"], r["targets"], r["restates"]) for r in found] == ([(kind, targets, restates)] if kind else [])


def test_labels(spark):
    #: Lists and their labels.
    known = {"2 και 4": ["2", "4"], "ιδ΄": ["ιδ"], "3α": ["3.α"], "το": [], "α), β) και γ'": ["α", "β", "γ"], "7Α, 8": ["7Α", "8"], "α έως δ": ["α", "β", "γ", "δ"], "5 έως και 7": ["5", "6", "7"], "9 έως 2": ["9", "2"], "": []}
    assert dict(zip(known, column(spark, list(known), amend.labels), strict=True)) == known


#: Ids and their citations.
CITED = {
    "224.3.β": "άρθ. 224 παρ. 3 περ. β΄", "120#1~4": "άρθ. 120", "206.6.ιστ.α": "άρθ. 206 παρ. 6 περ. ιστ΄ υποπερ. α΄", "Α5.3.7.1.α": "άρθ. 5 Κεφ. Α΄ παρ. 5.3.7.1 περ. α΄", "Β3": "άρθ. 3 Κεφ. Β΄",
    "11.7Α": "άρθ. 11 παρ. 7Α", "224.3.4": "άρθ. 224 παρ. 3 περ. 4", "11.3.α.2": "άρθ. 11 παρ. 3 περ. α΄ υποπερ. 2", "1.α": "άρθ. 1 περ. α΄", "1.2.α.β.γ": "άρθ. 1 παρ. 2 περ. α΄ υποπερ. β΄.γ΄",
}


def test_citations_go_by_position(spark):
    got = column(spark, list(CITED), lambda x: greek.cite(x, F.lit("Ν. 5306/2026"), F.lit("Α΄ 88/2026")))
    assert got == [f"{x} ν. 5306/2026 (ΦΕΚ Α΄ 88/2026)" for x in CITED.values()]
    assert column(spark, ["Π-Α"], lambda x: greek.cite(x, F.lit("Π.Δ. 41/2018"), F.lit("Α΄ 80/2018"), F.lit("Παράρτημα Α΄"))) == ["Παράρτημα Α΄ π.δ. 41/2018 (ΦΕΚ Α΄ 80/2018)"]


def test_a_list_of_articles_names_them_whole(spark):
    (found,) = column(spark, ["Τα άρθρα 29 έως 31 του ν. 4067/2012 καταργούνται. Στο άρθρο 5 του ν. 4067/2012 προστίθεται παρ. 2."], lambda x: amend.amendments(x, LAW))
    assert [(r["article"], r["kind"], r["targets"]) for r in found] == [("29", "repeal", ["29"]), ("30", "repeal", ["30"]), ("31", "repeal", ["31"]), ("5", "amend", ["5.2"])]


def test_references(spark):
    text = ["της περ. β) της παρ. 3 του άρθρου 224 και του άρθρου 10 του ν. 1577/1985", "των άρθρων 183 έως 185 του παρόντος Κώδικα", "του άρθρου 7 του ίδιου νόμου"]
    got = [[tuple(r) for r in x] for x in column(spark, text, amend.references)]
    own = ["Κατά την παρ. 3 του παρόντος άρθρου και την παρ. 4 του παρόντος Κεφαλαίου.", "της παρ. 5 του ίδιου άρθρου, του άρθρου 8 (Α΄ 79), του άρθρου 9 των προϊσχυόντων"]
    assert [[tuple(r) for r in x] for x in column(spark, own, amend.references)] == [[("", "3", "")], [("", "5", ""), ("9", "", "")]]
    assert got == [[("224", "3", "β")], [("183", "", ""), ("184", "", ""), ("185", "", "")], []]
    refs = {"Παρ. 5 του άρθρου 27 του ν. 4067/2012, όπως ισχύει": ["27.5"], "Παρ. 1 και 2 του άρθρου 13 του ν. 4067/2012": ["13.1", "13.2"], "Άρθρο 3 του ν. 4067/2012": ["3"], "Άρθρο 3 του ν. 1577/1985": []}
    assert column(spark, list(refs), lambda x: amend.law_references(x, "4067/2012")) == list(refs.values())


def test_deepest_known_id_without_a_hole(spark):
    cited = spark.createDataFrame([(1, ["a", "a.1", "a.1.x"]), (2, ["a", "a.2", "a.2.x"]), (3, ["b", "b.1"])], "i int, steps array<string>")
    known = spark.createDataFrame([("a",), ("a.1",), ("a.1.x",), ("a.2.x",), ("b.1",)], "gid string")
    assert {(r["i"], r["dst"]) for r in amend.resolve(cited, known, ["i"], "steps", "gid", "dst").collect()} == {(1, "a.1.x"), (2, "a")}


def test_links_between_paragraphs(spark):
    rows = [("code:1.1", "Βλ. παρ. 2 του παρόντος, παρ. 1 του άρθρου 1, άρθρο 2 και παρ. 9 του άρθρου 2."), ("code:1.2", "Βλ. περ. β) της παρ. 1 του άρθρου 2."), ("code:2.1", "Κείμενο."), ("code:2.1.β", None)]
    got = amend.cross_references(spark.createDataFrame(rows, "gid string, text string"), "gid", "text").collect()
    assert {tuple(r) for r in got} == {("code:1.1", "code:1.2"), ("code:1.1", "code:2"), ("code:1.2", "code:2.1.β")}


def test_four_forms_of_definitions(spark):
    texts = {"12. «Ανοικτός εξώστης (μπαλκόνι)»: η προεξοχή.": ("Ανοικτός εξώστης", "μπαλκόνι"), "3Α. «Δώμα»: το τμήμα.": ("Δώμα", None), "5. Ανοικτός Εξώστης (μπαλκόνι) είναι η προεξοχή.": ("Ανοικτός Εξώστης", "μπαλκόνι"), "Αντίδραση στη φωτιά (πυραντίδραση): Συμπεριφορά.": ("Αντίδραση στη φωτιά", "πυραντίδραση"), "το δώμα: τμήμα": None}
    assert [x and tuple(x) for x in column(spark, list(texts), amend.definition)] == list(texts.values())


def test_search_text(spark):
    from lexforge.functions import textfn

    assert column(spark, ["Cα Α2-s1 Εξώστ u"], textfn.searchable) == ["cα α2-s1 εξωστ u"]
    assert textfn.typed("Εξώστ Cα u") == "εξωστ cα u"
    long = "αρχή " + "λέξη " * 40 + "στόχος " + "λέξη " * 60
    (got,) = column(spark, [long], lambda x: textfn.snippet(x, F.instr(x, "στόχος")))
    assert got.startswith("…λέξη") and got.endswith("λέξη…") and "στόχος" in got and len(got) <= 262
    assert column(spark, ["short"], lambda x: textfn.snippet(x, F.lit(3))) == ["short"]


def test_definitions_and_numerals(spark):
    got = column(spark, ["«Ανοικτός εξώστης (μπαλκόνι)»: η οριζόντια προεξοχή.", "α) Οικόπεδο είναι η έκταση γης.", "Χωρίς ορισμό."], amend.definition)
    assert [x and tuple(x) for x in got] == [("Ανοικτός εξώστης", "μπαλκόνι"), ("Οικόπεδο", None), None]
    assert column(spark, ["ιστ", "κε", "ιστα", "και", "πθ"], greek.numeral) == [16, 25, None, None, 89]
    assert column(spark, ["δέκατο τρίτο", "ενδέκατο", "12Α", "εικοστό"], greek.ordinal) == ["13", "11", "12Α", "20"]


#: Commencement texts, the number of paragraphs, the rule and the day.
STARTS = [
    ("Η ισχύς του παρόντος αρχίζει από τη δημοσίευσή του.", 1, "publication", datetime.date(2020, 12, 10)),
    ("Η ισχύς του παρόντος αρχίζει από τη δημοσίευσή του, εκτός αν ορίζεται αλλιώς.", 1, "publication-unless", datetime.date(2020, 12, 10)),
    ("Η ισχύς του παρόντος αρχίζει από τη δημοσίευσή του.", 3, "publication-unless", datetime.date(2020, 12, 10)),
    ("Αρχίζει δέκα (10) ημέρες μετά τη δημοσίευσή του.", 1, "publication", datetime.date(2020, 12, 20)),
    ("Με απόφαση του Υπουργού ορίζεται η έναρξη.", 1, "text", None),
]


@pytest.mark.parametrize("text, paragraphs, rule, day", STARTS)
def test_commencement(spark, text, paragraphs, rule, day):
    x = greek.commencement(F.lit(text), F.lit("2020-12-10").cast("date"), F.lit(paragraphs), F.lit("2020-12-01").cast("date"))
    r = spark.range(1).select(x.alias("c")).first()["c"]
    assert (r["rule"], r["from_date"]) == (rule, day) and r["from_issued"] == (day and day - datetime.timedelta(days=9))


#: Texts of an article in order and their ids.
NUMBERED = [
    ("206", None, ["6. Όροι:", "ιε) ένα", "ιστ) δύο:", "ιστα) τρία", "ιστβ) τέσσερα", "ιζ) πέντε"], ["206.6", "206.6.ιε", "206.6.ιστ", "206.6.ιστ.α", "206.6.ιστ.β", "206.6.ιζ"]),
    ("207", None, ["6. Όροι", "ιβ) ιβα) ένα", "ιββ) δύο"], ["207.6", "207.6.ιβ.α", "207.6.ιβ.β"]),
    ("8", None, ["1) ένα", "2) δύο", "2Α. τρία", "1.5 μέτρα"], ["8.1", "8.2", "8.2Α", "8.2Α#1"]),
    ("5", None, ["1. Κείμενο", "και) δεν είναι αρίθμηση"], ["5.1", "5.1#1"]),
    ("7", None, ["3. Όροι:", "α) ένα.", "β) δύο.", "κείμενο", "κείμενο"], ["7.3", "7.3.α", "7.3.β", "7.3#1", "7.3#2"]),
    ("1", None, ["Σκοπός:", "α) ένα.", "β) δύο.", "Οι όροι:", "α) ένα.", "β) δύο."], ["1#1", "1.α", "1.β", "1#2", "1.α@2", "1.β@2"]),
    ("Α5", "5", ["5.3. Όροι", "κείμενο", "5.3.7.1. Όροι", "α) ένα", "5.4. Όροι", "17.2.1989 ημερομηνία"], ["Α5.3", "Α5.3#1", "Α5.3.7.1", "Α5.3.7.1.α", "Α5.4", "Α5.4#1"]),
]


def test_numbering(spark):
    for article, decimal, texts, want in NUMBERED:
        assert numbering.paragraph_ids(article, texts, decimal) == want


#: Texts of an article, which are quoted, their ids.
QUOTED = [
    ("26", ["2. Το άρθρο 6 αλλάζει:", "«6.1. Γενικά", "κείμενο", "6.5. Άλλο", "6.1. Μετάδοση", "6.6.1. Εντός", "6.7. Τέλος»"], [0, 1, 1, 1, 1, 1, 1], ["26.2", "26.2~6.1", "26.2~6.1#1", "26.2~6.5", "26.2~6.6", "26.2~6.6.1", "26.2~6.7"]),
    ("120", ["Το άρθρο αλλάζει:", "«κείμενο", "4. Τέσσερα:", "γ) τρία,", "κείμενο»", "2. Δύο"], [0, 1, 1, 1, 1, 0], ["120#1", "120#1~#1", "120#1~4", "120#1~4.γ", "120#1~4.γ#1", "120.2"]),
    ("11", ["11. Όροι:", "ιβ) δώδεκα:", "1. ένα", "2. δύο", "ιγ) δεκατρία:", "α) πρώτο", "β) δεύτερο", "ιδ) δεκατέσσερα", "12. Άλλο"], [0] * 9, ["11.11", "11.11.ιβ", "11.11.ιβ.1", "11.11.ιβ.2", "11.11.ιγ", "11.11.ιγ.α", "11.11.ιγ.β", "11.11.ιδ", "11.12"]),
    ("7", ["3. Όροι:", "α) ένα.", "β) δύο.", "κείμενο", "γ) τρία.", "γα) μέρος", "κείμενο", "4. Τέλος"], [0] * 8, ["7.3", "7.3.α", "7.3.β", "7.3#1", "7.3.γ", "7.3.γ.α", "7.3.γ.α#1", "7.4"]),
    ("8", ["1. Ένα", "ν. 4067/2012 ορίζει", "ωξ) άγνωστο", "1. Ένα πάλι"], [0] * 4, ["8.1", "8.1#1", "8.1#2", "8.1.1"]),
]


def test_numbering_of_quotations_and_resumed_lists(spark):
    for article, texts, quoted, want in QUOTED:
        assert numbering.paragraph_ids(article, texts, None, [bool(x) for x in quoted]) == want
    rows = spark.createDataFrame([(k, i, t, bool(q)) for k, (_, texts, quoted, _) in enumerate(QUOTED) for i, (t, q) in enumerate(zip(texts, quoted, strict=True))], "k int, i int, t string, q boolean").withColumn("a", F.element_at(F.array(*(F.lit(x[0]) for x in QUOTED)), F.col("k") + 1))
    got = numbering.number(rows, ["k"], "a", "i", "t", quoted="q").orderBy("k", "i").collect()
    assert [r["pid"] for r in got] == [pid for x in QUOTED for pid in x[3]]


def test_fire_references(spark):
    from lexforge.functions import citations

    #: Texts of chapter Β, and what they refer to.
    known = {
        "κατά την παρ. 5.3.7.3 του άρθρου 5 του Κεφαλαίου Α΄ και την παρ. 4.2.2 του άρθρου 4": ["Α5.3.7.3", "Α5", "Β4.2.2"], "τα άρθρα 9 και 10 του Κεφαλαίου Β": ["Β9", "Β10"], "του άρθρου 4 του παρόντος κεφαλαίου": ["Β4"],
        "του άρθρου 5 των Γενικών Διατάξεων, στο Παράρτημα Γ": ["Α5", "Π-Γ"], "κεφ. Α΄ του προϊσχύοντος π.δ. 71/1988, παρ. 2.1 του π.δ. 3/1981": [], "του άρθρου 7": [], "των άρθρων 2 έως και 4 του κεφ. Γ": ["Γ2", "Γ3", "Γ4"],
    }
    assert [citations.fire_references(t, "Β") for t in known] == list(known.values())
    rows = [("fire:Α5", ""), ("fire:Α5.3", "Βλ. παρ. 5.3.7.9 του άρθρου 5 και παρ. 6.1.2."), ("fire:Α5.3.7", "Βλ. παρ. 9.1, παρ. 6.2.5.1."), ("fire:Α6.2.5", "Βλ. το άρθρο 5 του παρόντος κεφαλαίου."), ("fire:Α6.1", "")]
    got = amend.fire_links(spark.createDataFrame(rows, "gid string, text string"), "gid", "text").collect()
    assert {tuple(r) for r in got} == {("fire:Α5.3", "fire:Α6.1"), ("fire:Α5.3.7", "fire:Α6.2.5"), ("fire:Α6.2.5", "fire:Α5")}


def test_internal_references():
    from lexforge.functions import citations

    #: Texts, and the articles of their own law that they refer to.
    known = {
        "Των άρθρων 66 έως 68 και του άρθρου 70 του παρόντος": ["66", "67", "68", "70"], "τα άρθρα 1 έως και 4 και το άρθρο 16 του ν. 719/1977": [], "το άρθρο 5 και, χωριστά, το άρθρο 16 του ν. 719/1977": ["5"],
        "των άρθρων 13 περίπτωση α΄ και 263Α του Ποινικού Κώδικα": [], "του άρθρου 14β, κατά το «άρθρο 9»": ["14"], "τα άρθρα 4 έως 7 του από 5/17.9.1935 π.δ.": [], "του άρθρου 8 (Α΄ 79)": [], "κατά το άρθρο 3 " + "και όσα άλλα ορίζονται " * 5 + "του ν. 1/1990": ["3"],
    }
    assert [citations.internal_numbers(t) for t in known] == list(known.values())


def test_levels_of_the_pages_of_a_law():
    assert numbering.marks("5. α) αβ) κείμενο") == [numbering.Mark("number", 5, "5"), numbering.Mark("clause", 1, "α"), numbering.Mark("part", 0, "αβ")]
    assert numbering.decimal_path("17.2.1989 κάτι") is None and numbering.decimal_path("5.3.7.1. Όροι") == ("5.3.7.1", "Όροι")


def test_phrases(spark):
    assert column(spark, ["Ανοικτός εξώστης", "Το δώμα και η στέγη"], phrases.stem) == ["ανοικτ εξωστ", "δωμα στεγ"]
    joined = column(spark, [["", "κτί-", "ριο του ν. 4014/", "2011 - όροι", "Α-", "Β α-", "Β"]], phrases.joined, "array<string>")
    assert joined == ["κτίριο του ν. 4014/2011 - όροι ΑΒ α- Β"]
    assert column(spark, ["ΤΜΗΜΑ VΙΙ", "AΡΘΡO", "MWh", "TEE"], phrases.greek_lookalikes) == ["ΤΜΗΜΑ VII", "ΑΡΘΡΟ", "MWh", "TEE"]

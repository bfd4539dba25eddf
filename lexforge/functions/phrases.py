"""Phrases of legal texts and listings as expressions: stems, titles, labels, links, joined lines, headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .textfn import fold

#: Words that a stem search leaves out, and endings that a stem loses.
STOP = ("η", "ο", "το", "τα", "οι", "του", "της", "των", "και", "ή")
ENDINGS = "(?:ου|ων|ος|ης|ας|ες|οι|εσ|οσ|ησ|ασ|α|η|ο|ι|ε|υ|σ)$"
#: Stems that titles of amending articles share anyway.
COMMON = ("τροπο", "αρθρο", "προσθ", "αντικ", "καταρ", "ρυθμι", "διατα", "σχετι")
#: Latin letters that look like Greek ones, and these.
ALIKE, ALIKE_GREEK = "ABEHIKMNOPTXYZaeiopxyv∆", "ΑΒΕΗΙΚΜΝΟΡΤΧΥΖαειορχυνΔ"


def stem(phrase: Column) -> Column:
    """Search stems of a phrase: folded words without stop words; of more than four letters, without the ending."""
    words = F.filter(F.regexp_extract_all(fold(phrase), F.lit("([α-ω]+)"), 1), lambda w: ~w.isin(*STOP))
    return F.array_join(F.transform(words, lambda w: F.when(F.length(w) > 4, F.regexp_replace(w, ENDINGS, "")).otherwise(w)), " ")


def title_stems(title: Column) -> Column:
    """The first five letters of each different word of four or more."""
    return F.array_distinct(F.transform(F.regexp_extract_all(fold(title), F.lit("([\\p{L}]{4,})"), 1), lambda w: F.substring(w, 1, 5)))


def same_title(body: Column, listed: Column) -> Column:
    """Whether an article's title is a contents entry's: three tenths of its first ten words' stems are shared, common
    ones not counting unless one of the two has no others."""
    a, b = title_stems(F.array_join(F.slice(F.split(F.trim(body), r"\s+"), 1, 10), " ")), title_stems(listed)
    common = F.array(*(F.lit(x) for x in COMMON))
    shared = F.array_intersect(a, b)
    only_common = (F.size(F.array_except(a, common)) == 0) | (F.size(F.array_except(b, common)) == 0)
    enough = F.size(shared) >= F.greatest(F.lit(1), F.bround(F.size(a) * F.lit(0.3)).cast("int"))
    return (F.size(shared) > 0) & F.when(F.size(F.array_except(shared, common)) > 0, enough).otherwise(only_common)


def plain_title(title: Column) -> Column:
    """Without hyphenation, with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(title, r"(?<=[a-zα-ωά-ώ])- (?=[a-zα-ωά-ώ])", ""), r"\s+", " "))


def joined(lines: Column) -> Column:
    """Lines as one text: a hyphen goes where the next line continues its word in the same case, a slash meets a digit
    without a space, empty lines before the text fall away."""

    def step(a: Column, b: Column) -> Column:
        last = F.substring(F.rtrim(a), -2, 1)
        case = lambda c: c.rlike(r"^\p{Ll}$")
        goes_on = a.rlike(r"\p{L}-$") & b.rlike(r"^\p{L}") & (case(last) == case(F.substring(b, 1, 1)))
        glued = F.substr(a, F.lit(1), F.length(a) - 1)
        return F.when(a == "", b).when(goes_on, F.concat(glued, b)).when(a.endswith("/") & b.rlike(r"^\d"), F.concat(a, b)).otherwise(F.concat_ws(" ", a, b))

    return F.aggregate(lines, F.lit(""), step)


def greek_lookalikes(text: Column) -> Column:
    """Latin look-alikes as Greek letters inside words that have Greek ones and no other Latin ones; Latin words stay. A
    Roman numeral of both scripts becomes Latin."""
    words = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_∆]+|[^\p{L}\p{N}_∆]+)"), 1)

    def one(w: Column) -> Column:
        roman = w.rlike("^[IVXΙΧ]+$") & w.rlike("[ΙΧ]") & w.rlike("[IVX]")
        runs = F.regexp_extract_all(w, F.lit("([A-Za-z∆]+|[^A-Za-z∆]+)"), 1)
        greek = w.rlike("[Ͱ-Ͽἀ-῿]")
        beside = lambda i: F.coalesce(F.get(runs, i - 1).rlike("[Ͱ-Ͽἀ-῿]$"), F.lit(False)) | F.coalesce(F.get(runs, i + 1).rlike("^[Ͱ-Ͽἀ-῿]"), F.lit(False))
        mixed = F.array_join(F.transform(runs, lambda r, i: F.when(beside(i) & r.rlike(f"^[{ALIKE}]+$"), F.translate(r, ALIKE, ALIKE_GREEK)).otherwise(r)), "")
        return F.when(roman, F.translate(w, "ΙΧ", "IX")).when(greek, mixed).otherwise(w)

    return F.array_join(F.transform(words, one), "")


def decoded(glyphs: Column, codes: dict[str, str]) -> Column:
    """Characters of glyph codes; a character without one is U+FFFD."""
    known = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])
    return F.array_join(F.transform(F.split(glyphs, ""), lambda c: F.when(c == "", "").otherwise(F.coalesce(F.try_element_at(known, c), F.lit("\ufffd")))), "")


def law_of(label: Column) -> Column:
    """`n/yyyy` at the end of an act's label; null without one."""
    return F.nullif(F.regexp_extract(label, r"(\d+/\d{4})$", 1), F.lit(""))


def act_label(act: Column) -> Column:
    """An act's label inside a sentence: the kind of act in small letters."""
    kind = F.regexp_extract(act, r"^(Ν\.|Π\.\s?Δ\.)", 1)
    return F.concat(F.lower(kind), F.substr(act, F.length(kind) + 1))


def fek_id(number: Column, year: Column) -> Column:
    return F.format_string("FEK-A-%d-%d", number, year)


def fek_path(number: Column, year: Column, issue: Column) -> Column:
    """Where an issue's file lies below the archive's root."""
    return F.format_string("%02d/%d/%d%02d%05d.pdf", issue, year, year, issue, number)


def frontmatter(**fields: Column) -> Column:
    """A header of `key: value` lines between rules: strings quoted, lists inline; nulls are left out."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))

    def line(name: str, value: Column, kind: str) -> Column:
        shown = F.concat(F.lit("["), F.array_join(F.transform(value, quote), ", "), F.lit("]")) if kind == "list" else quote(value) if kind == "text" else value.cast("string")
        return F.concat(F.lit(f"{name}: "), shown)

    rows = [line(name.rsplit("__", 1)[0], value, name.rsplit("__", 1)[1]) for name, value in fields.items()]
    return F.concat(F.lit("---\n"), F.array_join(F.array_compact(F.array(*rows)), "\n"), F.lit("\n---\n"))


def listed(items: Column, most: int = 8) -> Column:
    """The first items, and an ellipsis for the others."""
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), F.when(F.size(items) > most, " …").otherwise(""))


def span(first: Column, last: Column, most: int, from_ends: bool = True) -> Column:
    """Numbers from first to last; where they don't rise or lie further apart than `most`, the two ends, or none."""
    ends = F.array(first, last) if from_ends else F.array().cast("array<int>")
    return F.when((last >= first) & (last - first <= most), F.sequence(first, F.greatest(first, last))).otherwise(ends)


def amendment_line(published: Column, act: Column, by: Column, kind: Column, targets: Column, status: Column, restates: Column) -> Column:
    """One line of a provision's history."""
    aims = F.when(F.size(targets) > 0, F.concat(F.lit(" → "), F.array_join(targets, ", "))).otherwise("")
    return F.concat(F.coalesce(F.date_format(published, "yyyy-MM-dd"), F.lit("date unknown")), F.lit("  "), act, F.lit("  "), by, F.lit("  "), kind, F.when(restates, " (gives the full new text)").otherwise(""), aims, F.coalesce(F.concat(F.lit(" ["), status, F.lit("]")), F.lit("")))

"""Reading the provisions that a Greek legal text names: tokens, lists of labels, chains of units, sentences.

A text is cut into tokens once. A unit word (article, paragraph, clause) with its labels is a group, and groups that small
words link are a chain, such as clause - paragraph - article. Everything else (verbs, acts, what is added) is looked up among the tokens around
a chain. The functions take one text; `amend` runs them in Arrow batches.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .greek import NUMERALS
from .textfn import FOLD_FROM, FOLD_TO

_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)
_ORDER = {n: label for label, n in NUMERALS.items()}

#: Fixed values, folded: words for units of an act, by level.
UNIT_WORDS = {
    "article": "αρθρο αρθρου αρθρα αρθρων",
    "paragraph": "παρ παραγραφος παραγραφου παραγραφο παραγραφοι παραγραφων παραγραφους",
    "clause": "περ περιπτωση περιπτωσης περιπτωσεως περιπτωσεις περιπτωσεων υποπερ",
}
#: Fixed values, folded: verbs of amending sentences, those of repeals among them, nouns of amending titles.
VERBS = set("τροποποιειται τροποποιουνται αντικαθισταται αντικαθιστανται προστιθεται προστιθενται καταργειται καταργουνται αναστελλεται αναστελλονται συμπληρωνεται αναριθμειται διαγραφεται διαγραφονται απαλειφεται απαλειφονται διαμορφωνεται διαμορφωνονται επερχονται παρατεινεται παρατεινονται".split())
REPEALS = {"καταργειται", "καταργουνται"}
ADDITIONS = {"προστιθεται", "προστιθενται"}
TITLES = set("τροποποιηση τροποποιησεισ προσθηκη καταργηση αντικατασταση συμπληρωση αναστολη παραταση".split())
#: Fixed values, folded: words that name the place of a change first, that link units, that join labels.
PLACES = {"στο", "στην", "στον", "στα", "στισ", "στουσ"}
LINKS = {"του", "τησ", "των", "στο", "στον"}
JOINS = {",", "και", "εωσ", "-", "–"}
#: Fixed values, folded: what follows a reference to another act (the first three before a full stop), to one named before, and to this one.
ACT_LETTERS = {"ν", "π", "β", "κ", "υ"}
OTHER_ACTS = {"νομου", "διαταγματοσ", "κοινησ", "υπουργικησ", "αποφασησ", "συνταγματοσ", "κανονισμου", "κωδικα", "νεου", "κυα", "υπ"}
SAME_ACT = ({"ιδιου"}, {"ιδιασ"}, {"αυτου"}, {"αυτησ"})
#: Fixed values, folded: abbreviations that end no sentence, parts of an act that `του παρόντος` may name instead of the article.
ABBREVIATIONS = {"σφαλμ", "διορθ", "αριθμ"}
PARTS = {"τμηματοσ", "μερουσ", "κεφαλαιου", "κωδικα"}
#: How far around a reference its sentence is read, and the most numbers that a range may span.
BEFORE, AFTER, SPAN, CITED_SPAN = 150, 400, 50, 30

UNIT = {fold: level for level, words in UNIT_WORDS.items() for fold in words.replace("ς", "σ").split()}
MARKS = "΄'’"


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


class Token:
    __slots__ = ("text", "start", "low")

    def __init__(self, text: str, start: int):
        self.text, self.start, self.low = text, start, fold(text)

    @property
    def end(self) -> int:
        return self.start + len(self.text)

    @property
    def number(self) -> bool:
        return self.text[0].isdigit()


_TOKEN = re.compile(r"\d+[^\W\d_]?(?![^\W\d_])|\d+|[^\W\d_]+|[^\w\s]")
_DECIMAL = re.compile(r"\d+(?:\.\d+)+|" + _TOKEN.pattern)


def tokens(text: str, decimals: bool = False) -> list[Token]:
    """Numbers with a letter after them, words, and single marks; with `decimals`, decimal numbers as one token."""
    return [Token(m[0], m.start()) for m in (_DECIMAL if decimals else _TOKEN).finditer(text)]


#: Words come again and again: a worker makes each once, and forgets them when there are too many.
_WORDS: dict[str, Token] = {}


def words(text: str) -> list[Token]:
    """The tokens of a text without their places, which all texts share."""
    if len(_WORDS) >= 1 << 16:
        _WORDS.clear()
    return [_WORDS.get(w) or _WORDS.setdefault(w, Token(w, 0)) for w in _TOKEN.findall(text)]


def label_of(token: Token) -> str | None:
    """A number, a number with a letter (`3α` is 3.α, `7Α` stays), or a Greek numeral."""
    t = token.text
    if token.number:
        return f"{t[:-1]}.{t[-1]}" if t[-1].islower() else t
    return t if t in NUMERALS else None


def spread(first: str, last: str, most: int) -> list[str]:
    """The labels from first to last, where both are plain numbers or numerals that rise by less than `most`."""
    known = int if first.isdigit() and last.isdigit() else NUMERALS.get if first in NUMERALS and last in NUMERALS else None
    if known is None or not 0 <= known(last) - known(first) < most:
        return [first, last]
    return [str(n) if known is int else _ORDER[n] for n in range(known(first), known(last) + 1)]


def listed(ts: list[Token], i: int, most: int = SPAN) -> tuple[list[str], int]:
    """(labels of the list that starts at token i, the token after it); ranges are spelled out."""
    out: list[str] = []
    at, joint = i, ""
    while at < len(ts) and (label := label_of(ts[at])) is not None:
        if joint in ("εωσ", "-", "–") and out:
            out[-1:] = spread(out[-1], label, most)
        else:
            out.append(label)
        i = at = at + 1
        while at < len(ts) and (ts[at].text in MARKS or ts[at].text == ")"):
            i = at = at + 1
        if at >= len(ts) or ts[at].low not in JOINS:
            break
        joint, at = ts[at].low, at + 1
        while at < len(ts) and ts[at].low in JOINS:  # `, και`, `έως και`
            joint, at = joint if joint == "εωσ" else ts[at].low, at + 1
    return out, i


@dataclass
class Group:
    level: str
    labels: list[str]


@dataclass
class Chain:
    """Groups of units, in the order of the text, and the tokens that they take."""

    first: int
    after: int = 0
    groups: list[Group] = field(default_factory=list)

    def labels(self, level: str) -> list[str]:
        return next((g.labels for g in self.groups if g.level == level), [])

    def before_article(self, level: str) -> list[str]:
        at = next((k for k, g in enumerate(self.groups) if g.level == "article"), len(self.groups))
        return next((g.labels for g in self.groups[:at] if g.level == level), [])


def group_at(ts: list[Token], i: int, most: int) -> tuple[Group, int] | None:
    level = UNIT.get(ts[i].low)
    if level is None:
        return None
    at = i + 1
    if at < len(ts) and ts[at].text == ".":
        at += 1
    elif len(ts[i].low) <= 6 and ts[i].low in ("παρ", "περ", "υποπερ"):
        return None
    labels, after = listed(ts, at, most)
    if level == "article":
        labels = [x.replace(".", "") if "." in x else x for x in labels if x[0].isdigit()]
    return (Group(level, labels), after) if labels else None


def chains(ts: list[Token], most: int = SPAN) -> list[Chain]:
    out, i = [], 0
    while i < len(ts):
        found = group_at(ts, i, most) if ts[i].low in UNIT else None
        if found is None:
            i += 1
            continue
        chain = Chain(i)
        while found is not None:
            chain.groups.append(found[0])
            chain.after = at = found[1]
            if at < len(ts) and ts[at].low in LINKS:
                at += 1
            found = group_at(ts, at, most) if at < len(ts) else None
            if found and found[0].level in {g.level for g in chain.groups}:
                found = None
        out.append(chain)
        i = chain.after
    return out


def unquoted(text: str) -> str:
    """The text with its quotes blanked, character by character."""
    return re.sub("«[^«»]*»?", lambda m: " " * len(m[0]), re.sub(r"\s", " ", text))


def sentence_ends(ts: list[Token], text: str) -> list[int]:
    """Numbers of the tokens that end a sentence: a stop after a word of three letters or a bracket, before a capital."""
    out = []
    for k in range(1, len(ts) - 1):
        stop, before, after = ts[k], ts[k - 1], ts[k + 1]
        if stop.text not in ".;·" or not after.text[0].isupper() or after.start == stop.end:
            continue
        closes = before.text in ")»" or before.end == stop.start and len(text[: stop.start].split(" ")[-1].rpartition(".")[2]) >= 3
        if closes and before.low not in ABBREVIATIONS:
            out.append(k)
    return out


def _around(ts: list[Token], ends: list[int], first: int, after: int) -> tuple[list[Token], list[Token]]:
    """The sentence's tokens before and after a chain, no further than BEFORE and AFTER characters."""
    low = max((k + 1 for k in ends if k < first), default=0)
    high = min((k + 1 for k in ends if k >= after), default=len(ts))
    start, end = ts[first].start - BEFORE, ts[after - 1].end + AFTER
    return [t for t in ts[low:first] if t.start >= start], [t for t in ts[after:high] if t.end <= end]


def _first_word(ts: list[Token]) -> str:
    """The first word of a sentence after its number and its clause letter."""
    at = 0
    for wanted in (lambda t: t.number, lambda t: len(t.text) <= 3 and t.text.islower()):
        if at + 1 < len(ts) and wanted(ts[at]) and ts[at + 1].text in ".)":
            at += 2
    return ts[at].low if at < len(ts) else ""


def change(before: list[Token], after: list[Token]) -> str | None:
    """repeal, amend or None of a reference: a verb after it counts; one before it where the sentence starts with the verb
    or with the place of the change; a repeal's verb counts anywhere in the sentence."""
    said, says = {t.low for t in before}, {t.low for t in after}
    if (said | says) & REPEALS:
        return "repeal"
    first = _first_word(before)
    return "amend" if says & VERBS or first in VERBS or said & VERBS and first in PLACES else None


def title_change(title: str) -> str | None:
    return "amend" if any(t.low in TITLES for t in tokens(title)) else None


def _follow(ts: list[Token], *words) -> list[int]:
    """Where a run of tokens stands; a word is a set of folded forms."""
    return [k for k in range(len(ts) - len(words) + 1) if all(ts[k + j].low in w for j, w in enumerate(words))]


def _additions(after: list[Token]) -> list[Group]:
    out = []
    for k, t in enumerate(after):
        if t.low in ADDITIONS:
            at = k + 1
            at += at < len(after) and after[at].low in ("νεα", "νεεσ", "νεο")
            found = group_at(after, at, SPAN) if at < len(after) else None
            if found and found[0].level != "article":
                out.append(found[0])
    return out


def targets(chain: Chain, after: list[Token], article: str) -> tuple[list[str], bool]:
    """(provisions that a reference to one article names or adds, whether the article as a whole is written anew)."""
    paragraphs, clauses = chain.before_article("paragraph"), chain.before_article("clause")
    if not paragraphs:
        paragraphs, clauses = chain.labels("paragraph"), []
    base = [f"{article}.{p}" for p in paragraphs] or [article]
    named = {f"{b}.{c}" for b in base for c in clauses} or set(base)
    added = {f"{b}.{x}" for g in _additions(after) for b in ([article] if g.level == "paragraph" else base) for x in g.labels}
    if added and named == {article}:
        named = set()
    shaped = False
    for k in _follow(after, {"αρθρο"}):
        verb = k + 1 + (k + 1 < len(after) and after[k + 1].number)
        shaped |= verb < len(after) and after[verb].low == "διαμορφωνεται"
    return sorted(named | added), bool(shaped or not paragraphs and _follow(after, {"αντικαθισταται"}, {"ωσ"}, {"εξησ"}))


def amendments(text: str | None, law: re.Pattern) -> list[dict]:
    """Articles of a law that a text's sentences change: article, kind, targets, restates."""
    plain = unquoted(text or "")
    ts = tokens(plain)
    ends, out = sentence_ends(ts, plain), []
    for chain in chains(ts):
        articles = chain.labels("article")
        at = chain.after
        if len(_follow(ts[at : at + 2], {"με"}, {"τιτλο"})):
            at += 2
        if not articles or at >= len(ts) or not law.match(plain, ts[at].start):
            continue
        before, after = _around(ts, ends, chain.first, chain.after)
        kind = change(before, after)
        if kind is None:
            continue
        for a in articles:
            aims, restates = targets(chain, after, a) if len(articles) == 1 else ([a], False)
            out.append({"article": a, "kind": kind, "targets": aims, "restates": restates})
    for m in law.finditer(plain):  # `Στον ν. … προστίθεται άρθρο 20Α`
        rest = [t for t in ts if m.end() <= t.start <= m.end() + 60]
        rest = rest[: next((k for k, t in enumerate(rest) if t.text == "."), len(rest))]
        k = next((k for k, t in enumerate(rest) if t.low in ADDITIONS), None)
        if k is None:
            continue
        at = next(i for i, t in enumerate(ts) if t.start == rest[k].start) + 1
        at += at < len(ts) and ts[at].low in ("το", "τα")
        found = group_at(ts, at, SPAN) if at < len(ts) else None
        if found and found[0].level == "article":
            out += [{"article": a, "kind": "amend", "targets": [a], "restates": False} for a in found[0].labels]
    return out


def elsewhere(ts: list[Token], at: int) -> bool:
    """Whether what follows a reference says that it is to another act."""
    while at < len(ts) and ts[at].text in MARKS:
        at += 1
    if at >= len(ts):
        return False
    if ts[at].text == "(" or ts[at].low == "ν" and ts[at + 1 : at + 2] and ts[at + 1].text == ".":
        return True
    if ts[at].low not in ("του", "τησ", "των"):
        return False
    words = [t.low for t in ts[at + 1 : at + 5]]
    if words[:1] == ["προισχυοντοσ"]:
        words = words[1:]
    if not words or words[:2] == ["κωδικα", "αυτου"] or words[0] == "παροντοσ":
        return False
    letters = words[0] in ACT_LETTERS and words[1:2] == ["."]
    same = {words[0]} in SAME_ACT or words[:2] in (["ωσ", "ανω"], ["εν", "λογω"])
    return letters or words[0] in OTHER_ACTS or same


def _own(ts: list[Token], at: int) -> bool:
    """Whether `του παρόντος`, `ανωτέρω` or `του ίδιου άρθρου` follows: the article itself."""
    words = [t.low for t in ts[at : at + 4]]
    if words[:1] == ["ανωτερω"] or words[:3] == ["του", "ιδιου", "αρθρου"]:
        return True
    return words[:2] == ["του", "παροντοσ"] and not set(words[2:3]) & PARTS


def references(text: str | None) -> list[dict]:
    """Provisions of its own act that a text refers to: article (empty: its own), para, clause."""
    ts = words(text or "")
    out = []
    for chain in chains(ts, CITED_SPAN + 1):
        articles, paragraphs, clauses = (chain.labels(x) for x in ("article", "paragraph", "clause"))
        if articles:
            if elsewhere(ts, chain.after):
                continue
            one = len(articles) == 1
            para = paragraphs[0] if one and len(paragraphs) == 1 and chain.before_article("paragraph") else ""
            clause = fold(clauses[0]) if one and len(clauses) == 1 and chain.before_article("clause") and clauses[0] in NUMERALS and (para or not paragraphs) else ""
            out += [{"article": a, "para": para, "clause": clause} for a in articles]
        elif len(paragraphs) == 1 and _own(ts, chain.after):
            out.append({"article": "", "para": paragraphs[0], "clause": ""})
    return out


def law_references(text: str | None, law: str) -> list[str]:
    """`article` or `article.paragraph` of each reference to provisions of `law` (n/yyyy)."""
    ts = words(text or "")
    number, _, year = law.partition("/")
    out = []
    for chain in chains(ts):
        articles, after = chain.labels("article"), [t.low for t in ts[chain.after : chain.after + 6]]
        if len(articles) == 1 and after == ["του", "ν", ".", number, "/", year]:
            out += [f"{articles[0]}.{p}" for p in chain.before_article("paragraph")] or articles
    return out


#: Fixed values, folded: words for a chapter, for an annex; letters of the fire code's chapters and annexes.
CHAPTER_WORDS, ANNEX_WORDS, CHAPTERS, ANNEXES = {"κεφαλαιου", "κεφ"}, {"παραρτημα", "παραρτηματοσ"}, "ΑΒΓ", "ΑΒΓΔ"


def _chapter(ts: list[Token], at: int) -> tuple[str, int]:
    """(letter, token after it) of `[του] Κεφαλαίου Α΄`; an empty letter if none follows."""
    k = at + (at < len(ts) and ts[at].low in ("του", "των"))
    if k < len(ts) and ts[k].low in CHAPTER_WORDS:
        k += 1 + (k + 1 < len(ts) and ts[k + 1].text == ".")
        if k < len(ts) and ts[k].text in CHAPTERS:
            return ts[k].text, k + 1
    return "", at


def fire_references(text: str | None, chapter: str) -> list[str]:
    """Local ids that a text of the fire code refers to: decimal paragraphs, articles with their chapter (this one, or the general
    provisions, chapter Α), annexes. A decimal paragraph starts with its article's number."""
    ts = tokens(text or "", decimals=True)
    out = []
    for i, t in enumerate(ts):
        level = UNIT.get(t.low)
        at = i + 1 + (i + 1 < len(ts) and ts[i + 1].text == ".")
        if level == "paragraph" and at < len(ts) and "." in ts[at].text and ts[at].number:
            path, at = ts[at].text, at + 1
            at += at < len(ts) and ts[at].text == "."
            if [x.low for x in ts[at : at + 2]] == ["του", "αρθρου"] and at + 2 < len(ts) and ts[at + 2].number:
                at += 3
            letter, at = _chapter(ts, at)
            if not elsewhere(ts, at):
                out.append(f"{letter or chapter}{path}")
        elif level == "article":
            labels, at = listed(ts, i + 1, CITED_SPAN + 1)
            letter, after = _chapter(ts, at)
            words = [x.low for x in ts[at + (at < len(ts) and ts[at].low in ("του", "των")) :][:2]]
            if not letter:
                letter = chapter if words in (["παροντοσ", "κεφαλαιου"],) else "Α" if words == ["γενικων", "διαταξεων"] else ""
                after = at + 3
            if letter and not elsewhere(ts, after):
                out += [f"{letter}{x}" for x in labels if x.isdigit()]
        elif t.low in ANNEX_WORDS and i + 1 < len(ts) and ts[i + 1].text in ANNEXES and not elsewhere(ts, i + 2):
            out.append(f"Π-{ts[i + 1].text}")
    return list(dict.fromkeys(out))


#: Fixed value: within so many characters after its numbers a law claims a reference.
LAW_REACH = 80


def _law_named(ts: list[Token], at: int) -> bool:
    """Whether a law's name begins at a token."""
    words = [t.low for t in ts[at : at + 4]]
    if words[:1] == ["απο"]:
        return len(ts) > at + 1 and ts[at + 1].number
    letters = words[0] in {"ν", "β", "α", "π", "κ"} and words[1:2] == ["."] if words else False
    return letters or bool(words) and (words[0] in {"νομου", "κωδικα", "κυα", "νοκ", "υπ", "συνταγματοσ"} or ts[at].text[0].isupper() and words[1:2] == ["κωδικα"])


def internal_numbers(text: str | None) -> list[str]:
    """Articles of its own law that an article's text refers to. A law that is named within LAW_REACH characters claims the numbers
    before it, and those of the references that are joined to them; quotations don't count."""
    plain = unquoted(text or "")
    ts = tokens(plain)
    found = []  # first token, token after, numbers
    for i, t in enumerate(ts):
        if UNIT.get(t.low) == "article":
            labels, after = listed(ts, i + 1)
            numbers = [m[0] for x in labels if (m := re.match(r"\d+", x))]
            if numbers:
                found.append((i, after, numbers))
    foreign = []
    for _, after, _ in found:
        words = [t.low for t in ts[after : after + 2]]
        own = words[:1] in (["του"], ["τησ"]) and words[1:2] in (["παροντοσ"], ["παρουσασ"], ["ιδιου"])
        end = ts[after - 1].end + LAW_REACH
        near = [k for k in range(after, len(ts)) if ts[k].start < end]
        near = near[: next((n for n, k in enumerate(near) if UNIT.get(ts[k].low) == "article"), len(near))]
        claimed = any(ts[k].low in ("του", "τησ", "των") and _law_named(ts, k + 1) for k in near)
        direct = bool(words) and (words[0] == "(" or words == ["ν", "."])
        foreign.append(direct or not own and claimed)
    joints = {"το", "του", "τα", "των", "στο", "στα"}
    for k in range(len(found) - 2, -1, -1):
        between = [t.low for t in ts[found[k][1] : found[k + 1][0]]]
        joined = between[:1] in ([","], ["και"]) and (len(between) == 1 or len(between) == 2 and between[1] in joints)
        foreign[k] |= foreign[k + 1] and joined
    return list(dict.fromkeys(n for (_, _, numbers), out in zip(found, foreign, strict=True) if not out for n in numbers))


def laws_named(text: str | None, but: str, since: int) -> list[dict]:
    """law (n/yyyy) and article of each reference to one article of a law from a year on; a stray number may stand between."""
    ts = words(text or "")
    out = []
    for chain in chains(ts):
        articles, at = chain.labels("article"), chain.after
        if at < len(ts) and ts[at].number and len(ts[at].text) <= 2:
            at += 1
        after = [t.low for t in ts[at : at + 6]]
        if len(articles) == 1 and len(after) == 6 and after[:3] == ["του", "ν", "."] and after[4] == "/" and after[5].isdigit():
            law = f"{after[3]}/{after[5]}"
            if law != but and int(after[5]) >= since:
                out.append({"law": law, "article": articles[0]})
    return out


def label_list(text: str | None) -> list[str]:
    """Numbers and numerals of a list; other words go."""
    ts, out, i = words(text or ""), [], 0
    while i < len(ts):
        found, after = listed(ts, i)
        out += found
        i = after if after > i else i + 1
    return out

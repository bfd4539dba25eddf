"""Hierarchical ids of an article's paragraphs from their printed numbering: sequential, so one group per article.

An outline holds the open levels. A mark that goes on from an open level of its kind returns there; a first one opens a level below. A
clause that ends a sentence closes when unnumbered text follows, and opens again if the list goes on. Quoted text has an outline of
its own, below the paragraph that introduces it.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.greek import NUMERALS

#: Kinds of marks: a number, a Greek numeral, letters that only an open clause can explain, a decimal path.
NUMBER, CLAUSE, PART, SUB, DECIMAL = "number", "clause", "part", "sub", "decimal"


@dataclass(frozen=True)
class Mark:
    kind: str
    value: int
    label: str


def _head(text: str) -> tuple[str, str, str]:
    """(mark, its sign, rest) at a text's start, whatever the mark is; empty if no `.` or `)` ends one."""
    end = next((i for i, c in enumerate(text) if not c.isalnum()), len(text))
    name, rest = text[:end], text[end:]
    if rest[:1] in ("΄", "'", "’"):
        rest = rest[1:]
    return (name, rest[0], rest[1:].lstrip()) if name and rest[:1] in (".", ")") else ("", "", text)


def decimal_path(text: str) -> tuple[str, str] | None:
    """(path, rest) of a text that starts with a decimal number and a space."""
    first, _, rest = text.partition(" ")
    path = first.rstrip(".")
    steps = path.split(".")
    good = 2 <= len(steps) <= 5 and all(s.isdigit() and len(s) <= 2 for s in steps) and len(first) - len(path) <= 1 and rest
    return (path, rest.lstrip()) if good else None


def marks(text: str, decimal: str | None = None) -> list[Mark]:
    """The marks at a text's start: `5. α) …` is paragraph 5 and clause α. With `decimal`, the number of an article whose
    paragraphs are decimal, a path that starts with it comes first."""
    out, rest = [], text.strip()
    if decimal and (found := decimal_path(rest)) and found[0].split(".")[0] == decimal:
        out.append(Mark(DECIMAL, 0, found[0].partition(".")[2]))
        rest = found[1]
    while True:
        name, sign, after = _head(rest)
        number = name.rstrip("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
        if number.isdigit() and len(number) <= 3 and len(name) - len(number) <= 1 and not (rest[len(name) + 1 :][:1].isdigit()):
            out.append(Mark(NUMBER, int(number), name))
        elif name.islower() and name.isalpha() and len(name) <= 5 and not re.match(r"\d{3,}/", after):
            if name in NUMERALS:
                out.append(Mark(CLAUSE, NUMERALS[name], name))
            elif len(name) > 1:
                out.append(Mark(PART, 0, name))
            else:
                return out
        else:
            return out
        rest = after


@dataclass
class Outline:
    levels: list[Mark] = field(default_factory=list)
    closed: Mark | None = None  # the clause that ended a sentence, until the next mark

    def path(self) -> str:
        return ".".join(m.label for m in self.levels)

    def _continues(self, mark: Mark) -> bool:
        """Whether a mark goes on with the list of the clause that was closed."""
        c = self.closed
        return c is not None and (mark.kind == c.kind and mark.value == c.value + 1 or mark.kind == PART and mark.label.startswith(c.label))

    def _under(self, mark: Mark) -> Mark | None:
        """`ιστα` as clause α of the open clause ιστ; levels below that one close."""
        for depth in range(len(self.levels) - 1, -1, -1):
            parent = self.levels[depth]
            rest = mark.label.removeprefix(parent.label)
            if parent.kind == CLAUSE and rest != mark.label and rest in NUMERALS:
                del self.levels[depth + 1 :]
                return Mark(SUB, NUMERALS[rest], rest)
        return None

    def _decimal(self, mark: Mark) -> None:
        """A whole path. One that goes back or repeats on its level is a misprint for the next."""
        new = [int(x) for x in mark.label.split(".")]
        old = [m.value for m in self.levels if m.kind == DECIMAL]
        depth = len(new) - 1
        if len(old) > depth and old[:depth] == new[:depth] and new[depth] <= old[depth]:
            new[depth] = old[depth] + 1
        self.levels = [Mark(DECIMAL, x, str(x)) for x in new]

    def enter(self, found: list[Mark]) -> str | None:
        """The path after a paragraph's marks; None, and nothing changed, if none of them finds its place."""
        saved, entered = list(self.levels), False
        if found and self._continues(found[0]):
            self.levels.append(self.closed)
        for mark in found:
            if mark.kind == DECIMAL:
                self._decimal(mark)
            elif mark.kind == PART:
                sub = self._under(mark)
                if sub is None:
                    break
                self.levels.append(sub)
            else:
                same = [d for d, m in enumerate(self.levels) if m.kind == mark.kind]
                before = [d for d in same if self.levels[d].value == mark.value - 1]
                if before:
                    del self.levels[before[-1] :]
                elif mark.value != 1 and same:
                    del self.levels[same[-1] :]
                self.levels.append(mark)
            entered = True
        if not entered:
            self.levels = saved
            return None
        self.closed = None
        return self.path()

    def end_sentence(self, text: str) -> bool:
        """Close the open clause, whose text ended with a full stop, before unnumbered text; whether there was one."""
        if not self.levels or self.levels[-1].kind not in (CLAUSE, SUB) or not text.rstrip().endswith("."):
            return False
        self.closed = self.levels.pop()
        return True


def paragraph_ids(article: str, texts: list[str], decimal: str | None = None, quoted: list[bool] | None = None) -> list[str]:
    """Ids for the texts of an article in order.

    A text without a mark is the k-th of what it follows (`#k`); quoted text, marked so or starting with «, gets the id of the
    paragraph before the quotation, `~` and its own numbering; an id that comes again gets `@k`.
    """
    own, quote = Outline(), None
    base = anchor = article
    extra: Counter[str] = Counter()
    seen: Counter[str] = Counter()
    quoted_base, quoted_extra, quoted_decimal, before = "", Counter(), None, ""
    out: list[str] = []
    for text, inside in zip(texts, quoted or [False] * len(texts), strict=True):
        text = (text or "").strip()
        if not (inside or text.startswith("«")):
            if quote is not None:
                quote, before = None, ""
            path = own.enter(marks(text, decimal))
            if path is not None:
                base = pid = f"{article}.{path}"
                extra[base] = 0
            else:
                if before and own.end_sentence(before):
                    base = ".".join(x for x in (article, own.path()) if x)
                extra[base] += 1
                pid = f"{base}#{extra[base]}"
        else:
            text = text.lstrip("«").lstrip()
            if quote is None:
                quote, anchor = Outline(), out[-1] if out else article
                quoted_base, quoted_extra, quoted_decimal, before = "", Counter(), None, ""
            if quoted_decimal is None and not quote.levels and (found := decimal_path(text)):
                quoted_decimal = found[0].split(".")[0]
            chain = [Mark(DECIMAL, 0, f"{quoted_decimal}.{m.label}") if m.kind == DECIMAL else m for m in marks(text, quoted_decimal)]
            path = quote.enter(chain)
            if path is not None:
                quoted_base = path
                quoted_extra[path] = 0
                pid = f"{anchor}~{path}"
            else:
                if before and quote.end_sentence(before):
                    quoted_base = quote.path()
                quoted_extra[quoted_base] += 1
                pid = f"{anchor}~{quoted_base}#{quoted_extra[quoted_base]}"
        before = text if path is not None else ""
        seen[pid] += 1
        out.append(pid if seen[pid] == 1 else f"{pid}@{seen[pid]}")
    return out


@F.pandas_udf(ArrayType(StringType()))
def _ids(article: pd.Series, texts: pd.Series, decimal: pd.Series, quoted: pd.Series) -> pd.Series:
    rows = zip(article, texts, decimal, quoted, strict=True)
    return pd.Series([paragraph_ids(a, list(t), d or None, [bool(x) for x in q]) for a, t, d, q in rows], dtype=object)


def number(paragraphs: DataFrame, keys: list[str], article: str, position: str, text: str, decimal: str | None = None, quoted: str | None = None) -> DataFrame:
    """paragraphs with `pid`. An article's paragraphs are one array, whose size a printed law bounds; many articles go to a
    worker in a batch."""
    row = F.struct(*(F.col(c) for c in paragraphs.columns))
    whole = paragraphs.groupBy(*(F.col(c).alias(f"_key{i}") for i, c in enumerate(keys))).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), row.alias("row")))).alias("_rows"))
    each = lambda f: F.transform("_rows", lambda x: f(x["row"]))
    first = F.get("_rows", F.lit(0))["row"]
    texts, inside = each(lambda r: F.coalesce(r[text], F.lit(""))), each(lambda r: F.coalesce(r[quoted], F.lit(False)) if quoted else F.lit(False))
    ids = _ids(first[article].cast("string"), texts, first[decimal] if decimal else F.lit(None).cast("string"), inside)
    rows = whole.select("_rows", ids.alias("_pids")).select(F.explode(F.arrays_zip("_rows", "_pids")).alias("x"))
    return rows.select("x._rows.row.*", F.col("x._pids").alias("pid"))

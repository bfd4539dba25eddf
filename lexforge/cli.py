"""The commands on the command line: `python -m lexforge.cli --corpus DIR read code:224.3`.

DIR holds the four tables of a Corpus as Parquet. Output is paged to about 12,000 characters; exit code 0, or 2 on an error.
"""

from __future__ import annotations

import argparse
import datetime
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import greek, textfn
from .plans.api import SCOPES, Corpus

TABLES = ("paragraphs", "pointers", "links", "sections")


def day(text: str) -> str:
    """An ISO date, checked."""
    try:
        return datetime.date.fromisoformat(text).isoformat()
    except ValueError:
        raise argparse.ArgumentTypeError(f"{text!r} is not a date like 2024-01-31") from None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexforge")
    p.add_argument("--corpus")
    p.add_argument("--page", type=int, default=1)
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("info")
    search = commands.add_parser("search")
    search.add_argument("stems", nargs="+")
    search.add_argument("--limit", type=int, default=8)
    search.add_argument("--in", dest="scope", choices=SCOPES, default="all")
    for name in ("read", "trace"):
        commands.add_parser(name).add_argument("id")
    history = commands.add_parser("history")
    history.add_argument("id")
    history.add_argument("--as-of", type=day)
    changes = commands.add_parser("changes")
    changes.add_argument("--since", type=day, default="1900-01-01")
    toc = commands.add_parser("toc")
    toc.add_argument("dataset")
    toc.add_argument("--section")
    return p


def page(rows: DataFrame, number: int, limit: int = 12_000) -> tuple[list[str], int]:
    """(lines of one page, number of pages) of a result in its order; only a command's listing is gathered."""
    lines = ["  ".join("" if v is None else str(v) for v in r) for r in rows.collect()]
    if not lines:
        return [], 1
    sizes = rows.sparkSession.createDataFrame([([len(x) + 1 for x in lines],)], "s array<bigint>")
    of = sizes.select(textfn.pages(F.col("s"), limit).alias("p")).first()["p"]
    return [x for x, n in zip(lines, of, strict=True) if n == number], of[-1]


def run(corpus: Corpus, args: argparse.Namespace) -> tuple[list[str], int]:
    spark = corpus.paragraphs.sparkSession

    def normal(typed: str) -> str:
        gid = spark.range(1).select(greek.normalize(F.lit(typed)).alias("g")).first()["g"]
        if gid is None:
            raise ValueError(f"{typed!r} is not an id")
        return gid

    if args.command == "info":
        return page(corpus.info().orderBy("dataset"), args.page)
    if args.command == "search":
        terms, part = corpus.terms(args.stems), corpus.within(args.scope)
        if not terms:
            raise ValueError("give at least one search stem")
        lines, n = page(part.search(terms, limit=args.limit), args.page)
        total = part.found(terms).first()["articles"]
        return lines + ([f"{total - args.limit} more articles match"] if total > args.limit else []), n
    if args.command == "changes":
        return page(corpus.changes(args.since), args.page)
    if args.command == "toc":
        return page(corpus.toc(args.dataset, args.section), args.page)
    gid = normal(args.id)
    if args.command == "trace":
        return page(corpus.trace(gid), args.page)
    if args.command == "history":
        return page(corpus.history(gid, args.as_of), args.page)
    lines, n = page(corpus.read(gid), args.page)
    if not lines:
        near = [r["gid"] for r in corpus.nearest(gid).collect()]
        raise ValueError(f"there is no {gid}" + (f"; there are {', '.join(near)}" if near else ""))
    said = corpus.status(gid).first()
    left = f" {said['hidden']} superseded left out." if said and said["hidden"] else ""
    return [f"Status: amended {said['amended']} time(s), latest {said['latest'] or 'date unknown'}.{left}" if said else "Status: no amendment.", *lines], n


def main(argv: list[str] | None = None, corpus: Corpus | None = None) -> int:
    try:
        args = parser().parse_args(argv)
        if corpus is None:
            spark = SparkSession.builder.appName("lexforge").getOrCreate()
            corpus = Corpus(*(spark.read.parquet(f"{args.corpus}/{t}") for t in TABLES))
        lines, pages = run(corpus, args)
    except SystemExit as error:
        return 2 if error.code else 0
    except ValueError as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    print("\n".join(lines))
    if pages > 1:
        print(f"page {args.page} of {pages}")
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""HTML extraction (operator 10): a tree-structured graphical model over the DOM, with exact marginals by sum-product.

Every element is a binary node (content or not). Its own potential is log-linear in features of tag, names, text and
links; a potential on each parent-child edge, by kind of child, says how labels pass down. Messages go from the leaves
to the root and back, level by level for all pages of a batch at once, and give each element's content marginal; a text
belongs to its nearest block element and is kept where that marginal is over 1/2. Weights are trained by gradient
ascent on the exact likelihood (features observed less features expected) of labelled pages: `labelled_pages` writes
such pages from a grammar of layouts, as none are given.

Text: scripts, styles, comments and the head are never text; character references are decoded; white space inside a
block becomes one space; blocks are joined in page order by one space. Unclosed and misnested tags are mended as
browsers do for paragraphs, list items, cells and options. Drawings and formulas are inline text. A class, id or role name tells by
itself only where it is known as a whole or in each part; other parts are weaker features, weighed with the article around the
element, its tag and the length of its text. A `<` that no tag or `>` follows is text. Scanning takes time
in proportion to a page's length, whatever stands in it.

Defined results: null and empty html, and pages without content, give ""; plain text without tags is one block of the
body and kept; pages are taken together up to CHUNK bytes, a longer one is read whole and alone; repeated rows, and ids
that repeat or are null, get a row each and equal pages equal results; an empty table gives no rows; extra columns
aren't read.
"""

from __future__ import annotations

import html
import pickle
import random
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesnp import chunks

CHUNK = 1 << 20
#: Element names by role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template iframe select button xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover mstyle semantics annotation svg g path text tspan textpath defs use symbol circle rect line polygon polyline ellipse canvas".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}, "option": {"select"}}
TAGS = "body main article section div p h1 h2 h3 h4 ul ol li nav header footer aside form table tr td figure figcaption blockquote pre dl dd address details fieldset".split()
#: Parts of class, id and role names, by what they tell.
NAMES = {
    "menu": "nav menu breadcrumb crumb toolbar pager pagination tabs skip toc",
    "head": "header masthead topbar banner logo branding hero-nav",
    "foot": "footer foot copyright colophon legal imprint",
    "side": "sidebar aside widget related recommend trending popular rail more-stories tags",
    "notice": "cookie consent notice alert popup modal newsletter subscribe signup gdpr paywall",
    "advert": "ad ads advert advertisement sponsor promo banner-ad adsbox dfp",
    "form": "form search login contact",
    "comment": "comment comments reply replies disqus discussion respond",
    "share": "share social follow buttons author-links",
    "content": "content article post entry story main body text page-content",
}
_NAME = {w: k for k, (_, ws) in enumerate(NAMES.items()) for w in ws.split()}
_KINDS = len(NAMES)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
RAW_END = {x: re.compile(f"</{x}(?![a-z0-9])", re.I | re.A) for x in RAW}
STOP = re.compile(r"""[>"']""")
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
WORDS = re.compile(r"[a-z]+(?:-[a-z]+)*")
SPLIT = re.compile(r"[^a-z]+")

N_TAGS = len(TAGS) + 1
#: tag, whole names, parts of names, then: constant, text sizes (3), link share, long and unlinked, lists' links, depth, no text, all
#: linked, little text; inside an article: itself, with a telling name, with a telling part, either of them with long unlinked
#: text, a header, a heading; a telling part on a tag of running text; the parent's telling name and part.
N_FEATURES = N_TAGS + 2 * _KINDS + 20
_TAG = {t: i for i, t in enumerate(TAGS)}
#: Kinds of edges: by the child's role.
EDGE_KINDS = 6


@dataclass
class Tree:
    """Elements of a page in document order; texts as (element of the block, block number, text)."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[frozenset] = field(default_factory=list)  # kinds that class, id and role names tell, whole or by each part
    parts: list[frozenset] = field(default_factory=list)  # kinds that parts of other names tell
    marked: list[str] = field(default_factory=list)  # data-label, for labelled pages
    own: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    texts: list[tuple[int, int, str]] = field(default_factory=list)


def tokens(page: str):
    """(text, end tag, name in lower case or None, attributes) of a page, in order; comments, declarations and the insides
    of RAW elements are left out."""
    at, size, last = 0, len(page), page.rfind(">")
    while at < size:
        start = page.find("<", at)
        if start < 0 or start > last:  # no tag ends after here; an open comment lasts to the end
            end = page.find("<!--", at)
            yield page[at:] if end < 0 else page[at:end], "", None, ""
            return
        if start > at:
            yield page[at:start], "", None, ""
        at = start
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), at):
            at = page.find(">", at) + 1
            continue
        m = TAG.match(page, at)
        if m is None:
            yield "<", "", None, ""
            at += 1
            continue
        end = m.end()
        while True:  # to the tag's end; a quote that doesn't close before the last one is a plain character
            stop = STOP.search(page, end)
            end = stop.end()
            if stop[0] == ">":
                break
            close = page.find(stop[0], end, last)
            if close >= 0:
                end = close + 1
            else:
                end = page.find(">", end) + 1
                break
        name, attrs = m[2].lower(), page[m.end() : end - 1]
        at = end
        yield "", m[1], name, attrs
        if name in RAW and not m[1] and not (attrs.endswith("/") and name == "svg"):
            found = RAW_END[name].search(page, at)
            at = size if found is None else page.find(">", found.start()) + 1 or size


def parse(page: str | None, labels: bool = False) -> Tree:
    """The block elements of a page. Inline elements only carry their text's links."""
    t = Tree()

    def node(parent: int, tag: str, attrs: str) -> int:
        found, some = set(), set()
        if attrs and "=" in attrs:
            for _, value in ATTR.findall(attrs):
                value = value.strip("\"'").lower()
                for w in WORDS.findall(value):
                    if (k := _NAME.get(w)) is not None:
                        found.add(k)
                        continue
                    parts = SPLIT.split(w)
                    told = [_NAME[part] for part in parts if part in _NAME]
                    (found if len(told) == len(parts) else some).update(told)
        t.parent.append(parent)
        t.tag.append(tag)
        t.names.append(frozenset(found))
        t.parts.append(frozenset(some))
        t.own.append(0)
        t.linked.append(0)
        if labels:
            m = re.search(r'data-label="(\d)"', attrs)
            t.marked.append(m[1] if m else "")
        return len(t.parent) - 1

    root = node(-1, "body", "")
    stack: list[tuple[str, int]] = [("body", root)]  # block elements
    held: dict[str, int] = {}  # how many of each name are on the stack, so that no search goes in vain

    def cut(k: int) -> None:
        for name, _ in stack[k:]:
            held[name] -= 1
        del stack[k:]

    links, block = 0, 0
    in_head = False
    for text, closing, name, attrs in tokens(page or ""):
        if name is None:
            if in_head:
                continue
            if "&" in text:
                text = html.unescape(text)
            here = stack[-1][1]
            n = len(text) - text.count(" ")
            t.own[here] += n
            if links:
                t.linked[here] += n
            t.texts.append((here, block, text))
            continue
        if closing:
            if name == "a":
                links = 0
            elif name == "head":
                in_head = False
            elif name not in INLINE and held.get(name):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        cut(k)
                        block += 1
                        break
            continue
        if name in RAW:
            block += 1
            continue
        if name == "head":
            in_head = True
            continue
        if name in ("html", "body"):
            in_head = False
            continue
        if in_head and name not in VOID:
            in_head = False
        if name in VOID:
            if name == "br":
                t.texts.append((stack[-1][1], block, " "))
            elif name == "hr":
                block += 1
            continue
        if name in INLINE:
            if name == "a":
                links = 1
            continue
        links = 0
        block += 1
        if name in CLOSES_P and held.get("p"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    cut(k)
                    break
                if stack[k][0] in ("table", "td", "th", "article", "section", "div", "li"):
                    break
        if name in SAME and any(held.get(x) for x in SAME[name]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in SCOPE[name]:
                    break
                if stack[k][0] in SAME[name]:
                    cut(k)
                    break
        stack.append((name, node(stack[-1][1], name, attrs)))
        held[name] = held.get(name, 0) + 1
    return t


def levels_of(depth: np.ndarray) -> list[np.ndarray]:
    """Nodes of each depth."""
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if len(depth) else []


def features(trees: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, parents, depths, edge kinds) of the nodes of all trees, one after the other; roots have parent -1."""
    sizes = [len(t.parent) for t in trees]
    n = sum(sizes)
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if sizes else np.zeros(0, np.int64)
    cat = lambda get, kind: np.array([x for t in trees for x in get(t)], dtype=kind)
    local = cat(lambda t: t.parent, np.int64)
    parent = np.where(local < 0, -1, local + np.repeat(base, sizes))
    own, linked = (cat(lambda t, k=k: getattr(t, k), np.float64) for k in ("own", "linked"))
    depth = np.zeros(n, np.int64)
    for i in range(n):  # parents come before children
        if parent[i] >= 0:
            depth[i] = depth[parent[i]] + 1
    whole, whole_linked = own.copy(), linked.copy()
    for at in reversed(levels_of(depth)[1:]):
        np.add.at(whole, parent[at], whole[at])
        np.add.at(whole_linked, parent[at], whole_linked[at])
    x = np.zeros((n, N_FEATURES))
    tags = cat(lambda t: [_TAG.get(g, N_TAGS - 1) for g in t.tag], np.int64)
    x[np.arange(n), tags] = 1
    for first, get in ((N_TAGS, lambda t: t.names), (N_TAGS + _KINDS, lambda t: t.parts)):
        i = 0
        for t in trees:
            for names in get(t):
                for k in names:
                    x[i, first + k] = 1
                i += 1
    at = N_TAGS + 2 * _KINDS
    share = np.where(whole > 0, whole_linked / np.maximum(whole, 1), 0.0)
    x[:, at] = 1
    x[:, at + 1] = own >= 25
    x[:, at + 2] = own >= 80
    x[:, at + 3] = own >= 250
    x[:, at + 4] = share
    x[:, at + 5] = (own >= 25) & (share == 0)
    x[:, at + 6] = (share > 0.6) & np.isin(tags, [_TAG["ul"], _TAG["ol"], _TAG["li"]])
    x[:, at + 7] = np.minimum(depth, 10) / 10
    x[:, at + 8] = whole == 0
    x[:, at + 9] = (share > 0.9) & (whole > 0)
    x[:, at + 10] = (own > 0) & (own < 25)
    named = x[:, N_TAGS : N_TAGS + _KINDS - 1].any(axis=1)
    partly = x[:, N_TAGS + _KINDS : N_TAGS + 2 * _KINDS - 1].any(axis=1)
    inside = np.isin(tags, [_TAG["article"], _TAG["main"]]) | (x[:, N_TAGS + _KINDS - 1] > 0)
    of_article = inside.copy()
    for here in levels_of(depth)[1:]:  # strictly below an article, and then whether such a one is the node or above
        inside[here] = of_article[parent[here]]
        of_article[here] |= inside[here]
    inside[depth == 0] = False
    running = (own >= 40) & (share == 0)
    headings = np.isin(tags, [_TAG[k] for k in ("h1", "h2", "h3", "h4")])
    text_tags = np.isin(tags, [_TAG[k] for k in ("p", "h1", "h2", "h3", "h4", "li", "blockquote", "pre", "td", "dd", "figcaption")])
    above = lambda flag: np.where(parent >= 0, flag[parent], False)
    for k, flag in enumerate((inside, inside & named, inside & partly, inside & partly & running, inside & named & running, inside & (tags == _TAG["header"]), inside & headings, partly & text_tags, above(named) | above(partly))):
        x[:, at + 11 + k] = flag
    kind = np.zeros(n, np.int64)
    kind[np.isin(tags, [_TAG[k] for k in ("p", "h1", "h2", "h3", "h4", "li", "blockquote", "pre", "td", "dd", "figcaption")])] = 1
    kind[np.isin(tags, [_TAG[k] for k in ("ul", "ol", "table", "tr", "figure", "dl")])] = 2
    kind[np.isin(tags, [_TAG[k] for k in ("nav", "header", "footer", "aside", "form")])] = 3
    kind[partly] = 5
    kind[named] = 4
    return x, parent, depth, kind


class TreeModel:
    def __init__(self):
        self.w = np.zeros(N_FEATURES)
        self.edge = np.zeros((EDGE_KINDS, 2, 2))

    def marginals(self, x: np.ndarray, parent: np.ndarray, depth: np.ndarray, kind: np.ndarray):
        """(content marginals, pair marginals of each node with its parent, log partition) by sum-product."""
        n = len(x)
        unary = np.stack([np.zeros(n), x @ self.w], axis=1)
        up = unary.copy()  # own potential and messages from children
        to_parent = np.zeros((n, 2))
        levels = levels_of(depth)
        for at in reversed(levels[1:]):
            both = up[at][:, None, :] + self.edge[kind[at]]  # parent label, own label
            to_parent[at] = np.logaddexp(both[:, :, 0], both[:, :, 1])
            np.add.at(up, parent[at], to_parent[at])
        down = np.zeros((n, 2))
        pair = np.zeros((n, 2, 2))
        for at in levels[1:]:
            p = parent[at]
            rest = up[p] + down[p] - to_parent[at]
            both = rest[:, :, None] + self.edge[kind[at]]
            down[at] = np.logaddexp(both[:, 0, :], both[:, 1, :])
            joint = both + up[at][:, None, :]
            joint -= joint.max(axis=(1, 2), keepdims=True)
            joint = np.exp(joint)
            pair[at] = joint / joint.sum(axis=(1, 2), keepdims=True)
        belief = up + down
        z = np.logaddexp(belief[:, 0], belief[:, 1])
        return np.exp(belief[:, 1] - z), pair, z[depth == 0].sum()

    def fit(self, trees: list[Tree], labels: np.ndarray, steps: int = 200, rate: float = 0.1, ridge: float = 1e-3) -> None:
        """Gradient ascent (Adam) on the labels' likelihood."""
        x, parent, depth, kind = features(trees)
        kids = parent >= 0
        seen = np.zeros_like(self.edge)
        np.add.at(seen, (kind[kids], labels[parent[kids]], labels[kids]), 1)
        moment = [np.zeros_like(self.w), np.zeros_like(self.w), np.zeros_like(self.edge), np.zeros_like(self.edge)]
        n = len(trees)
        for i in range(1, steps + 1):
            p, pair, _ = self.marginals(x, parent, depth, kind)
            expected = np.zeros_like(self.edge)
            np.add.at(expected, kind[kids], pair[kids])
            grads = [x.T @ (labels - p) / n - ridge * self.w, (seen - expected) / n - ridge * self.edge]
            for j, (value, g) in enumerate(((self.w, grads[0]), (self.edge, grads[1]))):
                m, v = moment[2 * j], moment[2 * j + 1]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                value += rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)


def labelled_pages(n: int = 500, seed: int = 11) -> list[tuple[str, None]]:
    """Pages whose blocks carry data-label="1" for content and "0" for the rest, from a grammar of layouts."""
    rng = random.Random(seed)
    syll = "ta ri mo ne lu ka so de vi pa er on th an in es qu ou ch le".split()

    def words(k):
        return " ".join("".join(rng.choice(syll) for _ in range(rng.randint(1, 4))) for _ in range(k))

    def sentence_block(lo, hi):
        return " ".join(words(rng.randint(3, 14)).capitalize() + rng.choice([".", ".", ",", "?"]) for _ in range(rng.randint(lo, hi)))

    def el(tag, label, inner, name=""):
        c = rng.choice(["class", "id"])
        return f'<{tag} data-label="{label}"' + (f' {c}="{name}"' if name else "") + f">{inner}</{tag}>"

    def pick(*options):
        return rng.choice(options)

    telling = [w for kind, ws in NAMES.items() if kind != "content" for w in ws.split() if "-" not in w]

    def misleading():
        """A name of which a part tells of boilerplate, though the block is text."""
        if rng.random() < 0.8:
            return ""
        return "-".join(pick([rng.choice(telling), words(1)], [words(1), rng.choice(telling)], [words(1), rng.choice(telling), words(1)]))

    def links(k, label=0):
        return el(pick("ul", "ul", "div"), label, "".join(el("li", label, f'<a href="/x">{words(rng.randint(1, 3))}</a>') for _ in range(k)))

    def boiler(inside=False):
        """inside: in an article, where a block of plain text has names that tell in full."""
        kind = rng.randrange(10)
        if kind == 0:
            return el("nav", 0, links(rng.randint(2, 8))) if rng.random() < 0.6 else el("div", 0, links(rng.randint(2, 8)), pick("nav", "menu", "breadcrumb", "main-menu"))
        if kind == 1:
            return el("header", 0, el("div", 0, words(3)) + links(rng.randint(0, 4)), pick("", "masthead")) if rng.random() < 0.6 else el("div", 0, el(pick("p", "h1"), 0, words(rng.randint(1, 4))), pick("header", "topbar", "logo", "site-header", "page-logo"))
        if kind == 2:
            return el("footer", 0, pick(words(8), el("p", 0, "&copy; 2024 " + sentence_block(1, 2)), links(4))) if rng.random() < 0.7 else el("div", 0, el("p", 0, sentence_block(1, 2)), pick("footer", "site-footer", "copyright", "page-foot"))
        if kind == 3:
            return el(pick("aside", "div", "section"), 0, el("h3", 0, words(2)) + pick(links(5), el("p", 0, sentence_block(1, 3))), pick("sidebar", "widget", "related", "right-sidebar", "related-posts", "trending-now"))
        if kind == 4:
            return el("div", 0, pick(sentence_block(1, 3), el("p", 0, sentence_block(1, 3)) + "<button>ok</button>"), pick("cookie-notice", "notice", "newsletter", "cookie-consent", "alert", "newsletter-signup", "gdpr-popup"))
        if kind == 5:
            return el(pick("div", "div", "aside"), 0, pick(sentence_block(1, 4), el("p", 0, sentence_block(1, 3)), f'<a href="x">{words(4)}</a>'), pick("ad", "ads", "advert", "promo", "sponsor", *(() if inside else ("ad-box", "ad-slot", "sponsor-line"))))
        if kind == 6:
            return el("form", 0, el("p", 0, words(4)) + f'<label>{words(2)}</label><input name="q"><button>go</button>', pick("", "search"))
        if kind == 7:
            one = lambda: el(pick("div", "li", "p"), 0, el("p", 0, sentence_block(1, 4)), pick("comment", "", "reply"))
            return el(pick("section", "div", "ol"), 0, el("h3", 0, words(2)) + "".join(one() for _ in range(rng.randint(1, 4))), pick("comments", "comment-list", "discussion", "user-comments"))
        if kind == 8:
            return el("div", 0, links(3), pick("share", "social", "tags", "pagination", "share-buttons", "social-links", "tags-list"))
        return el("aside", 0, el("p", 0, sentence_block(1, 2)))

    def content():
        title = el("h1", 1, words(rng.randint(1, 12)), misleading())
        if rng.random() < 0.2:
            title = el("header", 1, title + pick("", el("p", 1, words(rng.randint(2, 20)))), misleading())
        parts = [title] if rng.random() < 0.85 else []
        plain = rng.random() < 0.25  # without punctuation
        short = rng.random() < 0.2  # mostly short lines
        for _ in range(rng.randint(1, 25 if short else 12)):
            r = rng.random()
            if short and r < 0.85:
                parts.append(el("p", 1, pick("", "<b>") + words(rng.randint(1, 3)), misleading()))
            elif plain and r < 0.8:
                parts.append(el("p", 1, pick("", "", "<b>") + " | ".join(words(rng.randint(1, 80)) for _ in range(pick(1, 1, 4))), misleading()))
            elif r < 0.7:
                parts.append(el("p", 1, pick("", "", "<b>") + pick(sentence_block(1, 6), sentence_block(1, 6), words(rng.randint(1, 5)), f'{sentence_block(1, 2)} <a href="x">{words(3)}</a> {sentence_block(1, 2)}'), misleading()))
            elif r < 0.78:
                parts.append(el(pick("h2", "h3"), 1, words(rng.randint(1, 6)), misleading()))
            elif r < 0.86:
                parts.append(el(pick("ul", "ol"), 1, "".join(el("li", 1, sentence_block(1, 2)) for _ in range(rng.randint(2, 5))), misleading()))
            elif r < 0.9:
                parts.append(el("blockquote", 1, el("p", 1, sentence_block(1, 2))))
            elif r < 0.94:
                parts.append(el("table", 1, "".join(el("tr", 1, el("td", 1, words(2)) + el("td", 1, words(3))) for _ in range(3))))
            elif r < 0.96:
                parts.append(el("figure", 1, '<img src="x">' + el("figcaption", 1, sentence_block(1, 1))))
            else:
                parts.append(el(pick("div", "section"), 1, pick(el("p", 1, sentence_block(1, 3)), sentence_block(1, 4)), misleading()))
            if rng.random() < 0.1:
                parts.append(boiler(True))
        body = "".join(parts)
        if rng.random() < 0.3:
            body = el("div", 1, body, pick("", "entry", "text", "content"))
        return el("article", 1, body, pick("", "", "post")) if rng.random() < 0.6 else el(pick("div", "main", "section"), 1, body, pick("content", "article", "post", "entry-content", "story", ""))

    pages = []
    for _ in range(n):
        inner = "".join(boiler() for _ in range(rng.randint(0, 4))) + content() + "".join(boiler() for _ in range(rng.randint(0, 4)))
        for _ in range(rng.randint(0, 2)):
            inner = el("div", 1, inner, pick("", "wrapper", "container", "page"))
        pages.append(f"<html><head><title>{words(4)}</title></head><body>{inner}</body></html>")
    return pages


def train(pages: list[str] | None = None, **options) -> TreeModel:
    trees = [parse(p, labels=True) for p in (labelled_pages() if pages is None else pages)]
    labels = np.array([1 if i == 0 else int(m or 0) for t in trees for i, m in enumerate(t.marked)], dtype=np.int64)
    model = TreeModel()
    model.fit(trees, labels, **options)
    return model


def extract(model: TreeModel, pages: list[str | None]) -> list[str]:
    """The main texts of pages."""
    trees = [parse(p) for p in pages]
    if not trees:
        return []
    p, _, _ = model.marginals(*features(trees))
    out, base = [], 0
    for t in trees:
        keep = p[base : base + len(t.parent)] > 0.5
        base += len(t.parent)
        blocks: list[list[str]] = []
        last = None
        for here, block, text in t.texts:
            if keep[here]:
                if (here, block) != last:
                    blocks.append([])
                    last = (here, block)
                blocks[-1].append(text)
        out.append(" ".join(x for x in (" ".join("".join(b).split()) for b in blocks) if x))
    return out


def main_text(pages: DataFrame, model: TreeModel, html_col: str = "html") -> DataFrame:
    """pages' page_id and url with text and n_chars (code points). The model goes out as bytes of plain arrays."""
    shared = pages.sparkSession.sparkContext.broadcast(pickle.dumps((model.w, model.edge)))

    def run(batches):
        m = TreeModel()
        m.w, m.edge = pickle.loads(shared.value)
        for b in batches:
            for at, data, off in chunks(b.column(2), CHUNK):
                texts = extract(m, [data[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
                part = b.slice(at, len(texts))
                yield pa.record_batch([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(texts, type=pa.string()), pa.array([len(x) for x in texts], type=pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")

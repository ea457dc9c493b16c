"""The main text of web pages: flat text blocks, classified by a decision tree.

A page is read once from left to right.  Tags of block elements cut its text into flat
blocks; inline tags leave it whole.  A block is described by its number of words, the
share of its characters that lie in links, both figures of the block before and after it,
its place - in an element that holds no part of an article (``nav``, ``footer``, forms,
names like ``sidebar``), outside the page's main elements (``article``, ``main``), on a page
without any, or inside one - and whether it is a heading.  A decision tree (least Gini
impurity) trained on the blocks of the small labelled pages below tells the article's.

Defined cases: null counts as empty; a page without text or without article blocks gives
the empty text; repeated rows give equal texts; an empty table gives an empty result; other
columns aren't read.  A comment, script or style that doesn't end reaches to the end of the
page; a quote that doesn't end is an ordinary character; an element that isn't closed ends
with the one around it.  Time is linear in the length of a page, and memory is the page and
its blocks.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that leave a text whole.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark math nobr q rp rt ruby s samp"
    " small span strike strong sub sup time tt u var wbr".split()
)
#: Elements whose content is no text of the page.
RAW = frozenset("script style title textarea noscript template iframe object svg select option noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
OFF = frozenset("nav header footer aside form dialog button menu fieldset head label".split())
#: Words in names and roles of elements that hold no part of an article.
OFF_NAMES = frozenset(
    "ad ads advert advertisement adverts adsense banner breadcrumb breadcrumbs comment comments commentlist consent"
    " cookie cookies contentinfo disclaimer disqus footer form gdpr header login masthead menu modal nav navbar"
    " navigation newsletter notice notices pagination popup promo related replies respond search share sharing sidebar"
    " signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
MAIN_NAMES = frozenset("article main maincontent".split())
#: A name with one of these before a word says that something has it, not that it is it.
ABOUT = frozenset("no has with without is".split())

TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^<>\"']*)>")
OPEN = re.compile(r"</?[A-Za-z!?]")
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]++)\s*+(?:=\s*+("[^"]*+"|'[^']*+'|[^\s"'<>]++))?""")
PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
WHITE = re.compile(r"[\s\x00]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block(NamedTuple):
    text: str
    words: int
    density: float
    main: bool
    off: bool
    heading: bool
    label: bool


def attributes(own: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(own)}


@functools.lru_cache(maxsize=4096)
def kind_of(tag: str, own: str) -> tuple[bool, bool, bool]:
    """Whether an element is a main one, one without article text, and labelled in a training page."""
    has = attributes(own) if own.strip() else {}
    names = " ".join(has.get(k, "") for k in ("class", "id", "role"))
    words = [w.lower() for w in PARTS.findall(names)]
    said = {w for before, w in zip(["", *words], words) if before not in ABOUT}
    hidden = "hidden" in has or has.get("aria-hidden") == "true" or HIDDEN.search(has.get("style", ""))
    off = tag in OFF or bool(hidden) or (tag not in ("html", "body") and bool(said & OFF_NAMES))
    return tag in MAIN or bool(said & MAIN_NAMES), off, "data-good" in has


def end_of_tag(page: str, at: int, none: dict[str, int]) -> int:
    """Behind the tag that begins at ``at``; ``none`` remembers from where on a quote occurs no more."""
    while True:
        close = page.find(">", at)
        if close < 0:
            return len(page)
        quotes = [(q, p) for q in "\"'" if at < none.get(q, len(page) + 1) and 0 <= (p := page.find(q, at, close))]
        if not quotes:
            return close + 1
        quote, p = min(quotes, key=lambda x: x[1])
        again = page.find(quote, p + 1)
        if again < 0:
            none[quote] = p
        at = (again if again >= 0 else p) + 1


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page, in its order."""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # name, main, off, heading, label
    main = off = heading = label = False
    text: list[tuple[str, bool]] = []
    links, size, at, none = 0, len(page), 0, {}

    def flush() -> None:
        if text:
            whole = WHITE.sub(" ", html.unescape("".join(t for t, _ in text))).strip()
            if whole:
                inside = sum(len(t) for t, linked in text if linked)
                total = sum(len(t) for t, _ in text)
                found.append(Block(whole, whole.count(" ") + 1, inside / total, main, off, heading, label))
            text.clear()

    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            text.append((page[at:lt], links > 0))
            at = lt
            if at == size:
                break
        plain = TAG.match(page, at)
        if plain:
            closing, name, own, after = bool(plain[1]), plain[2].lower(), plain[3], plain.end()
        elif not OPEN.match(page, at):
            text.append(("<", links > 0))
            at += 1
            continue
        elif page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = size if end < 0 else end + 3
            continue
        elif page[at + 1] in "!?":
            end = page.find(">", at)
            at = size if end < 0 else end + 1
            continue
        else:
            after = end_of_tag(page, at, none)
            closing, name = page[at + 1] == "/", NAME.match(page, at)[1].lower()
            own = page[at + 1 + closing + len(name) : after - 1]
        at = after
        if name in RAW and not closing:
            if name not in ("option", "select", "title", "textarea"):
                flush()
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            at = size if end is None else end_of_tag(page, end.start(), none)
            continue
        if name in INLINE:
            if name == "a":
                links = max(0, links + (-1 if closing else 1))
            if name in ("a", "img", "wbr") or closing or not own.strip():
                continue
            _, gone, _ = kind_of(name, own)
            if not gone:
                continue
        flush()
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), -1)
            if depth >= 0:
                del stack[depth:]
        elif name not in VOID and not own.endswith("/"):
            if name in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
                stack.pop()  # the end tag of these may be left out
            m, o, g = kind_of(name, own if len(own) < 400 else own[:400])
            up = stack[-1] if stack else ("", False, False, False, False)
            stack.append((name, up[1] or m, up[2] or o, up[3] or name in HEADING, up[4] or g))
        if stack:
            _, main, off, heading, label = stack[-1]
        else:
            main = off = heading = label = False
        if name not in INLINE and links and (closing or name in ("p", "div", "li", "td")):
            links = 0  # a link doesn't reach into another block
    flush()
    return found


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "place", "heading")
#: Places, from the least likely for an article to the likeliest.
NO_PART, OUTSIDE, NO_MAIN, INSIDE = 0, 1, 2, 3


def features(found: list[Block]) -> np.ndarray:
    """One row for each block."""
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    if n:
        own = np.array([(b.words, b.density, b.main, b.off, b.heading) for b in found], float)
        x[:, 0:2] = own[:, 0:2]
        x[1:, 2:4] = own[:-1, 0:2]
        x[:-1, 4:6] = own[1:, 0:2]
        main, off = own[:, 2] > 0, own[:, 3] > 0
        x[:, 6] = np.where(off, NO_PART, np.where(main, INSIDE, OUTSIDE if (main & ~off).any() else NO_MAIN))
        x[:, 7] = own[:, 4]
    return x


class Tree(NamedTuple):
    feature: int  # -1: a leaf
    least: float  # values from here on go right
    left: object
    right: object
    good: bool


def grown(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Tree:
    """Splits by the least Gini impurity, the first of equal ones, halfway between values."""
    leaf = Tree(-1, 0.0, None, None, bool(2 * y.sum() > len(y)))
    if depth == 0 or y.all() or not y.any():
        return leaf
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order].cumsum()
        k = np.flatnonzero(v[1:] > v[:-1]) + 1  # sizes of the left side
        if not len(k):
            continue
        good, n, whole = t[k - 1], len(y), t[-1]
        impure = good * (k - good) / k + (whole - good) * ((n - k) - (whole - good)) / (n - k)
        i = int(np.argmin(impure))
        if best is None or impure[i] < best[0] - 1e-12:
            best = (impure[i], f, (v[k[i] - 1] + v[k[i]]) / 2)
    if best is None:
        return leaf
    _, f, least = best
    right = x[:, f] >= least
    return Tree(f, least, grown(x[~right], y[~right], depth - 1), grown(x[right], y[right], depth - 1), False)


def classify(tree: Tree, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), bool)

    def walk(node: Tree, rows: np.ndarray) -> None:
        if node.feature < 0:
            out[rows] = node.good
        else:
            right = x[rows, node.feature] >= node.least
            walk(node.left, rows[~right])
            walk(node.right, rows[right])

    walk(tree, np.arange(len(x)))
    return out


SHORT, LINE = "Rain again.", "The river rose in the night and by the morning it stood at the doors of the lower houses."
LONG = " ".join([LINE, "Boats went from street to street, and people who had never met shared bread on the roofs."] * 3)
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/c>Contact us</a></li></ul>"
#: The labelled table: small pages whose article blocks carry ``data-good``.
LABELLED = [
    f"<title>River</title><body><nav>{MENU}</nav><article><h1 data-good>River</h1><p data-good>{LONG}<p data-good>{SHORT}</article><footer>All rights kept by us</footer>",
    f"<body><header><h1>Daily</h1>{MENU}</header><main><p data-good>{SHORT}</p><p data-good>{LONG}</p><ul data-good><li>Boats</li><li>{LINE}</li></ul></main><footer>{LONG}</footer>",
    f"<body><div class=ad>{LINE}</div><article><p data-good>{SHORT}</p><div class=ad>{SHORT}</div><p data-good>{LINE}</p></article><aside>{LONG}</aside>",
    f"<body><article><h2 data-good>Water</h2><p data-good>See <a href=/r>the report</a></p><p data-good><a href=/x>{LINE}</a></p></article><section id=comments><article><p>{LONG}</p><p>{SHORT}</p></article></section>",
    f"<body><div id=cookie-notice>{LINE}</div><article><p data-good>{LINE}</p><form>{SHORT}<label>Name</label></form><p data-good>{SHORT}</p></article><div>{LONG}</div><p>{SHORT}</p>",
    f"<body><div class=sidebar>{LONG}<p>{LINE}</div><div class=main><h1 data-good>Rain</h1><p data-good>{LINE}</p></div><p>{LINE}</p><div>{MENU}</div>",
    f"<body><div>{MENU}</div><div><h1 data-good>River</h1><p data-good>{LONG}</p><p data-good>{LINE}</p><p data-good>{LONG}</p></div><div><a href=/a>Terms</a> <a href=/b>Privacy</a></div><p>Contact</p>",
    f"<body><p><a href=/1>One</a></p><p><a href=/2>Two</a> <a href=/3>Three</a></p><p data-good>{LONG}</p><p data-good>{LINE}</p><p data-good>{SHORT}</p><p data-good>{LONG}</p><p><a href=/4>{LINE}</a></p><p>Posted by us</p>",
    f"<body><div>{MENU}</div><div><p data-good>{LINE}</p><p data-good>{LINE}</p></div><div class=footer>{LINE}</div><div class=newsletter>{LONG}</div>",
    f"<body><div>Skip</div><div>{MENU}</div><div>Today</div><div><a href=/1>More</a></div><h2 data-good>Rain</h2><p data-good>{LONG}</p><p data-good>{LINE}</p><p>Print</p><p><a href=/2>Send</a></p><p>Top</p>",
    f"<body><td><a href=/1>Start</a></td><td><a href=/2>{LINE}</a></td><td data-good>{LONG}</td><td data-good>{LINE}</td><td>{SHORT}</td>",
]


@functools.lru_cache(maxsize=1)
def trained() -> Tree:
    found = [blocks(page) for page in LABELLED]
    return grown(np.vstack([features(f) for f in found]), np.array([b.label for f in found for b in f]))


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    return " ".join(b.text for b, good in zip(found, classify(tree, features(found))) if good)


def extract(page: Column, tree: Tree | None = None) -> Column:
    """The main text of each page; ``tree`` is one grown from other labelled blocks."""
    tree = tree or trained()

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array((main_text(p.as_py(), tree) for p in pages), pa.string())

    return text(page)

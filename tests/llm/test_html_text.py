"""Main texts of pages against a reading by the standard library's parser, and small pages."""

from __future__ import annotations

import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import html_text, queries


class Article(HTMLParser):
    """Text within article elements, a space for each tag of a block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.out.append("" if tag == "b" else " ")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.out.append("" if tag == "b" else " ")

    def handle_data(self, data):
        if self.inside:
            self.out.append(data)


def test_every_page_of_the_table(spark):
    rows = queries.table(spark, "/root/testdata/sf0.01", "pages").collect()
    got = {r.page_id: r for r in queries.op12_html_text(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    for r in rows:
        plain = Article()
        plain.feed(r.html)
        plain.close()
        text = re.sub(r"\s+", " ", "".join(plain.out)).strip()
        assert (got[r.page_id].url, got[r.page_id].text, got[r.page_id].n_chars) == (r.url, text, len(text))


def text_of(page):
    return html_text.main_text(page, html_text.trained())


A = "The river rose in the night and by the morning it stood at the doors."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<nav>only a menu</nav>", ""),
        (f"<article><p>{A}</p><p>Short.</article><footer>{A}{A}</footer>", f"{A} Short."),
        (f"<main><h1>T&amp;C &lt;b&gt; &eacute;&#x27;&#39;&nbsp;x</h1><p>a<b>b</b>c<br>d\n\t e</main>", "T&C <b> é'' x abc d e"),
        (f"<article><p>{A}<script>var x='</p>';if(a<b)y()</script><style>p{{}}</style><!-- <p>gone</p> --></article>", A),
        (f"<article><p>{A}</p><div class='social-share'>Share</div><aside>{A}</aside><form><p>{A}</p></form></article>", A),
        (f"<article><p>{A}</p></article><section class=comments><article><p>{A} {A}</p></article></section>", A),
        (f"<body class='has-sidebar'><div id=siteHeader>{A}</div><article class='no-comments'><p>{A}</p></article>", A),
        (f"<article><a href='/x>y'>linked</a> 1 < 2 & 3 <p title=\"a>b\">{A}</article>", f"linked 1 < 2 & 3 {A}"),
        (f"<article><p>{A}<!-- never ends <p>x</article>", A),
        (f"<article><p>{A}</p><p hidden>{A}</p><p style='display: none'>{A}</p></article>", A),
        (f"<ARTICLE><P>{A}</P><TABLE><TR><TD>x<TD>y</TABLE></ARTICLE>", f"{A} x y"),
        (f"<div><ul><li><a href=/>Home</a><li><a href=/>News</a></ul></div><div><p>{A}</p><p>{A} {A}</p></div><div><a href=/>Terms</a></div>", f"{A} {A} {A}"),
    ],
)
def test_pages(page, text):
    assert text_of(page) == text


def test_neighbours_and_places():
    found = html_text.blocks(f"<p><a href=/>a b</a> c</p><main><h2>d</h2><nav>e</nav></main>")
    x = html_text.features(found)
    assert x[:, 0].tolist() == [3, 1, 1] and x[1, 2:6].tolist() == [3, pytest.approx(3 / 5), 1, 0]
    assert x[:, 6].tolist() == [html_text.OUTSIDE, html_text.INSIDE, html_text.NO_PART] and x[:, 7].tolist() == [0, 1, 0]


def test_tree_learns_its_table_and_takes_the_purest_split():
    found = [html_text.blocks(p) for p in html_text.LABELLED]
    labels = np.array([b.label for f in found for b in f])
    got = html_text.classify(html_text.trained(), np.vstack([html_text.features(f) for f in found]))
    assert (got == labels).mean() >= 0.97 and 80 < len(labels) < 200
    assert html_text.FEATURES[html_text.trained().feature] == "place"
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 5, (60, 3)).astype(float), rng.random(60) < 0.5
    tree = html_text.grown(x, y, 1)
    gini = lambda t: 2 * t.mean() * (1 - t.mean()) * len(t)
    every = [gini(y[x[:, f] < v]) + gini(y[x[:, f] >= v]) for f in range(3) for v in range(1, 5)]
    right = x[:, tree.feature] >= tree.least
    assert gini(y[right]) + gini(y[~right]) == pytest.approx(min(every))


@pytest.mark.parametrize("part", ["<p>word ", "<a \"", "<div '", "<!--", "<", "</x", "<script>", "&amp", "<b><i>", "<div><p>x"])
def test_time_in_proportion(part):
    began = time.perf_counter()
    html_text.blocks(part * (1_000_000 // len(part)))
    assert time.perf_counter() - began < 10


def test_table_cases(spark):
    page = f"<article><p>{A}</article>"
    pages = spark.createDataFrame([(1, page, "x"), (1, page, "y"), (None, None, None)], "page_id int, html string, text string")
    got = pages.select("page_id", html_text.extract(F.col("html")).alias("main")).collect()
    assert sorted(r.main for r in got) == ["", A, A]
    assert pages.limit(0).select(html_text.extract(F.col("html"))).collect() == []

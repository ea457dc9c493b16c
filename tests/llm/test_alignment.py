"""Cross-tokenizer alignment against whole texts, all overlaps and plain counts."""

from __future__ import annotations

import functools
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm import alignment, queries

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "\n", "a  b", " x", "x ", "a \n b", "a\nb", "\n\nab\n", "<|endoftext|> <s> <0x0A>", "naïve façade — 東京 \U0001f600\U0001f469‍\U0001f4bb", "a▁b", "▁", "tab\tnbsp x", "\x00\x1c y", "don't 'll 12345 !!??", "é ﬁ ｆｕｌｌ"]


def brute(text: str | None) -> tuple:
    """Ids, groups and links of a whole text, each pair of tokens compared."""
    model = alignment.loaded(*PATHS)
    if not text:
        return [], [], "", []
    want = (" " + text).encode()
    a, b = model.a.encode(" " + text, add_special_tokens=False).ids, model.b.encode(text)
    sides = []
    for ids, table in ((a, model.a_bytes), (b, model.b_bytes)):
        if b"".join(table[i] for i in ids) != want:
            return [], [], "", []
        at, own = 0, []
        for i in ids:
            own.append((i, at, at + len(table[i])))
            at = own[-1][2]
        sides.append(own)
    ends = sorted({t[2] for t in sides[0]} & {t[2] for t in sides[1]})
    groups = [
        "|".join(",".join(str(i) for i, s, e in side if low <= s and e <= high) for side in sides)
        for low, high in zip([0, *ends], ends)
    ]
    starts, stops = (np.array([t[k] for t in sides[1]]) for k in (1, 2))
    links = [(i, b[j]) for i, low, high in sides[0] for j in np.flatnonzero((starts < high) & (stops > low))]
    return a, b, ";".join(groups), links


def expected(texts: list) -> list[tuple]:
    made = [brute(t) for t in texts]
    count, most = Counter(), defaultdict(int)
    for *_, links in made:
        count.update(set(links))
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return [
        (len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), sum(count[x] == most[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for a, b, groups, links in made
    ]


def run(spark, texts: list, **sizes) -> list[tuple]:
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [tuple(r)[1:] for r in sorted(alignment.align(docs, *PATHS, **sizes).collect())]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab eé\n \t.'1東"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_cells_are_the_whole_text(text):
    got = alignment.loaded(*PATHS).of_text(text) if text else None
    a, b, groups, links = brute(text)
    if got is None:
        assert not groups
    else:
        base = alignment.loaded(*PATHS).base
        assert (got[0].groups, got[1], got[2]) == (groups, len(a), len(b))
        assert Counter(got[0].links.tolist()) == Counter(x * base + y for x, y in links)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abé .\n東Q7", min_size=1, max_size=60), st.integers(1, 12), st.randoms(use_true_random=False))
def test_any_order_of_composing_gives_the_whole(text, size, order):
    model = alignment.loaded(*PATHS)
    cut = list(alignment.chunks(text, size))
    assert [c[2] for c in cut[1:]] == [c[3] for c in cut[:-1]] and cut[-1][3] == len((" " + text).encode())
    parts = [alignment.UNIT, *(model.of_chunk(*c) for c in cut), alignment.UNIT]
    rows = [alignment.from_row(alignment.pd.DataFrame([alignment.as_row(p, 0, 0)], columns=[f.split()[0] for f in alignment.FRAGMENT.split(", ")]).iloc[0]) for p in parts]
    while len(rows) > 1:
        i = order.randrange(len(rows) - 1)
        rows[i : i + 2] = [alignment.compose(rows[i], rows[i + 1], model.base)]
    a, b, groups, links = brute(text)
    got = alignment.whole(rows[0], model.base)
    assert got.groups == groups and Counter(got.links.tolist()) == Counter(x * model.base + y for x, y in links)
    assert len(rows[0].tail_a) == len(rows[0].tail_b) == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aehtéñ ß.,!)('\"-:;\n", max_size=60))
def test_words_and_marks(text):
    got = alignment.loaded(*PATHS).of_text(text) if text else None
    a, b, groups, links = brute(text)
    assert (got[0].groups, got[1], got[2]) == (groups, len(a), len(b)) if got else not groups


def test_chunks_have_open_ends():
    model = alignment.loaded(*PATHS)
    parts = [model.of_chunk(*c) for c in alignment.chunks("unbelievably interoperable 東京 tokenizations " * 3, 16)]
    assert any(len(p.tail_a) or len(p.tail_b) for p in parts) and any(p.closed and p.closed.n_groups for p in parts)


def test_a_cell_longer_than_a_chunk_is_read_once():
    cut = list(alignment.chunks("x " + "a" * 1000 + " tail of text", 64))
    assert sum(len(c[0]) for c in cut) < 1000 + 2 * 64


def test_rows_and_odd_texts(spark):
    words = "the thing réseau größer 東京 don't a an 12 interoperable\nx . , \t".split(" ")
    rng = random.Random(5)
    long = " ".join(rng.choice(words) for _ in range(400))
    texts = [None, *ODD, "the the thing", "the thing", "the thing", long, long + " ▁", "b" * 700]
    want = expected(texts)
    assert run(spark, texts) == want
    assert run(spark, texts, chunk_bytes=48, fan=2, block_bytes=64, block_rows=3) == want


def test_ids_groups_and_other_columns(spark):
    rows = [(None, "ab cd", 1), (3, "ab cd", 2), (3, "ab cd", 2)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, block int").repartition(2)
    got = alignment.align(docs, *PATHS, keep_groups=True).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.groups) for r in got) == [(False, 3, brute("ab cd")[2])] * 2 + [(True, 0, brute("ab cd")[2])]
    assert {(r.n_best, r.count_sum) for r in got} == {(got[0].n_links, 3 * got[0].n_links)}
    assert alignment.align(docs.limit(0), *PATHS).collect() == []


def test_query_on_whole_table(spark):
    rows = sorted(queries.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect())
    got = sorted(queries.op13_tokenizer_alignment(spark, "/root/testdata/sf0.001").collect())
    assert [tuple(r) for r in got] == [(r.doc_id, *w) for r, w in zip(rows, expected([r.text for r in rows]))]

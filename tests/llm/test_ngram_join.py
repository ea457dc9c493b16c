import random

import numpy as np
import pytest

from docweave.llm import ngram_join as nj

KIND = "doc_id long, text string, lang string, n long"


def brute(rows):
    def shingles(text):
        words = (text or "").encode().lower().split()
        if not words:
            return frozenset()
        return frozenset({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)})

    sets = [(i, shingles(t)) for i, t, *_ in rows]
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted(((-9 if i is None else i), len(s), (i if not s else least.get(root(k))) or (-9 if i is None else i)) for k, (i, s) in enumerate(sets))


def run(spark, rows):
    got = nj.ngram_groups(spark.createDataFrame(rows, KIND).repartition(3)).collect()
    return sorted(((-9 if r.doc_id is None else r.doc_id), r.n_shingles, r.component_id if r.component_id is not None else -9) for r in got)


def texts(seed, count):
    pick = random.Random(seed)
    word = lambda: "".join(pick.choice("abcdeé") for _ in range(pick.randint(1, 5)))
    shared = [" ".join(word() for _ in range(60)) for _ in range(2)]
    out = []
    for i in range(count):
        kind = pick.random()
        if out and kind < 0.55:
            words = pick.choice(out)[1].split(" ")
            for _ in range(pick.randint(0, max(1, len(words) // 30))):
                words[pick.randrange(len(words))] = word()
            text = " ".join(words)
        else:
            text = " ".join(word() for _ in range(pick.randint(3, 120)))
            if kind > 0.75:
                text += "\n" + pick.choice(shared)
        out.append((i + 1, text.upper() if kind < 0.1 else text, "x", 0))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = texts(seed, 260)
    assert run(spark, rows) == brute(rows)


def test_cases(spark):
    long = " ".join(str(k) for k in range(3000))
    rows = [(9, "a b c", None, None), (3, "A\tb  c ", "", 1), (4, "a b", "", 1), (5, None, "", 1), (6, " \n", "", 1), (7, long, "", 1), (8, long + " x", "", 1), (8, long + " x", "", 1), (2, "É b c d e f", "", 1), (1, "é b c d e f", "", 1)]
    assert run(spark, rows) == brute(rows)
    got = run(spark, [(None, "p q r s t u", "", 1), (11, "p q r s t u", "", 1), (None, "only null", "", 1)])
    assert got == [(-9, 1, -9), (-9, 2, 11), (11, 2, 11)]
    assert run(spark, []) == []


def test_small_chunks(spark, monkeypatch):
    rows = texts(5, 150)
    for name, value in (("MOST", 300), ("SETS", 7), ("LISTED", 1)):
        monkeypatch.setattr(nj, name, value)
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("combined", [0, 64])
def test_many_components_in_a_bucket(spark, monkeypatch, combined):
    """Families of near copies that share their rarest passage; chains, whose ends aren't alike."""
    monkeypatch.setattr(nj, "COMBINED", combined)
    monkeypatch.setattr(nj, "COMPARED", 1)
    pick = random.Random(3)
    word = lambda: "".join(pick.choice("abcdefgh") for _ in range(5))
    common, rows = " ".join(word() for _ in range(60)), []
    for family in range(6):
        own = [word() for _ in range(pick.randint(40, 90))]
        for _ in range(12):
            kept = list(own)
            kept[pick.randrange(len(kept))] = word()
            rows.append((len(rows) + 1, common + " " + " ".join(kept), "x", 0))
    chain = [word() for _ in range(80)]
    for step in range(25):
        chain[(3 * step) % 80] = word()
        rows.append((len(rows) + 1, " ".join(chain), "x", 0))
    assert run(spark, rows) == brute(rows)


def sets(seed, size=60):
    pick = random.Random(seed)
    for _ in range(300):
        a = set(pick.sample(range(size), pick.randint(1, 40)))
        b = set(a)
        for _ in range(pick.randint(0, 8)):
            b.symmetric_difference_update({pick.randrange(size)})
        yield a, b


def test_check_of_pairs():
    for a, b in sets(8):
        x, y = (np.sort(np.array(sorted(s), np.uint64) * np.uint64(0x0432_1234_5678_9ABC)) for s in (a, b))
        want = bool(b) and 100 * len(a & b) >= 80 * len(a | b)
        assert nj.linked(len(x), x, len(y), y) == want


def test_filters_keep_every_link(spark):
    """Entries of made-up sets, as may_link sees them: a pair that links passes at every shingle that both have."""
    rows, wants = [], []
    for a, b in sets(9):
        alone = {0: a - b, 1: b - a}
        if 100 * len(a & b) < 80 * len(a | b):
            continue
        row = []
        for k, own in enumerate((a, b)):
            order = sorted(own, key=lambda x: (x not in alone[k], x))
            bits = [0, 0, 0, 0]
            for x in own - alone[k]:
                bits[x % 256 // 64] ^= 1 << x % 64
            row.append((order, len(alone[k]), [v - (1 << 64) if v >> 63 else v for v in bits]))
        for x in a & b:
            (p, u, s), (q, w, t) = row
            rows.append((len(p), u, p.index(x), *s, len(q), w, q.index(x), *t))
    names = ["n", "alone", "place", *nj.SIGNS]
    got = spark.createDataFrame(rows, [*names, *(f"p_{c}" for c in names)])
    assert len(rows) > 500 and got.where(~nj.may_link()).count() == 0


def test_digests_of_words():
    """White space and case as the contract has them; long words and many texts at once give what each alone does."""
    import pyarrow as pa

    many = ["A b\tC\x0bd e f", None, "", " ", "É x", "é x", "w" * 5000 + " v", "W" * 5000 + " V", "a b", "b a", "a\u00a0b c d e f g", "ab" * 40 + " c"]
    flat, sizes = nj.shingle_sets(pa.array(many, pa.string()))
    ends = np.cumsum(sizes)
    for k, text in enumerate(many):
        assert np.array_equal(nj.shingle_set(text), flat[ends[k] - sizes[k] : ends[k]])
    of = lambda t: nj.shingle_set(t).tolist()
    assert of("A b\tC\x0bd e f") == of("a B c d E  F") and len(of("a b c d e f")) == 2
    assert of("É x") != of("é x") and of(many[6]) == of(many[7]) and of("a b") != of("b a")
    assert len(of("a b a b a b a b a b a b")) == 2 and of(" ".join("abc" * 3)) != of("".join("abc" * 3))


def test_long_words_and_texts():
    import time

    began = time.time()
    assert len(nj.shingle_set("x" * 5_000_000 + " y z")) == 1
    assert len(nj.shingle_set("q " + " ".join(str(k) for k in range(1_000_000)))) == 999_997
    assert time.time() - began < 10


def frequent_passages(count, passages=9, each=4):
    """Texts of the same passages in other orders."""
    pick = random.Random(11)
    known = [" ".join(f"w{p}x{j}" for j in range(14)) for p in range(passages)]
    return [(i + 1, " ".join(pick.sample(known, each)), "x", 0) for i in range(count)]


@pytest.mark.parametrize("wide, combined", [(2, 0), (8, 2), (64, 64)])
def test_frequent_passages_in_other_orders(spark, monkeypatch, wide, combined):
    monkeypatch.setattr(nj, "WIDE", wide)
    monkeypatch.setattr(nj, "COMBINED", combined)
    monkeypatch.setattr(nj, "COMPARED", 1)
    rows = frequent_passages(220)
    assert run(spark, rows) == brute(rows)

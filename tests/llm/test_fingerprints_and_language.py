import random
import re

import pytest
from pyspark.sql import functions as F

from docweave.llm import fingerprints as fp
from docweave.llm import language
from docweave.llm.queries import op1_fingerprints, op6_language_id

SF = "/root/testdata/sf0.001"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_subsequence():
    pick = random.Random(2)
    for _ in range(200):
        a, b = ("".join(pick.choice("abc") for _ in range(pick.randint(0, 30))) for _ in range(2))
        assert fp.common(a, b) == lcs(a, b)


def test_likeness():
    pick = random.Random(3)
    words = ["".join(pick.choice("abcdefghij") for _ in range(pick.randint(2, 8))) for _ in range(4000)]
    for n in (300, 1900):
        a, b = " ".join(words[:n]), " ".join(words[-n:])
        assert fp.likeness(fp.fingerprint(a), fp.fingerprint(a)) == 1.0
        assert fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) == 0.0
        assert 0.6 < fp.likeness(fp.fingerprint(a), fp.fingerprint(fp.edited(a, b))) < 0.95
        assert fp.likeness(fp.fingerprint(a), fp.fingerprint("x" + a)) > 0.9
    assert fp.fingerprint(None) == fp.fingerprint("") == "4::"
    assert len(fp.fingerprint("ab" * 100_000)) < 4 * fp.MOST + 20


@pytest.mark.parametrize("ranges", [1, 3, 50])
def test_next_document(spark, ranges):
    rows = [(i, f"text of {i} " * (i % 7), "clash") for i in range(40)] + [(5, "twice", None), (5, "twice", None), (None, "no id", None), (90, None, "")]
    got = fp.compared_with_next(spark.createDataFrame(rows, "doc_id long, text string, edited string").repartition(5), ranges=ranges).collect()
    order = sorted(((i is not None, i or 0, t or "") for i, t, _ in rows))
    want = sorted((o[1] if o[0] else -1, len(o[2]), fp.edited(o[2], n[2])) for o, n in zip(order, order[1:] + order[:1]))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_chars, r.edited) for r in got) == want
    assert all(r.edited_fingerprint == fp.fingerprint(r.edited) for r in got)


def slow_fingerprint(text):
    """Byte by byte, as the module's head describes it."""
    data, two32 = (text or "").encode(), 1 << 32
    if not data:
        return "4::"

    def mixed(at):
        h = sum((data[at - k] + 1) * pow(0x9E3779B1, k + 1, two32) for k in range(7) if at >= k) % two32
        h = (h ^ h >> 15) * 0x85EBCA6B % two32
        return h ^ h >> 13

    marks = [mixed(at) for at in range(len(data))]

    def letters(block):
        out, total, open_ = "", 0, False
        for h in marks:
            total, open_ = (total + h * 0xC2B2AE35) % two32, True
            if h % block == block - 1:
                out, total, open_ = out + letter(total), 0, False
        return out + letter(total) if open_ else out

    def letter(total):
        return chr(fp.LETTERS[((total ^ total >> 16) * 0x7FEB352D % two32) >> 26])

    block = 4
    while block * fp.MOST < len(data):
        block *= 2
    while sum(h % block == block - 1 for h in marks) + 1 > 2 * fp.MOST:
        block *= 2
    return f"{block}:{letters(block)}:{letters(2 * block)}"


def test_fingerprint_byte_by_byte():
    pick = random.Random(6)
    texts = ["", "a", "abcdefg", "é€ 𝄞", "ab" * 3000, "x" * 900, "\0\0"]
    texts += ["".join(pick.choice("abcdefgh \né") for _ in range(pick.randint(1, 3000))) for _ in range(60)]
    for text in texts:
        assert fp.fingerprint(text) == slow_fingerprint(text)


def test_language_against_plain_counts(spark):
    """Counts, priors and scores again in plain Python."""
    import math
    from collections import Counter

    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sets = {"doc_id": "long", "text": "string", "lang": "string"}
    df = spark.createDataFrame([(r.doc_id, r.text[:400] if r.text else r.text, r.lang) for r in docs], ", ".join(f"{k} {v}" for k, v in sets.items()))
    rows = df.collect()

    def grams(text):
        codes, found = [ord(c) for c in text.lower()], []
        for start in range(len(codes)):
            mixed = 0
            for order, c in enumerate(codes[start : start + 3]):
                mixed = (mixed * 0x01000193 + c + order + 1) % (1 << 32)
                found.append((mixed * 0x9E3779B1 % (1 << 32)) >> 19)
        return found

    counts, seen = {}, Counter()
    for r in rows:
        if r.lang is not None and r.text is not None:
            counts.setdefault(r.lang, Counter()).update(grams(r.text))
            seen[r.lang] += 1
    total = sum(n + 1 for n in seen.values())
    size = {k: sum(c.values()) + 0.5 * language.BUCKETS for k, c in counts.items()}
    got = {r.doc_id: r.p for r in df.select("doc_id", language.predict(F.col("text"), language.learn(df)).alias("p")).collect()}
    for r in rows:
        if not r.text or not language.LETTER.search(r.text):
            assert tuple(got[r.doc_id]) == ("und", 0.0)
            continue
        own = Counter(grams(r.text))
        logs = {k: math.log((seen[k] + 1) / total) + sum(n * math.log((counts[k][g] + 0.5) / size[k]) for g, n in own.items()) for k in counts}
        best = max(sorted(logs), key=logs.get)
        assert got[r.doc_id].lang == best
        assert abs(got[r.doc_id].score - 1 / sum(math.exp(x - logs[best]) for x in logs.values())) < 1e-6


def test_many_languages_and_long_texts(spark, monkeypatch):
    rows = [(k, f"w{k} " * 5, f"l{k:03d}") for k in range(300)]
    df = spark.createDataFrame([*rows, (999, "w7 " * 300_000, None)], "doc_id long, text string, lang string")
    model = language.learn(df)
    got = {r.doc_id: r.p.lang for r in df.select("doc_id", language.predict(F.col("text"), model).alias("p")).collect()}
    assert len(model.languages) == 300 and sum(got[k] == lang for k, _, lang in rows) > 290 and got[999] in got.values()
    texts = [t for _, t, _ in rows[:60]]
    whole = language.score_batch(model, texts)
    monkeypatch.setattr(language, "MOST_CELLS", 1)
    parts = language.score_batch(model, texts)
    assert (whole[0] == parts[0]).all() and abs(whole[1] - parts[1]).max() < 1e-9


def test_next_of_none_and_one(spark):
    df = spark.createDataFrame([(4, "abcdefgh")], "doc_id long, text string")
    assert fp.compared_with_next(df.limit(0)).count() == 0
    assert [r.edited for r in fp.compared_with_next(df).collect()] == ["abcdefab"]


def test_op1_keeps_all(spark):
    rows = op1_fingerprints(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert sum(r.near_edited for r in rows) / len(rows) > 0.5


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in op6_language_id(spark, "/root/testdata/sf0.01").collect()}
    held = [(r.lang, got[r.doc_id].lang_pred) for r in docs.collect() if got[r.doc_id].held_out and r.lang]
    assert len(got) == docs.count() and len(held) > 100
    assert sum(a == b for a, b in held) / len(held) > 0.95


def test_language_cases(spark):
    rows = [(1, "the cat is on the mat", "en", 0.0), (2, "der hund und die katze", "de", 1.0), (3, None, "en", None), (4, "12 34!", None, None), (5, "", "de", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = language.learn(df)
    got = {r.doc_id: r.p for r in df.select("doc_id", language.predict(F.col("text"), model).alias("p")).collect()}
    assert [got[i].lang for i in range(1, 6)] == ["en", "de", "und", "und", "und"]
    none = language.learn(df.limit(0))
    assert {r.p.lang for r in df.select(language.predict(F.col("text"), none).alias("p")).collect()} == {"und"}

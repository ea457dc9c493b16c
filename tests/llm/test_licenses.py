import random
from collections import Counter

from pyspark.sql import functions as F

from docweave.llm import licenses as li
from docweave.llm.queries import op2_license_scans


def brute(text, templates, threshold):
    words = li.normal_words(text)
    rated = []
    for k, t in enumerate(templates.values()):
        own = li.normal_words(t)
        width = min(len(own), len(words))
        for s in range(len(words) - width + 1):
            part = words[s : s + width]
            a, b = Counter(zip(part, part[1:])), Counter(zip(own, own[1:]))
            dice = 2.0 * sum((a & b).values()) / max(1, len(part) + len(own) - 2)
            if width > 1 and dice >= threshold - 1e-12:
                rated.append((-dice, s, k, s + width))
    taken, out = set(), []
    for dice, s, k, e in sorted(rated):
        if taken.isdisjoint(range(s, e)):
            taken |= set(range(s, e))
            out.append((k, s, e, -dice))
    return sorted(out, key=lambda x: x[1])


def test_against_brute_force():
    pick = random.Random(4)
    scanner = li.Scanner(li.TEMPLATES)
    for _ in range(60):
        parts = []
        for _ in range(pick.randint(0, 4)):
            words = pick.choice(list(li.TEMPLATES.values())).split()
            for _ in range(pick.randint(0, 3)):
                words[pick.randrange(len(words))] = "other"
            parts += [" ".join(words), " ".join(pick.choice(["the", "software", "x", "license", "of"]) for _ in range(pick.randint(0, 9)))]
        text = pick.choice(["\n", " "]).join(parts)
        assert scanner.find(text) == brute(text, li.TEMPLATES, 0.8)
    assert scanner.find("software " + li.TEMPLATES["MIT"].upper().replace(",", "") + " end")[0][3] > 0.99


def test_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "é\nReleased under the  MIT license", None), (3, "Released under the MIT License. " * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = [(r.doc_id, len(r.f)) for r in df.select("doc_id", li.licenses(F.col("text")).alias("f")).collect()]
    assert got == [(1, 0), (2, 0), (3, 1), (3, 5000)]
    assert df.limit(0).select(li.licenses(F.col("text"))).count() == 0


def test_whole_table(spark):
    """Whole texts against every template that shares two fifths of its bigrams with them, which any finding needs."""
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op2_license_scans(spark, sf).collect()
    assert {r.doc_id for r in rows} == docs.keys()
    both = [*li.TEMPLATES.items(), *li.license_texts.common()]
    sizes, holders = [], {}
    for k, (_, template) in enumerate(both):
        own = li.normal_words(template)
        pairs = Counter(zip(own, own[1:]))
        sizes.append(sum(pairs.values()))
        for pair, n in pairs.items():
            holders.setdefault(pair, []).append((k, n))
    found = 0
    for r in rows:
        words, shared = li.normal_words(docs[r.doc_id]), Counter()
        for pair, n in Counter(zip(words, words[1:])).items():
            for k, own in holders.get(pair, ()):
                shared[k] += min(n, own)
        some = {k: both[k][1] for k in sorted(shared) if shared[k] >= 0.4 * sizes[k] - 1e-9}
        names = [both[k][0] for k in some]
        want = brute(docs[r.doc_id], some, 0.8)
        assert r.spans == ",".join(f"{names[k]}:{s}:{e}" for k, s, e, _ in want)
        found += len(want)
    assert found > 10


def test_common_licences_get_their_own_names(spark):
    both = [*li.TEMPLATES.items(), *li.license_texts.common()]
    scanner = li.Scanner(both)

    def named(text):
        return scanner.names[max(scanner.find(text), key=lambda f: (f[3], -f[1]))[0]]

    bare = lambda name: name.removesuffix("-notice").removesuffix("-header").removesuffix("-terms")
    for name, text in both:
        assert bare(named(f"words before\n{text}\nwords behind it")) == bare(name), text[:200]
    cases = {
        "This work is licensed under the GNU General Public License, version 2.": "GPL-2.0-notice",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-notice",
        "This work is licensed under the GNU Lesser General Public License, version 3.": "LGPL-3.0-notice",
        "Licensed under the Apache License, Version 1.1.": "Apache-1.1-notice",
        "Licensed under the Apache License, Version 9.0.": "Apache-notice",
        "Licensed under CC BY-NC 3.0.": "CC-BY-NC-3.0-notice",
        "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0-notice",
    }
    assert {text: named(text) for text in cases} == cases
    got = spark.createDataFrame([(t,) for t in cases], "text string").select("text", li.licenses(F.col("text"))[0]["license"].alias("l")).collect()
    assert {r.text: r.l for r in got} == cases


def test_long_template_with_changes_against_brute_force():
    whole = li.license_texts.files()["LGPL-3.0"].split()
    words = ["the", "software", *whole[:400], "other", *whole[401:], "license", "of"] + whole[:30]
    templates = {"LGPL-3.0": " ".join(whole), "part": " ".join(whole[500:560])}
    assert li.Scanner(templates).find(" ".join(words)) == brute(" ".join(words), templates, 0.8)

import re

import corpus_pipeline
from docweave.llm import ngram_join, packing, secrets, toxicity
from docweave.llm.queries import table, toxicity_network
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    scores = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.score(F.col("text"), toxicity_network(spark, docs, SF)).alias("s")).collect()}
    left = {i: r.text or "" for i, r in rows.items() if scores[i] < toxicity.TOXIC}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i]), i)
    left = {i: left[i] for i in first.values()}
    sets = {i: frozenset(ngram_join.shingle_set(t).tolist()) for i, t in left.items()}
    by, parent = {}, {i: i for i in sets}
    for i, s in sets.items():
        for h in s:
            by.setdefault(h, []).append(i)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for own in by.values():
        for a in own:
            for b in own:
                if a < b and root(a) != root(b) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    left = {i: t for i, t in left.items() if root(i) == i}
    for i, text in left.items():
        out, upto = [], 0
        for start, _, end in secrets.find(text):
            if start >= upto:
                out += [text[upto:start], "[secret]"]
            upto = max(upto, end)
        left[i] = "".join(out) + text[upto:]
    import public_tokenizers

    model = packing.loaded(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((i, k // 4096, min(4096, n - k)) for i, t in left.items() for n in [len(model.encode(t)) // 4 + 1] for k in range(0, n, 4096))
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in got) == want
    fill = {}
    for r in got:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 4096 and len(fill) <= sum(fill.values()) / 4096 * 1.02 + 1


def test_stages_on_odd_rows(spark):
    rows = [(1, None, None, None, None, 5), (1, None, None, None, None, 5), (2, "", "en", "s", 0, 1), (None, "token = abcdefgh", "en", "s", 16, 1), (3, "token = abcdefgh", "en", "s", 16, 1), (4, "token = 12345678", "en", "s", 16, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long")
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "n"], name
    got = sorted((r.doc_id, r.text, r.n_chars) for r in docs.collect())
    assert got == [(1, None, None), (3, "[secret]", 8), (4, "[secret]", 8)]
    assert corpus_pipeline.STAGES[4][1](spark, docs.limit(0), SF).count() == 0


def test_near_copies_without_ids(spark):
    base, other = (" ".join(f"{c}{k}" for k in range(200)) for c in "ab")
    texts = [(None, base), (None, base + " x"), (7, base + " x y"), (5, base + " z"), (None, other), (None, other + " x"), (None, ""), (None, None), (9, ""), (None, "on its own"), (5, base)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]
    assert len([x for x in got if x[1] and x[1].startswith("a0")]) == 1 and {x[0] for x in got if x[1] and x[1].startswith("a0")} == {5}
    assert [x[0] for x in got if x[1] and x[1].startswith("b0")] == [None]
    rest = [x for x in got if not x[1] or x[1][:2] not in ("a0", "b0")]
    assert sorted(rest, key=repr) == sorted([(None, ""), (None, None), (9, ""), (None, "on its own")], key=repr)


def test_columns_with_the_names_of_the_stages_own(spark):
    rows = [(1, "token = abcdefgh", 16, "k", "s"), (2, "token = abcdefgh", 16, "K", "S"), (3, "clean", 5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, _key string, _spans string")
    near = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert near.dtypes == docs.dtypes and sorted((r.doc_id, r._key) for r in near.collect()) == [(1, "k"), (3, None)]
    clean = corpus_pipeline.hide_secrets(spark, docs, SF)
    assert clean.dtypes == docs.dtypes and [(r.text, r.n_chars, r._spans) for r in clean.orderBy("doc_id").collect()] == [("[secret]", 8, "s"), ("[secret]", 8, "S"), ("clean", 5, None)]

"""The stored index of a revision, and bounds that leave out what can't reach the first ranks."""

from __future__ import annotations

import glob
import random

import pytest
from pyspark.sql import functions as F

from docweave.functions import dims
from docweave.operators import evidence, index, ranking
from tests.test_operators import chunk


def made(spark, n=12, body=lambda k: f"alpha beta number{k} next.js"):
    return index.index_fields(chunk(spark, [(k, k, None, "nodejs", f"Title {k}", body(k)) for k in range(n)]))


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    b = b.select(a.columns)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_index_of_a_revision(spark, tmp_path):
    fields = made(spark)
    for revision in ("r1", "r2"):
        index.write_index(fields if revision == "r1" else fields.where("chunk_id < 3"), str(tmp_path), revision, 4)
    built, want = index.read_index(spark, str(tmp_path), "r1"), index.postings(fields)
    same(built.postings.select(want.columns), want)
    same(built.frequencies, index.document_frequency(want))
    stats = built.stats.first()
    assert (stats.n_chunks, stats.n_blocks, stats.buckets) == (12, 1, 4) and built.fields.count() == 12
    assert built.postings.where(F.col("bucket") != index.bucket_of(F.col("token"), 4)).count() == 0
    assert index.read_index(spark, str(tmp_path), "r2").fields.count() == 3


def test_what_a_failed_build_leaves_is_never_read(spark, tmp_path):
    path, fields = str(tmp_path), made(spark)

    def broken():
        index.write_tables(fields, f"{path}/builds/half", 4)
        raise OSError("lost")

    with pytest.raises(OSError):
        index.open_index(spark, path, "r1", broken)
    assert index.read_index(spark, path, "r1") is None
    assert index.open_index(spark, path, "r1", lambda: fields, 4).fields.count() == 12
    before = sorted(glob.glob(f"{path}/builds/*"))

    def never():
        raise AssertionError("built again")

    again = index.open_index(spark, path, "r1", never)
    assert again.fields.count() == 12 and sorted(glob.glob(f"{path}/builds/*")) == before


def test_buckets_prune_the_postings(spark, tmp_path):
    built = index.open_index(spark, str(tmp_path), "r1", lambda: made(spark, 200), 16)
    questions = spark.createDataFrame([(1, "number7 title", 5.0)], "question_id long, text string, limit double")
    terms = ranking.prepare(questions, built, dims.stopwords(spark), dims.aliases(spark))["terms"]
    near = terms.join(built.postings, ["bucket", "token"])
    near.collect()
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "dynamicpruningexpression" in plan


def test_an_updated_index_equals_a_rebuilt_one(spark, tmp_path):
    path = str(tmp_path)
    old = made(spark, 40)
    new = made(spark, 45, lambda k: f"alpha beta number{k} next.js" if k % 4 else f"gamma number{k}").where("chunk_id != 3")
    index.write_index(old, path, "old", 4, n_blocks=2)
    index.update_index(spark, path, "old", "new", new)
    index.write_index(new, path, "whole", 4, n_blocks=2)
    a, b = index.read_index(spark, path, "new"), index.read_index(spark, path, "whole")
    for x, y in zip(a, b):
        same(x, y)
    changes = {(r.chunk_id, r.change) for r in index.field_changes(old, new).collect()}
    assert changes == {(3, "removed")} | {(k, "changed") for k in range(0, 40, 4)} | {(k, "added") for k in range(40, 45)}
    with pytest.raises(ValueError):
        index.update_index(spark, path, "none", "x", new)


def corpus(spark, n=600):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    strong = "rare1 rare2 rare3 rare4 rare5 rare6"
    rows = []
    for i in range(n):
        body = " ".join(rng.choice(words) for _ in range(30))
        rows.append((i, i, None, "go", "best1" if i % 30 == 0 else "t", f"{strong} best1 {body}" if i % 60 == 0 else body))
    asked = [(1, f"{strong} w1 w2", 10.0), (6, "best1 " + " ".join(words[:12]), 9.0), (2, "w3 w4 w5", 20.0), (3, "rare1", 3.0), (4, "absent", 5.0), (5, "w1 w2", 20.0)]
    return rows, spark.createDataFrame(asked, "question_id long, text string, limit double")


def test_bounds_give_the_first_ranks_of_all(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 8)
    rows, questions = corpus(spark)
    built = ranking.build_index(chunk(spark, rows))
    args = (questions, built, dims.stopwords(spark), dims.aliases(spark))
    whole = ranking.score_questions(*args)
    every = whole["ranked"].cache()
    some = ranking.best_scored(ranking.prepare(*args), built, first=8, lead=14).cache()
    key = ["question_id", "rank", "chunk_id", "score"]
    same(ranking.ranked(some).where("rank <= 8").select(key), every.where("rank <= 8").select(key))
    n, all_of = some.where("question_id = 6").count(), every.where("question_id = 6").count()
    assert 8 <= n < all_of / 4, (n, all_of)
    bounds = ranking.block_bounds(whole["terms"], built.blocks)
    blocks = F.pmod(F.xxhash64("chunk_id"), F.lit(75)).cast("int")
    over = every.withColumn("block", blocks).join(bounds, ["question_id", "block"]).where("score > most")
    assert over.count() == 0


def test_questions_that_the_first_ranks_do_not_fill(spark):
    """A question whose best candidates are copies of one text goes on to its end."""
    rows, questions = corpus(spark, 120)
    copies = [(1000 + k, 1000 + k, None, "go", "same", "rare1 rare2 rare3 rare4 rare5 rare6 " + " ".join(f"c{j}" for j in range(30)) + (f" x{k}" if k % 2 else "")) for k in range(80)]
    built = ranking.build_index(chunk(spark, rows + copies))
    args = (questions, built, dims.stopwords(spark), dims.aliases(spark))
    whole = ranking.score_questions(*args)
    want = {(r.question_id, r.rank, r.chunk_id) for r in ranking.suppress_duplicates(whole["scored"], built.fields, 10_000).collect()}
    got, _ = ranking.retrieve(*args, first=20)
    assert {(r.question_id, r.rank, r.chunk_id) for r in got.collect()} == want
    assert sum(q == 1 for q, _, _ in want) > 1


def test_shards_and_parts_give_what_the_gates_pass(spark):
    """Whatever shards and parts questions and chunks fall into; with filters, aliases and a phrase that only one chunk has."""
    rows, questions = corpus(spark, 120)
    asked = [(7, "w1 w2 w3", 5.0, "go"), (8, "w1 w2 w3", 5.0, "none"), (9, rows[7][5][:30], 3.0, None), (10, "@w1.w2 node.js", 3.0, None)]
    kind = "question_id long, text string, limit double, category string"
    questions = questions.selectExpr("*", "CAST(NULL AS STRING) AS category").unionByName(spark.createDataFrame(asked, kind))
    built = ranking.build_index(chunk(spark, rows))
    made = ranking.prepare(questions, built, dims.stopwords(spark), dims.aliases(spark))
    want = ranking.gated(ranking.candidates(made["terms"], built.postings, made["wanted"]), made["weights"])
    rounded = lambda t: t.withColumns({c: F.round(c, 9) for c in ("partial", "coverage")}).cache()
    got, want = rounded(ranking.shard_scores(made, built, shard=50, part=4)), rounded(want)
    same(got, want)
    assert want.count() > 100
    key = ["question_id", "rank", "chunk_id", "score"]
    whole, some = (ranking.ranked(ranking.scored(t, made["wanted"], made["tokens"], built.fields)).where("rank <= 5").select(key) for t in (want, ranking.shard_scores(made, built, 5, shard=50, part=4)))
    same(some, whole)


def test_rows_of_tokens_move_without_hashes(spark, monkeypatch):
    """Near duplicates are found by numbers of bodies; pairs come back by their hashes, the smaller first."""
    words = [f"v{k}" for k in range(60)]
    body = lambda k: " ".join([*words, *(f"only{k}n{j}" for j in range(40 if k > 3 else 0)), f"x{k}"])
    kept = []
    monkeypatch.setattr(ranking, "cut", lambda df: kept.append(df.columns) or df)
    pairs = {tuple(r) for r in ranking.near_duplicate_classes(made(spark, 6, body)).collect()}
    hashes = sorted(r.body_hash for r in made(spark, 4, body).select("body_hash").collect())
    assert pairs == {(a, b) for a in hashes for b in hashes if a < b}
    assert len(kept) == 1 and "body_hash" not in kept[0]


def test_tokens_of_a_chunk_meet_where_they_are(spark):
    """Fields move once, by chunk; the rows of their tokens don't move."""
    found = index.postings(made(spark))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_COL" in plan, plan
    assert found.where("token = 'number7' AND tf_body = 1 AND chunk_id = 7").count() == 1


def moved(spark, action):
    """Bytes that an action writes for shuffles."""
    context = spark.sparkContext._jsc.sc()

    def so_far():
        context.listenerBus().waitUntilEmpty(30_000)
        return context.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = so_far()
    action()
    return so_far() - before


def test_postings_are_not_copied_for_parts_of_the_questions(spark):
    """What scoring moves doesn't grow with the number of parts and shards, and the rows stay the same."""
    rows, questions = corpus(spark, 1200)
    built = ranking.build_index(chunk(spark, rows))
    made = ranking.prepare(questions, built, dims.stopwords(spark), dims.aliases(spark))
    got = {}

    def score(part, shard):
        made_rows = ranking.shard_scores(made, built, part=part, shard=shard)
        got[part] = {(r.question_id, r.chunk_id, tuple(r.matched_terms), round(r.coverage, 9)) for r in made_rows.collect()}

    one, many = moved(spark, lambda: score(100, 5000)), moved(spark, lambda: score(1, 300))
    assert got[1] == got[100] and len(got[1]) > 100
    assert many < 1.5 * one, (one, many)


def test_ranked_rows_move_without_tokens_unless_another_body_is_near(spark):
    rng = random.Random(8)
    words = lambda n: " ".join(f"x{rng.randrange(10**9)}" for _ in range(n))
    bodies = [words(4000) for _ in range(8)]
    bodies += [f"{bodies[0]} more", bodies[1], words(5)]
    fields = index.index_fields(chunk(spark, [(k, k, None, "go", "t", b) for k, b in enumerate(bodies)])).cache()
    kinds = "question_id long, chunk_id long, document_id long, section_id long, path string, chunk_order int, limit int, matched_terms array<string>, score double"
    rows = spark.createDataFrame([(q, k, k, None, f"p{k}", 0, 20, ["t"], 1.0 / (k + 1)) for q in range(40) for k in range(11) if q or k in (0, 8)], kinds)
    scored = rows.join(fields.select("chunk_id", "body_hash", (F.col("body_text") == "").alias("body_empty")), "chunk_id").cache()
    assert scored.count() and fields.count()
    got = {}

    def walk():
        got.update({(r.question_id, r.chunk_id): r.rank for r in ranking.suppress_duplicates(scored, fields, 60).collect()})

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = moved(spark, walk)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {k for q, k in got if q == 7} == {0, 1, 2, 3, 4, 5, 6, 7, 10} and {k for q, k in got if q == 0} == {0}
    assert n < 40 * 11 * 4000 * 8 / 3, n


def test_sets_that_are_near_share_a_signature(spark):
    """At the edges of the classes of sizes, and as different as near sets may be."""
    rng = random.Random(3)
    rows = []
    for n in [20, 21, 22, 39, 40, 41, 100, 379, 400, 401, 2000]:
        own = [rng.randrange(-(2**63), 2**63) for _ in range(n)]
        for less in (0, n // 40, n // 20):
            for more in range(0, n // 20 + 1, max(1, n // 60)):
                other = own[less:] + [rng.randrange(-(2**63), 2**63) for _ in range(more)]
                if (n - less) / (n + more) >= 0.95 and len(other) >= 20:
                    rows.append((own, rng.sample(other, len(other))))
    rows.append(([1] * 5, [2] * 5))
    table = spark.createDataFrame(rows, "a array<long>, b array<long>").repartition(3)
    got = table.select("*", ranking.signatures(F.col("a")).alias("x"), ranking.signatures(F.col("b")).alias("y")).collect()
    assert len(got) > 40 and all(set(r.x) & set(r.y) for r in got if len(r.a) > 5)
    assert all(r.x == r.y == [] for r in got if len(r.a) == 5)
    distinct = [tuple(r.x) for r in got if len(r.a) > 5]
    assert not set(got[0].x) & {s for r, x in zip(got, distinct) if set(r.a).isdisjoint(got[0].a) for s in r.x}


def test_contents_that_do_not_fit_are_not_moved(spark):
    rng = random.Random(5)
    long = [" ".join(str(rng.random()) for _ in range(3000)) for _ in range(10)]
    rows = [(q, k, k, "t", None, "https://x/", long[k] if k < 10 else f"short {k}") for q in range(5) for k in range(12)]
    matches = spark.createDataFrame(rows, "question_id long, rank int, chunk_id long, title string, heading string, published_url string, content string").cache()
    assert matches.count() == 60
    got = {}

    def pack():
        kept, contexts = evidence.pack_context(matches)
        got.update({(r.question_id, r.citation_index): r.chunk_id for r in kept.collect()})
        assert all(r.formatted.count('"content":"short') == 2 for r in contexts.collect())

    assert moved(spark, pack) < sum(map(len, long)) / 5
    assert got == {(q, n): 9 + n for q in range(5) for n in (1, 2)}


def test_families_of_near_bodies_over_several_blocks(spark, monkeypatch):
    """Chains and large groups of edited copies, equal bodies and sizes that differ, against all pairs."""
    monkeypatch.setattr(ranking, "TOGETHER", 4)
    rng, bodies = random.Random(6), []
    for size in (19, 20, 21, 40, 77, 300):
        own = [f"b{size}w{j}" for j in range(size)]
        for _ in range(14):
            bodies.append(" ".join(own))
            if rng.random() < 0.7:
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                own.append(f"n{rng.randrange(10**6)}")
        bodies += [" ".join(reversed(own)), bodies[-1], " ".join(own) + " " + "long" * size]
    fields = made(spark, len(bodies), lambda k: bodies[k])
    by_hash = {r.body_hash: r.body_text for r in fields.select("body_hash", "body_text").collect()}
    want = set()
    for a in by_hash:
        for b in by_hash:
            x, y, n, m = set(by_hash[a].split()), set(by_hash[b].split()), len(by_hash[a]), len(by_hash[b])
            if a < b and min(len(x), len(y)) >= 20 and min(n, m) >= max(n, m) * 0.85 and len(x & y) / len(x | y) >= 0.95:
                want.add((a, b))
    got = [tuple(r) for r in ranking.near_duplicate_classes(fields).collect()]
    assert set(got) == want and len(got) == len(want) > 60


def test_near_duplicates_move_bodies_and_not_rows_of_tokens(spark):
    rng = random.Random(7)
    family = [f"f{rng.randrange(10**9)}" for _ in range(400)]
    bodies = [" ".join(f"x{rng.randrange(10**9)}" for _ in range(400)) for _ in range(60)] + [" ".join([*family, f"y{k}"]) for k in range(60)]
    fields = made(spark, 120, lambda k: bodies[k]).cache()
    assert fields.count() == 120
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = []
        n = moved(spark, lambda: got.extend(ranking.near_duplicate_classes(fields).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 60 * 59 // 2
    assert n < 2 * sum(map(len, bodies)), (n, sum(map(len, bodies)))

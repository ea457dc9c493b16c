import numpy as np
from pyspark.sql import functions as F

from docweave.llm import toxicity as tx
from docweave.llm.queries import op9_toxicity

SF = "/root/testdata/sf0.01"


def small():
    words = ["alpha", "beta", "gamma", "delta", "é"]
    net = tx.Network.fresh(words[:3], np.array([0.5, -0.5, 0.1], np.float32))
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 5, (6, 4))
    mask = np.ones((6, 4), bool)
    mask[4:, 1] = mask[1:, 2] = mask[:, 3] = False
    return net, words, rows, mask


def test_gradient_matches_differences():
    net, words, rows, mask = small()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    label, x = np.array([1.0, 0.0, 1.0, 0.0]), net.inputs(words).astype(float)
    _, g, d_x = net.gradient(x, rows, mask, label)

    def loss():
        logits = net.run(net.gates(x), rows, mask)
        return float(np.mean(np.logaddexp(0, logits) - label * logits))

    for name in ("Wf", "Ub", "bf", "Wa", "va", "wo", "bo"):
        value, flat = net.p[name], net.p[name].reshape(-1)
        k = len(flat) // 2
        old = flat[k]
        flat[k] = old + 1e-2
        up = loss()
        flat[k] = old - 1e-2
        down = loss()
        flat[k] = old
        assert abs((up - down) / 2e-2 - g[name].reshape(-1)[k]) < 2e-3, name
        assert value.shape == g[name].shape
    x[1, 3] += 1e-2
    up = loss()
    x[1, 3] -= 2e-2
    down = loss()
    assert abs((up - down) / 2e-2 - d_x[1, 3]) < 2e-3


def test_windows_cover_every_word():
    for n in range(0, 200):
        starts = tx.windows(n)
        covered = {k for s in starts for k in range(s, min(n, s + tx.WINDOW))}
        assert covered == set(range(n)) and len(starts) >= 1


def test_scores_do_not_depend_on_batches():
    net, *_ = small()
    texts = ["alpha beta " * 3000, "", None, "gamma", "delta é " * 17]
    together = tx.Scorer(net, chunk=50).scores(texts)
    assert np.allclose(together, [tx.Scorer(net).scores([t])[0] for t in texts], atol=1e-5)
    one = tx.Scorer(net)
    words = tx.words_of(texts[0])
    best = max(one.scores([" ".join(words[s : s + tx.WINDOW])])[0] for s in tx.windows(len(words)))
    assert abs(best - together[0]) < 1e-5


def test_held_out_documents(spark):
    rows = op9_toxicity(spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [(labels[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    yes, no = [s for y, s, _ in held if y], [s for y, s, _ in held if not y]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in yes for b in no])
    assert auc > 0.8
    assert np.mean([p == y for y, _, p in held]) > 0.9


def test_cases(spark):
    docs = spark.createDataFrame([(k, "vile words here" if k % 2 else "kind words here", 0.5) for k in range(40)] + [(100, None, None), (101, "", None), (0, "kind words here", 0.1)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, k % 2, "x") for k in range(40)] + [(None, 1, "x"), (3, None, "x"), (4, 7, None), (1, 1, "x")], "doc_id long, toxic int, text string")
    net = tx.learn(docs, labels)
    got = {r.doc_id: r.s for r in docs.select("doc_id", tx.score(F.col("text"), net).alias("s")).collect()}
    assert min(got[k] for k in range(1, 40, 2)) > max(got[k] for k in range(0, 40, 2))
    assert 0 <= got[100] == got[101] <= 1
    assert tx.learn(docs, labels.where("toxic = 1")) is None
    assert docs.limit(0).select(tx.score(F.col("text"), net)).count() == 0


def test_forward_pass_number_by_number():
    """Gates, states, attention and score of each window in plain Python."""
    import math

    net, words, rows, mask = small()
    rng = np.random.default_rng(9)
    net.p = {k: v + rng.standard_normal(v.shape).astype(np.float32) * 0.1 for k, v in net.p.items()}
    x = net.inputs(words)
    got = net.run(net.gates(x), rows, mask)
    p = {k: v.astype(float) for k, v in net.p.items()}
    squash = lambda v: 1 / (1 + math.exp(-v))
    n = tx.STATE

    def states(way, seen):
        h, out = [0.0] * n, {}
        for t in seen if way == "f" else reversed(seen):
            v, w, u, b = x[rows[t, k]], p[f"W{way}"], p[f"U{way}"], p[f"b{way}"]
            gate = [sum(v[i] * w[i, j] for i in range(len(v))) + b[j] for j in range(3 * n)]
            back = [sum(h[i] * u[i, j] for i in range(n)) for j in range(3 * n)]
            z = [squash(gate[j] + back[j]) for j in range(n)]
            r = [squash(gate[n + j] + back[n + j]) for j in range(n)]
            c = [math.tanh(gate[2 * n + j] + r[j] * back[2 * n + j]) for j in range(n)]
            h = [c[j] + z[j] * (h[j] - c[j]) for j in range(n)]
            out[t] = h
        return out

    for k in range(rows.shape[1]):
        seen = [t for t in range(len(rows)) if mask[t, k]]
        one, two = states("f", seen), states("b", seen)
        both = {t: one[t] + two[t] for t in seen}
        e = {t: sum(math.tanh(sum(both[t][i] * p["Wa"][i, a] for i in range(2 * n)) + p["ba"][a]) * p["va"][a] for a in range(tx.ATTEND)) for t in seen}
        top = sum(math.exp(v) for v in e.values())
        pooled = [sum(math.exp(e[t]) / top * both[t][i] for t in seen) for i in range(2 * n)]
        assert abs(sum(pooled[i] * p["wo"][i] for i in range(2 * n)) + p["bo"][0] - got[k]) < 1e-4


def test_inputs_word_by_word():
    net, words, *_ = small()
    for word, got in zip(words, net.inputs(words)):
        marked = "\x02" + word + "\x03"
        parts = []
        for a, b, c in zip(marked, marked[1:], marked[2:]):
            h = ((ord(a) * 0x01000193 + ord(b)) * 0x01000193 + ord(c)) % (1 << 32)
            parts.append(net.p["char"][((h ^ h >> 15) * 0x9E3779B1 % (1 << 32)) >> 21])
        want = np.concatenate([net.p["word"][net.vocabulary.get(word, 0)], np.mean(parts, axis=0)])
        assert np.allclose(got, want, atol=1e-6)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert tx.learn(docs, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert tx.learn(docs.limit(0), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")) is None
    assert docs.select(tx.score(F.col("text"), None).alias("s")).first().s == 0.0

"""Toxicity of a text: a bidirectional gated recurrent network with attention pooling.

Each word enters as its own vector (words that the training texts show often enough to
matter) beside the mean of its hashed character trigrams.  Two gated recurrent layers
read a window of words from either end, attention pools their states, and a logistic
unit gives the window's score.  A text's score is the greatest over all its windows,
which overlap by half and cover every word.

The network is trained in numpy on a bounded sample of labelled rows: at most
``sample`` rows, half of each label, of at most ``longest`` characters, chosen by a hash
of the id.  A text is learned through its window with the greatest score so far.

Defined cases: null and empty texts get the score of an empty window; labels that are
null or other than 0 and 1, and null ids, are not learned from; repeated rows are learned
as often as they occur; with one label or none to learn from every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.wordcache import forget, give_back

STATE, PART, ATTEND = 8, 8, 8
TRIGRAMS = 1 << 11
WINDOW, STRIDE = 32, 16
EDGES = ".,;:!?\"'()[]{}<>*#%&$|-_`~/\\+="
#: Epochs before which the window to learn from is chosen anew.
RECHOOSE = {1, 2, 4, 7, 11, 16, 24, 36, 50}
WORDS_KEPT = 100_000
#: From this score on a text counts as toxic.
TOXIC = 0.7


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of all words, with the place where each word's begin."""
    joined = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(w) + 2 for w in words])
    h = (joined[:-2] * np.uint32(0x01000193) + joined[1:-1]) * np.uint32(0x01000193) + joined[2:]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
    keep = np.ones(len(joined), bool)
    keep[ends - 1] = keep[ends - 2] = False  # trigrams within one word only
    starts = np.concatenate([[0], ends[:-1]]) - 2 * np.arange(len(words))
    return (h >> np.uint32(21)).astype(np.int64)[keep[:-2]], starts


def windows(n: int) -> np.ndarray:
    """Starts of the windows over ``n`` words; the last reaches the end."""
    return np.arange(0, max(1, n - STRIDE), STRIDE)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


@dataclass
class Network:
    vocabulary: dict[str, int]  # from 1; 0 stands for every other word
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, words: list[str], odds: np.ndarray, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        own = draw(len(words) + 1, PART, scale=0.05)
        own[0] = 0
        own[1:, 0] = odds
        p = {"word": own, "char": draw(TRIGRAMS, PART, scale=0.1)}
        for way in "fb":
            p |= {f"W{way}": draw(2 * PART, 3 * STATE, scale=0.3), f"U{way}": draw(STATE, 3 * STATE, scale=0.3), f"b{way}": np.zeros(3 * STATE, np.float32)}
        p |= {"Wa": draw(2 * STATE, ATTEND, scale=0.3), "ba": np.zeros(ATTEND, np.float32), "va": draw(ATTEND, scale=0.5)}
        p |= {"wo": draw(2 * STATE, scale=0.3), "bo": np.zeros(1, np.float32)}
        return cls({w: k + 1 for k, w in enumerate(words)}, p)

    def inputs(self, words: list[str]) -> np.ndarray:
        """The input vector of each word."""
        bare = [w.strip(EDGES) or w for w in words]
        grams, starts = trigrams(bare)
        mean = np.add.reduceat(self.p["char"][grams], starts, axis=0) / np.diff(np.append(starts, len(grams)))[:, None]
        own = self.p["word"][[self.vocabulary.get(w, 0) for w in bare]]
        return np.concatenate([own, mean.astype(np.float32)], axis=1)

    def run(self, inputs: dict[str, np.ndarray], rows: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows.  inputs: each word's part of the gates, by direction; rows: time by window."""
        p, (steps, n) = self.p, rows.shape
        states = np.empty((steps, n, 2 * STATE), np.float32)
        for way in "fb":
            h, u, log = np.zeros((n, STATE), np.float32), p[f"U{way}"], []
            lo = 0 if way == "f" else STATE
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                a, g = inputs[way][rows[t]], h @ u
                zr = sigmoid(a[:, : 2 * STATE] + g[:, : 2 * STATE])
                z, r, gn = zr[:, :STATE], zr[:, STATE:], g[:, 2 * STATE :]
                c = 2.0 * sigmoid(2.0 * (a[:, 2 * STATE :] + r * gn)) - 1.0
                new = c + z * (h - c)
                if keep is not None:
                    log.append((t, h, z, r, c, gn))
                m = mask[t]
                h = new if m.all() else np.where(m[:, None], new, h)
                states[t, :, lo : lo + STATE] = h
            if keep is not None:
                keep[way] = log
        hidden = 2.0 * sigmoid(2.0 * (states @ p["Wa"] + p["ba"])) - 1.0
        e = np.where(mask, hidden @ p["va"], -30.0)
        e = np.exp(e - e.max(axis=0)) * mask
        weight = e / np.maximum(e.sum(axis=0), 1e-9)
        pooled = (weight[:, :, None] * states).sum(axis=0)
        if keep is not None:
            keep |= {"states": states, "hidden": hidden, "weight": weight, "pooled": pooled}
        return pooled @ p["wo"] + p["bo"]

    def gates(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {way: x @ self.p[f"W{way}"] + self.p[f"b{way}"] for way in "fb"}

    def gradient(self, x: np.ndarray, rows: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Mean log loss, its gradient, and the gradient of each input vector."""
        p, kept = self.p, {}
        logits = self.run(self.gates(x), rows, mask, kept)
        steps, n = rows.shape
        loss = float(np.mean(np.logaddexp(0, logits) - label * logits))
        d = ((sigmoid(logits) - label) / n).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "char")}
        states, hidden, weight, pooled = (kept[k] for k in ("states", "hidden", "weight", "pooled"))
        g["wo"], g["bo"] = pooled.T @ d, np.array([d.sum()], np.float32)
        d_pooled = d[:, None] * p["wo"]
        d_states = weight[:, :, None] * d_pooled
        d_weight = (states * d_pooled).sum(axis=2)
        d_e = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["va"] = np.einsum("tn,tna->a", d_e, hidden)
        d_hidden = d_e[:, :, None] * p["va"] * (1 - hidden**2)
        g["Wa"], g["ba"] = np.einsum("tns,tna->sa", states, d_hidden), d_hidden.sum(axis=(0, 1))
        d_states = d_states + d_hidden @ p["Wa"].T
        d_x = np.zeros_like(x)
        for way in "fb":
            lo, u, w = (0 if way == "f" else STATE), p[f"U{way}"], p[f"W{way}"]
            dh, d_rows = np.zeros((n, STATE), np.float32), np.zeros((steps, n, 3 * STATE), np.float32)
            for t, h, z, r, c, gn in reversed(kept[way]):
                dh = dh + d_states[t, :, lo : lo + STATE]
                m = mask[t][:, None]
                dn = dh * m
                dc = dn * (1 - z) * (1 - c**2)
                dz = dn * (h - c) * z * (1 - z)
                dr = dc * gn * r * (1 - r)
                d_rows[t] = np.concatenate([dz, dr, dc], axis=1)
                du = np.concatenate([dz, dr, dc * r], axis=1)
                g[f"U{way}"] += h.T @ du
                dh = dn * z + dh * ~m + du @ u.T
            flat, at = d_rows.reshape(-1, 3 * STATE), rows.reshape(-1)
            by_word = np.zeros((len(x), 3 * STATE), np.float32)
            np.add.at(by_word, at, flat)
            g[f"W{way}"], g[f"b{way}"] = x.T @ by_word, by_word.sum(axis=0)
            d_x += by_word @ w.T
        return loss, g, d_x


@dataclass
class Adam:
    rate: float = 0.01
    first: dict = field(default_factory=dict)
    second: dict = field(default_factory=dict)
    steps: int = 0

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.steps += 1
        for k, v in g.items():
            m = self.first[k] = 0.9 * self.first.get(k, 0) + 0.1 * v
            s = self.second[k] = 0.999 * self.second.get(k, 0) + 0.001 * v * v
            p[k] -= self.rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.999**self.steps)) + 1e-8)


class Scorer:
    """Scores texts; remembers the gates of words within a bound."""

    def __init__(self, network: Network, chunk: int = 2048):
        self.network, self.chunk = network, chunk
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        size = 1024
        self.table = {way: np.zeros((size, 3 * STATE), np.float32) for way in "fb"}

    def rows(self, words: list[str]) -> np.ndarray:
        """Row of each word in the table; row 0 is for places past the end."""
        fresh = list({w for w in words if w not in self.row})
        if fresh:
            at = len(self.row) + 1
            for k, w in enumerate(fresh):
                self.row[w] = at + k
            made = self.network.gates(self.network.inputs(fresh))
            for way, table in self.table.items():
                if at + len(fresh) > len(table):
                    table = self.table[way] = np.concatenate([table, np.zeros((max(len(table), len(fresh)), 3 * STATE), np.float32)])
                table[at : at + len(fresh)] = made[way]
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.full(len(texts), -np.inf)
        waiting: list[tuple[int, np.ndarray, np.ndarray]] = []  # text, rows by window, mask
        count = 0

        def flush() -> None:
            nonlocal count
            if not waiting:
                return
            of = np.concatenate([np.full(len(r), k) for k, r, _ in waiting])
            r, m = (np.concatenate([w[j] for w in waiting]) for j in (1, 2))
            for lo in range(0, len(of), self.chunk):
                part = slice(lo, lo + self.chunk)
                logits = self.network.run(self.table, np.ascontiguousarray(r[part].T), np.ascontiguousarray(m[part].T))
                np.maximum.at(out, of[part], logits)
            waiting.clear()
            count = 0

        with np.errstate(over="ignore"):
            for k, text in enumerate(texts):
                words = words_of(text)
                own = self.rows(words)
                starts = windows(len(words))
                for lo in range(0, len(starts), self.chunk):  # a very long text in parts
                    at = starts[lo : lo + self.chunk, None] + np.arange(WINDOW)
                    inside = at < len(words)
                    waiting.append((k, np.where(inside, own[np.minimum(at, len(words) - 1)] if len(words) else 0, 0), inside))
                    count += len(at)
                    if count >= self.chunk:
                        flush()
                if len(self.row) > WORDS_KEPT:
                    flush()
                    self.forget()
            flush()
            return sigmoid(out)


def telling_words(docs: list[set[str]], labels: np.ndarray, most: int = 4096, sure: float = 4.0) -> tuple[list[str], np.ndarray]:
    """Words whose documents are of one label beyond chance, then the most frequent; and their scaled log odds."""
    seen: dict[str, list[int]] = {}
    for own, label in zip(docs, labels):
        for w in own:
            seen.setdefault(w, [0, 0])[int(label)] += 1
    base = labels.mean()
    rated = []
    for w, (no, yes) in seen.items():
        n = no + yes
        if n >= 4:
            z = (yes - n * base) / np.sqrt(n * base * (1 - base))
            rated.append((int(abs(z) >= sure), abs(z) if abs(z) >= sure else n, w, np.log((yes + 0.5) / (no + 0.5) * (1 - base) / base) if abs(z) >= sure else 0.0))
    rated.sort(key=lambda x: (-x[0], -x[1], x[2]))
    return [x[2] for x in rated[:most]], np.array([x[3] / 3 for x in rated[:most]], np.float32)


def fit(texts: list[str], labels: np.ndarray, batch: int = 64, seed: int = 7, decay: float = 1e-3) -> Network | None:
    if not 0 < labels.sum() < len(labels):
        return None
    rng = np.random.default_rng(seed)
    said = [words_of(t) for t in texts]
    names, odds = telling_words([{w.strip(EDGES) or w for w in s} for s in said], labels)
    net, adam = Network.fresh(names, odds, seed), Adam()
    lean = dict(zip(names, odds))
    chosen = []  # of each text the window to learn from: first the one whose words lean most
    for s in said:
        sums = np.concatenate([[0], np.cumsum([lean.get(w.strip(EDGES), 0.0) for w in s])])
        starts = windows(len(s))
        chosen.append(starts[np.argmax(sums[np.minimum(starts + WINDOW, len(s))] - sums[starts])])
    clean = [k for k in range(len(said)) if not labels[k]]
    others = 1 if len(said) > 1000 else 3  # random windows of each clean text
    epochs = int(np.clip(45_000 // (len(said) + others * len(clean)), 8, 60))
    for epoch in range(epochs):
        if epoch in RECHOOSE:
            chosen = best_windows(net, said)
        adam.rate = 0.01 * (1 - epoch / epochs) + 0.0005
        # Every window of a clean text is clean: learn from the worst and from others at random.
        jobs = [(k, chosen[k]) for k in range(len(said))]
        jobs += [(k, rng.choice(windows(len(said[k])))) for k in clean for _ in range(others)]
        order = rng.permutation(len(jobs))
        for lo in range(0, len(order), batch):
            some = [jobs[j] for j in order[lo : lo + batch]]
            parts = [said[k][at : at + WINDOW] for k, at in some]
            learn_batch(net, adam, parts, labels[[k for k, _ in some]].astype(np.float32), decay)
    return net


def learn_batch(net: Network, adam: Adam, parts: list[list[str]], label: np.ndarray, decay: float = 0.0) -> float:
    words = sorted({w for part in parts for w in part}) or ["\x03"]
    row = {w: k for k, w in enumerate(words)}
    rows, mask = np.zeros((WINDOW, len(parts)), np.int64), np.zeros((WINDOW, len(parts)), bool)
    for k, part in enumerate(parts):
        rows[: len(part), k] = [row[w] for w in part]
        mask[: len(part), k] = True
    loss, g, d_x = net.gradient(net.inputs(words), rows, mask, label)
    bare = [w.strip(EDGES) or w for w in words]
    grams, starts = trigrams(bare)
    sizes = np.diff(np.append(starts, len(grams)))
    g["word"], g["char"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["char"])
    np.add.at(g["word"], [net.vocabulary.get(w, 0) for w in bare], d_x[:, :PART])
    g["word"][0] = 0
    np.add.at(g["char"], grams, np.repeat(d_x[:, PART:] / sizes[:, None], sizes, axis=0))
    for k in ("word", "char"):  # what is rarely seen stays near nothing
        g[k] += decay * net.p[k]
    adam.step(net.p, g)
    return loss


def best_windows(net: Network, said: list[list[str]]) -> list[int]:
    scorer, out = Scorer(net), []
    for lo in range(0, len(said), 64):
        some = said[lo : lo + 64]
        rows = [scorer.rows(s) for s in some]
        starts = [windows(len(s)) for s in some]
        at = [x[:, None] + np.arange(WINDOW) for x in starts]
        inside = [a < len(s) for a, s in zip(at, some)]
        where = [np.where(i, r[np.minimum(a, len(r) - 1)] if len(r) else 0, 0) for i, r, a in zip(inside, rows, at)]
        with np.errstate(over="ignore"):
            logits = net.run(scorer.table, np.ascontiguousarray(np.concatenate(where).T), np.ascontiguousarray(np.concatenate(inside).T))
        for x, own in zip(starts, np.split(logits, np.cumsum([len(x) for x in starts])[:-1])):
            out.append(int(x[np.argmax(own)]))
    return out


def learn(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = 4000,
    longest: int = 20_000,
) -> Network | None:
    """Train on at most ``sample`` rows, of at most ``longest`` characters each: labels joined to their texts."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("id IS NOT NULL")
    picked = [known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(sample // 2) for k in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= longest)
    rows = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "id").orderBy("id", "text").limit(sample).toArrow()
    return fit(rows.column("text").to_pylist(), np.array(rows.column("label").to_pylist(), float))


def score(text: Column, network: Network | None) -> Column:
    """The score of each text, from 0 to 1."""
    if network is None:
        return F.lit(0.0)
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(network)

    @F.arrow_udf("double")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        scorer = Scorer(shared.value)
        for texts in batches:
            out = [scorer.scores(texts[lo : lo + 256].to_pylist()) for lo in range(0, len(texts), 256)]
            yield pa.array(np.concatenate(out) if out else np.empty(0))
        del scorer
        give_back()

    return made(text)

"""Ranking whole tables of questions against the index.

A question table has question_id, text and, where questions are limited, limit, category,
framework and service (null: no filter).
"""

from __future__ import annotations

import functools
import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions.text import normalize_text, terms, tokens_of
from docweave.operators import index as ix
from docweave.session import cut, shared_folder, stored, stored_in_turn

# Weights and gates of the score.
SATURATION, LENGTH_PART = 1.2, 0.75
FIELD_BOOST = {"title": 2.4, "heading": 1.9, "path": 1.15, "class": 0.85}
PHRASE_BONUS = {"title": 2.4, "heading": 1.9, "body": 1.1}
COVERAGE_WEIGHT, LEAST_COVERAGE, LEAST_SCORE = 0.35, 0.4, 0.55
COMMON_RATIO, COMMON_FROM = 0.65, 10
#: What coverage and phrase can add to the sum of the tokens, and a margin for rounding.
MOST_BEYOND = COVERAGE_WEIGHT + max(PHRASE_BONUS.values()) + 1e-5
MOST_RESULTS = 20
#: Ranks that the first walk takes, and blocks that a question looks into first.
FIRST_RANKS, FIRST_BLOCKS = 60, 8
NEAR_TOKENS, NEAR_JACCARD, NEAR_LENGTH = 20, 0.95, 0.85


def question_terms(questions: DataFrame, stopwords: DataFrame, composed: bool = False) -> DataFrame:
    """Rows of question_id, group_no (its place) and term; stopwords left out, repeats kept."""
    each = questions.select("question_id", F.posexplode(terms(normalize_text(F.col("text"), composed))).alias("group_no", "term"))
    return each.join(stopwords, "term", "left_anti").select("question_id", "group_no", "term")


def expand_aliases(found: DataFrame, aliases: DataFrame, composed: bool = False) -> DataFrame:
    """Each term's group of tokens: its own, then those of its aliases, first seen first."""
    own = aliases.groupBy("term").agg(F.sort_array(F.collect_list(F.struct("place", "alias"))).alias("a"))
    own = own.select("term", F.transform("a", lambda x: normalize_text(x["alias"], True)).alias("said"))
    more = F.flatten(F.transform(F.coalesce("said", F.array().cast("array<string>")), tokens_of))
    return found.join(own, "term", "left").select(
        "question_id", "group_no", "term", F.array_distinct(F.concat(tokens_of(F.col("term")), more)).alias("tokens")
    )


def scoring_tokens(groups: DataFrame) -> DataFrame:
    """Rows of question_id, token and its first place; a token of several groups counts once."""
    each = groups.select("question_id", "group_no", F.posexplode("tokens").alias("at", "token"))
    return each.groupBy("question_id", "token").agg(F.min(F.struct("group_no", "at")).alias("pos"))


def with_idf(tokens: DataFrame, frequencies: DataFrame, stats: DataFrame) -> DataFrame:
    """Tokens of questions with df and idf; a token that no chunk has counts with df 0."""
    near = tokens.join(frequencies, "token", "left").join(F.broadcast(stats))
    df = F.coalesce("df", F.lit(0))
    more = [c for c in stats.columns if c == "buckets"]
    return near.select(tokens["*"], df.alias("df"), ix.idf(df, F.col("n_chunks")).alias("idf"), "n_chunks", "avg_body_len", *more)


def group_weights(groups: DataFrame, weighed: DataFrame) -> DataFrame:
    """Each question's groups with their weight (the greatest idf of their tokens), and the sum."""
    each = groups.select("question_id", "group_no", F.explode("tokens").alias("token"), "tokens")
    by_group = (
        each.join(weighed.select("question_id", "token", "idf"), ["question_id", "token"])
        .groupBy("question_id", "group_no")
        .agg(F.max("idf").alias("weight"), F.first("tokens").alias("tokens"))
    )
    own = by_group.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("group_no", "weight", "tokens"))).alias("groups"))
    return own.withColumn("total", F.aggregate("groups", F.lit(0.0), lambda s, g: s + g["weight"]))


def bm25(tf: Column, length: Column, mean: Column, weight: Column) -> Column:
    scaled = F.lit(1 - LENGTH_PART) + F.lit(LENGTH_PART) * (length / mean)
    return F.when(tf > 0, weight * (tf * F.lit(SATURATION + 1)) / (tf + F.lit(SATURATION) * scaled)).otherwise(F.lit(0.0))


def passes_filters(q: str = "q_") -> Column:
    """Category as it is; framework and service by their keys; an empty key never passes."""
    category = F.col(f"{q}category").isNull() | (F.col("category") == F.col(f"{q}category"))
    keys = [F.col(f"{q}{f}").isNull() | ((F.col(f"{q}{f}") != "") & (F.col(f"{f}_key") == F.col(f"{q}{f}"))) for f in ("framework", "service")]
    return F.coalesce(category & keys[0] & keys[1], F.lit(False))


def asked(questions: DataFrame, composed: bool = False) -> DataFrame:
    """Questions with their search form, filter keys and a limit from 0 to 20."""
    have = set(questions.columns)
    col = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    wish = F.coalesce(col("limit", "double").cast("double"), F.lit(0.0)) if "limit" in have else F.lit(10.0)
    limit = F.when(F.isnan(wish) | (wish <= 0) | (wish == float("inf")), F.lit(0)).otherwise(F.least(F.floor(wish), F.lit(MOST_RESULTS)))
    return questions.select(
        "question_id",
        normalize_text(F.col("text"), composed).alias("normal"),
        limit.cast("int").alias("limit"),
        col("category", "string").alias("q_category"),
        ix.filter_key(col("framework", "string"), True).alias("q_framework"),
        ix.filter_key(col("service", "string"), True).alias("q_service"),
    )


def gains(groups: DataFrame) -> DataFrame:
    """Of each question's tokens the summed weight of the groups that have it, and the sum of all its groups."""
    each = groups.select("question_id", "total", F.explode("groups").alias("g")).select("question_id", "total", F.explode("g.tokens").alias("token"), F.col("g.weight").alias("weight"))
    return each.groupBy("question_id", "token").agg(F.sum("weight").alias("gain"), F.first("total").alias("total"))


def impact(idf: Column) -> list[Column]:
    """What a token adds to a chunk's score, field by field; of a block's row the most that it can add."""
    parts = [bm25(F.col("tf_body"), F.col("body_len"), F.col("avg_body_len"), idf)]
    return parts + [F.when(F.col(f"in_{f}"), idf * F.lit(b)).otherwise(F.lit(0.0)) for f, b in FIELD_BOOST.items()]


def added(parts: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a + b, parts)


def block_bounds(terms: DataFrame, blocks: DataFrame) -> DataFrame:
    """For each question and block of chunks the most that a chunk of it can score, coverage and phrase included."""
    near = terms.join(blocks, ["bucket", "token"])
    return near.groupBy("question_id", "block").agg((F.sum(added(impact(F.col("idf")))) + MOST_BEYOND).alias("most"))


def candidates(terms: DataFrame, found: DataFrame, wanted: DataFrame, within: DataFrame | None = None, floor: DataFrame | None = None) -> DataFrame:
    """Question and chunk for the chunks that share tokens, pass the filters and may pass the gates, and their evidence.

    Terms meet postings on bucket and token: the buckets of the terms prune the scan; Catalyst broadcasts the
    terms while they are small and splits hot tokens otherwise.  Sums and maxima tell first which
    chunks can't pass a gate (what their tokens gain is at least what the groups cover) or stay below
    the question's ``floor`` (question_id, least score); only the others' hits are gathered, in the
    order of the question.  ``within`` are the only blocks to look into (question_id, block).
    """
    near = terms.join(found, ["bucket", "token"])
    if within is not None:
        near = near.join(within.select("question_id", "block"), ["question_id", "block"], "left_semi")
    near = near.join(wanted.select("question_id", "q_category", "q_framework", "q_service"), "question_id").where(passes_filters())
    local = (F.col("tf_body") > 0) | F.col("in_heading") | ((F.col("chunk_order") == 0) & (F.col("in_title") | F.col("in_path")))
    telling = F.col("df") / F.col("n_chunks") <= COMMON_RATIO
    parts = impact(F.col("idf"))
    light = near.groupBy("question_id", "chunk_id").agg(
        F.max(local).alias("local"), F.max(telling | (F.col("n_chunks") < COMMON_FROM)).alias("telling"), F.sum("gain").alias("gain"), F.max("total").alias("total"), F.sum(added(parts)).alias("sum")
    )
    light = light.where("local AND telling").where(F.col("gain") >= F.col("total") * (LEAST_COVERAGE - 1e-9))
    if floor is not None:
        light = light.join(floor, "question_id", "left").where(F.col("least").isNull() | (F.col("sum") + MOST_BEYOND >= F.col("least")))
    able = cut(light.select("question_id", "chunk_id"))
    hit = F.struct("pos", "token", F.array(*parts).alias("parts"), telling.alias("telling"))
    return near.join(able, ["question_id", "chunk_id"]).groupBy("question_id", "chunk_id", "chunk_order", "n_chunks").agg(
        F.sort_array(F.collect_list(hit)).alias("hits"), F.max(local).alias("local")
    )


def gated(found: DataFrame, groups: DataFrame) -> DataFrame:
    """Candidates that pass the local-evidence, discriminative and coverage gates, with their score so far."""
    rows = found.where("local").join(groups, "question_id")
    matched = F.transform("hits", lambda h: h["token"])
    score = F.aggregate(F.flatten(F.transform("hits", lambda h: h["parts"])), F.lit(0.0), lambda s, x: s + x)
    rows = rows.withColumn("matched_terms", matched).withColumn("partial", score)
    covered = F.aggregate("groups", F.lit(0.0), lambda s, g: s + F.when(F.arrays_overlap(g["tokens"], F.col("matched_terms")), g["weight"]).otherwise(F.lit(0.0)))
    rows = rows.withColumn("coverage", F.when(F.col("total") == 0, F.lit(0.0)).otherwise(covered / F.col("total")))
    telling = F.exists("hits", lambda h: h["telling"])
    return rows.where((F.col("coverage") >= LEAST_COVERAGE) & ((F.col("n_chunks") < COMMON_FROM) | telling)).select(
        "question_id", "chunk_id", "chunk_order", "matched_terms", "partial", "coverage"
    )


#: Chunks of a shard and tokens of their bodies at most, and questions of a part, about, that shards meet at a time.
SHARD, SHARD_TOKENS, PART = 8192, 4_000_000, 16384
#: Of a question's weight what the tokens may have that a shard is not searched for at first: the most common ones.
COMMON_WEIGHT = 0.2
#: Below this distance two scores may be equal once they are rounded.
ROUNDING = 2e-6


def number_of(token: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), token)


def telling_seed(tokens: DataFrame) -> int:
    """A seed by which no two tokens have the same number."""
    for seed in itertools.count():
        if tokens.groupBy(number_of(F.col("token"), seed)).agg(F.min("token").alias("a"), F.max("token").alias("b")).where("a != b").isEmpty():
            return seed


def in_file(table: pa.Table) -> bytes:
    """An Arrow table as compressed bytes."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def out_of_file(packed: bytes) -> pa.Table:
    return pa.ipc.open_stream(packed).read_all().combine_chunks()


def questions_in_rows(made: dict[str, DataFrame], seed: int) -> DataFrame:
    """One row a question: its filters, tokens by their numbers in order, and groups with weight.

    A group is inner if it is neither the first nor the last term of the question: a field that
    holds the question's whole text has these as whole terms.  Tokens that no chunk has are left out.
    """
    telling = (F.col("df") / F.col("n_chunks") <= COMMON_RATIO) | (F.col("n_chunks") < COMMON_FROM)
    hit = F.struct("pos", number_of(F.col("token"), seed).alias("tid"), telling.alias("telling"), "idf", "token")
    own = made["terms"].groupBy("question_id").agg(F.sort_array(F.collect_list(hit)).alias("hits"), F.first("total").alias("total"))
    last = made["wanted"].select("question_id", "q_category", "q_framework", "q_service", (F.size(terms(F.col("normal"))) - 1).alias("last"))
    several = made["tokens"].groupBy("question_id").agg(F.count(F.lit(1)).alias("n_tokens"))
    rows = last.join(own, "question_id").join(made["weights"].select("question_id", "groups"), "question_id").join(several, "question_id")
    inner = lambda g: (g["group_no"] > 0) & (g["group_no"] < F.col("last"))
    known = lambda g: F.transform(F.filter(g["tokens"], lambda t: F.array_contains("hits.token", t)), lambda t: number_of(t, seed))
    groups = F.filter(F.transform("groups", lambda g: F.struct(g["weight"].alias("weight"), inner(g).alias("inner"), known(g).alias("tids"))), lambda g: F.size(g["tids"]) > 0)
    return rows.select("question_id", "q_category", "q_framework", "q_service", "hits", "total", "n_tokens", groups.alias("groups"), F.size(F.filter("groups", inner)).alias("n_inner"))


class Part:
    """The questions of a part as arrays; tokens go by their places in ``tids``."""

    def __init__(self, rows: pa.Table):
        self.ids = rows["question_id"].combine_chunks()
        plain = rows.select(["q_category", "q_framework", "q_service", "total", "n_tokens", "n_inner"]).to_pylist()
        hits, groups = rows["hits"].combine_chunks(), rows["groups"].combine_chunks()
        self.tids, hit = np.unique(np.asarray(hits.values.field("tid")), return_inverse=True)
        inside = groups.values.field("tids")
        # a group's tokens are some of the question's, so all of them have a place
        held = np.searchsorted(self.tids, np.asarray(inside.values))
        telling, idf = hits.values.field("telling").to_numpy(zero_copy_only=False), np.asarray(hits.values.field("idf"))
        weight, inner = np.asarray(groups.values.field("weight")), groups.values.field("inner").to_numpy(zero_copy_only=False)
        h, g, t = (np.asarray(x.offsets) for x in (hits, groups, inside))
        self.questions = []
        for k, q in enumerate(plain):
            of_hits, of_groups = slice(h[k], h[k + 1]), slice(g[k], g[k + 1])
            starts = t[g[k] : g[k + 1] + 1]
            q |= {"at": hit[of_hits], "telling": telling[of_hits], "idf": idf[of_hits], "weight": weight[of_groups], "inner": inner[of_groups]}
            q["groups"] = starts[:-1] - starts[0]
            place = np.argsort(q["at"])
            tokens, sizes = held[starts[0] : starts[-1]], np.diff(starts)
            q["held"] = place[np.searchsorted(q["at"][place], tokens)]
            # the least weights together stay below what a chunk needs, so it has one of the others
            order = np.argsort(q["weight"], kind="stable")
            summed = np.cumsum(q["weight"][order])
            n = int(np.searchsorted(summed, COMMON_WEIGHT * q["total"], "right"))
            rare = np.ones(len(order), bool)
            rare[order[:n]] = False
            rare = np.repeat(rare, sizes)
            q["rare"], q["rare_weight"] = tokens[rare], np.repeat(q["weight"], sizes)[rare]
            q["need"] = LEAST_COVERAGE * q["total"] - (summed[n - 1] if n else 0.0) - 1e-9 * q["total"]
            self.questions.append(q)


class Shard:
    """The postings of a shard's chunks, by token and then place of the chunk."""

    def __init__(self, chunks: bytes, tokens: bytes, hits: bytes, part: Part, mean: float):
        self.chunks, found, rows = out_of_file(chunks), out_of_file(tokens), out_of_file(hits)
        self.n, self.mean = len(self.chunks), mean
        self.length = self.chunks["body_len"].to_numpy()
        self.first = self.chunks["chunk_order"].fill_null(-1).to_numpy() == 0
        tid, start = found["tid"].to_numpy(), np.append(found["start"].to_numpy(), len(rows))
        self.at, self.tf, self.flags = (rows[c].to_numpy() for c in ("at", "tf", "flags"))
        self.keys = np.repeat(np.arange(len(tid)) * self.n, np.diff(start)) + self.at
        # of each of the part's tokens its place here, or -1
        spot = np.minimum(np.searchsorted(tid, part.tids), len(tid) - 1)
        here = tid[spot] == part.tids
        self.spot = np.where(here, spot, -1)
        self.start, self.stop = np.where(here, start[spot], 0), np.where(here, start[spot + 1], 0)

    def passing(self, question: dict, chosen: np.ndarray) -> np.ndarray:
        """Which of the chunks pass the question's filters; an empty key never passes."""
        good = np.ones(len(chosen), bool)
        for name, column in (("q_category", "category"), ("q_framework", "framework_key"), ("q_service", "service_key")):
            if question[name] is not None:
                said = self.chunks[column].take(pa.array(chosen)).to_numpy()
                good &= (said == question[name]) & (name == "q_category" or question[name] != "")
        return good

    def postings_of(self, question: dict, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the question's tokens and the chosen chunks that have them the places of both, and of the posting."""
        a, b = self.start[question["at"]], self.stop[question["at"]]
        if len(a) * len(chosen) * 4 < (b - a).sum():
            asked = self.spot[question["at"]][:, None] * self.n + chosen
            found = np.searchsorted(self.keys, asked)
            found[found == len(self.keys)] = 0
            k, c = np.nonzero(self.keys[found] == asked)
            return k, c, found[k, c]
        mark = np.full(self.n, -1)
        mark[chosen] = np.arange(len(chosen))
        found = np.concatenate([np.arange(x, y) for x, y in zip(a, b)])
        c = mark[self.at[found]]
        keep = c >= 0
        return np.repeat(np.arange(len(a)), b - a)[keep], c[keep], found[keep]

    def added(self, idf: np.ndarray, found: np.ndarray) -> np.ndarray:
        """What postings add to the score, field by field."""
        tf, flags = self.tf[found], self.flags[found]
        scaled = (1 - LENGTH_PART) + LENGTH_PART * (self.length[self.at[found]] / self.mean) if self.mean else np.ones(len(found))
        own = np.where(tf > 0, idf * (tf * (SATURATION + 1)) / (tf + SATURATION * scaled), 0.0)
        for k, f in enumerate(ix.FIELDS):
            if k:
                own += np.where(flags & (1 << k), idf * FIELD_BOOST[f], 0.0)
        return own

    def score(self, question: dict, first: int | None) -> tuple | None:
        """Places, sums, coverages, bounds and matched tokens of the chunks that pass the gates; with ``first`` of those that may be among so many.

        Rare tokens come first: a chunk that they don't bring far enough fails the gate of coverage whatever common
        tokens it has, so only the others are looked at token by token.
        """
        a, b = self.start[question["rare"]], self.stop[question["rare"]]
        sizes = b - a
        if question["rare_weight"][sizes > 0].sum() < question["need"] or not question["total"]:
            return None
        lists = [self.at[x:y] for x, y in zip(a.tolist(), b.tolist()) if x < y]
        if not lists:
            return None
        chosen = np.flatnonzero(np.bincount(np.concatenate(lists), np.repeat(question["rare_weight"], sizes), self.n) >= question["need"])
        if not len(chosen):
            return None
        k, c, found = self.postings_of(question, chosen)
        has = np.zeros((len(question["at"]), len(chosen)), bool)
        has[k, c] = True
        grouped = np.logical_or.reduceat(has[question["held"]], question["groups"], axis=0)
        covered = (grouped * question["weight"][:, None]).sum(axis=0)
        flags, first_of_all = self.flags[found], self.first[self.at[found]]
        place = {f: 1 << n for n, f in enumerate(ix.FIELDS)}
        local = (self.tf[found] > 0) | (flags & place["heading"] > 0) | (first_of_all & (flags & (place["title"] | place["path"]) > 0))
        good = (covered / question["total"] >= LEAST_COVERAGE) & has[question["telling"]].any(axis=0)
        good &= np.bincount(c[local], minlength=len(chosen)) > 0
        if any(question[q] is not None for q in ("q_category", "q_framework", "q_service")):
            good &= self.passing(question, chosen)
        if not good.any():
            return None
        parts = np.zeros(has.shape)
        parts[k, c] = self.added(question["idf"][k], found)
        partial, coverage = parts.sum(axis=0)[good], (covered / question["total"])[good]
        least = partial + coverage * COVERAGE_WEIGHT
        most = least.copy()
        if question["n_tokens"] >= 2:
            whole = grouped[question["inner"]].sum(axis=0)[good] == question["n_inner"]
            most += np.where(whole, max(PHRASE_BONUS.values()), 0.0)
        chosen, has = chosen[good], has[:, good]
        if first is not None:
            sure = least[least >= LEAST_SCORE + ROUNDING]
            floor = np.partition(sure, -first)[-first] if len(sure) > first else LEAST_SCORE
            keep = most >= max(floor, LEAST_SCORE) - ROUNDING
            chosen, partial, coverage, least, most, has = (x[..., keep] for x in (chosen, partial, coverage, least, most, has))
        return chosen, partial, coverage, least, most, has.sum(axis=0), np.nonzero(has.T)[1]


def packed_shards(built: ix.Index, seed: int, shard: int = SHARD) -> DataFrame:
    """A row for each shard of chunks: facts of its chunks, tokens by number, and postings, each as one column of bytes.

    Chunks stay in the tasks that read them, so nothing is moved; a shard holds a bounded number of chunks and tokens.
    """
    numbers = lambda f: F.transform(tokens_of(F.col(f"{f}_text")), lambda t: number_of(t, seed)).alias(f)
    facts = ["chunk_id", "chunk_order", "category", "framework_key", "service_key", "body_len"]
    rows = built.fields.select(*facts, *map(numbers, ix.FIELDS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            k, size = np.arange(batch.num_rows), np.cumsum(batch["body_len"].to_numpy(zero_copy_only=False))
            ends = np.flatnonzero(np.diff(k // shard) | np.diff(size // SHARD_TOKENS)) + 1
            for a, b in itertools.pairwise([0, *ends.tolist(), batch.num_rows]):
                own = batch.slice(a, b - a)
                tids, at, field = [], [], []
                for n, f in enumerate(ix.FIELDS):
                    lengths = pc.fill_null(pc.list_value_length(own[f]), 0).to_numpy(zero_copy_only=False)
                    tids.append(own[f].flatten().to_numpy(zero_copy_only=False))
                    at.append(np.repeat(np.arange(own.num_rows, dtype=np.int32), lengths))
                    field.append(np.full(len(at[-1]), n, np.int8))
                tids, at, field = (np.concatenate(x) for x in (tids, at, field))
                order = np.lexsort((at, tids))
                tids, at, field = tids[order], at[order], field[order]
                fresh = np.append(True, tids[1:] != tids[:-1])[: len(tids)]
                begin = np.flatnonzero(fresh | np.append(True, at[1:] != at[:-1])[: len(tids)])
                tf = np.add.reduceat((field == 0).astype(np.int32), begin) if len(begin) else np.zeros(0, np.int32)
                flags = np.bitwise_or.reduceat(np.int8(1) << field, begin) if len(begin) else np.zeros(0, np.int8)
                yield pa.RecordBatch.from_pydict({
                    "chunks": [in_file(pa.Table.from_batches([own.select(facts)]))],
                    "tokens": [in_file(pa.table({"tid": tids[fresh], "start": np.flatnonzero(fresh[begin]).astype(np.int32)}))],
                    "hits": [in_file(pa.table({"at": at[begin], "tf": tf, "flags": flags}))],
                }, pa.schema([(c, pa.binary()) for c in ("chunks", "tokens", "hits")]))

    return rows.mapInArrow(pack, "chunks binary, tokens binary, hits binary")


def shard_scores(made: dict[str, DataFrame], built: ix.Index, first: int | None = None, shard: int = SHARD, part: int = PART, shards: tuple[int, DataFrame] | None = None) -> DataFrame:
    """Chunks that pass the gates of a question, as :func:`gated`; with ``first`` at least those of the first ranks.

    Chunks lie in shards and questions in parts of bounded size.  One part after the other is broadcast as one row and
    meets all shards where they lie, so neither postings nor questions are copied on disk whatever their numbers; the
    product of both is in time only.  What a part's questions get is cut to their first ranks before the next part begins.
    The phrase bonus, which needs texts, counts as possible only where all inner terms of the question are there.
    """
    spark = built.fields.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in [*made["wanted"].schema, *built.fields.schema]}
    seed, table = shards or stored_shards(made, built, shard)
    asks = stored(questions_in_rows(made, seed))
    n_parts, mean = 1 + asks.count() // part, built.stats.first()["avg_body_len"]
    dealt = asks.withColumn("hits", F.transform("hits", lambda h: F.struct(h["tid"].alias("tid"), h["telling"].alias("telling"), h["idf"].alias("idf"))))
    dealt = dealt.withColumn("qpart", F.pmod(F.xxhash64("question_id"), F.lit(n_parts)).cast("int"))

    def pack(questions: pa.Table) -> pa.Table:
        return pa.table({"qpart": questions["qpart"][:1], "questions": pa.array([in_file(questions.drop_columns(["qpart"]))], pa.binary())})

    parts = stored(dealt.groupBy("qpart").applyInArrow(pack, "qpart int, questions binary"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None
        for batch in batches:
            for row in range(batch.num_rows):
                if asked is None:  # the same in all rows of a job
                    asked = Part(out_of_file(batch["questions"][row].as_py()))
                own = Shard(*(batch[c][row].as_py() for c in ("chunks", "tokens", "hits")), asked, mean)
                at, asked_at, out = [], [], [[] for _ in range(6)]
                for k, question in enumerate(asked.questions):
                    got = own.score(question, first)
                    if got is not None:
                        at.append(got[0])
                        asked_at.append(np.full(len(got[0]), k))
                        for column, values in zip(out, got[1:]):
                            column.append(values)
                join = lambda columns, kind: np.concatenate(columns).astype(kind) if columns else np.zeros(0, kind)
                at = join(at, np.int64)
                offsets = np.concatenate([[0], np.cumsum(join(out[4], np.int64))]).astype(np.int32)
                columns = {
                    "question_id": asked.ids.take(pa.array(join(asked_at, np.int64))),
                    "chunk_id": own.chunks["chunk_id"].combine_chunks().take(pa.array(at)),
                    "chunk_order": own.chunks["chunk_order"].combine_chunks().take(pa.array(at)).cast(pa.int32()),
                    **{name: pa.array(join(x, np.float64)) for name, x in zip(("partial", "coverage", "least", "most"), out)},
                    "matched": pa.ListArray.from_arrays(pa.array(offsets), pa.array(join(out[5], np.int32))),
                }
                yield from pa.table(columns).to_batches(10_000)

    kind = f"question_id {kinds['question_id']}, chunk_id {kinds['chunk_id']}, chunk_order int, partial double, coverage double, least double, most double, matched array<int>"

    def scores(number: int) -> DataFrame:
        rows = table.crossJoin(F.broadcast(parts.where(F.col("qpart") == number).select("questions"))).mapInArrow(score, kind)
        if first is None:
            return rows
        rows = stored(rows)
        sure = rows.where(F.col("least") >= LEAST_SCORE + ROUNDING).select("question_id", "least")
        turn = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("least")))
        floor = sure.withColumn("_turn", turn).where(F.col("_turn") <= first).where(F.col("_turn") == first).select("question_id", F.col("least").alias("floor"))
        return rows.join(floor, "question_id", "left").where(F.col("floor").isNull() | (F.col("most") >= F.col("floor") - ROUNDING)).drop("floor")

    rows = stored_in_turn(spark, [functools.partial(scores, number) for number in range(n_parts)])
    named = rows.join(asks.select("question_id", F.col("hits.token").alias("_names")), "question_id")
    return named.select("question_id", "chunk_id", "chunk_order", F.transform("matched", lambda k: F.get("_names", k)).alias("matched_terms"), "partial", "coverage")


def stored_shards(made: dict[str, DataFrame], built: ix.Index, shard: int = SHARD) -> tuple[int, DataFrame]:
    """The shards of an index and the seed of their tokens' numbers, for several calls of :func:`shard_scores`."""
    seed = telling_seed(built.frequencies.select("token").unionByName(made["tokens"].select("token")))
    return seed, stored(packed_shards(built, seed, shard))


def scored(rows: DataFrame, wanted: DataFrame, tokens: DataFrame, fields: DataFrame) -> DataFrame:
    """Final scores: the coverage's part and the phrase bonus added; low scores left out."""
    several = tokens.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_tokens"))
    near = rows.join(wanted.join(several, "question_id"), "question_id").join(
        fields.select("chunk_id", "document_id", "section_id", "path", "title_text", "heading_text", "body_text", "body_hash"), "chunk_id"
    )
    bonus = F.lit(0.0)
    for f in ("body", "heading", "title"):
        bonus = F.when(F.contains(F.col(f"{f}_text"), F.col("normal")), F.lit(PHRASE_BONUS[f])).otherwise(bonus)
    whole = F.col("partial") + F.col("coverage") * COVERAGE_WEIGHT + F.when(F.col("n_tokens") >= 2, bonus).otherwise(F.lit(0.0))
    return (
        near.withColumn("whole", whole)
        .where(F.col("whole") >= LEAST_SCORE)
        .select(
            "question_id", "chunk_id", "document_id", "section_id", "path", "chunk_order", "limit", "matched_terms",
            F.round("whole", 6).alias("score"), "body_hash", (F.col("body_text") == "").alias("body_empty"),
        )
    )


def ranked(rows: DataFrame) -> DataFrame:
    """Adds rank.  A caller that keeps ranks up to a number lets Spark cut each question's rows before the shuffle."""
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "path", "chunk_order", "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order))


def top_k(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("rank") <= F.col("limit"))


def body_classes(fields: DataFrame) -> DataFrame:
    """One row for each distinct body of enough distinct tokens: its hash, its length, and these tokens as one text.

    Tokens are cut where the fields are made; only they are moved.
    """
    own = fields.select("body_hash", F.length("body_text").alias("chars"), F.array_distinct(tokens_of(F.col("body_text"))).alias("tokens"))
    own = own.select("body_hash", "chars", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("words"))
    return own.dropDuplicates(["body_hash"]).where(F.col("n") >= NEAR_TOKENS)


#: Sizes of sets that may be near enough lie in one class or in two that follow each other.
SIZE_STEP = 1.001 / NEAR_JACCARD


def signatures(numbers: Column) -> Column:
    """Of a set of numbers some signatures, at least one of which it shares with every set that is near enough; none of a small set.

    Two sets that are near enough differ in a bounded number of elements.  Dealt into one part more than that, at least
    one part is the same in both; a signature is the sum of a part.  The number of parts goes by the class of the
    set's size, and a set has those of its own class and of the next, as the other set may be of either.
    """

    @F.arrow_udf("array<long>")
    def dealt(sets: pa.Array) -> pa.Array:
        n = pc.fill_null(pc.list_value_length(sets), 0).to_numpy(zero_copy_only=False)
        values = sets.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        large = n >= NEAR_TOKENS
        level = np.floor(np.log(np.maximum(n, NEAR_TOKENS) / NEAR_TOKENS) / np.log(SIZE_STEP)).astype(np.int64)
        parts = [np.where(large, (2 * NEAR_TOKENS * SIZE_STEP ** (level + k + 1) * (1 - NEAR_JACCARD) / (1 + NEAR_JACCARD) + 1e-6).astype(np.int64) + 1, 0) for k in (0, 1)]
        offsets = np.concatenate([[0], np.cumsum(parts[0] + parts[1])])
        sums = np.zeros(offsets[-1], np.uint64)
        row = np.repeat(np.arange(len(n)), n)
        row, values = row[large[row]], values[large[row]]
        mixed = lambda x: (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        for k, begin in ((0, offsets[:-1]), (1, offsets[:-1] + parts[0])):
            np.add.at(sums, begin[row] + (values % np.maximum(parts[k], 1).astype(np.uint64)[row]).astype(np.int64), mixed(values))
            many = np.arange(parts[k].sum()) - np.repeat(np.cumsum(parts[k]) - parts[k], parts[k])
            name = np.repeat((level + k) << 32, parts[k]) + many
            sums[np.repeat(begin, parts[k]) + many] ^= mixed(mixed(name.astype(np.uint64) + np.uint64(1)))
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(sums.view(np.int64)))

    return dealt(numbers)


def near_bodies(ranks: DataFrame, fields: DataFrame) -> DataFrame:
    """chunk_id, chars and tokens (as numbers) of the ranked chunks whose body shares a signature with another body among them.

    The others have no near duplicate there, so they are compared by the hash of their body alone.
    """
    chosen = fields.join(ranks.select("chunk_id").distinct(), "chunk_id", "left_semi")
    sets = F.transform(F.array_distinct(tokens_of(F.col("body_text"))), lambda t: F.xxhash64(t))
    own = chosen.select("chunk_id", F.xxhash64("body_hash").alias("body"), F.length("body_text").alias("chars"), sets.alias("tokens"))
    own = stored(own.withColumn("signatures", signatures(F.col("tokens"))).where(F.size("signatures") > 0))
    each = own.select("chunk_id", "body", F.explode("signatures").alias("signature"))
    shared = each.groupBy("signature").agg(F.min("body").alias("a"), F.max("body").alias("b")).where("a < b")
    near = each.join(shared, "signature", "left_semi").select("chunk_id").distinct()
    return stored(own.select("chunk_id", "chars", "tokens").join(near, "chunk_id", "left_semi"))


def near_duplicate_classes(fields: DataFrame) -> DataFrame:
    """Pairs of distinct bodies that count as near duplicates, each once (a < b).

    Equal bodies are one class, so copies are never expanded into pairs.  Bodies meet on signatures of parts of
    their sets (:func:`signatures`): two sets that are near enough have the whole of a part in common, which others
    hardly do, whatever words they share.  Only signatures that several bodies have are paired, and pairs pass the
    filters of length before their sets are compared.  Until then a body goes by a number, as its hash would be most of what a row moves.
    """
    own = body_classes(fields).withColumns({"no": F.monotonically_increasing_id(), "signatures": signatures(F.transform(F.split("words", " "), lambda t: F.xxhash64(t)))})
    own = stored(own)
    each = own.select("no", "chars", "n", F.size("signatures").alias("_size"), F.posexplode("signatures").alias("_at", "signature"))
    # those of the set's own class come first; two sets that both have another as one of the next class share one of their own, too
    each = each.select("no", "chars", "n", "signature", (F.col("_at") < F.floor(F.col("_size") / 2)).alias("own"))
    several = each.groupBy("signature").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    lead = cut(each.join(several, "signature"))
    other = lead.select("signature", *(F.col(c).alias(f"b_{c}") for c in ("no", "chars", "n", "own")))
    near = lead.join(other, "signature").where((F.col("no") < F.col("b_no")) & (F.col("own") | F.col("b_own")))
    ratio = lambda a, b, least: F.least(a, b) >= F.greatest(a, b) * least
    near = near.where(ratio(F.col("chars"), F.col("b_chars"), NEAR_LENGTH) & ratio(F.col("n"), F.col("b_n"), NEAR_JACCARD))
    pairs = near.select(F.col("no").alias("x_no"), F.col("b_no").alias("y_no")).distinct()
    return compared(pairs, compared_in(lead), own.select("no", "body_hash", "words"))


#: Bodies of a block, about.
TOGETHER = 64


def compared_in(lead: DataFrame) -> DataFrame:
    """Number and block of each body of ``lead`` (no, signature, df); bodies with the same most common signature go together."""
    top = stored(lead.groupBy("no").agg(F.max(F.struct("df", "signature"))["signature"].alias("signature")))
    n_blocks = 1 + top.count() // TOGETHER
    sizes = top.groupBy("signature").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("n"))
    turn = F.pmod(F.xxhash64("no"), F.col("n"))
    return stored(top.join(sizes, "signature").select("no", F.pmod(F.xxhash64("signature", turn), F.lit(n_blocks)).cast("int").alias("block")))


def compared(pairs: DataFrame, blocks: DataFrame, bodies: DataFrame) -> DataFrame:
    """Of pairs of bodies (x_no, y_no) those whose sets are near enough, by their hashes.

    The pairs of two blocks are one group, which gets each of their bodies once, so the words of a body move once for
    each block that has others like it and not once for each of them.
    """
    x, y = (blocks.select(F.col("no").alias(f"{c}_no"), F.col("block").alias(f"_{c}")) for c in "xy")
    dealt = pairs.join(x, "x_no").join(y, "y_no")
    dealt = stored(dealt.select("x_no", "y_no", F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")))
    members = dealt.select(F.col("a").alias("p"), F.col("b").alias("q"), F.explode(F.array("x_no", "y_no")).alias("no")).distinct().join(bodies, "no")

    def compare(pairs: pa.Table, bodies: pa.Table) -> pa.Table:
        said = pc.split_pattern(bodies["words"].combine_chunks(), " ")
        codes = said.values.dictionary_encode()
        ends, codes, n = np.asarray(said.offsets), codes.indices.to_numpy(), len(codes.dictionary)
        sets = [codes[a:b] for a, b in itertools.pairwise(ends)]
        order = np.argsort(bodies["no"].to_numpy())
        x, y = (order[np.searchsorted(bodies["no"].to_numpy(), pairs[c].to_numpy(), sorter=order)] for c in ("x_no", "y_no"))
        kept, mark, last = [], np.zeros(n, bool), None
        for k in np.argsort(x, kind="stable").tolist():
            a, b = sets[x[k]], sets[y[k]]
            if x[k] != last:
                mark[:] = False
                mark[a] = True
                last = x[k]
            same = int(np.count_nonzero(mark[b]))
            if same / (len(a) + len(b) - same) >= NEAR_JACCARD:
                kept.append(k)
        a, b = (bodies["body_hash"].take(pa.array(c[kept])) for c in (x, y))
        return pa.table({"a": pc.min_element_wise(a, b), "b": pc.max_element_wise(a, b)})

    return dealt.groupBy("a", "b").cogroup(members.groupBy("p", "q")).applyInArrow(compare, "a string, b string")


ITEM = ["chunk_id", "document_id", "score", "matched_terms", "path", "chunk_order"]


class Kept:
    """The at most 20 candidates that a question has kept, and whether another one repeats one of them."""

    def __init__(self):
        self.rows: list = []

    def repeats(self, c) -> bool:
        return any(self.same(k, c) for k in self.rows)

    @staticmethod
    def same(k, c) -> bool:
        sections = k.section_id is not None and c.section_id is not None and k.section_id != c.section_id
        if k.document_id == c.document_id and sections:
            return False
        if c.body_hash == k.body_hash:
            return not c.body_empty
        n, m = len(k.tokens), len(c.tokens)
        if min(n, m) < NEAR_TOKENS or min(n, m) < max(n, m) * NEAR_JACCARD or min(k.chars, c.chars) < max(k.chars, c.chars) * NEAR_LENGTH:
            return False
        both = len(np.intersect1d(k.tokens, c.tokens, assume_unique=True))
        return both / (n + m - both) >= NEAR_JACCARD


def walk(ranks: DataFrame, bodies: DataFrame) -> DataFrame:
    """Each question's candidates in rank order, without those that repeat a kept one, until its limit.

    A question's rows reach one task sorted by rank and are read as a stream; the state is the rows kept so
    far, so memory doesn't grow with the candidates, and a full question skips the rest.  ``bodies`` are the
    :func:`near_bodies` of the ranks; rows of other chunks move without tokens.
    """
    rows = ranks.join(bodies, "chunk_id", "left").withColumns({"chars": F.coalesce("chars", F.lit(0)), "tokens": F.coalesce("tokens", F.array().cast("array<long>"))})
    kinds = dict(ranks.dtypes)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        question, kept = None, Kept()
        for frame in frames:
            frame["section_id"] = frame["section_id"].astype(object).where(frame["section_id"].notna(), None)
            out = []
            for c in frame.itertuples(index=False):
                if c.question_id != question:
                    question, kept = c.question_id, Kept()
                if len(kept.rows) < c.limit and not kept.repeats(c):
                    kept.rows.append(c)
                    out.append((c.question_id, len(kept.rows), *(getattr(c, f) for f in ITEM)))
            yield pd.DataFrame(out, columns=["question_id", "rank", *ITEM])

    dealt = rows.repartition("question_id").sortWithinPartitions("question_id", "rank")
    columns = ", ".join(f"{c} {kinds[c]}" for c in ITEM)
    return dealt.mapInPandas(read, f"question_id {kinds['question_id']}, rank int, {columns}")


def open_questions(rows: DataFrame, kept: DataFrame, first: int | Column) -> DataFrame:
    """Questions that the first ranks didn't fill and that may have more."""
    n = kept.groupBy("question_id").agg(F.count(F.lit(1)).alias("_kept"))
    seen = rows.groupBy("question_id", "limit").agg(F.count(F.lit(1)).alias("_seen")).join(n, "question_id", "left")
    return seen.where((F.col("_seen") >= first) & (F.coalesce("_kept", F.lit(0)) < F.col("limit"))).select("question_id")


def suppress_duplicates(rows: DataFrame, fields: DataFrame, first: int = FIRST_RANKS) -> DataFrame:
    """Walk each question's scored candidates in rank order and leave out what repeats a kept one.

    The first ranks do for most questions; those that they don't fill are walked over all their candidates.
    Distinct sections of one document never repeat each other.
    """
    bodies = near_bodies(rows, fields)
    early = stored(walk(ranked(rows).where(F.col("rank") <= first), bodies))
    again = cut(open_questions(rows, early, first))
    if again.isEmpty():
        return early
    late = walk(ranked(rows.join(again, "question_id", "left_semi")), bodies)
    return early.join(again, "question_id", "left_anti").unionByName(late)


def considered(wanted: DataFrame, chunks: DataFrame, tokens: DataFrame) -> DataFrame:
    """For each question the chunks that pass its filters; 0 without terms or with limit 0.

    Chunks are counted for each set of filters that may be given (a cube of three keys), so a question meets
    one row by equality: a filter that isn't given asks for the row of all.
    """
    keys = {"category": "q_category", "framework_key": "q_framework", "service_key": "q_service"}
    cube = chunks.cube(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.grouping(k).alias(f"_{q}") for k, q in keys.items()))
    # a key that is null or empty passes no filter
    cube = cube.where(functools.reduce(lambda a, b: a & b, [(F.col(f"_{q}") == 1) | (F.col(k).isNotNull() & (F.lit(k == "category") | (F.col(k) != ""))) for k, q in keys.items()]))
    cube = cube.select("n", *(f"_{q}" for q in keys.values()), *(F.coalesce(k, F.lit("")).alias(q) for k, q in keys.items()))
    asks = wanted.join(tokens.select("question_id").distinct(), "question_id", "left_semi").where("limit > 0")
    asks = asks.select("question_id", *(F.col(q).isNull().cast("byte").alias(f"_{q}") for q in keys.values()), *(F.coalesce(q, F.lit("")).alias(q) for q in keys.values()))
    got = asks.join(cube, [c for c in asks.columns if c != "question_id"])
    return wanted.select("question_id").join(got.select("question_id", "n"), "question_id", "left").select("question_id", F.coalesce("n", F.lit(0)).cast("long").alias("considered_count"))


def outcomes(wanted: DataFrame, matches: DataFrame, counted: DataFrame) -> DataFrame:
    """``matches`` or ``no_matches`` for every question."""
    n = matches.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_matches"))
    rows = wanted.select("question_id").join(n, "question_id", "left").join(counted, "question_id", "left")
    return rows.select(
        "question_id",
        F.when(F.col("n_matches") > 0, "matches").otherwise("no_matches").alias("kind"),
        F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"),
        "considered_count",
    )


def prepare(questions: DataFrame, built: ix.Index, stopwords: DataFrame, aliases: DataFrame, composed: bool = False) -> dict[str, DataFrame]:
    """What questions ask, by name: wanted, groups, tokens, weighed, weights and terms (tokens that some chunk has)."""
    wanted = asked(questions, composed)
    groups = cut(expand_aliases(question_terms(questions, stopwords, composed), aliases))
    tokens = scoring_tokens(groups)
    weighed = cut(with_idf(tokens, built.frequencies, built.stats))
    weights = cut(group_weights(groups, weighed))
    terms = weighed.join(gains(weights), ["question_id", "token"]).join(wanted.where("limit > 0").select("question_id"), "question_id", "left_semi")
    terms = cut(terms.withColumn("bucket", ix.bucket_of(F.col("token"), F.col("buckets"))).drop("buckets"))
    # the filter tells Catalyst that the terms are few of all tokens, so that their buckets prune the postings
    return {"wanted": wanted, "groups": groups, "tokens": tokens, "weighed": weighed, "weights": weights, "terms": terms.where("df > 0")}


def score_questions(questions: DataFrame, built: ix.Index, stopwords: DataFrame, aliases: DataFrame, composed: bool = False) -> dict[str, DataFrame]:
    """The tables from terms to all scored candidates, by name."""
    made = prepare(questions, built, stopwords, aliases, composed)
    passed = shard_scores(made, built)
    rows = scored(passed, made["wanted"], made["tokens"], built.fields)
    return made | {"gated": passed, "scored": rows, "ranked": ranked(rows)}


def best_scored(made: dict[str, DataFrame], built: ix.Index, first: int = FIRST_RANKS, lead: int = FIRST_BLOCKS) -> DataFrame:
    """Scored candidates, of which each question's first ranks are those among all candidates.

    A question looks into the blocks with the greatest bounds first.  The score at rank ``first``
    there is a floor: blocks and chunks whose bound is below it can't reach these ranks and are left out.
    A question with fewer candidates than that has no floor, and gets all of them.
    """
    bounds = cut(block_bounds(made["terms"], built.blocks))
    turn = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("most"), "block"))
    early = cut(bounds.withColumn("turn", turn).where(F.col("turn") <= lead))

    def score(within: DataFrame, floor: DataFrame | None) -> DataFrame:
        near = candidates(made["terms"], built.postings, made["wanted"], within, floor)
        return stored(scored(gated(near, made["weights"]), made["wanted"], made["tokens"], built.fields))

    head = score(early, None)
    floor = cut(ranked(head).where(F.col("rank") == first).select("question_id", F.col("score").alias("least")))
    rest = bounds.join(early, ["question_id", "block"], "left_anti").join(floor, "question_id", "left")
    rest = cut(rest.where(F.col("least").isNull() | (F.col("most") >= F.col("least"))).select("question_id", "block"))
    return head.unionByName(score(rest, floor))


def first_scored(made: dict[str, DataFrame], built: ix.Index, first: int = FIRST_RANKS, shards: tuple[int, DataFrame] | None = None) -> DataFrame:
    """Scored candidates, of which each question's first ranks are those among all candidates; for many questions."""
    return stored(scored(shard_scores(made, built, first, shards=shards), made["wanted"], made["tokens"], built.fields))


def build_index(chunks: DataFrame, composed: bool = False, buckets: int = 8) -> ix.Index:
    """The index in the shared folder, for one use; ``index.open_index`` keeps it under a revision."""
    root = f"{shared_folder(chunks.sparkSession)}/{uuid.uuid4().hex}"
    ix.write_tables(ix.index_fields(chunks, composed), root, buckets)
    return ix.tables_at(chunks.sparkSession, root)


def retrieve(questions: DataFrame, built: ix.Index, stopwords: DataFrame, aliases: DataFrame, composed: bool = False, first: int = FIRST_RANKS) -> tuple[DataFrame, DataFrame]:
    """The whole pipeline over an index: matches (ranked from 1, duplicates left out) and outcomes.

    A question's first ranks up to twice its limit are walked; those that they don't fill go on to all first ranks,
    and those that these don't fill are scored in full and walked to their end.
    """
    made = prepare(questions, built, stopwords, aliases, composed)
    shards = stored_shards(made, built)
    rows = stored(ranked(first_scored(made, built, first, shards)).where(F.col("rank") <= first))
    bodies = near_bodies(rows, built.fields)
    twice = F.least(F.col("limit") * 2, F.lit(first))
    lead = rows.where(F.col("rank") <= twice)
    matches = stored(walk(lead, bodies))
    again = cut(open_questions(lead, matches, twice))
    if not again.isEmpty():
        later = walk(rows.join(again, "question_id", "left_semi"), bodies)
        matches = stored(matches.join(again, "question_id", "left_anti").unionByName(later))
    again = cut(open_questions(rows, matches, first))
    if not again.isEmpty():
        left = made | {name: made[name].join(again, "question_id", "left_semi") for name in ("terms", "weights")}
        late = stored(scored(shard_scores(left, built, shards=shards), made["wanted"], made["tokens"], built.fields))
        late = walk(ranked(late), near_bodies(late, built.fields))
        matches = stored(matches.join(again, "question_id", "left_anti").unionByName(late))
    return matches, outcomes(made["wanted"], matches, considered(made["wanted"], built.fields, made["tokens"]))

"""The trie against one built by adding each conversation turn by turn, and against its SQL."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from docweave.llm import prefix_trie, queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    """Sequences of (role, text) by conversation."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return made


def brute(talks):
    """Rows of all nodes, each conversation put in turn by turn."""
    members = defaultdict(list)
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)

    def below(node):
        own = (len(members[node]) - 1) * len(node[-1][1].split()) if node else 0
        parts = [below(k) for k in kids[node]]
        return own + sum(p[0] for p in parts), sum(p[1] for p in parts) or 1

    rows = []
    for node, who in members.items():
        saved, leaves = below(node)
        ends = ",".join(str(c) for c in sorted(who) if len(talks[c]) == len(node))
        up = min(members[node[:-1]]) if node else None
        rows.append((min(who), len(node), up, len(who), len(kids[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def answer(spark, rows, block=prefix_trie.BLOCK):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    own = prefix_trie.turn_digests(turns)
    made = prefix_trie.prefix_trie(prefix_trie.borrowed_prefixes(own), own.select("conv").distinct(), block)
    assert made.columns == COLUMNS
    return sorted(map(tuple, made.collect()), key=str)


ODD = [
    (1, None, None, None), (1, 0, "", None), (1, 1, "a", "b c"), (1, 1, "a", "b c"), (2, 5, "u", "x  y\tz"), (2, 5, "a", "x  y\tz"),
    (None, 0, "u", "lost"), (20, 0, "u", "one"), (21, 0, "u", "own"), (40, 0, "u", ""), (40, 1, "", "u"), (47, 0, "z", ""), (47, 1, "z", "w"), (47, 2, "z", "w w"), (47, 3, "z", "v"),
]


@pytest.mark.parametrize("block", [1, 2, 4, 7])
def test_odd_rows(spark, block):
    assert answer(spark, ODD, block) == brute(rebuilt(ODD))


@pytest.mark.parametrize("seed", range(3))
def test_random_talks(spark, seed):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice("ua"), rng.choice(["yes", "no no", "", "a b c"][: 1 + seed])) for c in rng.sample(range(400), 150) for t in range(rng.choice([1, 2, 5, 9, 30]))]
    assert answer(spark, rows) == brute(rebuilt(rows))


def test_one_talk_repeated_and_many_children(spark):
    rows = [(c, t, "u", f"t{t}") for c in range(0, 3000) for t in range(3)]
    rows += [(c, t, "u", f"t{t}" if t < 2 else f"own {c}") for c in range(5000, 7000) for t in range(3)]
    assert answer(spark, rows) == brute(rebuilt(rows))


def test_ids_of_a_node_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(c, 0, "u", "same") for c in range(100)]
    assert answer(spark, rows) == brute(rebuilt(rows))


def test_empty_and_other_columns(spark):
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string, depth int, k int")
    own = prefix_trie.turn_digests(turns)
    assert prefix_trie.prefix_trie(prefix_trie.ordered(own), own.select("conv").distinct()).collect() == []
    turns = spark.createDataFrame([(7, 0, "u", "a b", 1, 2), (9, 0, "u", "a b", 3, 4)], turns.schema)
    own = prefix_trie.turn_digests(turns)
    got = sorted(map(tuple, prefix_trie.prefix_trie(prefix_trie.ordered(own), own.select("conv").distinct()).collect()), key=str)
    assert got == brute({7: [("u", "a b")], 9: [("u", "a b")]})


def test_whole_table_and_sql(spark):
    rows = [tuple(r) for r in queries.table(spark, "/root/testdata/sf0.01", "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, queries.op11_prefix_trie(spark, "/root/testdata/sf0.01").collect()), key=str)
    assert got == brute(rebuilt(rows))
    db = duckdb.connect()
    db.execute("CREATE TABLE conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    assert sorted(db.execute(prefix_trie.ORACLE).fetchall(), key=str) == got
    db.execute("DELETE FROM conversations")
    db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", ODD)
    assert sorted(db.execute(prefix_trie.ORACLE).fetchall(), key=str) == brute(rebuilt(ODD))

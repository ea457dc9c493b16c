"""The prefix trie of conversations, found by hashing blocks of turns.

A conversation starts with the root, a turn of its own at depth 0.  Its turns carry 128-bit digests of
role and text, and each prefix is named by the exclusive or of two 64-bit hashes of
(depth, digest) over its turns, a running value that needs no list of turns.  Blocks of
``BLOCK`` turns at fixed depths are named by the prefix before and the prefix behind them:

1. Conversations are grouped by block first; a group keeps its number of members, its
   smallest member and the turns of one member, as all have the same.
2. A block that has no sibling (another block behind the same prefix) has the same members at
   all its depths, so its nodes are read off.  Only blocks with siblings are opened,
   group by group, and their turn prefixes are grouped: boundaries are refined there.

A node belongs to its smallest member.  If it belongs to c at one depth then so it does at all
later ones of c, so c owns a chain from its first own depth to its end.  What a subtree
holds is therefore a sum over members: the words that c says at or below a depth, less the
words of the nodes it owns there; and one leaf if c's last node is its own and childless.
Sums over members are made for blocks and refined in the same way; no step goes
through the tree level by level.

Keys with many rows: grouping is partial on the map side, so members of one prefix leave a task as one row.
Children meet their parent on its name; a parent of more than a thousandth of all nodes (so there are fewer than a
thousand of them) comes to the tasks by broadcast.  Ids of conversations that end in one node are
sorted by range over all tasks and joined to texts of ``PIECE`` ids there, whose digest one task takes, piece by piece.

Defined cases: a null role or text counts as empty, a null turn comes first, turns that tie come in the order of their digests,
rows that repeat are turns of their own, rows with a null id name no conversation and are left out, conversations
without turns end in the root, an empty table gives an empty result, other columns aren't read.  A conversation is
read as a sorted stream, never as a list.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.session import stored

#: Turns of a block, the root included in the first.
BLOCK = 4
#: Ids that are joined to one text before the last task takes their digest.
PIECE = 4096
WORDS = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "pa", "pb"]


def turn_digests(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows of conv, turn, digest and words."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text)))
    return turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).alias("turn"),
        digest.alias("digest"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("words"),
    )


def in_order(*more: str) -> Window:
    return Window.partitionBy("conv").orderBy(*[F.col(c).asc_nulls_first() for c in (*more, "turn", "digest")])


def borrowed_prefixes(turns: DataFrame, every: int = 20, longest: int = 4) -> DataFrame:
    """Conversations rebuilt: conversation c gets the first h turns of c - c % every, then its own after its first h.

    h is c's CRC-32 modulo ``longest``.  Rows of conv, depth (from 1), digest and words; conversations without turns have none.
    """
    h = F.crc32(F.col("conv").cast("string")) % longest
    base = F.col("conv") - F.col("conv") % every
    lent = turns.where(F.col("conv") % every == 0).withColumn("d", F.row_number().over(in_order())).where(F.col("d") < longest)
    lent = lent.select(F.col("conv").alias("base"), "d", "digest", "words")
    takers = turns.select("conv").distinct().withColumn("base", base).withColumn("h", h).where("conv != base AND h > 0")
    given = takers.join(lent, "base").where("d <= h").select("conv", F.lit(0).alias("own"), F.col("d").cast("long").alias("turn"), "digest", "words")
    kept = turns.select("conv", F.lit(1).alias("own"), F.col("turn").cast("long").alias("turn"), "digest", "words")
    w = in_order("own")
    numbered = kept.unionByName(given).select(
        "*", F.row_number().over(w).alias("row"), F.coalesce(F.sum(1 - F.col("own")).over(w), F.lit(0)).alias("lent")
    )
    skipped = F.when(F.col("conv") == base, 0).otherwise(h)
    rows = numbered.where((F.col("own") == 0) | (F.col("row") - F.col("lent") > skipped))
    depth = F.when(F.col("own") == 0, F.col("row")).otherwise(F.col("row") - skipped)
    return rows.select("conv", depth.cast("long").alias("depth"), "digest", "words")


def ordered(turns: DataFrame) -> DataFrame:
    """Conversations as they are: rows of conv, depth (from 1), digest and words."""
    return turns.select("conv", F.row_number().over(in_order()).cast("long").alias("depth"), "digest", "words")


def blocks(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each conversation and block: the prefixes around it, its turns, words behind it, and whether it is the last."""
    root = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.unhex(F.lit("00" * 16)).alias("digest"), F.lit(0).cast("long").alias("words"))
    lanes = turns.unionByName(root).select(
        "conv", "depth", "words", F.xxhash64("depth", "digest").alias("la"), F.xxhash64("digest", "depth", F.lit("b")).alias("lb")
    )
    w, all_of = Window.partitionBy("conv").orderBy("depth"), Window.partitionBy("conv")
    running = lanes.select(
        "*",
        F.bit_xor("la").over(w).alias("pa"),
        F.bit_xor("lb").over(w).alias("pb"),
        F.sum("words").over(w).alias("said"),
    )
    turn = F.struct("depth", "pa", "pb", "words", "la", "lb", "said")
    made = running.groupBy("conv", F.floor(F.col("depth") / block).alias("k")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    made = made.withColumn("end", F.element_at("turns", -1)).withColumn("last", F.max("k").over(all_of) == F.col("k"))
    total = F.max("end.said").over(all_of)
    first = F.col("turns")[0]
    return made.select(
        "conv",
        "k",
        first["pa"].bitwiseXOR(first["la"]).alias("ba"),
        first["pb"].bitwiseXOR(first["lb"]).alias("bb"),
        F.col("end.pa").alias("wa"),
        F.col("end.pb").alias("wb"),
        F.transform("turns", lambda t: F.struct(t["depth"], t["pa"], t["pb"], t["words"])).alias("turns"),
        (total - F.col("end.said")).alias("behind"),
        "last",
    )


KEY = ["k", "ba", "bb", "wa", "wb"]


def grouped(made: DataFrame) -> DataFrame:
    """One row for each distinct block: members, smallest member, turns, words behind, and whether it has siblings."""
    groups = made.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.min("conv").alias("first"), F.any_value("turns").alias("turns"), F.sum("behind").alias("behind")
    )
    groups = stored(groups)
    one = groups.groupBy("k", "ba", "bb").agg(F.count(F.lit(1)).alias("siblings"), F.any_value(F.struct("wa", "wb")).alias("w")).where("siblings = 1")
    alone = one.select("k", "ba", "bb", "w.wa", "w.wb", F.lit(True).alias("alone"))
    return groups.join(alone, KEY, "left").withColumn("alone", F.coalesce("alone", F.lit(False)))


def refined(rows: DataFrame, values: dict[str, Column], sums: list[Column]) -> DataFrame:
    """Nodes of blocks: read off where a block is alone, grouped by turn prefix where it has siblings.

    ``values`` are of block and turn (``t``, and its place ``i``), ``sums`` aggregate them.
    """
    opened = rows.select("*", F.posexplode("turns").alias("i", "t"))
    up = F.when(F.col("i") > 0, F.col("turns")[F.col("i") - 1])
    cols = [F.col("t.depth"), F.col("t.pa"), F.col("t.pb")]
    ups = [F.coalesce(up["pa"], F.col("ba")).alias("ua"), F.coalesce(up["pb"], F.col("bb")).alias("ub")]
    nodes = opened.select(*cols, *ups, F.col("t.words").alias("words"), "alone", *[v.alias(n) for n, v in values.items()])
    read = nodes.where("alone").drop("alone")
    found = nodes.where("NOT alone").groupBy(*NODE, "ua", "ub", "words").agg(*sums)
    return read.unionByName(found.select(read.columns))


def with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with the number of their children and the id that their parent belongs to."""
    kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("ua").alias("pa"), F.col("ub").alias("pb")).agg(F.count(F.lit(1)).alias("n_children"))
    own = stored(nodes.join(kids, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    parents = own.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("pa").alias("ua"), F.col("pb").alias("ub"), F.col("first").alias("parent"), "n_children"
    )
    many = own.count() // 1000
    up = ["depth", "ua", "ub"]
    hot = parents.where(F.col("n_children") > many).select(*up, F.col("parent").alias("hot"))  # fewer than a thousand rows
    met = own.join(F.broadcast(hot), up, "left")
    rest = met.where("hot IS NULL").join(parents.where(F.col("n_children") <= many).select(*up, "parent"), up, "left")
    return met.where("hot IS NOT NULL").withColumn("parent", F.col("hot")).unionByName(rest).drop("hot")


def end_digests(ends: DataFrame) -> DataFrame:
    """The digest of the ids that end in each node (rows of conv and node), ascending and joined by commas."""
    spread = ends.repartitionByRange(*NODE, "conv").sortWithinPartitions(*NODE, "conv")

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for node, own in frame.groupby(NODE, sort=False)["conv"]:
                ids = own.tolist()
                out += [(*node, ids[i], ",".join(map(str, ids[i : i + PIECE]))) for i in range(0, len(ids), PIECE)]
            yield pd.DataFrame(out, columns=[*NODE, "conv", "ids"])

    pieces = spread.mapInPandas(join, "depth long, pa long, pb long, conv long, ids string")

    def digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sha = None, None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if (row.depth, row.pa, row.pb) != at:
                    if at:
                        out.append((*at, sha.hexdigest()))
                    at, sha = (row.depth, row.pa, row.pb), hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(row.ids.encode())
            yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
        if at:
            yield pd.DataFrame([(*at, sha.hexdigest())], columns=[*NODE, "ends_sha256"])

    met = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "conv")
    return met.mapInPandas(digest, "depth long, pa long, pb long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each node of the trie of ``turns`` (conv, depth, digest, words); ``convs`` are all their ids, and those without turns."""
    made = stored(blocks(turns, convs, block))
    groups = stored(grouped(made))
    nodes = with_parents(refined(groups, {"first": F.col("first")}, [F.min("first").alias("first")]))
    nodes = stored(nodes)
    # what each conversation owns: its chain of nodes
    chains = nodes.groupBy(F.col("first").alias("conv")).agg(
        F.min("depth").alias("since"), F.sum("words").alias("own"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")
    )
    end = F.element_at("turns", -1)["depth"]
    owned = made.join(chains, "conv").groupBy(*KEY).agg(
        F.sum(F.when(F.col("since") > end, F.col("own")).otherwise(F.col("behind"))).alias("own"),
        F.sum("leaf").alias("leaves"),
        F.min("since").alias("since"),
    )
    summed = groups.join(owned, KEY, "left")
    i = F.col("i")
    words_from = F.aggregate(F.slice("turns", i + 1, F.size("turns")), F.lit(0).cast("long"), lambda s, t: s + t["words"])
    own_from = F.aggregate(
        F.filter(F.slice("turns", i + 1, F.size("turns")), lambda t: t["depth"] >= F.col("since")), F.lit(0).cast("long"), lambda s, t: s + t["words"]
    )
    saved = F.col("behind") + F.col("n") * words_from - F.coalesce("own", F.lit(0)) - F.coalesce(own_from, F.lit(0))
    values = {"n_convs": F.col("n"), "n_leaves": F.coalesce("leaves", F.lit(0)), "saved_tokens": saved}
    totals = refined(summed, values, [F.sum(c).alias(c) for c in values]).select(*NODE, *values)
    ends = end_digests(made.where("last").select("conv", end.alias("depth"), F.col("wa").alias("pa"), F.col("wb").alias("pb")))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(totals, NODE).join(ends, NODE, "left").select(
        F.col("first").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )


#: Nodes by the whole list of digests before them; CRC-32 bit by bit; subtrees by the ancestors of every node.
ORACLE = r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')) AS digest,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, digest) AS d FROM t),
c AS (
  SELECT conv, conv - conv % 20 AS base, xor(list_reduce(
    list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(conv AS VARCHAR), ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv FROM t)
), r AS (
  SELECT c.conv, 0 AS own, n.d, n.digest, n.words FROM c JOIN n ON n.conv = c.base AND n.d <= c.h
  UNION ALL SELECT n.conv, 1, n.d, n.digest, n.words FROM n JOIN c ON n.conv = c.conv AND n.d > c.h
), p AS (
  SELECT conv, row_number() OVER w AS depth, md5(array_to_string(list(digest) OVER w, ',')) AS pid, words
  FROM r WINDOW w AS (PARTITION BY conv ORDER BY own, d)
  UNION ALL SELECT conv, 0, 'root', 0 FROM c
), q AS (SELECT *, lag(pid) OVER (PARTITION BY conv ORDER BY depth) AS up, max(depth) OVER (PARTITION BY conv) AS length FROM p),
v AS (
  SELECT depth, pid, up, any_value(words) AS words, min(conv) AS first, count(*) AS n,
    coalesce(string_agg(CAST(conv AS VARCHAR), ',' ORDER BY conv) FILTER (depth = length), '') AS ends
  FROM q GROUP BY depth, pid, up
), k AS (SELECT depth - 1 AS depth, up AS pid, count(*) AS kids FROM v WHERE depth > 0 GROUP BY ALL),
x AS (SELECT v.*, coalesce(k.kids, 0) AS kids FROM v LEFT JOIN k ON v.depth = k.depth AND v.pid = k.pid),
s AS (
  SELECT a.depth, a.pid, sum((x.n - 1) * x.words) AS saved, count(*) FILTER (x.kids = 0) AS leaves
  FROM x JOIN q a ON a.conv = x.first AND a.depth <= x.depth GROUP BY a.depth, a.pid
)
SELECT x.first AS conv_id, CAST(x.depth AS BIGINT) AS depth, u.first AS parent_conv_id, x.n AS n_convs, CAST(x.kids AS BIGINT) AS n_children,
  CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM x JOIN s ON s.depth = x.depth AND s.pid = x.pid LEFT JOIN x u ON u.depth = x.depth - 1 AND u.pid = x.up
"""

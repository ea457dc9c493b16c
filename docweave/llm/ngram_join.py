"""Groups of texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

1. One pass over the texts turns each into a sorted set of 64-bit digests of its word
   shingles and names the set by a 128-bit digest.  Sets are gathered in chunks of a few
   million shingles; a chunk sends each range of digests once, with the number of its sets
   that have each digest (so that the most frequent shingle costs one entry a chunk).
2. Each range adds up the exact number of sets that have a digest and answers every chunk
   with the digests that two sets or more share.  Equal sets become one vertex.
3. A chunk orders the shingles of its vertices by frequency, rare ones first, and emits the
   first of them: two sets that are similar enough share one of those.  A shingle of one
   set only takes a place but makes no entry, so most texts without a near copy end here.
4. The vertices that share an entry form a bucket.  Pairs of a bucket pass the length and
   positional filters and a bound on what the rest can share, by the parity of how many
   digests fall into each of 256 stretches; each pair left is verified once, by counts in 64
   stretches (suffix filter) and then by the digests themselves.  Links join components.
5. Not all pairs of a bucket are made.  First its pivot, the vertex whose shingles are the
   most frequent (in a group of near copies the text that they were made from), is paired
   with the others; while the pairs left over are many and a round pays, the heaviest vertex
   outside the pivots' components is the next pivot.  What is left are texts that share frequent passages without being
   alike: a bucket with many of them is split by the second shingle in common, and again (``split``), so
   that they don't meet pair by pair.  At last every pair left over whose ends are in different components is
   made, except those inside the bucket's largest component.  No link between components is
   lost, and a group of near copies costs about one pair for each member.

Sets are compared by digests: for a pair of texts to be misjudged, two different shingles
of the pair must have the same 64 bits; for two sets to be confused, their 128 bits.

The texts are numbered by their place in the input, which must give the same rows in the
same order when it is read again (files do; write other inputs to files first).

Defined cases: a text with fewer words than a shingle is one shingle; null texts and texts
without words have an empty set, are linked with nothing and keep their own id; rows that
repeat are copies; rows with a null id take part, and a component without any id has the
null id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.wordcache import give_back
from docweave.session import cut, stored

WORDS = 5
PERCENT = 80
#: A chunk ends after so many shingles for each range of digests, but within these bounds (a task holds
#: about 50 bytes for each), or after so many sets.
EACH, LEAST, MOST, SETS = 4096, 1_000_000, 8_000_000, 30_000
#: Sets that share a digest within a chunk are listed to its range up to so many; else only their number.
LISTED = 16
STRETCHES, PARITY = 64, 256
#: Further pivots are sought while the pairs left over are more than so many for each entry, and while a round pays:
#: it settles so much of the entries, or it makes so many pairs for each and finds so many of them linked.
COMBINED, PAYS, PAIRED = 8, 0.1, 0.01
#: Buckets of more members may be split by the next shingles in common, of which so many are used, where
#: that makes fewer rows than the bucket has pairs for each of so many (a pair is only compared, a row is moved).
WIDE, FURTHER, COMPARED = 64, 4, 64

STEPS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(WORDS)], np.uint64)
#: Bytes of words longer than this are hashed one word at a time.
LONG_WORD, BLOCK = 64, 1 << 21
BASE = 0xD6E8FEB86659FD93
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def _byte_values() -> np.ndarray:
    """A random number for each byte; white space has none, and both cases of A-Z the same."""
    values = np.random.default_rng(5).integers(0, 1 << 64, 256, np.uint64)
    values[65:91] = values[97:123]
    values[SPACE] = 0
    return values


def _powers(base: int) -> np.ndarray:
    out = np.full(BLOCK, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


VALUES, UP, DOWN = _byte_values(), _powers(BASE), _powers(pow(BASE, -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def word_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One digest for each word: a polynomial of its bytes, over blocks of many words at a time."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, "right")))
        first, last = int(starts[at]), int(ends[upto - 1])
        if last - first <= BLOCK:
            own = starts[at:upto] - first
            values = VALUES[data[first:last]]
            values *= UP[: last - first]
            out[at:upto] = np.add.reduceat(values, own) * DOWN[own]
        at = upto
    out += (ends - starts).astype(np.uint64)
    for k in np.flatnonzero(ends - starts > LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes().lower())
    return _mixed(out)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct digests of all texts, one text after the other, and how many each has."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    begin, end = int(bounds[0]), int(bounds[-1])
    if begin == end:
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    data, bounds = np.frombuffer(texts.buffers()[2], np.uint8)[begin:end], bounds - begin
    ink = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    starts = np.flatnonzero(ink & (edge[:-1] | np.concatenate([[True], ~ink[:-1]])))
    ends = np.flatnonzero(ink & (edge[1:] | np.concatenate([~ink[1:], [True]]))) + 1
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    words = word_digests(data, starts, ends)
    first = np.searchsorted(starts, bounds)
    count = np.diff(first)
    windows = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    offset = np.concatenate([[0], np.cumsum(windows)])
    h = np.empty(int(offset[-1]), np.uint64)
    # All windows of the texts that have a whole one; then the short texts, by their number of words.
    whole = np.zeros(len(words), bool)
    if len(words) >= WORDS:
        sums = np.zeros(len(words) - WORDS + 1, np.uint64)
        for k in range(WORDS):
            sums += words[k : k + len(sums)] * STEPS[k]
        text_of = np.repeat(np.arange(len(count)), count)
        whole = text_of[: len(sums)] == text_of[WORDS - 1 :]
        h[np.repeat(count >= WORDS, windows)] = sums[whole]
    for size in range(1, WORDS):
        short = np.flatnonzero(count == size)
        h[offset[short]] = sum(words[first[short] + k] * STEPS[k] for k in range(size)) + np.uint64(size) if len(short) else 0
    h = _mixed(h)
    for a, b in zip(offset[:-1].tolist(), offset[1:].tolist()):
        h[a:b].sort()
    fresh = np.ones(len(h), bool)
    fresh[1:] = h[1:] != h[:-1]
    fresh[offset[:-1][windows > 0]] = True
    sizes = np.diff(np.concatenate([[0], np.cumsum(fresh)])[offset])
    return h[fresh], sizes


def shingle_set(text: str | None) -> np.ndarray:
    return shingle_sets(pa.array([text], pa.large_string()))[0]


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """The least overlap of sets of these sizes that makes a link."""
    return -(-percent * (a + b) // (100 + percent))


def stretches(shared: np.ndarray) -> np.ndarray:
    """How many of the sorted digests lie in each of 64 stretches of their range."""
    edges = np.arange(1, STRETCHES, dtype=np.uint64) << np.uint64(64 - 6)
    return np.diff(np.concatenate([[0], np.searchsorted(shared, edges), [len(shared)]]))


def linked(n: int, a: np.ndarray, m: int, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether sets of n and m shingles link; a and b hold at least all that they have in common."""
    least = needed(n, m, percent)
    if min(len(a), len(b)) < least or int(np.minimum(stretches(a), stretches(b)).sum()) < least:
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a)) >= least


def planes(digests: np.ndarray) -> bytes:
    """The first bytes of all digests, then the second bytes, and so on: sorted digests compress well so."""
    return np.ascontiguousarray(digests.astype(">u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def from_planes(held: pa.Scalar) -> np.ndarray:
    held = np.frombuffer(held.as_buffer(), np.uint8)
    return np.ascontiguousarray(held.reshape(8, -1).T).view(">u8").reshape(-1).astype(np.uint64)


DOC, COUNTED, FREQUENT = 0, 1, 2
FIELDS = "kind int, id {}, n long, name binary, v long, part int, chunk long, h binary, df binary, count binary, sets binary"


def rows_of(schema: pa.Schema, size: int, **columns) -> pa.RecordBatch:
    """A batch of ``size`` rows; columns that are not given are null."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns.get(f.name), pa.Array) else pa.array(c, f.type) if c is not None else pa.nulls(size, f.type) for f in schema], schema=schema
    )


def schema_of(id_type: pa.DataType) -> pa.Schema:
    kinds = {"kind": pa.int32(), "id": id_type, "n": pa.int64(), "name": pa.binary(), "v": pa.int64(), "part": pa.int32(), "chunk": pa.int64()}
    return pa.schema(list(kinds.items()) + [(c, pa.binary()) for c in ("h", "df", "count", "sets")])


def in_chunks(docs: DataFrame, parts: int) -> DataFrame:
    """A row for each document, and the shingles of each chunk of documents, dealt by ranges of digests.

    A vertex is numbered by task, chunk and place in the chunk.
    """
    starts = np.array([-(-(p << 32) // parts) << 32 for p in range(parts)], np.uint64)
    most = min(MOST, max(LEAST, EACH * parts))

    def send(schema: pa.Schema, chunk: int, held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, sets = np.concatenate(held), np.repeat(np.arange(len(held), dtype=np.uint16), [len(x) for x in held])
        order = np.argsort(h, kind="stable")
        h, sets = h[order], sets[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        count, h = np.diff(np.append(first, len(h))), h[first]
        many = count > LISTED
        listed = np.repeat(~many, count)
        if many.any():
            yield rows_of(schema, 1, kind=[FREQUENT], part=[chunk % parts], chunk=[chunk], h=[planes(h[many])], count=[count[many].astype(np.uint16).tobytes()], sets=[sets[~listed].tobytes()])
        sets = sets[listed]
        to = np.concatenate([[0], np.cumsum(np.where(many, 0, count))])
        edges = np.append(np.searchsorted(h, starts), len(h))
        some = np.flatnonzero(np.diff(edges)).tolist()
        own = [(edges[p], edges[p + 1]) for p in some]
        yield rows_of(
            schema, len(some), kind=[COUNTED] * len(some), part=some, chunk=[chunk] * len(some), h=[planes(h[a:b]) for a, b in own],
            count=[count[a:b].astype(np.uint16).tobytes() for a, b in own], sets=[sets[to[a] : to[b]].tobytes() for a, b in own],
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, schema, known, held, waiting = TaskContext.get().partitionId() << 16, None, {}, [], 0
        for batch in batches:
            schema = schema or schema_of(batch.column(0).type)
            flat, sizes = shingle_sets(batch.column(1))
            names, numbers, at = [], [], 0
            for size in sizes.tolist():
                own, at = flat[at : at + size], at + size
                if not size:
                    names.append(None)
                    numbers.append(None)
                    continue
                name = xxhash.xxh3_128_digest(own.tobytes())
                if name not in known:
                    if held and (waiting + size > most or len(held) >= SETS):
                        yield from send(schema, chunk, held)
                        chunk, known, held, waiting = chunk + 1, {}, [], 0
                    known[name] = chunk << 16 | len(held)
                    held.append(own)
                    waiting += size
                names.append(name)
                numbers.append(known[name])
            yield rows_of(schema, len(sizes), kind=[DOC] * len(sizes), id=batch.column(0), n=sizes, name=names, v=numbers, part=np.arange(len(sizes)) % parts)
        if held:
            yield from send(schema, chunk, held)
        known, held = {}, []
        give_back()

    return docs.mapInArrow(read, FIELDS.format(dict(docs.dtypes)["id"]))


def counted(rows: DataFrame, parts: int) -> DataFrame:
    """The shared digests of each chunk with their exact frequencies; other rows as they are."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, counts, sets, chunks, schema = [], [], [], [], None
        for batch in batches:
            schema = batch.schema
            own = pc.equal(batch.column("kind"), COUNTED)
            yield batch.filter(pc.invert(own))
            batch = batch.filter(own)
            hs += [from_planes(x) for x in batch.column("h")]
            counts += [np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column("count")]
            sets += [np.frombuffer(x.as_buffer(), np.uint16).copy() for x in batch.column("sets")]
            chunks += batch.column("chunk").to_pylist()
        if not hs:
            return
        h = np.concatenate(hs)
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        del h
        total = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), first)
        df = np.empty(len(order), np.int64)
        df[order] = np.repeat(total, np.diff(np.append(first, len(order))))
        at = 0
        for own, count, listed, chunk in zip(hs, counts, sets, chunks):
            mine, at = df[at : at + len(own)], at + len(own)
            keep = mine > 1
            if keep.any():
                some = np.repeat(keep, np.where(count > LISTED, 0, count))
                yield rows_of(schema, 1, kind=[COUNTED], chunk=[chunk], h=[planes(own[keep])], df=[mine[keep].tobytes()], count=[count[keep].tobytes()], sets=[listed[some].tobytes()])
        del hs, counts, sets, order, total, df
        give_back()

    return rows.repartitionById(parts, F.col("part")).mapInArrow(read, rows.schema)


ENTRY = pa.schema([(c, pa.int64()) for c in ("h", "v", "n", "alone", "place")] + [("weight", pa.float64())] + [(f"s{k}", pa.int64()) for k in range(PARITY // 64)] + [("shared", pa.binary())])


def entries_of(found: DataFrame, vertices: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows of two kinds: h, v, n, alone, place, weight, s0 to s3 for the first shared shingles of each
    vertex; and v, n, shared with all its shared shingles, where it has an entry.

    ``place`` is the place of h in the set, rare shingles first; the first ``alone`` are in this
    set only.  ``weight`` is the mean frequency of the set's shingles.
    """

    def read(told: pa.Table, reps: pa.Table) -> pa.Table:
        if not told.num_rows or not reps.num_rows:
            return ENTRY.empty_table()
        numbers = reps.column("v").to_numpy()
        size = np.zeros(1 << 16, np.int64)
        size[numbers & 0xFFFF] = reps.column("n").to_numpy()
        many_h, many_df, h, df, who = [], [], [], [], []
        kinds, cols = told.column("kind").to_pylist(), [told.column(c) for c in ("h", "df", "count", "sets")]
        for k in (k for k, kind in enumerate(kinds) if kind == COUNTED):
            own, count = from_planes(cols[0][k]), np.frombuffer(cols[2][k].as_buffer(), np.uint16)
            own_df = np.frombuffer(cols[1][k].as_buffer(), np.int64)
            few = count <= LISTED
            many_h.append(own[~few])
            many_df.append(own_df[~few])
            h.append(np.repeat(own[few], count[few]))
            df.append(np.repeat(own_df[few], count[few]))
            who.append(np.frombuffer(cols[3][k].as_buffer(), np.uint16))
        if many_h and any(len(x) for x in many_h):
            many, many_df = np.concatenate(many_h), np.concatenate(many_df)
            order = np.argsort(many)
            many, many_df = many[order], many_df[order]
            for k in (k for k, kind in enumerate(kinds) if kind == FREQUENT):
                own, count = from_planes(cols[0][k]), np.frombuffer(cols[2][k].as_buffer(), np.uint16)
                h.append(np.repeat(own, count))
                df.append(np.repeat(many_df[np.searchsorted(many, own)], count))
                who.append(np.frombuffer(cols[3][k].as_buffer(), np.uint16))
        if not h:
            return ENTRY.empty_table()
        h, df, who = np.concatenate(h), np.concatenate(df), np.concatenate(who).astype(np.int64)
        mine = size[who] > 0
        h, df, who = h[mine], df[mine], who[mine]
        shared = np.bincount(who, minlength=1 << 16)
        alone = size - shared
        prefix = size + (-percent * size) // 100 + 1
        alive = (size > 0) & (prefix > alone)
        mine = alive[who]
        h, df, who = h[mine], df[mine], who[mine]
        if not len(h):
            return ENTRY.empty_table()
        order = np.lexsort((h, df, who))
        h, df, who = h[order], df[order], who[order]
        first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        runs = np.diff(np.append(first, len(who)))
        place = np.arange(len(who)) - np.repeat(first, runs) + alone[who]
        some = who[first]
        weight = np.zeros(1 << 16)
        weight[some] = (np.add.reduceat(df, first) + alone[some]) / size[some]
        nth = np.repeat(np.arange(len(first)), runs)
        bits = np.bincount(nth * PARITY + ((h >> np.uint64(20)) % np.uint64(PARITY)).astype(np.int64), minlength=len(first) * PARITY) & 1
        sketch = np.packbits(bits.astype(np.uint8).reshape(-1, PARITY), axis=1, bitorder="little").view(np.int64)
        chunk = int(numbers[0]) >> 16 << 16
        held = [np.sort(h[a : a + k]).tobytes() for a, k in zip(first.tolist(), runs.tolist())]
        whole = rows_of(ENTRY, len(some), v=some | chunk, n=size[some], shared=held)
        keep = place < prefix[who] + FURTHER
        h, who, place, nth = h[keep], who[keep], place[keep], nth[keep]
        signs = {f"s{k}": sketch[nth, k] for k in range(PARITY // 64)}
        own = rows_of(ENTRY, len(h), h=h.view(np.int64), v=who | chunk, n=size[who], alone=alone[who], place=place, weight=weight[who], **signs)
        return pa.Table.from_batches([own, whole])

    told = found.where(F.col("kind") != DOC).select("chunk", "kind", "h", "df", "count", "sets")
    reps = vertices.select(F.shiftright("v", 16).alias("chunk"), "v", "n")
    fields = "h long, v long, n long, alone long, place long, weight double, s0 long, s1 long, s2 long, s3 long, shared binary"
    return told.groupBy("chunk").cogroup(reps.groupBy("chunk")).applyInArrow(read, fields)


SIGNS = [f"s{k}" for k in range(PARITY // 64)]
OWN = ["v", "n", "alone", "place", *SIGNS]


def may_link(one: str = "", two: str = "p_", percent: int = PERCENT) -> Column:
    """Length, positional and parity filters for two entries of one shingle.

    What comes before the shingle is common at most as far as either has shared shingles there;
    what comes after, as far as either goes on.  An odd difference in the number of digests of a stretch
    is at least one digest that only one of the two has, beside those that they have alone.
    """
    n, m, a, b, at, to = (F.col(f"{side}{c}") for c in ("n", "alone", "place") for side in (one, two))
    odd = sum((F.bit_count(F.col(f"{one}{s}").bitwiseXOR(F.col(f"{two}{s}"))) for s in SIGNS), a + b)
    most = F.least(at - a, to - b) + 1 + F.least(n - at - 1, m - to - 1)
    both = n + m
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * most >= percent * both) & ((100 + percent) * (both - odd) >= 2 * percent * both)


def pairs_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("v", "p_v").alias("a"), F.greatest("v", "p_v").alias("b")).distinct()


def as_pivot(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("h", *(F.col(c).alias(f"p_{c}") for c in (*OWN, *more)))


def heaviest(rows: DataFrame, *more: str) -> DataFrame:
    """The pivot of each bucket: one order of all vertices, by weight; made by partial aggregates."""
    best = F.max(F.struct("weight", "v", *(c for c in (*OWN, *more) if c != "v"))).alias("best")
    return rows.groupBy("h").agg(best, F.count(F.lit(1)).alias("size"))


def verified(pairs: DataFrame, whole: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links x, y among the pairs a, b."""
    one, two = (whole.select(F.col("v").alias(k), F.col("n").alias(f"{k}_n"), F.col("shared").alias(f"{k}_s")) for k in "ab")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(c) for c in ("a_s", "b_s", "a_n", "b_n"))
            keep = [
                k
                for k, (size, other) in enumerate(zip(n.to_pylist(), m.to_pylist()))
                if linked(size, np.frombuffer(a[k].as_buffer(), np.uint64), other, np.frombuffer(b[k].as_buffer(), np.uint64), percent)
            ]
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(take), batch.column("b").take(take)], ["x", "y"])

    return cut(pairs.join(one, "a").join(two, "b").mapInArrow(check, "x long, y long"))


def flat(to: DataFrame) -> DataFrame:
    """x, root (root below x): every root replaced by the last one of its chain, by doubling."""
    while True:
        above = to.select(F.col("x").alias("root"), F.col("root").alias("above"))
        if to.join(above, "root", "left_semi").isEmpty():
            return to
        to = cut(to.join(above, "root", "left").select("x", F.coalesce("above", "root").alias("root")))


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (x, root; checkpointed) after the links x, y have joined components; roots are the least vertices.

    Each turn every root moves to the least root that it is linked to, and the links move
    along; those within a component fall away.
    """

    def moved(edges: DataFrame, to: DataFrame) -> DataFrame:
        left, right = (to.select(F.col("x").alias(k), F.col("root").alias(f"r{k}")) for k in "xy")
        at = edges.join(left, "x", "left").join(right, "y", "left")
        x, y = F.coalesce("rx", "x"), F.coalesce("ry", "y")
        return at.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).where("x < y").distinct()

    if labels.isEmpty():
        edges = links.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    else:
        edges = cut(moved(links, labels))
    if edges.isEmpty():
        return labels
    ends = edges.select("x").unionByName(edges.select(F.col("y").alias("x"))).distinct()
    labels = labels.unionByName(ends.join(labels.select("x"), "x", "left_anti").withColumn("root", F.col("x")))
    while not edges.isEmpty():
        to = flat(cut(edges.groupBy(F.col("y").alias("x")).agg(F.min("x").alias("root"))))
        labels = labels.join(to.select(F.col("x").alias("root"), F.col("root").alias("above")), "root", "left").select("x", F.coalesce("above", "root").alias("root"))
        edges = cut(moved(edges, to))
    return cut(labels)


def unsettled(entries: DataFrame, labels: DataFrame) -> DataFrame:
    """Entries, with their roots, of the buckets that hold two components or more."""
    here = entries.join(labels.withColumnRenamed("x", "v"), "v", "left").withColumn("root", F.coalesce("root", "v"))
    several = here.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("h")
    return cut(here.join(cut(several), "h", "left_semi"))


def few_combinations(rest: DataFrame) -> bool:
    """Whether the pairs between a bucket's components, but for those inside the largest, are in proportion to the entries."""
    sizes = rest.groupBy("h", "root").agg(F.count(F.lit(1)).alias("size")).groupBy("h").agg(F.sum("size").alias("size"), F.max("size").alias("main"))
    sums = sizes.agg(F.sum((F.col("size") - F.col("main")) * F.col("size")).alias("made"), F.sum("size").alias("held")).first()
    return (sums["made"] or 0) <= COMBINED * (sums["held"] or 0)


def prefix_size(percent: int) -> Column:
    """How many shingles of a set, rare ones first, hold one of any set that is similar enough."""
    return F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1


def split(rest: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """``rest`` with the key that its rows meet on: the shingle, or in a wide bucket the first shingles in common.

    Two sets that are similar enough have k shingles in common within the first ones and k - 1 more.  So rows of a wide
    bucket may meet on that shingle and the next one in common, which is any later one (``tokens``:
    v, h, place) within one place more, and so on.  A bucket is split where that makes far fewer rows than
    it has pairs outside its largest component; what stays wide after ``FURTHER`` shingles is left as it is.  ``met`` is the number of
    shingles in the key and ``last`` the place of the last.
    """
    rows, done = rest.select("*", F.col("h").alias("key"), F.col("place").alias("last"), F.lit(1).alias("met")), []
    end = prefix_size(percent)
    for met in range(1, FURTHER + 1):
        sizes = rows.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"), F.sum(end + met - F.col("last") - 1).alias("cost"))
        sizes = sizes.groupBy("key").agg(F.sum("size").alias("size"), F.max("size").alias("main"), F.sum("cost").alias("cost"))
        twice = F.col("size") * F.col("size") - F.col("main") * F.col("main")  # the pairs that would be made, counted twice
        wide = cut(sizes.where((F.col("size") > WIDE) & (twice > 2 * COMPARED * F.col("cost"))).select("key"))
        if wide.isEmpty():
            break
        done.append(rows.join(wide, "key", "left_anti"))
        next_ = tokens.select("v", F.col("h").alias("t"), F.col("place").alias("t_place"))
        more = rows.join(wide, "key", "left_semi").join(next_, "v").where((F.col("t_place") > F.col("last")) & (F.col("t_place") < end + met))
        more = more.withColumns({"key": F.xxhash64("key", "t"), "last": F.col("t_place"), "met": F.lit(met + 1)}).select(rows.columns)
        several = more.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
        rows = cut(more.join(several, "key", "left_semi"))
    for more in done:
        rows = rows.unionByName(more)
    return cut(rows)


def may_meet(percent: int) -> Column:
    """As ``may_link`` for rows of one key; those that met on several shingles have no other ones in common before the last."""
    after = F.least(F.col("n") - F.col("last") - 1, F.col("p_n") - F.col("p_last") - 1)
    return may_link(percent=percent) & ((F.col("met") == 1) | ((100 + percent) * (F.col("met") + after) >= percent * (F.col("n") + F.col("p_n"))))


def components(entries: DataFrame, whole: DataFrame, percent: int = PERCENT) -> DataFrame:
    """x, root for every vertex that has a link; the root is the component's least vertex."""
    tokens, entries = entries.select("v", "h", "place"), entries.where(F.col("place") < prefix_size(percent))
    hubs = cut(heaviest(entries).where("size > 1"))
    led = entries.join(as_pivot(hubs.select("h", "best.*")), "h").where(F.col("v") != F.col("p_v"))
    known = cut(pairs_of(led.where(may_link(percent=percent))))
    links = verified(known, whole, percent)
    labels = joined(cut(links.sparkSession.createDataFrame([], "x long, root long")), links)
    rest = unsettled(entries.join(hubs.select("h"), "h", "left_semi"), labels)
    pivots, left = hubs.select("h", F.col("best.v").alias("v")), rest.count()
    while left and not few_combinations(rest):
        at = labels.select(F.col("x").alias("v"), "root")
        roots = pivots.join(at, "v", "left").select("h", F.coalesce("root", "v").alias("root")).distinct()
        next_ = cut(heaviest(rest.join(roots, ["h", "root"], "left_anti"), "root").select("h", "best.*"))
        led = rest.join(as_pivot(next_, "root"), "h").where(F.col("root") != F.col("p_root")).where(may_link(percent=percent))
        pairs = cut(pairs_of(led).join(known, ["a", "b"], "left_anti"))
        known = known.unionByName(pairs)
        links = verified(pairs, whole, percent)
        labels = joined(labels, links)
        rest = unsettled(rest.drop("root"), labels)
        pivots = pivots.unionByName(next_.select("h", "v"))
        before, left, made = left, rest.count(), pairs.count()
        if left > (1 - PAYS) * before and (made < PAIRED * before or links.count() < PAYS * made):
            break
    if not left:
        return labels
    # What is left: pairs of different components that meet on a key, but for those inside the largest of the bucket.
    held = tokens.join(rest.select("v").distinct(), "v", "left_semi")
    marked = split(rest, held, percent)
    sizes = marked.groupBy("key", "root").agg(F.count(F.lit(1)).alias("size"))
    largest = cut(sizes.groupBy("key").agg(F.max(F.struct("size", "root")).alias("m")).select("key", F.col("m.root").alias("main")))
    marked = cut(marked.join(largest, "key"))
    minor = marked.where("root != main").select("key", *(F.col(c).alias(f"p_{c}") for c in (*OWN, "root", "last")))
    once = (F.col("root") == F.col("main")) | (F.col("v") < F.col("p_v"))
    led = marked.join(minor, "key").where((F.col("root") != F.col("p_root")) & once & may_meet(percent))
    return joined(labels, verified(cut(pairs_of(led).join(known, ["a", "b"], "left_anti")), whole, percent))


def ngram_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (the least id of its component)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    session = docs.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * rows.rdd.getNumPartitions())
    found = stored(counted(in_chunks(rows, parts), parts))
    named = found.where(F.col("name").isNotNull())
    vertices = stored(named.groupBy("name").agg(F.min("v").alias("v"), F.min("id").alias("rep"), F.first("n").alias("n")))
    made = stored(entries_of(found, vertices, percent))
    labels = components(made.where("h IS NOT NULL").drop("shared"), made.where("h IS NULL").select("v", "n", "shared"), percent)

    at = vertices.join(labels.withColumnRenamed("x", "v"), "v")
    least = at.groupBy("root").agg(F.min("rep").alias("least"))
    linked_ = at.join(least, "root").select("v", "least")
    whose = vertices.join(linked_.withColumn("linked", F.lit(True)), "v", "left")
    whose = whose.select("name", F.when(F.col("linked"), F.col("least")).otherwise(F.col("rep")).alias("component"))
    sets = found.where(F.col("kind") == DOC).select("id", "n", "name")
    return sets.join(whose, "name", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("name").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"),
    )

"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last seven bytes decides where a chunk ends: where its low bits
are all ones.  Each chunk gives one of 64 letters, from the sum of mixed rolling values
in it (each of which depends on the order of its bytes).  A fingerprint is
``block:letters:letters`` with the letters at a block size and at its double, so that
two fingerprints can be compared at a block size that both have.  The block size is the
least power of two, from 4 on, that gives at most ``MOST`` letters.

Likeness is one minus the edit distance (insertions and deletions) over the sum of the
lengths, at the best of the compatible block sizes, and 0 if the letters share no run of
``RUN`` (or of all letters, if there are fewer): letters of unrelated texts agree here
and there by chance.

Defined cases: null counts as empty; the empty fingerprint is ``4::`` and is like itself
only; equal texts have equal fingerprints.  ``compared_with_next`` takes integer ids (null and
repeated ones too, row by row); an empty table gives an empty result, a table of one row is
compared with itself, and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 7
MOST = 96
RUN = 7
LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Odd multipliers, powers of one of them; made by rule.
STEPS = np.array([pow(0x9E3779B1, k + 1, 1 << 32) for k in range(WINDOW)], np.uint32)


def fingerprint(text: str | None) -> str:
    data = np.frombuffer((text or "").encode("utf-8"), np.uint8)
    if not len(data):
        return "4::"
    rolling = np.zeros(len(data), np.uint32)
    wide = data.astype(np.uint32) + np.uint32(1)
    for k in range(min(WINDOW, len(data))):
        rolling[k:] += wide[: len(data) - k] * STEPS[k]
    rolling ^= rolling >> np.uint32(15)
    rolling *= np.uint32(0x85EBCA6B)
    rolling ^= rolling >> np.uint32(13)
    values = rolling * np.uint32(0xC2B2AE35)
    block = 4
    while block * MOST < len(data):
        block *= 2
    ends = np.flatnonzero((rolling & np.uint32(block - 1)) == block - 1)
    while len(ends) + 1 > 2 * MOST:  # texts that repeat themselves
        block *= 2
        ends = ends[(rolling[ends] & np.uint32(block - 1)) == block - 1]
    wider = ends[(rolling[ends] & np.uint32(2 * block - 1)) == 2 * block - 1]
    return f"{block}:{_letters(values, ends)}:{_letters(values, wider)}"


def _letters(values: np.ndarray, ends: np.ndarray) -> str:
    starts = np.concatenate([[0], ends + 1])
    sums = np.add.reduceat(values, starts[starts < len(values)], dtype=np.uint32)
    sums = (sums ^ (sums >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return LETTERS[sums >> np.uint32(26)].tobytes().decode()


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, with a bit for each letter of ``a``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def letters_alike(a: str, b: str) -> float:
    run = min(RUN, len(a), len(b))
    if not run or {a[i : i + run] for i in range(len(a) - run + 1)}.isdisjoint(
        b[i : i + run] for i in range(len(b) - run + 1)
    ):
        return 0.0
    return 2.0 * common(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    (m, a1, a2), (n, b1, b2) = ((int(x), y, z) for x, y, z in (a.split(":"), b.split(":")))
    if m == n:
        return max(letters_alike(a1, b1), letters_alike(a2, b2))
    if m == 2 * n:
        return letters_alike(a1, b2)
    return letters_alike(a2, b1) if n == 2 * m else 0.0


def fingerprints(text: Column) -> Column:
    @F.arrow_udf("string")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array((fingerprint(t.as_py()) for t in texts), pa.string())

    return made(text)


def likenesses(a: Column, b: Column) -> Column:
    @F.arrow_udf("double")
    def made(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            pairs = zip(left.to_pylist(), right.to_pylist())
            yield pa.array((None if x is None or y is None else likeness(x, y) for x, y in pairs), pa.float64())

    return made(a, b)


def edited(text: str, other: str) -> str:
    """The last quarter of the code points replaced by the first as many of another text."""
    k = len(text) // 4
    return text[: len(text) - k] + other[:k]


def compared_with_next(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None
) -> DataFrame:
    """Each document with its fingerprint, its edited text's, and their likeness.

    The next document is by ascending id, then text (null ids come first); after the last
    comes the first.  Ids are cut into ranges whose borders are ids of the table, the first
    document of each range is also given to the range before it, and each range is then read
    in order, one document held at a time.  The texts are shuffled once.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = ranges or 4 * partitions
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]
    found = rows.agg(
        F.percentile_approx("id", [k / ranges for k in range(1, ranges)] or [0.5], 100 * ranges).alias("cuts"),
        F.min("id").alias("least"),
        F.max(F.col("id").isNull()).alias("nulls"),
    ).first()
    borders = sorted(set(found["cuts"] or []) - {found["least"]})
    cuts, no_null = np.array(borders, np.int64), not found["nulls"]
    least, last = found["least"], len(borders)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid = np.asarray(batch.column(0).is_valid())
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            own = np.where(valid, np.searchsorted(cuts, ids, side="right"), 0)
            heads = np.flatnonzero(valid & (own > 0) & (cuts[np.maximum(own, 1) - 1] == ids)) if last else np.empty(0, int)
            first = np.flatnonzero(valid & (ids == least) if no_null else ~valid)
            take = np.concatenate([np.arange(len(ids)), heads, first])
            part = np.concatenate([own, own[heads] - 1, np.full(len(first), last)])
            extra = np.arange(len(take)) >= len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(extra), batch.column(0).take(pa.array(take)), batch.column(1).take(pa.array(take))],
                ["part", "extra", "id", "text"],
            )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # part, id, text, fingerprint of the document that waits for its next

        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("id", "n_chars", "edited", "own", "changed", "near_edited", "near_next")}
            for part, extra, i, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = fingerprint(text)
                if held is not None and held[0] == part:
                    changed = edited(held[2], text)
                    mark = fingerprint(changed)
                    for k, v in zip(out, (held[1], len(held[2]), changed, held[3], mark, likeness(held[3], mark), likeness(held[3], own))):
                        out[k].append(v)
                held = None if extra else (part, i, text, own)
            kinds = (batch.column(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    order = ["part", "extra", F.col("id").asc_nulls_first(), "text"]
    dealt = rows.mapInArrow(deal, f"part int, extra boolean, id {kind}, text string")
    made = dealt.repartition(partitions, "part").sortWithinPartitions(*order).mapInArrow(
        read,
        f"id {kind}, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
    return made.withColumnRenamed("id", id_col)

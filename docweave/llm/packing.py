"""Best-fit packing of token sequences with several capacities.

Documents become pieces of at most ``capacity`` tokens.  A bin has residual tokens,
document count and attention cost (the sum of squared lengths); a piece may enter a bin
only if every residual allows it.  Pieces come longest first; among the bins that can
take a piece, either the one whose weighted residual norm after placement is least
("norm"), or the one with the largest weighted dot product of piece and residual
("dot") gets it.  All parts are fractions of their capacity.

Pieces are dealt at random into groups of about ``group_size`` and each group is packed
by itself, so the work spreads over tasks and a group has a fixed bound; a group leaves
about one bin partly filled.

Defined cases: null text counts as empty (its end id alone); null or repeated ids and
repeated rows are packed row by row; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.bpe import byte_letters
from docweave.llm.wordcache import Remembered, give_back, held_by_worker
from docweave.session import cut

#: The printable letter of each byte in a byte-level vocabulary.
SHOWN = {b: c for c, b in byte_letters().items()}
#: Letters below U+0250, which are all composed, and ASCII marks.
LATIN = re.compile(r"((?:(?![\u00aa\u00b5\u00ba\u00d7\u00f7])[A-Za-z\u00c0-\u024f])+)([!-/:-@\[-`{-~]*)")


class Words:
    """Ids of a word-level tokenizer, whose words never hold a space.

    What the tokenizers library gives for a text is what it gives for the parts between
    its spaces and line feeds, so each distinct part is encoded once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        self.words = Remembered(self._word, 300_000)
        self.marks = Remembered(self._encode, 10_000)
        self.parts = Remembered(self._part, 300_000)

    def _encode(self, part: str) -> bytes:
        return array("I", self.own.encode(part, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        """A word of lower-case letters needs no more than the tokenizer's model."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(SHOWN)
        return array("I", [t.id for t in self.own.model.tokenize(shown)]).tobytes()

    def _part(self, part: str) -> bytes:
        # Latin letters, and marks behind them, are words of their own.
        found = LATIN.fullmatch(part)
        if found and (word := found[1].lower()).isalpha():
            return self.words[word] + (self.marks[found[2]] if found[2] else b"")
        return self._encode(part) if part else b""

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.parts.__getitem__, text.replace("\n", " ").split(" "))) if text else b""


@held_by_worker
def loaded(path: str) -> Words:
    return Words(path)


def pieces(
    docs: DataFrame,
    path: str,
    capacity: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Rows of id, piece, start, length, ids_crc32 and, if asked for, the ids as binary."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    end = array("I", [end_id]).tobytes()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                own = model.encode(text.as_py()) + end
                for k, lo in enumerate(range(0, len(own), 4 * capacity)):
                    part = own[lo : lo + 4 * capacity]
                    at.append(row)
                    piece.append(k)
                    start.append(lo // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
            columns = [
                batch.column(0).take(pa.array(at, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        give_back()

    made = rows.mapInArrow(
        split,
        f"id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""),
    )
    return made.withColumnRenamed("id", id_col)


def fill(
    lengths: np.ndarray,
    capacity: int,
    max_docs: int,
    max_attention: float,
    select: str = "norm",
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each piece of one group."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    shortest = float(lengths.min()) / capacity if n else 0.0
    w = np.asarray(weights, float)[:, None]
    left = np.empty((3, n))  # of the bins that are open
    names = np.empty(n, np.int64)
    used = np.empty(n, np.int64)
    live = made = 0
    for i in order:
        size = lengths[i]
        if size > capacity or size * size > max_attention or max_docs < 1:
            raise ValueError("a piece is larger than a bin")
        own = np.array([[size / capacity], [1.0 / max_docs], [size * size / max_attention]])
        best = -1
        if live:
            rest = left[:, :live] - own
            fits = (rest >= -1e-12).all(axis=0)
            if fits.any():
                if select == "dot":
                    score = -((w * own) * left[:, :live]).sum(axis=0)
                else:
                    score = (w * rest * rest).sum(axis=0)
                best = int(np.argmin(np.where(fits, score, np.inf)))
        if best < 0:
            best, live = live, live + 1
            left[:, best], names[best], used[best] = 1.0, made, 0
            made += 1
        bins[i], offsets[i] = names[best], used[best]
        left[:, best] -= own[:, 0]
        used[best] += size
        if left[0, best] < shortest - 1e-12 or left[1, best] < 0.5 / max_docs:  # nothing fits any more
            live -= 1
            left[:, best], names[best], used[best] = left[:, live], names[live], used[live]
    return bins, offsets


def pack(
    made: DataFrame,
    capacity: int = 4096,
    max_docs: int | None = None,
    max_attention: float | None = None,
    select: str = "norm",
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    group_size: int = 8192,
) -> DataFrame:
    """``made`` (with a column ``length``) with sequence_id and offset.

    ``max_docs`` and ``max_attention`` default to what the tokens alone allow.
    """
    docs, cost = max_docs or capacity, max_attention or float(capacity) ** 2
    kept = cut(made)
    groups = max(1, -(-kept.count() // group_size))
    dealt = kept.withColumn(
        "_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    )

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = list(frames)
        if not found:
            return
        group = pd.concat(found)
        group = group.sort_values(["length", *[c for c in ("ids_crc32",) if c in group]], ascending=False, kind="stable")
        bins, offsets = fill(group["length"].to_numpy(np.int64), capacity, docs, cost, select, weights)
        group["sequence_id"] = (group["_group"].to_numpy(np.int64) << 32) + bins
        group["offset"] = offsets
        yield group.drop(columns="_group")

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
    # one task for each group, whose size is bounded
    return dealt.repartitionById(groups, F.col("_group")).mapInPandas(packed, f"{fields}, sequence_id long, offset long")

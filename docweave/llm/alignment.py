"""Alignment of two tokenizers over the bytes of the same text.

A byte-level tokenizer A and a piece tokenizer B (which writes a space before a text) cut
the bytes of a space and the text.  Byte offsets where tokens of both end cut the tokens into
groups; inside a group each token of A is linked with the tokens of B whose bytes overlap its
own.  Over the corpus, the count of a pair of ids is the number of documents that link it.

The alignment of a stretch of bytes is a fragment: the tokens up to the first common end
(open prefix), the closed groups, and the tokens behind the last common end (open suffix).
``compose`` joins the fragments of two neighbouring stretches by closing what meets at their
border; it is associative and the fragment without tokens is its unit.  A long text is
cut into chunks of ``chunk_bytes`` at any byte, a token belonging to the chunk that it
starts in; chunks become fragments in tasks of their own, and rounds of grouping compose
``fan`` neighbours at a time until a document is one fragment.

Both tokenizers start anew at a single space or line feed between other characters, so a
text consists of cells, and what a cell gives is remembered.  A chunk is read with the cells
that its borders lie in; a border inside a cell of more than ``chunk_bytes`` moves to the
cell's end, so no byte is read by more than two chunks.

Documents carry their distinct pairs as packed numbers, in blocks of bounded size.  A block asks once for
each pair that any of its documents links; the answers go to the block, which adds up.  So the
shuffle holds a row for each block and pair, not for each document and pair.

Defined cases: a text that is null, empty, or whose joined bytes of A or B differ from the
space and the text has no tokens: zeros and the empty string.  Special tokens in a text are
plain text.  Rows are told apart by their place, so null and repeated ids and repeated rows are documents
of their own; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate, pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.bpe import byte_letters
from docweave.llm.wordcache import Remembered
from docweave.session import stored

#: Before a single space or line feed between other characters.
CELLS = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: A word of letters below U+0250 behind a space, and ASCII marks behind it.
PLAIN = re.compile(r"( (?:(?![\u00aa\u00b5\u00ba\u00d7\u00f7])[A-Za-z\u00c0-\u024f])+)([!-/:-@\[-`{-~]*)")
#: White space that isn't alone.
ODD = re.compile(r"\s\s")
NONE = np.empty((0, 2), np.int64)


class Closed(NamedTuple):
    """Groups between common ends: as text, their number, and the code of each link."""

    groups: str
    n_groups: int
    links: np.ndarray


class Fragment(NamedTuple):
    """Tokens are rows of id and end.  Without a common end, all tokens are in the head and ``closed`` is None."""

    head_a: np.ndarray
    head_b: np.ndarray
    closed: Closed | None
    tail_a: np.ndarray
    tail_b: np.ndarray


UNIT = Fragment(NONE, NONE, None, NONE, NONE)


def group_text(a: list[int], b: list[int]) -> str:
    if len(a) == len(b) == 1:
        return f"{a[0]}|{b[0]}"
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}"


def groups_of(ia: list[int], ea: list[int], ib: list[int], eb: list[int], base: int) -> tuple[list[str], list[int]]:
    """Groups and links of tokens (ids and ends) that start and end at common offsets."""
    i = j = last_i = last_j = 0
    links, texts = [], []
    while i < len(ia):
        links.append(ia[i] * base + ib[j])
        if ea[i] == eb[j]:
            i, j = i + 1, j + 1
            texts.append(group_text(ia[last_i:i], ib[last_j:j]))
            last_i, last_j = i, j
        elif ea[i] < eb[j]:
            i += 1
        else:
            j += 1
    return texts, links


def closed_groups(a: np.ndarray, b: np.ndarray, base: int) -> Closed:
    """Of tokens that start and end at common offsets."""
    texts, links = groups_of(*a.T.tolist(), *b.T.tolist(), base) if len(a) else ([], [])
    return Closed(";".join(texts), len(texts), np.array(links, np.int64))


def joined(*parts: Closed) -> Closed:
    some = [p for p in parts if p.n_groups]
    if len(some) < 2:
        return some[0] if some else Closed("", 0, np.empty(0, np.int64))
    return Closed(";".join(p.groups for p in some), sum(p.n_groups for p in some), np.concatenate([p.links for p in some]))


def fragment(a: np.ndarray, b: np.ndarray, base: int) -> Fragment:
    """Of the tokens in a stretch, which needn't start at a common offset."""
    common = np.intersect1d(a[:, 1], b[:, 1])
    if not len(common):
        return Fragment(a, b, None, NONE, NONE)
    (fa, la), (fb, lb) = (np.searchsorted(t[:, 1], common[[0, -1]], side="right") for t in (a, b))
    return Fragment(a[:fa], b[:fb], closed_groups(a[fa:la], b[fb:lb], base), a[la:], b[lb:])


def compose(x: Fragment, y: Fragment, base: int) -> Fragment:
    """The fragment of two neighbouring stretches."""
    own_a, own_b = (x.tail_a, x.tail_b) if x.closed else (x.head_a, x.head_b)
    middle = fragment(np.concatenate([own_a, y.head_a]), np.concatenate([own_b, y.head_b]), base)
    if middle.closed is None:  # then y has no common end either
        return Fragment(x.head_a, x.head_b, x.closed, middle.head_a, middle.head_b) if x.closed else middle
    tail = (y.tail_a, y.tail_b) if y.closed else (middle.tail_a, middle.tail_b)
    after = [y.closed] if y.closed else []
    if x.closed is None:
        return Fragment(middle.head_a, middle.head_b, joined(middle.closed, *after), *tail)
    first = closed_groups(middle.head_a, middle.head_b, base)  # a common offset is where it starts
    return Fragment(x.head_a, x.head_b, joined(x.closed, first, middle.closed, *after), *tail)


def whole(x: Fragment, base: int) -> Closed:
    """All groups of a document, whose start and end are common offsets."""
    first = closed_groups(x.head_a, x.head_b, base)
    return joined(first, x.closed) if x.closed else first


class Words(Remembered):
    def put(self, piece: str, made: tuple | None) -> None:
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[piece] = made


def one_word(path: str) -> Callable[[bytes], list[int]] | None:
    """Ids of the bytes of one word, from the ranks of the file's merges; None if merges don't have ranks of their own."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters, vocab = byte_letters(), model["vocab"]
    order = [c for c in letters if c in vocab] + ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if len(order) != len(set(order)) or len(letters) != sum(c in vocab for c in letters):
        return None
    ranks = {bytes(letters[c] for c in token): n for n, token in enumerate(order)}
    ids = [vocab[token] for token in order]
    own = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    return lambda word: [ids[n] for n in own._encode_single_piece(word)]


class Tokenizers:
    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.a_bytes = [bytes(letters.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.b_bytes = [self._piece(i) for i in range(self.b.vocab_size())]
        self.space = self.b.piece_to_id("▁")
        #: A link is the number a * base + b.
        self.base = self.b.vocab_size()
        if self.base * len(self.a_bytes) > 1 << 32:
            raise ValueError("the vocabularies are too large for links of 32 bits")
        self.size_a, self.size_b = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.cells = Remembered(self._cell, 20_000)
        #: By piece: the cell is the piece itself if it begins with a line feed, else a space and the piece.
        self.words = Words(lambda piece: self._cell(piece if piece[0] == "\n" else " " + piece), 80_000)
        self.quick = one_word(byte_path)
        self.tails = Remembered(self._tail, 10_000)
        #: What a piece of B may have behind a letter; other marks are always pieces apart.
        self.behind_letters = {y for i in range(self.base) if not self.b.is_byte(i) for x, y in pairwise(self.b.id_to_piece(i)) if x.isalpha()}
        self.marks = Remembered(lambda marks: self.a.encode(marks, add_special_tokens=False).ids, 10_000)

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _cell(self, cell: str, b: list[int] | None = None) -> tuple[str, bytes, int, int, int] | None:
        """Groups, links, and the numbers of tokens and groups; None if bytes differ."""
        if b is None:
            b = self.b.encode(cell[1:] if cell[0] == " " else cell)
            if cell[0] != " ":
                b = b[1:] if b[:1] == [self.space] else []
        own = cell.encode()
        found = PLAIN.fullmatch(cell) if self.quick else None
        if found:  # a word of letters, and marks behind it, are words of their own
            marks = found[2]
            a = self.quick(own[: len(own) - len(marks)]) + self.marks[marks] if marks else self.quick(own)
        else:
            a = self.a.encode(cell, add_special_tokens=False).ids
        ends_a, ends_b = list(accumulate([self.size_a[i] for i in a])), list(accumulate([self.size_b[i] for i in b]))
        if not ends_a or not ends_b or ends_a[-1] != len(own) or ends_b[-1] != len(own):
            return None
        if not found and not (b"".join([self.a_bytes[i] for i in a]) == own == b"".join([self.b_bytes[i] for i in b])):
            return None
        texts, links = groups_of(a, ends_a, b, ends_b, self.base)
        return ";".join(texts), array("I", links).tobytes(), len(a), len(b), len(texts)

    def _found(self, text: str) -> list[tuple | None]:
        """What each cell of a space and the text gives."""
        if not text or ODD.search(text) or text[0].isspace() or text[-1].isspace():  # only the pattern can tell the cells
            return list(map(self.cells.__getitem__, CELLS.split(" " + text)))
        words = self.words
        pieces = text.replace("\n", " \n").split(" ")
        new = [p for p in set(pieces) if p not in words and p not in words.old and p[0] != "\n"]
        if new:
            self._learn(new)
        return list(map(words.__getitem__, pieces))

    def _learn(self, new: list[str]) -> None:
        """Remember pieces; a word with marks behind it is put together from both, where they can be told apart."""
        words, apart, bare = self.words, [], []
        for piece in new:
            found = PLAIN.fullmatch(" " + piece) if self.quick else None
            if found and (marks := found[2]) and marks[0] not in self.behind_letters:
                apart.append((piece, piece[: -len(marks)], marks))
            else:
                bare.append(piece)
        own = {w: words.get(w) or words.old.get(w) for _, w, _ in apart}
        need = list(dict.fromkeys([*bare, *(w for w, made in own.items() if made is None)]))
        for word, b in zip(need, self.b.encode(need, num_threads=1) if need else []):
            own[word] = made = self._cell(" " + word, b)
            words.put(word, made)
        for piece, word, marks in apart:
            w, m = own[word], self.tails[marks]
            words.put(piece, w and m and (f"{w[0]};{m[0]}", w[1] + m[1], w[2] + m[2], w[3] + m[3], w[4] + m[4]))

    def _tail(self, marks: str) -> tuple[str, bytes, int, int, int] | None:
        """Marks behind a word: a line feed before them keeps B from writing a space."""
        b = self.b.encode("\n" + marks)
        return self._cell(marks, b[2:]) if b[:1] == [self.space] else None

    def of_text(self, text: str) -> tuple[Closed, int, int] | None:
        """All groups of a text, and its tokens; None if its bytes differ."""
        found = self._found(text)
        if None in found:
            return None
        groups, links, n_a, n_b, n_groups = zip(*found)
        return Closed(";".join(groups), sum(n_groups), np.frombuffer(b"".join(links), np.uint32)), sum(n_a), sum(n_b)

    def of_chunk(self, piece: str, start: int, low: int, high: int) -> Fragment | None:
        """The fragment of the bytes from ``low`` to ``high``; ``piece`` are the cells around, whose bytes begin at ``start``."""
        found, at = ([], []), start
        for text in CELLS.split(piece):
            cell = self.cells[text]
            if cell is None:
                return None
            groups = [g.split("|") for g in cell[0].split(";")]
            for k, (side, table) in enumerate(zip(found, (self.a_bytes, self.b_bytes))):
                ids = [int(i) for g in groups for i in g[k].split(",")]
                ends = list(accumulate((len(table[i]) for i in ids), initial=at))
                side += [(i, end) for i, begin, end in zip(ids, ends, ends[1:]) if low <= begin < high]
            at += len(text.encode())
        return fragment(*(np.array(side, np.int64).reshape(-1, 2) for side in found), self.base)


@functools.lru_cache(maxsize=1)
def loaded(byte_path: str, piece_path: str) -> Tokenizers:
    return Tokenizers(byte_path, piece_path)


def chunks(text: str, size: int) -> Iterator[tuple[str, int, int, int]]:
    """The cells around each chunk of a space and the text, where their bytes begin, and the chunk's own bytes."""
    cells = CELLS.split(" " + text)
    ends = np.cumsum([len(c.encode()) for c in cells])
    begins = np.concatenate([[0], ends[:-1]])
    borders, total = [0], int(ends[-1])
    while borders[-1] < total:
        border = borders[-1] + size
        if border < total:
            c = int(np.searchsorted(ends, border, side="right"))
            border = int(ends[c]) if ends[c] - begins[c] > size else border
        borders.append(min(border, total))
    for low, high in zip(borders, borders[1:]):
        first, last = np.searchsorted(ends, [low, high - 1], side="right")
        yield "".join(cells[first : last + 1]), int(begins[first]), low, high


def packed(links: np.ndarray) -> tuple[bytes, bytes]:
    """Distinct links and how often each occurs."""
    codes, times = np.unique(links.astype(np.uint32), return_counts=True)
    return codes.tobytes(), times.astype(np.uint32).tobytes()


FACTS = "n_a long, n_b long, n_groups long, groups_sha256 string, groups string, codes binary, times binary"
FRAGMENT = "ok boolean, n_a long, n_b long, head_a binary, head_b binary, groups string, n_groups long, links binary, tail_a binary, tail_b binary"


def facts(closed: Closed | None, n_a: int, n_b: int, keep_groups: bool) -> tuple:
    """The columns of FACTS."""
    if closed is None or not closed.n_groups:
        return 0, 0, 0, "", "" if keep_groups else None, b"", b""
    sha = hashlib.sha256(closed.groups.encode()).hexdigest()
    return n_a, n_b, closed.n_groups, sha, closed.groups if keep_groups else None, *packed(closed.links)


def as_row(x: Fragment | None, n_a: int, n_b: int) -> tuple:
    """The columns of FRAGMENT."""
    if x is None:
        return False, 0, 0, b"", b"", None, 0, b"", b"", b""
    c = x.closed
    own = (c.groups, c.n_groups, c.links.astype(np.uint32).tobytes()) if c else (None, 0, b"")
    return True, n_a, n_b, x.head_a.tobytes(), x.head_b.tobytes(), *own, x.tail_a.tobytes(), x.tail_b.tobytes()


def from_row(row) -> Fragment | None:
    if not row.ok:
        return None
    head_a, head_b, tail_a, tail_b = (np.frombuffer(x, np.int64).reshape(-1, 2) for x in (row.head_a, row.head_b, row.tail_a, row.tail_b))
    closed = None if row.groups is None else Closed(row.groups, row.n_groups, np.frombuffer(row.links, np.uint32))
    return Fragment(head_a, head_b, closed, tail_a, tail_b)


def fragments(parts: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """``parts`` (key, part, piece, start, low, high) as fragments."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = loaded(byte_path, piece_path)
        for frame in frames:
            rows = []
            for p in frame.itertuples():
                x = model.of_chunk(p.piece, p.start, p.low, p.high)
                n_a, n_b = (0, 0) if x is None else tokens_of(x, model.base)
                rows.append((p.key, p.part, *as_row(x, n_a, n_b)))
            yield pd.DataFrame(rows, columns=["key", "part", *[f.split()[0] for f in FRAGMENT.split(", ")]])

    return parts.select("key", "part", "piece", "start", "low", "high").mapInPandas(read, f"key long, part long, {FRAGMENT}")


def tokens_of(x: Fragment, base: int) -> tuple[int, int]:
    """How many tokens of A and B a fragment has."""
    inner = (0, 0)
    if x.closed and x.closed.n_groups:
        sides = re.split(r"[|;]", x.closed.groups)
        inner = tuple(sum(s.count(",") + 1 for s in sides[k::2]) for k in (0, 1))
    return len(x.head_a) + len(x.tail_a) + inner[0], len(x.head_b) + len(x.tail_b) + inner[1]


def composed(rows: pd.DataFrame, base: int) -> tuple:
    """Neighbouring fragments, in order, as one row of FRAGMENT."""
    rows = rows.sort_values("part")
    if not rows["ok"].all():
        return as_row(None, 0, 0)
    made = functools.reduce(lambda x, y: compose(x, y, base), map(from_row, rows.itertuples()), UNIT)
    return as_row(made, int(rows["n_a"].sum()), int(rows["n_b"].sum()))


def reduced(some: DataFrame, base: int, most: int, fan: int) -> DataFrame:
    """One fragment for each key: ``fan`` neighbours at a time; no key has more than ``most``."""
    names = [f.split()[0] for f in FRAGMENT.split(", ")]

    def up(group: pd.DataFrame) -> pd.DataFrame:
        own = group.iloc[0]
        return pd.DataFrame([(own["key"], own["part"] // fan, *composed(group, base))], columns=["key", "part", *names])

    while most > 1:
        some = some.groupBy("key", F.floor(F.col("part") / fan).alias("above")).applyInPandas(up, f"key long, part long, {FRAGMENT}")
        most = -(-most // fan)
    return some


def aligned(
    docs: DataFrame,
    byte_path: str,
    piece_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_groups: bool = False,
    chunk_bytes: int = 1 << 16,
    fan: int = 16,
    block_bytes: int = 4 << 20,
    block_rows: int = 4096,
) -> DataFrame:
    """One row for each document: its key, id, block, counts, groups and packed links."""
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    place = "part long, parts long, piece string, start long, low long, high long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(byte_path, piece_path)
        held = rows_held = block = 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            out = []
            for n, (key, text) in enumerate(zip(keys, batch.column(2))):
                text = text.as_py()
                if text and len(text) >= chunk_bytes // 4 and len(text.encode()) >= chunk_bytes:
                    cut = list(chunks(text, chunk_bytes))
                    out += [(n, key, -1 - key, p, len(cut), *c, *facts(None, 0, 0, False)) for p, c in enumerate(cut)]
                    continue
                got = model.of_text(text) if text else None
                own = facts(*(got or (None, 0, 0)), keep_groups)
                if held >= block_bytes or rows_held >= block_rows:
                    held, rows_held, block = 0, 0, block + 1
                held, rows_held = held + 2 * len(own[-1]), rows_held + 1
                out.append((n, key, ((key >> 33) << 24) + block, 0, 1, None, 0, 0, 0, *own))
            columns = list(zip(*out)) if out else [()] * (9 + 7)
            ids = batch.column(1).take(pa.array(columns[0], pa.int64()))
            kinds = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 6 + [pa.string()] * 2 + [pa.binary()] * 2
            made = [pa.array(c, k) for c, k in zip(columns[1:], kinds)]
            yield pa.RecordBatch.from_arrays([made[0], ids, *made[1:]], ["key", "id", "block", *[f.split()[0] for f in f"{place}, {FACTS}".split(", ")]])

    first = stored(rows.mapInArrow(read, f"key long, id {kind}, block long, {place}, {FACTS}"))
    short = first.where(F.col("piece").isNull())
    long = first.where(F.col("piece").isNotNull())
    most = long.agg(F.max("parts")).first()[0]
    names = [f.split()[0] for f in FACTS.split(", ")]
    short = short.select("key", "id", "block", *names)
    if most is None:
        return short
    base = loaded(byte_path, piece_path).base

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples():
                x = from_row(row)
                out.append((row.key, *facts(None if x is None else whole(x, base), row.n_a, row.n_b, keep_groups)))
            yield pd.DataFrame(out, columns=["key", *names])

    # chunks are dealt anew: those of one text lie in one file
    dealt = fragments(long.repartition("key", "part"), byte_path, piece_path)
    one = reduced(dealt, base, most, fan).mapInPandas(finish, f"key long, {FACTS}")
    heads = long.where("part = 0").select("key", "id", "block")
    return short.unionByName(stored(heads.join(one, "key")))


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", keep_groups: bool = False, **sizes) -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, ``groups``.

    ``n_best`` are its links whose pair has the largest count of all pairs with the same id of A.
    """
    made = aligned(docs, byte_path, piece_path, id_col, keep_groups=keep_groups, **sizes)
    base = loaded(byte_path, piece_path).base

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, codes = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for block in np.unique(blocks):
                own = b"".join(codes[i] for i in np.flatnonzero(blocks == block))
                found, n = np.unique(np.frombuffer(own, np.uint32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), block)), pa.array(found.astype(np.int64)), pa.array(n.astype(np.int64))], ["block", "code", "docs"])

    asked = stored(made.select("block", "codes").mapInArrow(ask, "block long, code long, docs long"))
    counts = asked.groupBy("code").agg(F.sum("docs").alias("n")).withColumn("a", F.expr(f"code div {base}"))
    top = counts.groupBy("a").agg(F.max("n").alias("most"))  # a row for each id of A, so no more than its vocabulary
    known = counts.join(F.broadcast(top), "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))
    told = asked.select("block", "code").join(known, "code")
    facts_of = ["n_a", "n_b", "n_groups", "groups_sha256", *(["groups"] if keep_groups else [])]
    kind = dict(made.dtypes)["id"]

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        code, at = np.unique(right["code"].to_numpy(), return_index=True)
        n, best = right["n"].to_numpy()[at], right["best"].to_numpy()[at]
        sums = []
        for codes, times in zip(left["codes"].to_pylist(), left["times"].to_pylist()):
            i, t = np.searchsorted(code, np.frombuffer(codes, np.uint32)), np.frombuffer(times, np.uint32).astype(np.int64)
            sums.append((int(t.sum()), int(t[best[i]].sum()), int((t * n[i]).sum())))
        out = left.select(["id", *facts_of])
        for name, column in zip(("n_links", "n_best", "count_sum"), zip(*sums)):
            out = out.append_column(name, pa.array(column, pa.int64()))
        return out

    schema = f"id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string" + (", groups string" if keep_groups else "")
    left = made.select("block", "id", *facts_of, "codes", "times").groupBy("block")

    summed = left.cogroup(told.groupBy("block")).applyInArrow(add, f"{schema}, n_links long, n_best long, count_sum long")
    last = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if keep_groups else [])]
    return summed.select(F.col("id").alias(id_col), *last)

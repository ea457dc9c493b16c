"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

The encoding of every prefix of a word ends in exactly one token.  An automaton over
the vocabulary names the tokens that are suffixes of the prefix, longest first; the
right one is the first that may follow the last token of the shorter prefix, that is,
for which merging would never have joined across the border of the pair.  The table of
last tokens then serves as back-pointers.

Words come from the tokenizer's split pattern.  A single space or line feed
between two other characters always starts a new word, so texts are cut there first and
the ids of each cut are remembered.

Defined cases: null counts as empty and has no ids; special tokens in a text become
their own ids; unused truncation and padding; ids are little-endian unsigned 32-bit
integers in one binary value.  Texts are read one by one, so repeated rows get equal ids, an
empty table gives an empty result, other columns are not read, and the memory for a long
text is its ids and a bounded store of parts.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.llm.wordcache import Remembered

#: White space by Unicode's property, and the split pattern of byte-level BPE.
WHITE = r"\t-\r\x20\x85\xa0  -     　"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class BytePairs:
    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        as_bytes = {token: bytes(letters[c] for c in token) for token in vocab}
        self.bytes_of = {i: as_bytes[token] for token, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.born = dict.fromkeys(vocab.values(), -1)  # the rank of the merge that makes a token
        self.halves: dict[int, tuple[int, int]] = {}
        for n, (a, b) in enumerate(spec["model"]["merges"]):
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            self.rank[pair], self.born[whole], self.halves[whole] = n, n, pair
        self.suffixes = ahocorasick.Automaton()
        for token, i in vocab.items():
            own = as_bytes[token]
            self.suffixes.add_word(own.decode("latin-1"), (len(own), i))
        self.suffixes.make_automaton()
        self.size_of = {i: len(b) for i, b in self.bytes_of.items()}
        self.follows: dict[tuple[int, int], bool] = {}
        self.words = regex.compile(WORDS)
        self.odd = re.compile(r"\s\s")  # what the standard library takes for white space is more than WHITE
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.known = Remembered(lambda word: array("I", self.word(word.encode("utf-8"))).tobytes(), 200_000)
        self.first = Remembered(self._piece, 20_000)
        self.later = Remembered(lambda piece: self._piece(piece if piece[:1] == "\n" else " " + piece), 200_000)

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens gives back this pair."""
        key = (left, right)
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > 300_000:
                self.follows.clear()
            known = self.follows[key] = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        # Take the merges apart from the last to the first.  Two tokens that meet at the
        # border do so until one of them is merged away; an earlier merge of the two joins them.
        rank, born, until = self.rank, self.born, 1 << 60
        while True:
            if rank.get((left, right), until) < until:
                return False
            if born[left] == born[right] == -1:
                return True
            if born[left] > born[right]:
                until, left = born[left], self.halves[left][1]
            else:  # of equal merges the left one comes first, so the same rank still joins
                until, right = born[right] + 1, self.halves[right][0]

    def word(self, word: bytes) -> list[int]:
        last: list[int | None] = [None] * (len(word) + 1)
        may_follow = self.may_follow
        for end, (size, token) in self.suffixes.iter(word.decode("latin-1")):
            end += 1
            if last[end] is None:
                before = last[end - size]
                if size == end or (before is not None and may_follow(before, token)):
                    last[end] = token
        ids, end, size_of = [], len(word), self.size_of
        while end:
            ids.append(token := last[end])
            end -= size_of[token]
        ids.reverse()
        return ids

    def _piece(self, piece: str) -> bytes:
        words = self.words.findall(piece)
        return self.known[words[0]] if len(words) == 1 else b"".join(map(self.known.__getitem__, words))

    def _plain(self, text: str) -> bytes:
        if self.odd.search(text):  # only the pattern can tell the words
            return self._words(text)
        pieces = text.replace("\n", " \n").split(" ")
        head = self.first[pieces[0]]
        return head + b"".join(map(self.later.__getitem__, pieces[1:]))

    def _words(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.words.findall(text)))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        out = []
        for part in self.cut.split(text):
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
            elif part:
                out.append(self._plain(part))
        return b"".join(out)

    def decode(self, ids: bytes | None) -> str:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids or b""))).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def loaded(path: str) -> BytePairs:
    return BytePairs(path)


def encode(text: Column, path: str) -> Column:
    """The ids of each text as binary."""

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = loaded(path)
        for texts in batches:
            yield pa.array((model.encode(t.as_py()) for t in texts), pa.binary())

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """The text of ids as made by :func:`encode`; bytes that aren't UTF-8 are replaced."""

    @F.arrow_udf("string")
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = loaded(path)
        for some in batches:
            yield pa.array((model.decode(i.as_py()) for i in some), pa.string())

    return text(ids)


def round_trip(text: Column, path: str) -> Column:
    """A struct of each text's ``ids`` and what those ids decode to, made by one worker."""

    @F.arrow_udf("struct<ids: binary, decoded: string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = loaded(path)
        for texts in batches:
            ids = [model.encode(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(map(model.decode, ids), pa.string())], ["ids", "decoded"])

    return both(text)

r"""Secrets in texts, confirmed by their structure.

Three base patterns are reported where they match.  Beyond them, runs that could be an
encoded key are decoded, and reported only if the bytes hold together:

- ``jwt``: a signed token whose header is a JSON object with an ``alg``, and whose
  payload is a JSON object;
- ``key``: base64 (in one line or wrapped) or hex of a DER private key (nested lengths fit exactly and the
  fields are those of PKCS#1, PKCS#8 or SEC 1) or of an ``openssh-key-v1`` blob whose
  length-prefixed fields fit; it may begin anywhere in a run, and its lengths tell its end;
- ``pem``: an armoured private key block whose body confirms in the same way.

A first pass with a linear-time matcher leaves out texts that hold no candidate; it lets
through everything that any later pattern could match.

Defined cases: null counts as empty and has no spans; spans are code points with an
exclusive end, by start and then by kind as listed in ``KINDS``; of one kind they never
overlap, of different kinds they may.  Texts are read one by one, so repeated rows get
equal spans, an empty table gives an empty result, other columns are not read, and a very
long text takes time and memory in proportion to its length.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "jwt", "key", "pem")
BASE = KINDS[:3]
SPANS = "array<struct<kind: string, start: int, end: int>>"

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is matched whole
# A run without a dot is tried from its start only, so a long one takes time in proportion.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{12,}+\.[A-Za-z0-9_-]{2,}+\.[A-Za-z0-9_-]*+")
#: Base64 over one line or several; a key may begin anywhere in it, and its lengths tell where it ends.
RUN = re.compile(r"[A-Za-z0-9+/_-]++(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)*+")
BREAK = re.compile(r"\r?\n[\x20\t]*")
HEX_RUN = re.compile(r"[0-9a-f]{80,}|[0-9A-F]{80,}")
#: Where the bytes of a sequence that begins with a number of one byte, or of an OpenSSH key, may begin.
BEGIN = re.compile(r"(?=M[A-H][A-Za-z0-9+/_-]C[A-Z]|MI[E-H][A-Za-z0-9+/_-][A-Za-z0-9+/_-]{4}|MI[I-L]|b3BlbnNzaC1rZXktdjEA)")
HEX_BEGIN = re.compile(r"(?=30(?:[0-7].|81..|82....)0201|6f70656e7373682d6b65792d763100)", re.I)
#: A key has no more bytes than a length of two bytes tells.
LONGEST = 0xFFFF + 4
ARMOUR = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
#: Holds wherever one of the above does.
MAYBE = (
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
    r"|[A-Za-z0-9_-]{12}\.[A-Za-z0-9_-]{2}[A-Za-z0-9_-]*\.|[A-Za-z0-9+/_-]{40}|[0-9A-F]{80}|-----BEGIN "
    r"|M[A-I][A-Za-z0-9+/_-]{2,}\r?\n|b3BlbnNzaC1rZXktdjEA"
)


def from_base64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_fields(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """Tags and contents that fill ``data`` exactly, or None; nested ones must fit too."""
    fields, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            more = size & 0x7F
            if not 1 <= more <= 4 or at + more > len(data):
                return None
            size, at = int.from_bytes(data[at : at + more], "big"), at + more
        if at + size > len(data):
            return None
        content = data[at : at + size]
        if tag & 0x20 and (depth > 8 or der_fields(content, depth + 1) is None):
            return None
        fields.append((tag, content))
        at += size
    return fields


def is_private_key(data: bytes) -> bool:
    if data.startswith(b"openssh-key-v1\0"):
        return _openssh(data)
    top = der_fields(data) if data[:1] == b"\x30" else None
    if not top or len(top) != 1:
        return False
    fields = der_fields(top[0][1]) or []
    tags = [tag for tag, _ in fields]
    if not tags or tags[0] != 0x02 or len(fields[0][1]) != 1:
        return False
    if tags[:3] == [0x02, 0x30, 0x04]:  # PKCS#8: version, algorithm, key
        inner = der_fields(fields[1][1]) or []
        return bool(inner) and inner[0][0] == 0x06
    if tags[:2] == [0x02, 0x04] and fields[0][1] == b"\x01":  # SEC 1
        return len(fields[1][1]) >= 16
    return len(tags) >= 6 and set(tags) == {0x02}  # PKCS#1 and DSA


def _openssh(data: bytes) -> bool:
    return openssh_size(lambda at, n: data[at : at + n]) is not None


Read = Callable[[int, int], bytes]


def openssh_size(read: Read) -> int | None:
    """How many bytes the length-prefixed fields of an ``openssh-key-v1`` blob take; None if they don't fit."""
    at = len(b"openssh-key-v1\0")

    def field(least: int) -> bool:
        nonlocal at
        head = read(at, 4)
        size = int.from_bytes(head, "big")
        at += 4 + size
        return len(head) == 4 and least <= size <= LONGEST and (not size or len(read(at - 1, 1)) == 1)

    if not all(field(0) for _ in range(3)):  # cipher, kdf and its options
        return None
    head = read(at, 4)
    keys, at = int.from_bytes(head, "big"), at + 4
    return at if len(head) == 4 and 1 <= keys <= 16 and all(field(1) for _ in range(keys + 1)) else None


def der_size(read: Read) -> int | None:
    """How many bytes a sequence takes whose fields fit like those of a private key; it is read header by header."""

    def header(at: int) -> tuple[int, int, int] | None:
        head = read(at, 4)
        if len(head) < 2:
            return None
        size, own = head[1], 2
        if size >= 0x80:
            more = size & 0x7F
            if not 1 <= more <= 2 or len(head) < 2 + more:
                return None
            size, own = int.from_bytes(head[2 : 2 + more], "big"), 2 + more
        return head[0], at + own, at + own + size

    top = header(0)
    if top is None or top[0] != 0x30:
        return None
    _, at, end = top
    for n in range(16):  # none of the kinds has more fields
        field = header(at)
        if field is None or field[2] > end or (n == 0 and (field[0] != 0x02 or field[2] - field[1] != 1)):
            return None
        at = field[2]
        if at == end:
            return end if len(read(end - 1, 1)) == 1 else None
    return None


def base64_reader(text: str, start: int) -> Read:
    """Bytes by place of the base64 that begins at ``start``; fewer where it ends."""

    def read(at: int, n: int) -> bytes:
        first, last = at // 3, -(-(at + n) // 3)
        part = text[start + 4 * first : start + 4 * last]
        data = from_base64(part if len(part) % 4 != 1 else part[:-1]) or b""
        return data[at - 3 * first : at - 3 * first + n]

    return read


def hex_reader(text: str, start: int, end: int) -> Read:
    def read(at: int, n: int) -> bytes:
        part = text[start + 2 * at : min(start + 2 * (at + n), end)]
        return bytes.fromhex(part if len(part) % 2 == 0 else part[:-1])

    return read


def key_size(read: Read) -> int | None:
    """How many bytes the private key at the reader's start takes; None if there is none."""
    size = openssh_size(read) if read(0, 15) == b"openssh-key-v1\0" else der_size(read)
    return size if size and size <= LONGEST and is_private_key(read(0, size)) else None


def keys_in(text: str) -> list[tuple[int, int]]:
    """Places of private keys in base64 or hex, wherever in a run they begin; of those that overlap the first."""
    found = []
    for run in RUN.finditer(text):
        if run.end() - run.start() < 40:
            continue
        breaks = [(m.start(), m.end()) for m in BREAK.finditer(text, run.start(), run.end())]
        body, places = run[0], None
        if breaks:  # the place in the text of each stretch between breaks, by its place in the body
            body = BREAK.sub("", body)
            cuts = [run.start(), *(end for _, end in breaks)]
            lens = [b - a for a, b in zip(cuts, [*(start for start, _ in breaks), run.end()])]
            places = ([0, *accumulate(lens)][:-1], cuts)

        def place(k: int, places=places, run=run) -> int:
            if places is None:
                return run.start() + k
            line = bisect_right(places[0], k) - 1
            return places[1][line] + k - places[0][line]

        done = 0
        for m in BEGIN.finditer(body):
            if m.start() < done or (size := key_size(base64_reader(body, m.start()))) is None:
                continue
            done = m.start() + -(-8 * size // 6)
            end = place(done - 1) + 1
            pad = -(done - m.start()) % 4
            end += len(text[end : end + pad]) - len(text[end : end + pad].lstrip("="))
            found.append((place(m.start()), end))
    for run in HEX_RUN.finditer(text):
        upto = run.start()
        for m in HEX_BEGIN.finditer(text, run.start(), run.end()):
            if m.start() < upto:
                continue
            size = key_size(hex_reader(text, m.start(), run.end()))
            if size and all(m.start() + 2 * size <= s or m.start() >= e for s, e in found):
                upto = m.start() + 2 * size
                found.append((m.start(), upto))
    return found


def is_signed_token(text: str) -> bool:
    for n, part in enumerate(text.split(".")[:2]):
        try:
            value = json.loads(from_base64(part) or b"")
        except (ValueError, RecursionError):
            return False
        if not isinstance(value, dict) or (n == 0 and not isinstance(value.get("alg"), str)):
            return False
    return True


def find(text: str) -> list[tuple[int, int, int]]:
    """Start, number of the kind, and end of each span in a text, in order."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans += [(m.start(), 3, m.end()) for m in TOKEN.finditer(text) if is_signed_token(m[0])]
    armoured = []
    for m in ARMOUR.finditer(text):
        data = from_base64("".join(m[2].split()))
        if data and is_private_key(data):
            armoured.append((m.start(), 5, m.end()))
    # a key within its armour is told once
    spans += [(a, 4, b) for a, b in keys_in(text) if all(b <= s or a >= e for s, _, e in armoured)]
    return sorted(spans + armoured)


def secret_spans(text: Column) -> Column:
    """An array of kind, start and end for each text."""

    @F.arrow_udf(SPANS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for texts in batches:
            maybe = pc.fill_null(pc.match_substring_regex(texts, MAYBE), False)
            offsets, kinds, starts, ends = [0], [], [], []
            for candidate, value in zip(maybe.to_pylist(), texts):
                if candidate:
                    for start, k, end in find(value.as_py()):
                        kinds.append(KINDS[k])
                        starts.append(start)
                        ends.append(end)
                offsets.append(len(kinds))
            flat = pa.StructArray.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], fields=list(kind)
            )
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)

    return scan(text)


def cover(text: str, starts: list[int], ends: list[int], mark: str = "[secret]") -> str:
    """The text with each stretch that spans (in order of their starts) cover replaced by ``mark``."""
    out, upto = [], 0
    for start, end in zip(starts, ends):
        if start >= upto and end > start:
            out += [text[upto:start], mark]
        upto = max(upto, end)
    return "".join(out) + text[upto:]


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text without what spans cover; texts without spans stay as they were."""

    @F.arrow_udf("string")
    def made(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, starts, ends in batches:
            rows = zip(texts, starts, ends)
            yield pa.array([cover(t.as_py(), a.as_py(), b.as_py(), mark) if t.is_valid else None for t, a, b in rows], pa.string())

    some = F.size(spans) > 0
    return F.when(some, made(F.when(some, text), spans["start"], spans["end"])).otherwise(text)


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


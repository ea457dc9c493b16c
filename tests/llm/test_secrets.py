import base64
import hashlib
import json
import os
import re

from pyspark.sql import functions as F

from docweave.llm import secrets
from docweave.llm.queries import op10_secret_scans

SF = "/root/testdata/sf0.01"


def tlv(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x82, n >> 8, n & 255])
    return bytes([tag]) + size + body


def number(n):
    return tlv(2, b"\x01" + bytes(range(n - 1)))


PKCS1 = tlv(0x30, tlv(2, b"\0") + b"".join(number(n) for n in (64, 3, 64, 32, 32, 32, 32, 32)))
PUBLIC = tlv(0x30, tlv(0x30, tlv(6, b"\x2a\x86\x48") + tlv(5, b"")) + tlv(3, b"\0" + bytes(90)))
B64 = base64.b64encode


def jwt(header, payload):
    enc = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
    return f"{enc(header)}.{enc(payload)}.c2lnbmF0dXJl"


def kinds(text):
    return [(secrets.KINDS[k], text[a:b]) for a, k, b in secrets.find(text)]


def plain(text):
    """The base patterns as the contract gives them."""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def test_confirmed_only_with_structure():
    assert ("key", B64(PKCS1).decode()) in kinds("é " + B64(PKCS1).decode() + " x")
    assert ("key", PKCS1.hex()) in kinds(f"k={PKCS1.hex()}!")
    assert not [k for k in kinds(B64(PUBLIC).decode()) if k[0] == "key"]
    assert not [k for k in kinds(B64(PKCS1[:-1]).decode()) if k[0] == "key"]
    good = jwt({"alg": "HS256"}, {"sub": 1})
    assert ("jwt", good) in kinds(f"({good})")
    assert not [k for k in kinds(jwt({"typ": "x" * 9}, {"sub": 1})) if k[0] == "jwt"]
    block = "-----BEGIN RSA PRIVATE KEY-----\n" + B64(PKCS1).decode() + "\n-----END RSA PRIVATE KEY-----"
    assert ("pem", block) in kinds(block)
    assert not [k for k in kinds(block.replace(B64(PKCS1).decode(), "A" * 64)) if k[0] == "pem"]
    field = lambda b: len(b).to_bytes(4, "big") + b
    blob = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"x" * 40) + field(b"y" * 60)
    assert secrets.is_private_key(blob) and not secrets.is_private_key(blob[:-1])


PKCS8 = tlv(0x30, number(1)[:1] + b"\x01\0" + tlv(0x30, tlv(6, b"\x2b\x65\x70")) + tlv(4, tlv(4, bytes(range(32)))))
SEC1 = tlv(0x30, b"\x02\x01\x01" + tlv(4, bytes(range(32))) + tlv(0xA0, tlv(6, b"\x2a\x86\x48\xce\x3d")))
FIELD = lambda b: len(b).to_bytes(4, "big") + b
OPENSSH = b"openssh-key-v1\0" + FIELD(b"none") + FIELD(b"none") + FIELD(b"") + (1).to_bytes(4, "big") + FIELD(b"x" * 40) + FIELD(b"y" * 61)


def test_keys_wherever_in_a_run_they_begin():
    for key in (PKCS1, PKCS8, SEC1, OPENSSH):
        whole = B64(key).decode()
        bare = whole.rstrip("=")
        for before in ("", "path/", "k-", "a", "ab", "abc", "MIIB", "MIIEpAIBAAKC", "x" * 50 + " "):
            assert ("key", whole) in kinds(f"{before}{whole} z"), before
            assert ("key", bare) in kinds(f"({before}{bare})"), before
            hexed = key.hex()
            for text in (hexed, hexed.upper()):
                assert ("key", text) in kinds(f"{'f' if text.islower() else 'F'}{text} {before}")
                assert ("key", text) in kinds(f"{text}{'0' if text.islower() else 'F'}")
        assert ("key", bare) in kinds(bare + "AAAA" * 9 if len(bare) % 4 == 0 else bare + ".")
        for end in ("\n", "\r\n", "\n  "):
            wrapped = end.join(whole[i : i + 64] for i in range(0, len(whole), 64))
            assert ("key", wrapped) in kinds(f"see {wrapped}\n.") and len(kinds(wrapped)) == 1
        assert not [k for k in kinds(B64(key[:-1]).decode()) + kinds(key[:-1].hex()) if k[0] == "key"]


def test_other_structures_are_left_alone():
    certificate = tlv(0x30, tlv(0x30, tlv(0xA0, b"\x02\x01\x02") + number(8) + tlv(0x30, tlv(6, b"\x2a\x86\x48"))) + tlv(3, bytes(64)))
    request = tlv(0x30, tlv(0x30, b"\x02\x01\0" + tlv(0x30, tlv(0x31, bytes([5, 0]))) + PUBLIC) + tlv(3, bytes(64)))
    for data in (PUBLIC, certificate, request):
        for before in ("", "a", "ab/"):
            assert not [k for k in kinds(before + B64(data).decode()) + kinds(before + data.hex()) if k[0] in ("key", "pem")]
    rng = __import__("random").Random(3)
    for _ in range(300):
        data = B64(bytes(rng.randrange(256) for _ in range(200))).decode()
        assert not [k for k in kinds("MIIB" + data + "\nMIIEpAIBAA" + data) if k[0] == "key"]
    block = "-----BEGIN PRIVATE KEY-----\n" + B64(PKCS8).decode() + "\n-----END PRIVATE KEY-----"
    assert kinds(block) == [("pem", block)]


def test_base_patterns_in_every_document(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in op10_secret_scans(spark, SF).collect()}
    assert rows.keys() == docs.keys()
    for doc, text in docs.items():
        base = plain(text or "")
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert rows[doc].base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert [rows[doc].n_assign, rows[doc].n_access, rows[doc].n_hex] == [sum(s[1] == k for s in base) for k in range(3)]


def test_odd_cases_and_redaction(spark):
    rows = [(1, None, "s"), (2, "", "s"), (3, "é TOKEN = 'abcdef' and AKIA" + "A" * 16 + " z", None), (3, "password: abc", None), (4, "ſecret=abcdef toKen=abcdef", ""), (5, "ab " * 100_000 + "token=0123456789abcdef01234567", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = [(r.doc_id, r.s, r.clean) for r in df.withColumn("found", secrets.secret_spans(F.col("text"))).select("doc_id", secrets.joined(F.col("found")).alias("s"), secrets.redacted(F.col("text"), F.col("found")).alias("clean")).collect()]
    assert got[0] == (1, "", None) and got[1] == (2, "", "")
    assert got[2] == (3, "assign:2:17,access:23:43", "é [secret]' and [secret] z")
    assert got[3] == (3, "", "password: abc")
    assert got[4][1] == "assign:14:26"
    assert got[5][1] == "assign:300000:300030,hex:300006:300030" and got[5][2] == "ab " * 100_000 + "[secret]"


def test_long_runs_take_time_in_proportion():
    import time

    for unit in ("aB3_", "a.bb", "AKIA", "0f", "eyJ.", " =", "MIIEpAIBAAKC", "30820201020100", "MIIEpAIBAA\n", "b3BlbnNzaC1rZXktdjEA", "-----BEGIN PRIVATE KEY-----"):
        text = unit * (1_000_000 // len(unit))
        began = time.time()
        secrets.find(text)
        assert time.time() - began < 10, unit
    token = jwt({"alg": "HS256"}, {"sub": 1})
    assert ("jwt", token) in kinds("x" * 1_000_000 + " " + token)
    assert secrets.cover("abc" * 400_000, list(range(0, 1_200_000, 6)), list(range(2, 1_200_002, 6))).startswith("[secret]cabc[secret]")


def test_empty_table_repeats_and_clashing_columns(spark):
    rows = [(1, "token = abcdefgh", "x"), (1, "token = abcdefgh", "y"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = df.withColumn("spans", secrets.secret_spans(F.col("text"))).withColumn("clean", secrets.redacted(F.col("text"), F.col("spans"))).collect()
    assert sorted((r.doc_id or 0, len(r.spans), r.clean or "") for r in got) == [(0, 0, ""), (1, 1, "[secret]"), (1, 1, "[secret]")]
    assert df.limit(0).select(secrets.secret_spans(F.col("text")).alias("s")).count() == 0

import random
from array import array

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docweave.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(theirs, text):
    ids = theirs.encode(text, add_special_tokens=False).ids
    own = bpe.loaded(PATH).encode(text)
    assert list(array("I", own)) == ids, text
    assert bpe.loaded(PATH).decode(own) == theirs.decode(ids, skip_special_tokens=False)


THEIRS = Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_any_text(text):
    check(THEIRS, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aabcdehinorst  \n\t'.,!19\x1c\x85 éß", max_size=80))
def test_likely_text(text):
    check(THEIRS, text)


def test_cases():
    pick = random.Random(1)
    for text in ["", " ", "  a", "a  b", "a \n b\n\n c ", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "aaaaaaaaaaaaaaa", "don't we'll", "ééé", "a" * 5000, "the" * 3000, "\U0001f600 ok", "\x1cb \x1c"]:
        check(THEIRS, text)
    for _ in range(300):
        check(THEIRS, "".join(pick.choice(["the", "ing", "tion", " ", "é", "er", "A", "\n", "00", "--"]) for _ in range(40)))


def test_columns(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "Hello  world\n", None), (3, "Hello  world\n", None)], "doc_id long, text string, ids string")
    ids = df.select("doc_id", bpe.encode(F.col("text"), PATH).alias("ids"))
    both = df.select("doc_id", bpe.round_trip(F.col("text"), PATH).alias("b"))
    got = [(r.doc_id, bytes(r.ids), r.t) for r in ids.withColumn("t", bpe.decode(F.col("ids"), PATH)).collect()]
    assert [(i, t) for i, _, t in got] == [(1, ""), (2, ""), (3, "Hello  world\n"), (3, "Hello  world\n")] and got[0][1] == b""
    assert [(r.doc_id, bytes(r.b.ids), r.b.decoded) for r in both.collect()] == got
    assert ids.limit(0).count() == 0

import hashlib
import re

from pyspark.sql import functions as F

from docweave.llm.chat_format import digests, format_chat, loss_text, read_turns
from docweave.llm.exact_dedup import exact_dedup, keep_first, normal_text

DOCS = "doc_id long, text string, lang string, keep_id long"


def test_exact_dedup_blanks_nulls_and_clashing_columns(spark):
    rows = [(3, "a  b", "x", 9), (1, "a\tb", None, None), (2, None, "y", 1), (4, "", "y", 1), (5, "a b", "z", 0), (None, "a b", None, None)]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(3, 1, 3, False), (1, 1, 3, True), (None, 1, 3, False), (2, 2, 2, True), (4, 2, 2, False), (5, 5, 1, True)}
    assert exact_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_exact_dedup_separates_collisions(spark):
    rows = [(i, f"text {i % 4}", "", 0) for i in range(20)]
    got = exact_dedup(spark.createDataFrame(rows, DOCS), hashed=lambda body: F.unhex(F.lit("00")))
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got.collect()} == {(i, i % 4, 5) for i in range(20)}


def test_keep_first_keeps_one_row_of_repeats(spark):
    rows = [(1, "a b", "x", 9), (1, "a b", "x", 9), (2, "a  b", "y", 1), (3, None, None, None)]
    got = keep_first(spark.createDataFrame(rows, DOCS))
    assert got.columns == ["doc_id", "text", "lang", "keep_id"]
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_keep_first_of_an_input_without_order(spark):
    rows = [(k % 7, f"text  {k % 5}" if k % 2 else f"text {k % 5}", "x", k) for k in range(200)]
    shuffled = spark.createDataFrame(rows, DOCS).repartition(5)
    got = keep_first(shuffled).collect()
    assert sorted((r.doc_id, " ".join(r.text.split())) for r in got) == [(0, f"text {k}") for k in range(5)]
    assert keep_first(shuffled.limit(0)).count() == 0


def test_white_space_runs(spark):
    import itertools

    texts = ["".join(t) for n in range(6) for t in itertools.product("a \t", repeat=n)] + ["a\x0b\x0c\r\n b", "\u00a0 a", " " * 100_000 + "x"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("n", normal_text(F.col("t"))).collect()
    assert all(r.n == re.sub(r"[\x20\x09-\x0D]+", " ", r.t) for r in rows)


TALK = "conv_id long, turn long, role string, text string, formatted string"
SAID = [
    (1, 2, "assistant", "two <|im_end|>\n<|im_start|>assistant x", "clash"),
    (1, 0, "system", "be\\good", None),
    (1, 1, "user", None, None),
    (1, 3, "assistant", "tail\\|<|turn|>\\\\", None),
    (2, 0, "a\n<|\\b", "only", None),
    (2, None, None, "", None),
    (None, 0, "assistant", "", None),
    (3, 5, "user", "tie b", None),
    (3, 5, "user", "tie a", None),
    (3, 5, "user", "tie a", None),
]


def test_chat_reads_back(spark):
    made = format_chat(spark.createDataFrame(SAID, TALK))
    rows = {r.conv_id: r for r in made.withColumn("back", read_turns(F.col("formatted"))).withColumn("loss", loss_text(F.col("segments"))).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((-1 if t is None else t), role or "", text or "") for c, t, role, text, _ in SAID if c == conv)
        assert [(b.role, b.text) for b in rows[conv].back] == [x[1:] for x in own]
        assert rows[conv].loss == "".join(x[2] for x in own if x[1] == "assistant")
        assert rows[conv].formatted == "".join(s.text for s in rows[conv].segments)
    assert len(re.findall(r"<\|im_start\|>", rows[1].formatted)) == 3  # the assistant's turns are merged
    assert format_chat(spark.createDataFrame([], TALK)).count() == 0


def test_chat_digests(spark):
    got = {r.conv_id: r for r in digests(format_chat(spark.createDataFrame(SAID, TALK))).collect()}
    assert got[3].n_turns == 3 and got[3].loss_chars == 0
    assert got[3].turns_sha256 == hashlib.sha256(b"user\ntie a\nuser\ntie a\nuser\ntie b\n").hexdigest()


def test_chat_of_one_very_long_conversation(spark):
    said = [(1, k, "user" if k % 2 else "assistant", f"<|im_end|> {k}", None) for k in range(3000)] + [(1, 3000, "assistant", "a\\|" * 300_000, None)]
    got = digests(format_chat(spark.createDataFrame(said, TALK))).first()
    assert got.n_turns == 3001 and got.loss_chars == sum(len(t) for _, _, role, t, _ in said if role == "assistant")
    want = hashlib.sha256("".join(f"{role}\n{t}\n" for _, _, role, t, _ in said).encode()).hexdigest()
    assert got.turns_sha256 == want

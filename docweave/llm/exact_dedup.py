"""Exact duplicates of texts, up to runs of ASCII white space.

The grouping key is a 128-bit digest together with the bytes themselves, so Spark
compares bytes inside each digest group and a collision makes two groups.  The
aggregation is partial on the map side: a text that fills a third of the table
leaves each task as one row.  Rows then find their group by digests only, so the
texts are shuffled once.

Defined cases: a null text counts as empty; a null id sorts after all others (the
group's id is null only if all its ids are); rows that repeat an id and its text
are one document, counted in ``group_size`` and sharing ``kept``; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.session import stored

#: Runs of ASCII white space that aren't one space already; nothing else counts as white space.
BLANKS = r"[\x09-\x0D][\x20\x09-\x0D]*+|\x20[\x20\x09-\x0D]++"


def normal_text(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def content_hash(text: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(text))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    hashed: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(id_col).alias("id"), normal_text(F.col(text_col)).alias("body"))
    rows = rows.select("id", "body", hashed(F.col("body")).alias("digest"))
    groups = (
        rows.groupBy("digest", "body")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", F.unhex(F.sha2("body", 256)).alias("full"), "keep_id", "group_size")
    )
    slim = rows.select("id", "digest", F.unhex(F.sha2("body", 256)).alias("full"))
    return slim.join(groups, ["digest", "full"]).select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("full")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", files: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; one row where an id repeats.

    Repeated ids are told apart by a number of the row, which must be the same whenever the
    row is read.  ``files`` says that ``docs`` is read from files and so gives the same rows in
    the same order again; any other input is stored with its numbers first.
    """
    held = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("n"))
    held = held if files else stored(held)
    body = normal_text(F.col(f"row.{text_col}"))
    d = held.select("row", F.col(f"row.{id_col}").alias("id"), content_hash(body).alias("digest"), body.alias("body"), "n")
    first = d.groupBy("digest", "body").agg(
        F.min(F.struct(F.col("id").isNull(), "id", "n")).alias("first")
    )
    stay = first.select(F.col("first.n").alias("n"))
    return d.select("row", "n").join(stay, "n", "left_semi").select("row.*")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body
  FROM documents
), g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept,
       sha256(t.body) AS text_sha256
FROM t JOIN g ON t.body = g.body
"""

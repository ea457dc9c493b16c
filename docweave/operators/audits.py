"""Audits and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.operators.evidence import citation_codes, markers


def corpus_counts(files: DataFrame, documents: DataFrame, chunks: DataFrame, skipped: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """Rows of what, detail and n."""
    whole = [rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), F.lit("").alias("detail"), "n") for name, rows in (("files", files), ("documents", documents), ("chunks", chunks))]
    by = [rows.groupBy(F.lit(name).alias("what"), F.col(c).alias("detail")).agg(F.count(F.lit(1)).alias("n")) for name, rows, c in (("skipped", skipped, "reason"), ("diagnostics", diagnostics, "code"))]
    found = whole[0]
    for rows in [*whole[1:], *by]:
        found = found.unionByName(rows)
    return found


def citation_audit(answers: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of answer_id, finding and display_index.

    missing: a marker without a citation; unreferenced: the other way; duplicate: an index twice, or
    each index of an id that occurs twice; malformed and non_official: by the citation's codes.
    """
    said = markers(answers).select("answer_id", "display_index").distinct()
    held = found.groupBy("answer_id", "display_index").agg(F.count(F.lit(1)).alias("n"))
    both = said.withColumn("_said", F.lit(True)).join(held, ["answer_id", "display_index"], "full_outer")
    pairs = both.select("answer_id", "display_index", F.when(F.col("n").isNull(), "missing").when(F.col("_said").isNull(), "unreferenced").alias("finding"), (F.col("n") > 1).alias("twice"))
    ids = found.groupBy("answer_id", "citation_id").agg(F.count(F.lit(1)).alias("n"), F.collect_set("display_index").alias("at"))
    repeated = ids.where("n > 1").select("answer_id", F.explode("at").alias("display_index"))
    codes = found.select("answer_id", "display_index", citation_codes().alias("codes"))
    only = lambda c: F.when(F.array_contains("codes", "bad_url"), "non_official") if c else F.when(F.size(F.array_remove("codes", "bad_url")) > 0, "malformed")
    parts = [
        pairs.where("finding IS NOT NULL").select("answer_id", "finding", "display_index"),
        pairs.where("twice").select("answer_id", F.lit("duplicate").alias("finding"), "display_index"),
        repeated.select("answer_id", F.lit("duplicate").alias("finding"), "display_index"),
        codes.select("answer_id", only(True).alias("finding"), "display_index").where("finding IS NOT NULL"),
        codes.select("answer_id", only(False).alias("finding"), "display_index").where("finding IS NOT NULL"),
    ]
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    return rows.distinct()


def grams(text: Column, size: int) -> Column:
    """The distinct stretches of ``size`` characters."""
    last = F.length(text) - size + 1
    each = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(size)))
    return F.when(last > 0, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def holding(texts: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id and chunk_id of every text that holds the whole text of a question.

    They meet on the question's longest inner word, which is a whole word of any text that holds it; a
    question of fewer than three words has none and meets on its first three characters (or all of them).
    """
    words = F.split("text", r"[\s]+")
    inner = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.length(w) > 0)
    key = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = questions.where("text != ''").select("question_id", F.col("text").alias("asked"), key.alias("word"))
    there = texts.select("chunk_id", F.explode(F.array_distinct(words)).alias("word"))
    met = there.join(asked.where("word IS NOT NULL").select("question_id", "word"), "word").select("chunk_id", "question_id")
    for size in (1, 2, 3):
        own = asked.where("word IS NULL").where(F.least(F.length("asked"), F.lit(3)) == size)
        own = own.select("question_id", F.substring("asked", 1, size).alias("gram"))
        each = texts.select("chunk_id", F.explode(grams(F.col("text"), size)).alias("gram"))
        met = met.unionByName(each.join(own, "gram").select("chunk_id", "question_id"))
    return met.join(texts, "chunk_id").join(asked, "question_id").where(F.contains("text", F.col("asked"))).select("question_id", "chunk_id").distinct()


def retrieval_quality(matches: DataFrame, truth: DataFrame, k: int = 10) -> DataFrame:
    """One row: questions with a truth, hits at 1 and at k, and the mean reciprocal rank."""
    hit = matches.join(truth, ["question_id", "chunk_id"]).groupBy("question_id").agg(F.min("rank").alias("rank"))
    rows = truth.select("question_id").distinct().join(hit, "question_id", "left")
    return rows.agg(
        F.count(F.lit(1)).alias("n_questions"),
        F.coalesce(F.avg((F.coalesce("rank", F.lit(k + 1)) == 1).cast("double")), F.lit(0.0)).alias("hit_at_1"),
        F.coalesce(F.avg((F.coalesce("rank", F.lit(k + 1)) <= k).cast("double")), F.lit(0.0)).alias("hit_at_k"),
        F.coalesce(F.avg(F.when(F.col("rank") <= k, 1.0 / F.col("rank")).otherwise(F.lit(0.0))), F.lit(0.0)).alias("mrr"),
    )


def revision_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents (document_id, content_hash) that were added, removed or changed."""
    a, b = old.select("document_id", F.col("content_hash").alias("_old")), new.select("document_id", F.col("content_hash").alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return a.join(b, "document_id", "full_outer").select("document_id", change.alias("change")).where("change IS NOT NULL")


def changed_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks of the new corpus that the old one lacks, rows as wholes."""
    return new.select("chunk_id", "content").exceptAll(old.select("chunk_id", "content"))

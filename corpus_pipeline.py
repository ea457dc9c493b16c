"""The training-data pipeline over ``documents``, each stage one operator of docweave.llm.

Every stage takes (spark, docs, sf_dir), decides about each row that its predecessor kept,
and returns a DataFrame; all but the last return the columns of documents.  Stages are
written as Parquet into the shared folder and read again, so ``docs`` is always read from
files, which give the same rows in the same order to every reading.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from docweave.llm import exact_dedup, ngram_join, packing, secrets, toxicity
from docweave.llm.queries import table, toxicity_network
from docweave.session import kept, remove, share_code, shared_folder, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; the network learns from the labels in ``sf_dir``."""
    network = toxicity_network(share_code(spark), docs, sf_dir)
    return docs.where(toxicity.score(F.col("text"), network) < toxicity.TOXIC)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space, the row with the smallest doc_id."""
    return exact_dedup.keep_first(docs, files=True)


def free_name(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have yet, whatever the case of its names."""
    have = {c.lower() for c in docs.columns}
    while name in have:
        name = f"_{name}"
    return name


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the rows whose texts links connect, the one with the smallest doc_id; rows without an id come last.

    Rows are told apart by a key of their own, as ids may be null or occur twice; it is stored
    with them, so that each reading finds the same.
    """
    key = free_name(docs, "_key")
    keyed = stored(docs.withColumn(key, F.monotonically_increasing_id()))
    groups = ngram_join.ngram_groups(keyed, key).select(key, "component_id").join(keyed.select(key, "doc_id"), key)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.col(key).alias("key"))).alias("first")
    stay = groups.groupBy("component_id").agg(first).select(F.col("first.key").alias(key))
    return keyed.join(stay, key, "left_semi").select(docs.columns)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the stretches that hold secrets replaced and its length counted anew."""
    spans = free_name(docs, "_spans")
    found = docs.withColumn(spans, secrets.secret_spans(F.col("text")))
    clean, changed = secrets.redacted(F.col("text"), F.col(spans)), F.size(spans) > 0
    told = {"text": clean, "n_chars": F.when(changed, F.length(clean)).otherwise(F.col("n_chars"))}
    return found.select(*(told[c].cast(t).alias(c) if c in told else F.col(c) for c, t in docs.dtypes))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document, packed into sequences of at most 4096 tokens."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scans", hide_secrets),
    ("best_fit_packing", pack_sequences),
]

#: A trained network decides in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage read or stored on its way is removed once its result is written."""
    docs, before = table(share_code(spark), sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        docs = kept(spark, path, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)

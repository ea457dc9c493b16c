"""Engine tables made from the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of categories for the adapters; ``doc_id`` picks one.
CATEGORIES = ["paas", "dbaas", "dns", "mail", "storage", "account", "cicd", "references", "support", "iaas", "tools"]
TAXONOMY = [("paas", f"src{k}", "framework") for k in range(10)] + [("dbaas", f"src{k}", "service") for k in range(10, 20)]
REVISION = "ab" * 20
ORIGIN, REPOSITORY = "https://docs.example.org", "https://code.example.org/docs"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def category() -> Column:
    return F.element_at(F.array(*map(F.lit, CATEGORIES)), (F.pmod("doc_id", F.lit(11)) + 1).cast("int"))


def path() -> Column:
    return F.concat(F.lit("src/pages/"), category(), F.lit("/"), F.col("source"), F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".mdx"))


#: The same in SQL.
CATEGORY_SQL = f"list_element([{', '.join(repr(c) for c in CATEGORIES)}], CAST(doc_id % 11 + 1 AS INT))"
PATH_SQL = f"('src/pages/' || {CATEGORY_SQL} || '/' || source || '/doc-' || doc_id || '.mdx')"


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(path().alias("path"), F.lit(REVISION).alias("revision"), F.sha2("text", 256).alias("content_hash"), F.col("text").alias("raw"), F.octet_length("text").cast("long").alias("length"), "doc_id")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chunk a document: its first sentence is the title."""
    docs = table(spark, sf_dir, "documents")
    cat, seg = category(), F.col("source")
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    return docs.select(
        F.col("doc_id").alias("chunk_id"),
        F.col("doc_id").alias("document_id"),
        F.lit(None).cast("long").alias("section_id"),
        path().alias("path"),
        F.concat(F.lit("/"), cat, F.lit("/"), seg, F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit("/")).alias("published_path"),
        F.regexp_extract("text", "^[^.\n]*", 0).alias("title"),
        F.lit(None).cast("string").alias("heading"),
        F.array().cast("array<string>").alias("heading_path"),
        F.col("text").alias("content"),
        F.lit(0).alias("chunk_order"),
        cat.alias("category"),
        F.when((cat == "paas") & (number < 10), seg).alias("framework"),
        F.when((cat == "dbaas") & (number >= 10), seg).alias("service"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), "text", F.lit(10.0).alias("limit"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests: id, key, time and milliseconds."""
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(F.col("event_id").alias("request_id"), F.col("user_id").alias("key"), ts.alias("ts"), F.unix_millis(ts).alias("ms"), "event_type", "value", "props")

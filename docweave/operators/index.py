"""The inverted index: analysed fields, postings, frequencies and corpus statistics.

A chunk table has chunk_id, document_id, section_id, path, published_path, title, heading,
heading_path (array), content, chunk_order, category, framework and service.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import normalize_text, tokens_of
from docweave.session import stored

FIELDS = ("body", "title", "heading", "path", "class")


def filter_key(value: Column, composed: bool = False) -> Column:
    """A name without case, spaces and separators, for comparing filters."""
    return F.regexp_replace(normalize_text(value, composed), r"[._/+:\-\s]", "")


def index_fields(chunks: DataFrame, composed: bool = False) -> DataFrame:
    """Each chunk's five fields in search form, with the keys that filters compare."""
    empty = F.lit("")
    text = {
        "body": F.coalesce("content", empty),
        "title": F.coalesce("title", empty),
        "heading": F.concat_ws(" ", "heading", F.array_join("heading_path", " ")),
        "path": F.concat_ws(" ", "path", "published_path"),
        "class": F.concat_ws(" ", "category", "framework", "service"),
    }
    made = chunks.select(
        "chunk_id",
        "document_id",
        "section_id",
        "path",
        "chunk_order",
        "category",
        filter_key(F.col("framework"), composed).alias("framework_key"),
        filter_key(F.col("service"), composed).alias("service_key"),
        *(normalize_text(text[f], composed).alias(f"{f}_text") for f in FIELDS),
    )
    return made.withColumns({"body_len": F.size(tokens_of(F.col("body_text"))), "body_hash": F.sha2("body_text", 256)})


def field_tokens(fields: DataFrame) -> DataFrame:
    """A row for each token of each field.

    Fields are dealt by chunk first, which is less to move than their tokens; the tokens of a chunk then meet where they are.
    """
    bits = F.array(*(F.struct(F.lit(k).alias("field"), tokens_of(F.col(f"{f}_text")).alias("tokens")) for k, f in enumerate(FIELDS)))
    each = fields.select("chunk_id", *(f"{f}_text" for f in FIELDS)).repartition("chunk_id").select("chunk_id", F.explode(bits).alias("f"))
    return each.select("chunk_id", F.col("f.field").alias("field"), F.explode("f.tokens").alias("token"))


def postings(fields: DataFrame) -> DataFrame:
    """Rows of token and chunk: how often in the body, and whether in each other field."""
    field = F.col("field")
    return field_tokens(fields).groupBy("token", "chunk_id").agg(
        F.count_if(field == 0).alias("tf_body"),
        *(F.max(field == k).alias(f"in_{f}") for k, f in enumerate(FIELDS) if k),
    )


def document_frequency(found: DataFrame) -> DataFrame:
    """Rows of token and the number of chunks that have it in any field."""
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(fields: DataFrame) -> DataFrame:
    """One row: the number of chunks and the mean number of body tokens."""
    return fields.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("body_len").alias("avg_body_len"))


def idf(df: Column, n: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


#: Chunks of a block of postings, whose greatest impacts are kept, and blocks that a task makes, about.
BLOCK, TASK_BLOCKS = 32, 64


class Index(NamedTuple):
    """The stored tables of a revision."""

    fields: DataFrame
    postings: DataFrame  # with what scoring and filters ask about the chunk; by bucket of the token
    blocks: DataFrame  # the most that a token can add to a chunk of a block; made from the postings when it is read
    frequencies: DataFrame
    stats: DataFrame  # one row: n_chunks, avg_body_len, n_blocks, buckets


def bucket_of(token: Column, buckets: Column | int) -> Column:
    return F.pmod(F.xxhash64(token), buckets if isinstance(buckets, Column) else F.lit(buckets)).cast("int")


def full_postings(fields: DataFrame, n_blocks: int, buckets: int) -> DataFrame:
    """Postings with the facts of their chunk, its block and the token's bucket.

    Fields are dealt by chunk first, which is less to move than their tokens; the tokens of a
    chunk then meet where they are, and are not moved again.  A task gets a bounded number of chunks, so that it needn't spill their tokens.
    """
    bits = F.array(*(F.struct(F.lit(k).alias("field"), tokens_of(F.col(f"{f}_text")).alias("tokens")) for k, f in enumerate(FIELDS)))
    facts = ["body_len", "chunk_order", "category", "framework_key", "service_key"]
    each = fields.repartition(1 + n_blocks // TASK_BLOCKS, "chunk_id").select("chunk_id", *facts, F.explode(bits).alias("f"))
    field = F.col("field")
    found = each.select("chunk_id", *facts, F.col("f.field").alias("field"), F.explode("f.tokens").alias("token")).groupBy("chunk_id", "token", *facts).agg(
        F.count_if(field == 0).alias("tf_body"), *(F.max(field == k).alias(f"in_{f}") for k, f in enumerate(FIELDS) if k)
    )
    return found.withColumns({"block": F.pmod(F.xxhash64("chunk_id"), F.lit(n_blocks)).cast("int"), "bucket": bucket_of(F.col("token"), buckets)})


def block_bounds(found: DataFrame) -> DataFrame:
    """For each token and block the greatest frequency, the shortest body, and the fields that any chunk has it in."""
    flags = (F.max(f"in_{f}").alias(f"in_{f}") for f in FIELDS[1:])
    return found.groupBy("bucket", "token", "block").agg(F.max("tf_body").alias("tf_body"), F.min("body_len").alias("body_len"), *flags)


def by_bucket(rows: DataFrame, path: str, mode: str = "error") -> None:
    """A table partitioned by bucket and sorted by token and block.

    Rows stay in the tasks that made them, so each bucket has a file of each task: nothing is moved, and a
    token that every chunk has is split as the chunks are.
    """
    rows.sortWithinPartitions("bucket", "token", "block").write.partitionBy("bucket").mode(mode).parquet(path)


def write_tables(fields: DataFrame, root: str, buckets: int, n_blocks: int | None = None) -> None:
    spark = fields.sparkSession
    fields.write.parquet(f"{root}/fields")
    fields = spark.read.schema(fields.schema).parquet(f"{root}/fields")
    n_blocks = n_blocks or max(1, -(-fields.count() // BLOCK))
    by_bucket(full_postings(fields, n_blocks, buckets), f"{root}/postings")
    finish_tables(spark, root, buckets, n_blocks)


def finish_tables(spark: SparkSession, root: str, buckets: int, n_blocks: int) -> None:
    """The tables that are made from stored fields and postings."""
    found = spark.read.parquet(f"{root}/postings")
    document_frequency(found).write.parquet(f"{root}/frequencies")
    sizes = {"n_blocks": F.lit(n_blocks), "buckets": F.lit(buckets)}
    corpus_stats(spark.read.parquet(f"{root}/fields")).withColumns(sizes).write.parquet(f"{root}/stats")


def tables_at(spark: SparkSession, root: str) -> Index:
    fields, found, frequencies, stats = (spark.read.parquet(f"{root}/{name}") for name in Index._fields if name != "blocks")
    return Index(fields, found, block_bounds(found), frequencies, stats)


def published(spark: SparkSession, path: str, revision: str) -> str | None:
    """The folder that holds a revision, once it is whole."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/published/{revision}")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return f"{path}/builds/{spark.read.text(place.toString()).first()[0]}"


def publish(spark: SparkSession, path: str, revision: str, build: str) -> None:
    """Point a revision to a build by one rename, so readers see all of it or nothing."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to, part = jvm.org.apache.hadoop.fs.Path(f"{path}/published/{revision}"), jvm.org.apache.hadoop.fs.Path(f"{path}/parts/{build}")
    system = to.getFileSystem(conf)
    out = system.create(part, True)
    out.write(bytearray(build.encode()))
    out.close()
    system.mkdirs(to.getParent())
    if not system.rename(part, to) and not system.exists(to):
        raise RuntimeError(f"revision {revision} couldn't be published")


def write_index(fields: DataFrame, path: str, revision: str, buckets: int = 64, n_blocks: int | None = None) -> None:
    """Build the index of a revision in a folder of its own and publish it when all of it is there."""
    build = uuid.uuid4().hex
    write_tables(fields, f"{path}/builds/{build}", buckets, n_blocks)
    publish(fields.sparkSession, path, revision, build)


def read_index(spark: SparkSession, path: str, revision: str) -> Index | None:
    """The published index of a revision; None if there is none, whatever a failed build left behind."""
    root = published(spark, path, revision)
    return tables_at(spark, root) if root else None


def open_index(spark: SparkSession, path: str, revision: str, fields: Callable[[], DataFrame], buckets: int = 64) -> Index:
    """The index of a revision, built only where it isn't published yet."""
    if published(spark, path, revision) is None:
        write_index(fields(), path, revision, buckets)
    return read_index(spark, path, revision)


def field_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """chunk_id and change (added, removed or changed) between the fields of two revisions."""
    digest = lambda rows: rows.select("chunk_id", F.xxhash64(*sorted(c for c in rows.columns if c != "chunk_id")).alias("digest"))
    a, b = digest(old).withColumnRenamed("digest", "_old"), digest(new).withColumnRenamed("digest", "_new")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed")
    return a.join(b, "chunk_id", "full_outer").select("chunk_id", change.alias("change")).where("change IS NOT NULL")


def update_index(spark: SparkSession, path: str, old: str, new: str, fields: DataFrame) -> None:
    """The index of revision ``new`` from that of ``old``: only chunks that differ are analysed into postings.

    Postings of the others are copied as they lie, without a shuffle; places of blocks and buckets stay.
    """
    before, build = read_index(spark, path, old), uuid.uuid4().hex
    if before is None:
        raise ValueError(f"revision {old} isn't published")
    root = f"{path}/builds/{build}"
    fields.write.parquet(f"{root}/fields")
    fields = spark.read.schema(fields.schema).parquet(f"{root}/fields")
    n_blocks, buckets = before.stats.select("n_blocks", "buckets").first()
    changes = stored(field_changes(before.fields, fields))
    kept = before.postings.join(changes.where("change != 'added'").select("chunk_id"), "chunk_id", "left_anti")
    kept.select(before.postings.columns).write.partitionBy("bucket").parquet(f"{root}/postings")
    more = fields.join(changes.where("change != 'removed'").select("chunk_id"), "chunk_id", "left_semi")
    by_bucket(full_postings(more, n_blocks, buckets).select(before.postings.columns), f"{root}/postings", "append")
    finish_tables(spark, root, buckets, n_blocks)
    publish(spark, path, new, build)

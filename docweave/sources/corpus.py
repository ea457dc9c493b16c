"""Reading and verifying a corpus of files, and writing its tables.

A file row has path, revision, content_hash, length and raw (its text).  Checks return
accepted rows and rejected rows (path and code) instead of failing on the first bad file;
``fail_on`` restores that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 1_048_576
MANIFEST = "path string, revision string, content_hash string"


def scan_corpus(spark: SparkSession, root: str, glob: str = "*.mdx") -> DataFrame:
    """Files below ``root``: path relative to it, length in bytes and content.

    The content column is read only where a later step uses it, so :func:`enforce_size`
    can leave out large files before they are read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    start = F.length(F.lit(root.rstrip("/").removeprefix("file:"))) + 2
    bare = F.regexp_replace("path", "^[a-z]+:(//[^/]*)?(?=/)", "")
    return found.select(F.substr(bare, start).alias("path"), "length", F.decode("content", "UTF-8").alias("raw"))


def split_by(rows: DataFrame, code: Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``code`` is null, and path and code of the others."""
    marked = rows.withColumn("_code", code)
    return marked.where("_code IS NULL").drop("_code"), marked.where("_code IS NOT NULL").select("path", F.col("_code").alias("code"))


def verify_manifest(files: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that the manifest lists, and the others as ``SOURCE_TREE_DIRTY``."""
    listed = manifest.select("path").distinct()
    lost = files.join(listed, "path", "left_anti").select("path", F.lit("SOURCE_TREE_DIRTY").alias("code"))
    return files.join(listed, "path", "left_semi"), lost


def size_code(most: int = MOST_BYTES) -> Column:
    return F.when(F.col("length") > most, F.lit("FILE_TOO_LARGE"))


def enforce_size(files: DataFrame, most: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    return split_by(files, size_code(most))


def hash_code() -> Column:
    """A recorded digest must be 64 hex digits and that of the content."""
    bad = ~F.coalesce(F.col("content_hash").rlike("^[a-fA-F0-9]{64}$"), F.lit(False))
    return F.when(bad, F.lit("INVALID_CONTENT_HASH")).when(F.lower("content_hash") != F.sha2(F.coalesce("raw", F.lit("")), 256), F.lit("CONTENT_HASH_MISMATCH"))


def verify_hash(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_by(files, hash_code())


def revision_code() -> Column:
    return F.when(~F.coalesce(F.col("revision").rlike("^[a-fA-F0-9]{40}$"), F.lit(False)), F.lit("INVALID_REVISION"))


def verify_revision(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Revisions of 40 hex digits, in lower case; :func:`one_revision` checks that there is one."""
    good, bad = split_by(files, revision_code())
    return good.withColumn("revision", F.lower("revision")), bad


def one_revision(files: DataFrame) -> DataFrame:
    """One row: the number of distinct revisions, and whether it is one."""
    n = F.count_distinct(F.lower("revision"))
    return files.agg(n.alias("n_revisions"), (n == 1).alias("single"))


def fail_on(rejected: DataFrame) -> DataFrame:
    """Raises when a row is read: for callers that want the first bad file to stop the job."""
    return rejected.select(F.raise_error(F.concat("code", F.lit(": "), "path")).alias("failed"))


def write_corpus(path: str, **tables: DataFrame) -> None:
    """Tables as Parquet; those with a category are laid out by it."""
    for name, rows in tables.items():
        writer = rows.write.mode("overwrite")
        (writer.partitionBy("category") if "category" in rows.columns else writer).parquet(f"{path}/{name}")

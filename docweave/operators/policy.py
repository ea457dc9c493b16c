"""Source policy: paths, categories, classification, addresses and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.identity import document_id
from docweave.functions.text import strip

SEGMENT = "^(?i)[a-z0-9][a-z0-9._-]*$"


def parse_path(files: DataFrame, root: tuple[str, ...] = ("src", "pages"), suffix: str = ".mdx") -> DataFrame:
    """Adds ``segments`` below the root without the suffix, and ``reject_code`` where the path isn't allowed."""
    path, parts = F.col("path"), F.split("path", "/")
    unsafe = (path == "") | path.startswith("/") | path.contains("\\") | path.contains("\0") | ~F.forall(parts, lambda s: s.rlike(SEGMENT))
    misplaced = (F.size(parts) < len(root) + 2) | ~F.element_at(parts, -1).endswith(suffix) | (F.length(F.element_at(parts, -1)) <= len(suffix))
    for k, name in enumerate(root):
        misplaced = misplaced | (F.get(parts, F.lit(k)) != name)
    code = F.when(F.coalesce(unsafe | misplaced, F.lit(True)), F.lit("INVALID_REPOSITORY_PATH"))
    below = F.slice(parts, len(root) + 1, F.greatest(F.size(parts) - len(root), F.lit(0)))
    last = F.substr(F.element_at(below, -1), F.lit(1), F.length(F.element_at(below, -1)) - len(suffix))
    own = F.concat(F.slice(below, 1, F.size(below) - 1), F.array(last))
    return files.withColumn("reject_code", code).withColumn("segments", F.when(F.col("reject_code").isNull(), own))


def check_category(parsed: DataFrame, categories: DataFrame) -> DataFrame:
    """Adds ``category``; a path outside the list is rejected as ``UNSUPPORTED_CATEGORY``."""
    known = categories.select(F.col("category").alias("_known"))
    near = parsed.join(known, F.get("segments", F.lit(0)) == F.col("_known"), "left")
    lost = F.col("reject_code").isNull() & F.col("_known").isNull()
    return near.withColumn("reject_code", F.when(lost, F.lit("UNSUPPORTED_CATEGORY")).otherwise(F.col("reject_code"))).withColumnRenamed("_known", "category")


def classify(parsed: DataFrame, taxonomy: DataFrame, one_click: str = "one-click-apps") -> DataFrame:
    """Adds framework and service from the second segment."""
    known = taxonomy.select(F.col("category").alias("_c"), F.col("segment").alias("_s"), "kind")
    second = F.get("segments", F.lit(1))
    near = parsed.join(known, (F.col("category") == F.col("_c")) & (second == F.col("_s")), "left")
    own = (F.col("category") == one_click) & (second != "about") & (F.size("segments") >= 3)
    return (
        near.withColumn("framework", F.when(F.col("kind") == "framework", second))
        .withColumn("service", F.when((F.col("kind") == "service") | own, second))
        .drop("_c", "_s", "kind")
    )


def derive_urls(sources: DataFrame, origin: str, repository: str) -> DataFrame:
    published = F.concat(F.lit("/"), F.array_join("segments", "/"), F.lit("/"))
    return sources.withColumns(
        {
            "published_path": published,
            "published_url": F.concat(F.lit(origin.rstrip("/")), published),
            "repository_url": F.concat(F.lit(repository.rstrip("/") + "/blob/"), F.lower("revision"), F.lit("/"), "path"),
        }
    )


def slug_title(segments: Column) -> Column:
    words = F.filter(F.split(F.element_at(segments, -1), "[-_]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def build_sources(files: DataFrame, categories: DataFrame, taxonomy: DataFrame, origin: str, repository: str) -> tuple[DataFrame, DataFrame]:
    """Files with ids, classification and addresses, and rejected paths with their codes."""
    rows = check_category(parse_path(files), categories)
    bad = rows.where("reject_code IS NOT NULL").select("path", F.col("reject_code").alias("code"))
    good = derive_urls(classify(rows.where("reject_code IS NULL").drop("reject_code"), taxonomy), origin, repository)
    return good.withColumn("document_id", document_id(F.col("path"))), bad


def host_of(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def with_allowlisted(rows: DataFrame, origins: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``allowlisted``: https on a listed host, and under its path prefix where it has one."""
    known = origins.select(F.col("host").alias("_host"), F.col("path_prefix").alias("_prefix"))
    url = F.col(url_col)
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    under = F.col("_prefix").isNull() | (path == F.col("_prefix")) | path.startswith(F.concat("_prefix", F.lit("/")))
    ok = (F.try_parse_url(url, F.lit("PROTOCOL")) == "https") & F.col("_host").isNotNull() & under
    return rows.join(known, host_of(url) == F.col("_host"), "left").withColumn("allowlisted", F.coalesce(ok, F.lit(False))).drop("_host", "_prefix")


def safe_link(label: Column, url: Column) -> Column:
    """``label (target)`` where the target is relative, a fragment or http(s); else the label."""
    target = strip(url)
    safe = target.rlike(r"^(/|\./|\.\./|#)") | target.rlike(r"^(?i)https?://[^/\s]")
    return F.when(F.coalesce(safe, F.lit(False)), F.concat(label, F.lit(" ("), target, F.lit(")"))).otherwise(label)

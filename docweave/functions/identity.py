"""Ids that are the same in every run: digests over parts with their lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespaces of the digests.
NAMESPACES = {"doc_": "document", "section_": "section", "chunk_": "chunk"}


def digest_id(prefix: str, parts: Column, namespace: str | None = None) -> Column:
    """``prefix`` and 24 hex digits over ``parts`` (an array of strings).

    Each part is led by its length in bytes, so that moving a border between parts
    changes the digest.
    """
    led = F.transform(parts, lambda p: F.concat(F.octet_length(p).cast("string"), F.lit(":"), p))
    whole = F.concat(F.lit(namespace or NAMESPACES[prefix]), F.char(F.lit(0)), F.array_join(led, ""))
    return F.concat(F.lit(prefix), F.substring(F.sha2(whole, 256), 1, 24))


def document_id(path: Column) -> Column:
    return digest_id("doc_", F.array(path))


def section_id(document: Column, heading_path: Column, anchor: Column, order: Column) -> Column:
    size = F.size(heading_path).cast("string")
    return digest_id("section_", F.concat(F.array(document, size), heading_path, F.array(F.coalesce(anchor, F.lit("")), order.cast("string"))))


def chunk_id(document: Column, section: Column, order: Column, content: Column) -> Column:
    return digest_id("chunk_", F.array(document, F.coalesce(section, F.lit("")), order.cast("string"), F.sha2(content, 256)))

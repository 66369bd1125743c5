"""Sizes of texts in tokens of the byte-level ByT5 tokenizer: UTF-8 bytes and one end token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096


def is_item(text: Column) -> Column:
    """Neither null nor whitespace only."""
    return F.coalesce(text.rlike(r"[^\s\p{Z}]"), F.lit(False))


def size(text: Column) -> Column:
    return (F.octet_length(text) + 1).cast("long")


def sized(documents: DataFrame) -> DataFrame:
    """``doc_id, source, text, size`` of all items."""
    return documents.where(is_item(F.col("text")) & F.col("doc_id").isNotNull()).select("doc_id", "source", "text", size(F.col("text")).alias("size"))


def plain_source(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))

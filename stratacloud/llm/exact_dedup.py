"""Exact deduplication: 128-bit content hash, smallest id, byte comparison inside a hash group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratacloud.llm._common import SPACES, cut, hot_join, text_or_empty


def normalised(text: str | Column = "text") -> Column:
    """Every run of ASCII white space as one space; null reads as empty."""
    return F.regexp_replace(text_or_empty(text), SPACES, " ")


def exact_duplicates(docs: DataFrame, content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are grouped by (content hash, bytes): texts that share a 128-bit hash and differ
    in a byte stay apart, since the bytes are part of the grouping key.  The first step
    aggregates before it shuffles, so a group of copies is one row per map task however
    large it is; the step that maps rows to their group joins on the hashes alone, and the
    few largest groups by broadcast.  Null text counts as empty.  The row with the
    smallest doc_id stays; rows without doc_id stay only if the group has no other
    (keep_id is then null); of rows repeating the kept doc_id all are kept.  An empty table
    gives an empty result; other columns are ignored.
    """
    texts = docs.select(F.col("doc_id"), normalised("text").alias("body"))
    groups = cut(
        texts.groupBy(content_hash(F.col("body")).alias("h"), "body")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("h", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size"),
        "groups",
    )
    rows = cut(texts.select("doc_id", content_hash(F.col("body")).alias("h"), F.sha2("body", 256).alias("text_sha256")), "hashes")
    return hot_join(rows, groups, ["h", "text_sha256"], "group_size", rows.count()).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )

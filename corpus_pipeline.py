"""Corpus pipeline: five stages from raw documents to token ids.

Every stage takes what its predecessor kept and, but for the last, returns rows of documents
with the same columns.  run() writes each stage as Parquet in the shared folder and reads it
back, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacloud.llm import bpe, exact_dedup, mixing, near_dedup, quality
from stratacloud.llm._common import cut, read, repeated_ids


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at or above its threshold."""
    return quality.keep_good(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with _key: doc_id if no id repeats, else a number for each row in the order of the ids; null without id."""
    if repeated_ids(docs).isEmpty():
        return docs.withColumn("_key", F.col("doc_id"))
    ordered = docs.orderBy("doc_id", F.xxhash64("text"), F.rand(0)).withColumn("_key", F.monotonically_increasing_id())
    # written, so that the numbers hold for all that reads them
    return cut(ordered.withColumn("_key", F.when(F.col("doc_id").isNotNull(), F.col("_key"))), "keyed")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, with the smallest doc_id; rows without id stay."""
    keyed = _keyed(docs)
    found = exact_dedup.exact_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"))
    dropped = found.where(~F.col("kept") & F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("keep_id"))).select(F.col("doc_id").alias("_key"))
    return keyed.join(dropped, "_key", "left_anti").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words at a similarity of 0.8 or more; rows without id stay."""
    keyed = _keyed(docs)
    found = near_dedup.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"))
    dropped = found.where(~F.col("kept")).select(F.col("doc_id").alias("_key"))
    return keyed.join(dropped, "_key", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them."""
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, a row for each document taken."""
    return bpe.digests(bpe.encode(docs, decode_too=True))


STAGES = [
    ("quality classifier", quality_filter),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("mixing sources", mix_sources),
    ("bpe encoding", encode_tokens),
]

#: The classifier is fitted by descent and has no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return docs

"""Helpers that the text operators share: reading tables, cutting lineage, tokenizer files."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words; everything else belongs to a word.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACES = "[\\x20\\x09-\\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Keys of more than this part of all rows are hot: there can't be more of them than its inverse, so they are broadcast.
HOT_KEYS = 4096
#: Groups of at most so many rows in all are broadcast whole.
FEW_ROWS = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; where none is named, a new one in local mode and an error on a cluster."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df written as a table in the shared folder and read back: short lineage, columnar, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop_cut(*frames: DataFrame) -> None:
    """Delete tables of cut() that later steps no longer read."""
    for df in frames:
        path = getattr(df, "_cut_path", None)
        if path:
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def hot_join(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with groups(keys, size, ...): a group for each key, `size` its number of rows, `total` that of all rows.

    Groups of more than total / HOT_KEYS rows are fewer than HOT_KEYS, so they go by
    broadcast and their rows stay where they are; the rest meet in a shuffled join, in which
    no key has more rows than that.  Both inputs are read twice, so beyond FEW_ROWS rows groups are
    written first, and rows should be a written table.
    """
    if total <= FEW_ROWS:
        return rows.join(F.broadcast(groups), keys, how)
    groups = groups if hasattr(groups, "_cut_path") else cut(groups, "groups")
    hot = F.col(size) > max(1, total // HOT_KEYS)
    few = F.broadcast(groups.where(hot))
    near = rows.join(few, keys)
    rest = rows.join(F.broadcast(groups.where(hot).select(*keys)), keys, "left_anti")
    return near.unionByName(rest.join(groups.where(~hot), keys, how))


def repeated_ids(docs: DataFrame) -> DataFrame:
    """doc_id of the ids that more than one row has."""
    return docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id")


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def tokenizer_path(name: str) -> str:
    """Where the vocabulary file lies on this machine; executors call it for themselves."""
    import public_tokenizers

    return public_tokenizers.path(name)

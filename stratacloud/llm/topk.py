"""Exact top-k inner-product search by distributed histogram selection.

Queries run in blocks of bounded size against all vectors.  For a block, every vector is
scored; each task counts scores in bins and returns, for each query, its bins from the top
down to the one that holds its own k-th score (the global k-th score cannot lie lower).  The
summed histogram gives the bin of the global k-th score, which the next round divides, until
a bin is one integer wide.  A last pass keeps scores above that value and, of those equal to
it, the smallest ids.  No task and no driver step holds more than a block's histogram.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratacloud.llm._common import cut, shared_dir
from stratacloud.llm._text import frugal

QUERY_BLOCK = 4096
BIN_BITS = 8
#: Blocks of queries that run at the same time.
BLOCKS_AT_ONCE = 3
#: Vectors scored at a time against a block of queries.
ROWS = 1024


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, q = floor(256 x) of each component; vectors null or with null or non-finite components go, as do null ids."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    q = F.transform(x, lambda c: F.floor(c * 256.0).cast("long"))
    return vectors.where("embedding is not null and vec_id is not null").where(whole).select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"))


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """Rows of a list column, short ones filled with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(column.offsets.to_numpy())
    if len(flat) == len(column) * width and (lengths == width).all():
        return flat.reshape(-1, width).astype(kind)
    out = np.zeros((len(column), width), kind)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _scores(batch: pa.RecordBatch, ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(vector ids, integer scores by vector and query, which of them count), a few rows at a time."""
    own = batch.column("vec_id").to_numpy()
    vectors = _matrix(batch.column("q"), queries.shape[1], queries.dtype.type)
    for a in range(0, len(own), ROWS):
        part = own[a : a + ROWS]
        yield part, (vectors[a : a + ROWS] @ queries.T).astype(np.int64), part[:, None] != ids[None, :]


def _histogram(held, k: int, shift: int):
    """Counts above each query's range (bin -1), and its top bins of width 2**shift down to the k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, low, bins = held.value
        n = len(ids)
        counts = np.zeros((n, bins + 1), np.int64)  # the last column: above the range
        for batch in batches:
            for _, scores, valid in _scores(batch, ids, queries):
                at = (scores - low[None, :]) >> shift
                use = valid & (at >= 0)
                place = np.minimum(at, bins) + np.arange(n)[None, :] * (bins + 1)
                counts += np.bincount(place[use], minlength=n * (bins + 1)).reshape(n, bins + 1)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        query, at = np.nonzero((counts > 0) & (above < k))
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(at), pa.array(counts[query, at])], names=["query", "bin", "n"])

    return run


def _select(held, k: int):
    """Scores above each query's k-th value, and of those equal to it the k smallest ids, of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries, least, _ = held.value
        kept = [np.zeros(0, np.int64)] * 3

        def trim() -> None:
            order = np.lexsort((kept[1], -kept[2], kept[0]))
            columns = [x[order] for x in kept]
            first = np.searchsorted(columns[0], columns[0])
            top = np.arange(len(first)) - first < k
            kept[:] = [x[top] for x in columns]

        for batch in batches:
            for own, scores, valid in _scores(batch, ids, queries):
                row, query = np.nonzero(valid & (scores >= least[None, :]))
                kept[:] = [np.concatenate((x, y)) for x, y in zip(kept, (query, own[row], scores[row, query]))]
                if len(kept[0]) > 4 * k * len(ids):
                    trim()
        trim()
        yield pa.RecordBatch.from_arrays([pa.array(kept[0]), pa.array(ids[kept[0]]), pa.array(kept[1]), pa.array(kept[2])], names=["query", "query_id", "vec_id", "score"])

    return run


def _block(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, limit: int) -> DataFrame:
    spark = vectors.sparkSession.sparkContext
    low = np.full(len(ids), -limit, np.int64)
    shift = max(0, (2 * limit + 1).bit_length() - BIN_BITS)
    while True:
        bins = 1 << BIN_BITS
        held = spark.broadcast((ids, queries, low, bins))
        counts = vectors.mapInArrow(frugal(_histogram(held, k, shift)), "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))
        downward = Window.partitionBy("query").orderBy(F.desc("bin"))
        reached = counts.withColumn("reached", F.sum("n").over(downward)).groupBy("query").agg(
            F.coalesce(F.max(F.when(F.col("reached") >= k, F.col("bin"))), F.lit(0)).alias("bin")
        )
        found = reached.toArrow()  # one number for each query of the block
        at = np.zeros(len(ids), np.int64)
        at[found.column("query").to_numpy()] = found.column("bin").to_numpy()
        low = low + (at << shift)
        if not shift:
            break
        shift = max(0, shift - BIN_BITS)
    held = spark.broadcast((ids, queries, low, 0))
    rank = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = vectors.mapInArrow(frugal(_select(held, k)), "query long, query_id long, vec_id long, score long")
    return best.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, is_query, k: int = 5, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank from 1, vec_id, score: the k highest integer inner products of each query.

    vectors needs vec_id and embedding (array of numbers); is_query is a condition on vec_id.
    Candidates are all rows with another id than the query's; a query has fewer than k rows
    if there are fewer.  Ties go to the smaller id.  Short vectors count as filled with
    zeros; vectors that are null or hold null or non-finite components, and rows without
    id, take no part.  A repeated row is a candidate each time, and one query.  Inner products must
    fit 63 bits.  An empty table, or one without queries, gives an empty result.
    """
    table = cut(quantised(vectors), "vectors")
    size = table.agg(F.max(F.size("q")).alias("width"), F.max(F.array_max(F.transform("q", lambda c: F.abs(c)))).alias("most")).first()
    width, most = size["width"] or 1, size["most"] or 0
    limit = max(1, width * most * most)
    kind = np.float32 if limit < 2**24 else np.float64 if limit < 2**53 else np.int64
    spark = vectors.sparkSession
    rows = table.where(is_query).distinct().orderBy("vec_id").toLocalIterator()
    path = f"{shared_dir(spark)}/found-{uuid.uuid4().hex}"
    schema = "query_id long, rank int, vec_id long, score long"

    def search(part: list) -> None:
        queries = _matrix(pa.array([r["q"] for r in part], pa.list_(pa.int64())), width, kind)
        _block(table, np.array([r["vec_id"] for r in part], np.int64), queries, k, limit).write.mode("append").parquet(f"{path}/block={part[0]['vec_id']}")

    if table.where(is_query).isEmpty():
        return spark.createDataFrame([], schema)
    # a few blocks at a time, so that the passes of one fill the gaps of another; each writes its own folder
    with ThreadPoolExecutor(BLOCKS_AT_ONCE) as pool:
        running = set()
        while part := list(islice(rows, block)):
            if len(running) >= BLOCKS_AT_ONCE:
                done, running = wait(running, return_when=FIRST_COMPLETED)
                for task in done:
                    task.result()
            running.add(pool.submit(search, part))
        for task in running:
            task.result()
    return spark.read.schema(f"{schema}, block long").parquet(path).drop("block")

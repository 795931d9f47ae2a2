import math
import random

import pytest
from pyspark.sql import functions as F

from stratacloud.llm import topk


@pytest.mark.parametrize(("scale", "block"), [(0.3, 4096), (300.0, 3), (5e5, 4096)])
def test_equals_brute_force(spark, monkeypatch, scale, block):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-scale, scale) for _ in range(6)]) for i in range(300)]
    rows += [(1000 + i, [0.25] * 6) for i in range(120)]
    rows[7] = (7, None)
    rows[8] = (8, [1.0, None])
    rows[9] = (9, [1.0, math.nan])
    rows[10] = (10, [math.inf] * 6)
    rows[11] = (11, [0.5, 0.25])
    df = spark.createDataFrame([(i, v, 1) for i, v in rows] + [(None, [1.0], 1)], "vec_id long, embedding array<double>, score int").repartition(5)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k=5, block=block).collect()
    good = {i: [math.floor(256 * x) for x in v] for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (i for i in good if i % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (3, [-9.0])], "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") == 0).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, 131072), (2, 3, -589824)]
    assert topk.top_k(df, F.col("vec_id") == 5).count() == topk.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_repeated_ids(spark):
    """A repeated row is a candidate each time; two vectors of one id are two queries' rows under that id."""
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [1.0]), (2, [3.0])], "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") == 0, k=3).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 2, 196608), (2, 1, 131072), (3, 1, 131072)]
    both = topk.top_k(df, F.col("vec_id") == 2, k=1).collect()
    assert sorted((r.query_id, r.vec_id, r.score) for r in both) == [(2, 1, 131072), (2, 1, 393216)]

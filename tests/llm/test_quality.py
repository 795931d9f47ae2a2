import numpy as np
from pyspark.sql import functions as F

from stratacloud.llm import quality


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    scored = quality.score(docs, quality.fit(docs, labels))
    assert scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").where("held_out").collect()
    score, label = np.array([r.score for r in rows]), np.array([r.quality for r in rows])
    assert ((score >= 0) & (score <= 1)).all()
    ranks = np.argsort(np.argsort(score)) + 1
    auc = (ranks[label == 1].sum() - (label == 1).sum() * ((label == 1).sum() + 1) / 2) / ((label == 1).sum() * (label == 0).sum())
    accuracy = np.mean([r.predicted == r.quality for r in rows])
    print("auc", auc, "accuracy", accuracy, len(rows))
    assert auc > 0.95 and accuracy > 0.93


def test_nulls_empty_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "x", 0), (1, "a " * 9000, 0)], "doc_id long, text string, score int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.score(docs, quality.fit(docs, none)).collect()
    assert [r.score for r in rows] == [0.5] * 4 and [r.held_out for r in rows if r.doc_id is None] == [False]
    one = spark.createDataFrame([(i, 1) for i in range(5)] + [(1, None)], "doc_id long, quality int")
    assert all(r.score > 0.99 for r in quality.score(docs, quality.fit(docs, one)).collect())
    assert quality.score(docs.limit(0), quality.fit(docs, none)).count() == 0
    assert quality.keep_good(docs, quality.fit(docs, one)).columns == docs.columns


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 50, 8) + 100 * (i % 2)) for i in range(60)]
    model = quality.fit_rows(rows, np.array([i % 2 for i in range(60)]))
    assert all((model.score(r) > 0.5) == bool(i % 2) for i, r in enumerate(rows))


def test_descent_reaches_the_optimum_of_a_plain_solver():
    rng = np.random.default_rng(7)
    rows = [np.append(np.unique(rng.integers(0, 30, 6)) + 20 * (i % 2), quality.COLUMNS).astype(np.int32) for i in range(40)]
    values = [rng.normal(1, 0.3, len(r)) for r in rows]
    signs, cost = np.array([1.0 if i % 2 else -1.0 for i in range(40)]), np.where(np.arange(40) % 2, 0.3, 0.5)
    dense = np.zeros((40, quality.COLUMNS + 1))
    for i, (r, v) in enumerate(zip(rows, values)):
        dense[i, r] = v
    used = np.flatnonzero(dense.any(axis=0))
    x = dense[:, used]
    objective = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - signs * (x @ w))).sum()
    w, best = np.zeros(len(used)), np.inf
    for step in range(1, 20_000):  # subgradient descent, nothing clever
        gap = signs * (x @ w) < 1
        w = w - (w - ((cost * signs * gap)[:, None] * x).sum(axis=0)) / (step + 10)
        best = min(best, objective(w))
    found = quality.dual_coordinate_descent(rows, values, signs, cost, epochs=500, tolerance=1e-6)
    assert objective(found[used]) <= best + 1e-3 and abs(objective(found[used]) - best) < 0.02 * best


def test_scores_equal_a_plain_scorer(spark):
    """Sums over the indicators written out one by one, for very long and odd texts too."""
    rng = np.random.default_rng(2)
    model = quality.Model(rng.normal(size=quality.COLUMNS), rng.random(quality.COLUMNS), 0.2, 1.3, -0.1)
    texts = ["", None, "One two two TWO 3.5 <b>", "é ü 日本", "word " * 100_000, " ".join(f"w{i}" for i in range(60_000))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    for i, text in enumerate(texts):
        words = quality.hash_words(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]), lower=True)
        grams, needs = quality._columns(words)
        held = {int(c) for g, k in zip(grams, needs) for c in g[k:]}
        length = sum(model.square[c] for c in held)
        margin = 0.2 + (sum(model.weight[c] for c in held) / length**0.5 if held else 0)
        assert abs(got[i] - 1 / (1 + np.exp(-(1.3 * margin - 0.1)))) < 1e-9


def test_learning_is_bounded_and_takes_one_text_of_an_id(spark, monkeypatch):
    monkeypatch.setattr(quality, "TRAIN_INDICATORS", 40)
    docs = spark.createDataFrame([(i % 12, f"good fine text {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    assert 0 < quality.fit(docs, labels).square.max()
    monkeypatch.setattr(quality, "TRAIN_INDICATORS", 0)
    assert quality.fit(docs, labels).square.max() == 0

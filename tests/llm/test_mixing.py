import heapq

from pyspark.sql import functions as F

from stratacloud.llm import mixing


def fill(sizes, weights, most=3):
    """Targets by repeated resharing."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    left = float(total)
    while open_ and left > 1e-9:
        level = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * level >= most * sizes[i]]
        if not full:
            for i in open_:
                target[i] = weights[i] * level
            break
        for i in full:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ = [i for i in open_ if i not in full]
    return target


def test_targets_taken_and_reruns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text", F.lit(1).alias("size"))
    few = spark.createDataFrame([(-1, None, "a b c", 1), (-2, "zz", None, 1), (-3, "zz", " ", 1), (-4, None, "d", 1), (-5, "a", "x " * 30000, 1)], docs.schema)
    docs = docs.unionByName(few)
    rows = mixing.mix(docs).collect()
    assert len(rows) == 1005
    by_source = {}
    for r in rows:
        by_source.setdefault(r.source, []).append(r)
    names = sorted((s for s in by_source if s is not None)) + [None]
    sizes = [sum(r["size"] for r in by_source[s]) for s in names]
    want = fill(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))])
    for name, size, target in zip(names, sizes, want):
        group = by_source[name]
        assert {r.source_size for r in group} == {size}
        assert all(abs(r.target - target) <= 1e-6 * max(1, target) for r in group)
        assert abs(sum(r.taken for r in group) - target) <= 8 + 0.002 * target
        assert all(0 <= r.taken <= 3 * r["size"] for r in group)
    again = mixing.mix(docs.repartition(7, "text")).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_seats_go_to_the_highest_quotients(spark):
    cases = {1: ([53, 24, 23], 7), 2: ([1, 1, 1, 1], 6), 3: ([1000, 1, 0, 7, 7], 1013), 4: ([5, 3], 0)}
    rows = [(k, i, float(w), n) for k, (weights, n) in cases.items() for i, w in enumerate(weights)]
    got = mixing.sainte_lague(spark.createDataFrame(rows, "k int, place int, w double, n long"), ["k"], "w", "n", ["place"], "seats").collect()
    for k, (weights, n) in cases.items():
        seats = [0] * len(weights)
        queue = [(-w, i) for i, w in enumerate(weights)]
        heapq.heapify(queue)
        for _ in range(n):
            _, i = heapq.heappop(queue)
            seats[i] += 1
            heapq.heappush(queue, (-weights[i] / (2 * seats[i] + 1), i))
        assert [r.seats for r in sorted((r for r in got if r.k == k), key=lambda r: r.place)] == seats


def test_mixed_documents_repeat(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 4 == 0], "w " * 50, "x") for i in range(400)], "doc_id long, source string, text string, lang string")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    counts = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(counts["a"] - 400 * 5 / 7) < 30 and abs(counts["b"] - 400 * 2 / 7) < 30

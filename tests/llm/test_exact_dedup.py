from pyspark.sql import functions as F

from stratacloud.llm.exact_dedup import exact_duplicates


def test_copies_nulls_and_ties(spark):
    rows = [(3, "a  b", 1), (1, "a\tb", 1), (2, "a b ", 1), (9, None, 1), (8, "", 1), (None, "a b", 1), (None, "z", 1), (1, "a b", 1)]
    got = exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string, h int")).collect()
    assert sorted(((r.doc_id or -1), r.keep_id or -1, r.group_size, r.kept) for r in got) == [
        (-1, -1, 1, True), (-1, 1, 4, False), (1, 1, 4, True), (1, 1, 4, True), (2, 2, 1, True), (3, 1, 4, False), (8, 8, 2, True), (9, 8, 2, False),
    ]
    long = "word \n" * 400_000
    got = exact_duplicates(spark.createDataFrame([(4, long), (2, long.replace("\n", "\t\t")), (6, long + "x")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(2, 2, 2), (4, 2, 2), (6, 6, 1)]
    assert exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bytes_separate_colliding_hashes(spark):
    rows = [(i, f"text {i % 5}") for i in range(40)]
    weak = exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), content_hash=lambda body: F.length(body).cast("string"))
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in weak.collect()) == [(i, i % 5, 8) for i in range(40)]

import corpus_pipeline
from stratacloud.llm._common import read


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert out.count() == counts[-1]


def test_stages_take_odd_rows(spark, sf_dir):
    rows = [(1, None, "en", "a", 7, 0), (2, "", None, None, 7, 0), (2, "", None, None, 7, 0), (None, "one two three", "en", "a", 7, 0), (3, "one two three", "en", None, 7, 0)]
    rows += [(9, "w " * 60_000, "en", "b", 7, 0), (10, "Plain words of some text that goes on for a while, and then ends.", "en", "b", 7, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size int, kept int")
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, sf_dir)
            assert name == "bpe encoding" or out.columns == docs.columns
            assert out.count() <= 3 * some.count()
    assert corpus_pipeline.STAGES[1][1](spark, docs, sf_dir).where("doc_id = 9").count() == 1


def test_repeated_and_missing_ids_lose_no_text(spark, sf_dir):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(3, "A"), (5, "A"), (5, "B"), (6, "C"), (6, "C"), (7, long), (7, "D"), (8, long + " end"), (8, "E"), (None, "F")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    exact = corpus_pipeline.drop_exact_copies(spark, docs, sf_dir)
    assert sorted(r.text for r in exact.collect()) == sorted(["A", "B", "C", long, "D", long + " end", "E", "F"])
    near = corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()
    assert sorted(map(str, near)) == sorted(map(str, spark.createDataFrame([(3, "A"), (5, "B"), (6, "C"), (7, long), (7, "D"), (8, "E"), (None, "F")], docs.schema).collect()))
    many = spark.createDataFrame([(None if i < 100 else i // 2, "a", f"v{i} " * 50) for i in range(400)], "doc_id long, source string, text string")
    mixed = [r.doc_id for r in corpus_pipeline.mix_sources(spark, many, sf_dir).collect()]
    assert abs(len(mixed) - 400) < 5 and abs(mixed.count(None) - 100) < 5

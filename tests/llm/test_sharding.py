from collections import Counter, defaultdict

from pyspark.sql import functions as F

from stratacloud.llm.sharding import assign, cut_links, shard_documents


def test_even_gapless_and_linked(spark):
    texts = [f"t{i // 3}" for i in range(1500)] + ["hot"] * 700 + [None, ""] + [f"u{i}" for i in range(900)]
    df = spark.createDataFrame([(i, t, i % 7) for i, t in enumerate(texts)] + [(0, "t0", 0)], "doc_id long, text string, shard int")
    rows = shard_documents(df).collect()
    assert len(rows) == len(texts) + 1
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    at = defaultdict(set)
    for r in rows:
        at[texts[r.doc_id]].add(r.shard)
    triples = [len(v) for k, v in at.items() if k and k.startswith("t")]
    assert sum(n == 1 for n in triples) > 0.9 * len(triples)
    hot = Counter(r.shard for r in rows if texts[r.doc_id] == "hot")
    assert max(hot.values()) >= 19  # a hub holds a quarter of an even shard
    again = shard_documents(df.repartition(5)).collect()
    assert sorted((r.doc_id, r.shard) for r in again) == sorted((r.doc_id, r.shard) for r in rows)


def test_small_tables(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    assert sorted((r["size"], r.text_crc32, r.slot, r.law) for r in shard_documents(df).collect()) == [(16, 0, 0, "rows"), (17, 3904355907, 0, "rows")]
    assert shard_documents(df.limit(0)).count() == 0


def test_large_hubs_keep_together(spark):
    # 40 groups of a tenth of a shard, two of 60 %, one of 2.5 shards, among 240 000 rows: more than four buckets
    even = 6000
    n = F.col("id")
    text = F.when(n < 40 * 600, F.concat(F.lit("g"), n % 40)).when(n < 40 * 600 + 7200, F.concat(F.lit("h"), n % 2)).when(n < 50000, F.lit("hot")).otherwise(F.concat(F.lit("u"), n))
    df = spark.range(40 * even).select(n.alias("doc_id"), text.alias("text"))
    held = shard_documents(df).join(df, "doc_id").groupBy("text", "shard").agg(F.count("*").alias("n")).where("text not like 'u%'").collect()
    at = defaultdict(Counter)
    for r in held:
        at[r.text][r.shard] += r.n
    assert all(len(at[f"g{i}"]) == 1 for i in range(40)) and len(at["h0"]) == len(at["h1"]) == 1
    assert sum(v for _, v in at["hot"].most_common(4)) > 0.97 * 18800


def test_hubs_move_on_until_none_fits(spark):
    # every row is linked, in triples that leave no shard room for a hub that it is not offered in time
    df = spark.range(40 * 600).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.floor(F.col("id") / 3)).alias("text"))
    rows = shard_documents(df).join(df, "doc_id")
    assert rows.groupBy("text").agg(F.countDistinct("shard").alias("s")).where("s > 1").count() == 0


def test_cut_links_against_brute_force(spark):
    """The measure equals a count of pairs, and the labels cut far fewer links than the hash they start from."""
    texts = [f"t{i % 130}" for i in range(1200)] + [None] * 300
    rows = spark.createDataFrame([(i if i % 50 else None, t) for i, t in enumerate(texts)], "doc_id long, link string")
    placed = assign(rows, shards=8)
    got, at = cut_links(placed).first(), defaultdict(list)
    for r in placed.where("link is not null").collect():
        at[r.link].append(r.shard)
    brute = [(x, y) for shards in at.values() for i, x in enumerate(shards) for y in shards[:i]]
    assert (got.links, got.cut) == (len(brute), sum(x != y for x, y in brute))
    hashed = cut_links(rows.withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(8)))).first()
    assert hashed.links == got.links and got.cut < 0.05 * hashed.cut
    counts = Counter(r.shard for r in placed.collect())
    assert len(counts) == 8 and max(counts.values()) - min(counts.values()) <= 1


def test_null_ids_and_long_texts(spark):
    long = "x" * 2_000_000
    df = spark.createDataFrame([(None, "a"), (None, "a"), (1, long), (2, long), (2, long)], "doc_id long, text string")
    rows = shard_documents(df).collect()
    assert sorted(r["size"] for r in rows) == [17, 17] + [2_000_016] * 3
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) == 1

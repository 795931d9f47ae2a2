import hashlib

from pyspark.sql import functions as F

from stratacloud.llm import warc

LONG = "é\r\n\r\nWARC/1.1\r\n" * 200


def test_write_and_read(spark, tmp_path):
    payloads = {1: LONG, 2: LONG, 3: LONG + "x", 4: None, 5: "", 6: "a", 7: "a", 8: "end\r\n", 9: "end\r\n\r\n", 10: "\r\n", 11: "\r\n\r\n", 12: "\r\n\r", 13: "\r\nx\r\n\r\r\n", 14: "🙂" * 400, 15: "🙂" * 400, 16: "y" * 999, 17: "y" * 999}
    rows = [(k, None if k == 3 else f"http://x/{k}\r\n%", v, "z") for k, v in payloads.items()] + [(None, "u", LONG, "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, chunk string").repartition(3)
    for limit in (7, 1 << 20):
        path = str(tmp_path / f"w{limit}")
        warc.write_archives(warc.plan_records(pages), path, chunk_bytes=limit)
        chunks = warc.read_archives(spark, path)
        got = {r.page_id: r for r in warc.checked_records(chunks).collect()}
        assert len(got) == len(rows)
        revisits = {1: 2, None: 2, 14: 15}
        for k, text in {**payloads, None: LONG}.items():
            data = (text or "").encode()
            assert (got[k].payload_bytes, got[k].payload_digest) == (len(data), hashlib.sha1(data).hexdigest()), k
            assert (got[k].record_type, got[k].refers_to) == (("revisit", revisits[k]) if k in revisits else ("response", None))
        stored = chunks.groupBy("page_id").agg(F.max(F.octet_length("chunk")).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_no", "chunk"))), lambda c: c["chunk"].cast("string")), "").alias("t")).collect()
        assert all(r.n <= limit for r in stored)
        assert all(r.t == (payloads[r.page_id] or "") for r in stored if r.page_id and r.page_id not in revisits)
    warc.write_archives(warc.plan_records(pages.limit(0)), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


def test_chunks_are_cut_between_characters(spark):
    text = "aé日🙂" * 500 + "z"
    records = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "🙂" * 9)], "page_id long, html string")
    for limit in (4, 7, 10, 1000):
        rows = warc.cut_chunks(records, limit).collect()
        for page, want in ((1, text), (2, ""), (3, ""), (4, "🙂" * 9)):
            own = sorted((r.chunk_no, bytes(r.chunk)) for r in rows if r.page_id == page)
            assert [n for n, _ in own] == list(range(len(own))) and all(len(c) <= limit for _, c in own)
            assert "".join(c.decode() for _, c in own) == want


def test_payload_of_several_chunks_and_repeated_ids(spark, tmp_path):
    """More than two chunks of the default size; rows repeating an id, with equal and unlike payloads."""
    large = "é\r\n\r\nx" * 400_000
    rows = [(1, "u", large), (2, "u", large), (2, "u", large), (3, "v", "y" * 2000), (3, "v", "z" * 2000), (4, "v", "y" * 2000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(warc.plan_records(pages), str(tmp_path / "w"))
    chunks = warc.read_archives(spark, str(tmp_path / "w"))
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    got = sorted(tuple(r) for r in warc.checked_records(chunks).na.fill(-1).collect())
    n = len(large.encode())
    want = [(1, n, sha(large), "revisit", 2), (2, n, sha(large), "response", -1), (2, n, sha(large), "response", -1)]
    want += [(3, 2000, sha("y" * 2000), "revisit", 4), (3, 2000, sha("z" * 2000), "response", -1), (4, 2000, sha("y" * 2000), "response", -1)]
    assert got == sorted(want)
    assert chunks.where("page_id = 2").agg(F.max("chunk_no"), F.max(F.octet_length("chunk"))).first()[0] >= 2

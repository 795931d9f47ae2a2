import duckdb
import pytest

from stratacloud.llm import registry

SQL = registry.oracle_sql()
COLUMNS = {
    "op1_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op2_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op3_quality": {"doc_id", "held_out", "score", "predicted"},
    "op4_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op5_chat": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op6_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op7_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"},
    "op8_token_counts": {"doc_id", "n_tokens"},
    "op9_warc": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op10_topk": {"query_id", "rank", "vec_id", "score"},
}


def test_one_query_for_each_operator():
    assert set(registry.queries()) == {*COLUMNS, "pipeline"}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_rows_and_sql(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    assert COLUMNS[name] <= set(df.columns)
    rows = df.collect()
    assert rows
    if name in SQL:
        con = duckdb.connect()
        for t in ("documents", "conversations", "pages", "embeddings"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        columns = sorted(df.columns)
        want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({SQL[name]})").fetchall()
        assert sorted(repr(tuple(r[c] for c in columns)) for r in rows) == sorted(map(repr, want))

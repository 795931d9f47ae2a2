"""DuckDB SQL of the queries that SQL can express."""


def _hex(text: str) -> str:
    """The number that the first eight hex digits of an MD5 write."""
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def _seats(name: str, parties: str, key: str, weight: str, seats: str, order: str, own: str, out: str) -> str:
    """Tables <name>: the rows of `parties` with the seats of highest quotients, `seats` for each key."""
    return f"""
        {name}_f AS (SELECT *, coalesce({weight} / nullif(sum({weight}) OVER (PARTITION BY {key}), 0), 0) AS f_, count(*) OVER (PARTITION BY {key}) / CAST(2 AS DOUBLE) AS half_ FROM {parties}),
        {name}_r AS (SELECT *, CAST(greatest(0, floor(f_ * ({seats} - half_) - 1)) AS BIGINT) AS low_, CASE WHEN f_ > 0 THEN CAST(ceil(f_ * ({seats} + half_) + 1) AS BIGINT) ELSE 0 END AS high_ FROM {name}_f),
        {name}_o AS (SELECT *, {seats} - sum(low_) OVER (PARTITION BY {key}) AS open_ FROM {name}_r),
        {name}_s AS (SELECT *, unnest(range(low_, high_)) AS seat_ FROM {name}_o),
        {name}_k AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {weight} / (2 * seat_ + 1) DESC, {order}) AS rank_ FROM {name}_s),
        {name}_c AS (SELECT {own}, count(*) AS more_ FROM {name}_k WHERE rank_ <= open_ GROUP BY ALL),
        {name} AS (SELECT o.*, low_ + coalesce(more_, 0) AS {out} FROM {name}_o o LEFT JOIN {name}_c c USING ({own}))"""


MIXING = rf"""
    WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, '17:' || coalesce(CAST(doc_id AS VARCHAR), '') AS ticket FROM documents),
        t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s GROUP BY source),
        w AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight FROM t),
        l AS (SELECT *, CAST(CAST(sum(source_size) OVER () AS BIGINT) - coalesce(sum(3 * source_size) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                        / sum(weight) OVER (ORDER BY CAST(3 * source_size AS DOUBLE) / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        g AS (SELECT source, place, source_size, docs, least(CAST(3 * source_size AS DOUBLE), weight * max(level) OVER ()) AS target, CAST(round(CAST(sum(source_size) OVER () AS DOUBLE) / 4) AS BIGINT) AS blocks, 1 AS every FROM l),
        {_seats("a", "g", "every", "target", "blocks", "place", "place", "quota")},
        p AS (SELECT s.doc_id, s.size, s.ticket, a.place, a.source_size, a.target, a.quota, {_hex("s.ticket")} % least(256, CAST(ceil(a.docs / CAST(64 AS DOUBLE)) AS BIGINT)) AS shard FROM s JOIN a ON s.source IS NOT DISTINCT FROM a.source),
        h AS (SELECT place, shard, quota, CAST(sum(size) AS DOUBLE) AS words FROM p GROUP BY ALL),
        {_seats("b", "h", "place", "words", "quota", "shard", "place, shard", "seats")},
        n AS (SELECT place, shard, CAST(words AS BIGINT) AS words, seats, greatest(1, CAST(round(words / 4) AS BIGINT)) AS n FROM b),
        q AS (SELECT *, least(seats, 3 * n) // n AS passes, least(seats, 3 * n) % n AS run, {_hex("'17:' || place || ':' || shard")} % n AS start FROM n),
        e AS (SELECT place, shard, passes, start * (words // n) + least(start, words % n) AS from_word, least(start + run, n) * (words // n) + least(least(start + run, n), words % n) AS to_word,
                     greatest(start + run - n, 0) * (words // n) + least(greatest(start + run - n, 0), words % n) AS wrap_word FROM q),
        d AS (SELECT *, coalesce(CAST(sum(size) OVER (PARTITION BY place, shard ORDER BY md5(ticket), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS pos FROM p)
    SELECT doc_id, size, source_size, target,
           CAST(passes * size + greatest(0, least(pos + size, to_word) - greatest(pos, from_word)) + greatest(0, least(pos + size, wrap_word) - pos) AS BIGINT) AS taken
    FROM d JOIN e USING (place, shard)
"""

ORACLES = {
    "op1_mixing": MIXING,
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
             g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.body) AS text_sha256
        FROM t JOIN g ON t.body = g.body
    """,
    "op5_chat": r"""
        WITH m AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), e AS (
            SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS body,
                   replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS name FROM m
        ), g AS (
            SELECT conv_id, count(*) AS n_turns,
                   string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, body) AS told,
                   coalesce(string_agg(text, '' ORDER BY turn, role, body) FILTER (role = 'assistant'), '') AS loss,
                   sum(length('<turn ' || name || '>' || body || '</turn>' || chr(10))) AS formatted_chars
            FROM e GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
               CAST(formatted_chars AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS expanded_tokens
        FROM g
    """,
    "op9_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS digest, max(page_id) OVER (PARTITION BY html) AS first,
                          count(*) OVER (PARTITION BY html) AS copies FROM p)
        SELECT page_id, n AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 1000 AND copies > 1 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND copies > 1 AND page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM d
    """,
    "op10_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
                   CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
}

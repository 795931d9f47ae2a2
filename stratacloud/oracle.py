"""DuckDB SQL for the registered queries, written independently of the DataFrame code."""

from __future__ import annotations

ID = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
P = f"""
    p AS (SELECT {ID}, l_extendedprice AS wx, CAST(l_partkey * 50 AS DOUBLE) AS wy, l_quantity * CAST(2000 AS DOUBLE) AS wz,
                 CAST(epoch(l_shipdate) AS DOUBLE) AS gps_time, CAST(l_suppkey % 8 AS INTEGER) AS file_idx FROM lineitem)"""
E = """
    p AS (SELECT event_id AS point_id, CAST(user_id AS DOUBLE) AS wx, value AS wy, CAST(CAST(floor(epoch(ts)) AS BIGINT) % 86400 AS DOUBLE) AS wz,
                 CAST(floor(epoch(ts)) AS DOUBLE) AS gps_time FROM events)"""
#: Bounds and cube of p.
FRAME = """
    b AS (SELECT min(wx + 0) AS min_x, max(wx + 0) AS max_x, min(wy + 0) AS min_y, max(wy + 0) AS max_y, min(wz + 0) AS min_z, max(wz + 0) AS max_z, count(*) AS n FROM p),
    h AS (SELECT *, (greatest(max_x - min_x, max_y - min_y, max_z - min_z) / CAST(2 AS DOUBLE) + CAST(0.01 AS DOUBLE)) * CAST(1.0001 AS DOUBLE) AS half FROM b),
    f AS (SELECT *, min_x - CAST(0.01 AS DOUBLE) + half AS cx, min_y - CAST(0.01 AS DOUBLE) + half AS cy, min_z - CAST(0.01 AS DOUBLE) + half AS cz FROM h)"""
POS = "CAST({} AS DOUBLE)"


def keyed(source: str, depth: int, keep: str) -> str:
    """Rows of `source` with kx, ky, kz at `depth`, one halving of all axes in each nested query."""
    sql = f"SELECT {keep}, wx, wy, wz" + "".join(f", c{a} - half AS l{a}, c{a} + half AS h{a}, 0 AS k{a}" for a in "xyz") + f" FROM {source}, f"
    for _ in range(depth):
        mid = {a: f"(l{a} + (h{a} - l{a}) / CAST(2 AS DOUBLE))" for a in "xyz"}
        part = ", ".join(f"CASE WHEN w{a} >= {m} THEN {m} ELSE l{a} END AS l{a}, CASE WHEN w{a} >= {m} THEN h{a} ELSE {m} END AS h{a}, k{a} * 2 + CASE WHEN w{a} >= {m} THEN 1 ELSE 0 END AS k{a}" for a, m in mid.items())
        sql = f"SELECT {keep}, wx, wy, wz, {part} FROM ({sql})"
    return f"SELECT {keep}, wx, wy, wz, kx, ky, kz FROM ({sql})"


def cells(depth: int) -> str:
    return f"c AS (SELECT kx AS x, ky AS y, kz AS z, count(*) AS n FROM ({keyed('p', depth, 'file_idx')}) GROUP BY ALL)"


def totals(depth: int) -> str:
    return f"t AS (SELECT CAST(l AS INTEGER) AS level, x >> ({depth} - l) AS x, y >> ({depth} - l) AS y, z >> ({depth} - l) AS z, CAST(sum(n) AS BIGINT) AS n FROM c, range({depth} + 1) r(l) GROUP BY ALL)"


def assigned(leaf: int, cap: int, keep: str) -> str:
    """k: points with their key at the cap; a: points with the node that they are in."""
    return f"""
    k AS ({keyed('p', cap, keep)}),
    full_ AS (SELECT CAST(l AS INTEGER) AS level, kx >> ({cap} - l) AS x, ky >> ({cap} - l) AS y, kz >> ({cap} - l) AS z FROM k, range({cap}) r(l) GROUP BY ALL HAVING count(*) > {leaf}),
    d AS (SELECT kx, ky, kz, count(full_.level) AS level FROM (SELECT DISTINCT kx, ky, kz FROM k) u, range({cap}) r(l)
          LEFT JOIN full_ ON full_.level = l AND full_.x = kx >> ({cap} - l) AND full_.y = ky >> ({cap} - l) AND full_.z = kz >> ({cap} - l) GROUP BY kx, ky, kz),
    a AS (SELECT k.* EXCLUDE (kx, ky, kz), CAST(d.level AS INTEGER) AS level, k.kx >> ({cap} - d.level) AS kx, k.ky >> ({cap} - d.level) AS ky, k.kz >> ({cap} - d.level) AS kz FROM k JOIN d ON k.kx = d.kx AND k.ky = d.ky AND k.kz = d.kz)"""


NODES = "nodes AS (SELECT level, CAST(kx AS INTEGER) AS x, CAST(ky AS INTEGER) AS y, CAST(kz AS INTEGER) AS z, count(*) AS n FROM a GROUP BY ALL)"
MISSING = """missing AS (SELECT DISTINCT CAST(l AS INTEGER) AS level, x >> (level - l) AS x, y >> (level - l) AS y, z >> (level - l) AS z FROM nodes, range(30) r(l) WHERE l < level),
    every AS (SELECT * FROM nodes UNION ALL SELECT m.level, m.x, m.y, m.z, CAST(0 AS BIGINT) FROM missing m ANTI JOIN nodes USING (level, x, y, z))"""
SAMPLES = """r AS (SELECT level, kx AS x, ky AS y, kz AS z, gps_time, row_number() OVER (PARTITION BY level, kx, ky, kz ORDER BY gps_time, point_id) - 1 AS place, count(*) OVER (PARTITION BY level, kx, ky, kz) AS n FROM a),
    s AS (SELECT level, x, y, z, place, gps_time FROM r WHERE place % 10 = 0 OR place = n - 1)"""


def morton(x: str, y: str, z: str) -> str:
    def spread(v: str) -> str:
        v = f"(CAST({v} AS HUGEINT) & 2097151)"
        for by, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)):
            v = f"(({v} | ({v} * {2**by})) & CAST({mask} AS HUGEINT))" if by == 32 else f"(SELECT (q | (q * {2**by})) & CAST({mask} AS HUGEINT) FROM (SELECT {v} AS q))"
        return v

    return f"CAST({spread(x)} + {spread(y)} * 2 + {spread(z)} * 4 AS BIGINT)"


def quantized(axis: str) -> str:
    return f"CAST(round(w{axis} / CAST(0.01 AS DOUBLE)) AS INTEGER)"


def sampled(source: str, level: str, cells_: int, keep: str) -> str:
    """Sampling cell and Morton code of points(x, y, z) in parents (px, py, pz) at a level."""
    side = f"(CAST(2 AS DOUBLE) * half / pow(CAST(2 AS DOUBLE), {level}))"
    off = {a: f"(CAST({a} AS BIGINT) - CAST(round((c{a} - half + CAST(p{a} AS DOUBLE) * {side}) / CAST(0.01 AS DOUBLE)) AS BIGINT))" for a in "xyz"}
    size = f"CAST(greatest(round({side} / CAST(0.01 AS DOUBLE)), {cells_}) AS BIGINT)"
    rows = f"SELECT {keep}, {size} AS size, " + ", ".join(f"greatest({off[a]}, 0) AS o{a}" for a in "xyz") + f" FROM {source}, f"
    at = {a: f"least(o{a} * {cells_} // size, {cells_ - 1})" for a in "xyz"}
    return f"SELECT {keep}, CAST({at['x']} + {at['y']} * {cells_} + {at['z']} * {cells_ * cells_} AS INTEGER) AS cell, {morton('ox', 'oy', 'oz')} AS code FROM ({rows})"


def lod(leaf: int, cap: int, grid: int) -> str:
    """t0: points after all promotions, one group of queries for each level."""
    sql = f"{assigned(leaf, cap, 'point_id')}, t{cap} AS (SELECT point_id, level, CAST(kx AS INTEGER) AS kx, CAST(ky AS INTEGER) AS ky, CAST(kz AS INTEGER) AS kz, {quantized('x')} AS x, {quantized('y')} AS y, {quantized('z')} AS z FROM a)"
    for level in range(cap - 1, -1, -1):
        was = f"t{level + 1}"
        keep = "point_id, kx, ky, kz, px, py, pz"
        source = f"(SELECT *, kx >> 1 AS px, ky >> 1 AS py, kz >> 1 AS pz FROM {was} WHERE level = {level + 1})"
        sql += f""",
    g{level} AS ({sampled(source, str(level), grid, keep)}),
    o{level} AS (SELECT *, row_number() OVER (PARTITION BY px, py, pz, cell ORDER BY (kx & 1) + (ky & 1) * 2 + (kz & 1) * 4, code, point_id) = 1 AS up FROM g{level}),
    e{level} AS (SELECT *, bool_and(up) OVER (PARTITION BY kx, ky, kz) AS bare, row_number() OVER (PARTITION BY kx, ky, kz ORDER BY code DESC, point_id DESC) AS back FROM o{level}),
    u{level} AS (SELECT point_id FROM e{level} WHERE up AND NOT (bare AND back = 1)),
    t{level} AS (SELECT w.point_id, CASE WHEN u.point_id IS NULL THEN w.level ELSE {level} END AS level, CASE WHEN u.point_id IS NULL THEN kx ELSE kx >> 1 END AS kx, CASE WHEN u.point_id IS NULL THEN ky ELSE ky >> 1 END AS ky,
                 CASE WHEN u.point_id IS NULL THEN kz ELSE kz >> 1 END AS kz, x, y, z FROM {was} w LEFT JOIN u{level} u ON w.point_id = u.point_id)"""
    return sql


def levels_of(count: str, limit: int, cap: int) -> str:
    return "CASE " + " ".join(f"WHEN CAST({count} AS DOUBLE) / {8**k} <= {limit} THEN {k}" for k in range(cap)) + f" ELSE {cap} END"


ROOTS = """big AS (SELECT * FROM t WHERE level < 3 AND n > 200),
    roots AS (SELECT t.* FROM t WHERE NOT (level < 3 AND n > 200) AND (level = 0 OR EXISTS (SELECT 1 FROM big WHERE big.level = t.level - 1 AND big.x = t.x >> 1 AND big.y = t.y >> 1 AND big.z = t.z >> 1))),
    ext AS (SELECT *, CASE WHEN level = 3 AND n > 200 THEN """ + levels_of("n", 200, 6) + """ ELSE 0 END AS k FROM roots)"""
PLAN = """plan AS (SELECT CAST(level + k AS INTEGER) AS level, CAST(x * (1 << k) + i % (1 << k) AS INTEGER) AS x, CAST(y * (1 << k) + (i >> k) % (1 << k) AS INTEGER) AS y, CAST(z * (1 << k) + (i >> (2 * k)) AS INTEGER) AS z,
                     n // (1 << (3 * k)) + CASE WHEN i < n % (1 << (3 * k)) THEN 1 ELSE 0 END AS estimate
              FROM ext, range(262144) r(i) WHERE i < (1 << (3 * k)))"""
#: Page levels in files whose deepest level is m: multiples of three below m.
PAGES = "m AS (SELECT max(level) AS m FROM {0}), bounds AS (SELECT l FROM range(0, 30, 3) r(l), m WHERE l < m OR l = 0)"


def page_tables(source: str, inclusive: bool, columns: str, sums: str) -> str:
    """g: pages with their entries; q: pages with the number of pages that they point to."""
    compare = "<=" if inclusive else "<"
    return f"""
    e0 AS (SELECT *, coalesce((SELECT max(l) FROM bounds WHERE l {compare} level), 0) AS pl FROM {source}),
    g AS (SELECT pl, x >> (level - pl) AS px, y >> (level - pl) AS py, z >> (level - pl) AS pz, {columns} FROM e0 GROUP BY ALL),
    up AS (SELECT pl - 3 AS pl, px >> 3 AS px, py >> 3 AS py, pz >> 3 AS pz, count(*) AS pointers FROM g WHERE pl > 0 GROUP BY ALL),
    q AS (SELECT coalesce(g.pl, up.pl) AS page_level, coalesce(g.px, up.px) AS page_x, coalesce(g.py, up.py) AS page_y, coalesce(g.pz, up.pz) AS page_z, {sums}, coalesce(pointers, 0) AS pointers
          FROM g FULL JOIN up ON g.pl = up.pl AND g.px = up.px AND g.py = up.py AND g.pz = up.pz)"""


def rank_at(share: str) -> str:
    return f"CAST(round((count(*) - 1) * CAST({share} AS DOUBLE)) AS BIGINT)"


def statements() -> dict[str, str]:
    q25 = lambda a: f"CAST(round((w{a} - CAST(10 AS DOUBLE)) / CAST(0.25 AS DOUBLE)) AS INTEGER)"
    leaf = assigned(1000, 8, "gps_time, l_linenumber")
    fine = assigned(20, 8, "point_id, gps_time")
    event_leaf = assigned(500, 8, "point_id, gps_time")
    return {
        "quantize_roundtrip": f"WITH {P} SELECT {ID}, " + ", ".join(f"{q25(a)} AS {a}, {q25(a)} * CAST(0.25 AS DOUBLE) + CAST(10 AS DOUBLE) AS s{a}" for a in "xyz") + " FROM p",
        "octree_keys": f"WITH {P}, {FRAME} SELECT {ID}, wx, kx, ky, kz FROM ({keyed('p', 12, ID)})",
        "key_ancestors": f"WITH {P}, {FRAME}, {cells(6)} SELECT x, y, z, x >> 1 AS px, y >> 1 AS py, z >> 1 AS pz, x >> 4 AS ax, y >> 4 AS ay, z >> 4 AS az, (x & 1) + (y & 1) * 2 + (z & 1) * 4 AS octant, (x & 3) + (y & 3) * 4 + (z & 3) * 16 AS local FROM c",
        "key_children": f"WITH {P}, {FRAME}, {cells(3)} SELECT 4 AS level, x * 2 + CAST(o & 1 AS INTEGER) AS x, y * 2 + CAST((o >> 1) & 1 AS INTEGER) AS y, z * 2 + CAST(o >> 2 AS INTEGER) AS z FROM c, range(8) r(o)",
        "morton_codes": f"WITH {P}, v AS (SELECT {ID}, {quantized('x')} AS x, {quantized('y')} AS y, {quantized('z')} AS z FROM p) SELECT {ID}, x, {morton('x', 'y', 'z')} AS code FROM v",
        "sample_cells": f"WITH {E}, {FRAME}, v AS (SELECT point_id, {quantized('x')} AS x, {quantized('y')} AS y, {quantized('z')} AS z, kx AS px, ky AS py, kz AS pz FROM ({keyed('p', 2, 'point_id')})) {sampled('v', '2', 128, 'point_id')}",
        "las_flags_bits": f"""WITH v AS (SELECT {ID}, l_extendedprice, l_linenumber * 37 % 256 AS b14, CAST(l_partkey % 256 AS INTEGER) AS b15, CAST(l_suppkey % 11 AS INTEGER) AS fmt FROM lineitem),
            w AS (SELECT *, CASE WHEN fmt IN (2, 3, 5, 7) THEN 7 WHEN fmt IN (8, 10) THEN 8 ELSE 6 END AS out FROM v)
            SELECT {ID}, l_extendedprice, CASE WHEN fmt >= 6 THEN b15 ELSE (b15 >> 5) | (b14 & 192) END AS flags, (l_linenumber & 15) | ((b15 & 15) << 4) AS returns, out AS output_format,
                   CASE out WHEN 6 THEN 30 WHEN 7 THEN 36 ELSE 38 END + fmt AS record_length, fmt NOT IN (0, 2) AS has_gps,
                   ['undocumented', 'u8', 'i8', 'u16', 'i16', 'u32', 'i32', 'u64', 'i64', 'f32', 'f64'][fmt + 1] AS type_name FROM w""",
        "file_scan": f"WITH {P} SELECT file_idx, count(*) AS point_count, min(wx) AS min_x, max(wx) AS max_x, min(wy) AS min_y, max(wy) AS max_y, min(wz) AS min_z, max(wz) AS max_z FROM p GROUP BY file_idx",
        "file_totals": f"WITH {P} SELECT count(DISTINCT file_idx) AS files, count(*) AS points, min(wx + 0) AS min_x, max(wx + 0) AS max_x, min(wy + 0) AS min_y, max(wy + 0) AS max_y, min(wz + 0) AS min_z, max(wz + 0) AS max_z FROM p",
        "first_payload": "SELECT s_suppkey AS file_idx, s_name AS wkt FROM supplier WHERE s_acctbal > 5000 ORDER BY s_suppkey LIMIT 1",
        "bounds_frame": f"""WITH {P}, {FRAME}, g AS (SELECT (greatest(max_x / 2 - min_x, max_y / 2 - min_y, max_z / 2 - min_z) / CAST(2 AS DOUBLE) + CAST(0.01 AS DOUBLE)) * CAST(1.0001 AS DOUBLE) AS fitted FROM b)
            SELECT n, min_x, max_x, min_y, max_y, min_z, max_z, cx, cy, cz, half, fitted < CAST(0.9 AS DOUBLE) * half AS refit FROM f, g""",
        "header_mismatch": f"""WITH {P}, {FRAME}, v AS (SELECT unnest(['min_x', 'max_x', 'min_y', 'max_y', 'min_z', 'max_z']) AS bound, unnest([min_x, max_x, min_y, max_y, min_z, max_z]) AS actual,
            unnest([CAST(-1.0 AS DOUBLE), 0.0, 0.01, 0.02, 0.0, 5.0]) AS delta FROM b)
            SELECT bound, actual + delta AS header, actual FROM v WHERE abs((actual + delta) - actual) > CAST(1.5 AS DOUBLE) * CAST(0.01 AS DOUBLE)""",
        "validate_files": """WITH v AS (SELECT s_suppkey AS i, s_suppkey % 7 < 4 AS has_wkt, CASE WHEN s_suppkey % 5 = 0 THEN 32633 ELSE 3006 END AS code, s_suppkey % 7 = 5 AS has_code,
                CASE WHEN s_suppkey % 14 = 5 THEN 5613 END AS vertical, CASE WHEN s_suppkey % 11 = 3 THEN 2 ELSE 7 END AS fmt, s_suppkey % 3 > 0 AS has_extra, s_suppkey % 2 AS extra, s_suppkey % 13 <> 4 AS std FROM supplier),
            r AS (SELECT (SELECT code FROM v WHERE has_wkt ORDER BY i LIMIT 1) AS code, (SELECT fmt FROM v ORDER BY i LIMIT 1) AS fmt, (SELECT extra FROM v WHERE has_extra ORDER BY i LIMIT 1) AS extra, (SELECT std FROM v ORDER BY i LIMIT 1) AS std)
            SELECT i AS file_idx, 'crs' AS reason FROM v, r WHERE CASE WHEN has_wkt THEN v.code <> r.code WHEN has_code THEN r.code <> 3006 ELSE true END
            UNION ALL SELECT i, 'point_format' FROM v, r WHERE v.fmt <> r.fmt
            UNION ALL SELECT i, 'extra_bytes' FROM v, r WHERE NOT has_extra OR v.extra <> r.extra
            UNION ALL SELECT i, 'gps_time' FROM v, r WHERE v.fmt <> 2 AND v.std <> r.std
            UNION ALL SELECT i, 'vertical_only' FROM v, r WHERE has_code AND NOT has_wkt AND r.code = 3006 AND vertical IS NOT NULL""",
        "schema_diff": """WITH j AS (SELECT CAST(n_nationkey AS INTEGER) AS place, n_name, CAST(n_regionkey AS VARCHAR) AS a, r_name, CAST(r_regionkey AS VARCHAR) AS b FROM nation FULL JOIN region ON n_nationkey = r_regionkey WHERE coalesce(n_nationkey, r_regionkey) < 5)
            SELECT place, 'name' AS what, n_name AS left, r_name AS right FROM j WHERE n_name IS DISTINCT FROM r_name UNION ALL SELECT place, 'data_type', a, b FROM j WHERE a IS DISTINCT FROM b""",
        "stat_merge": """SELECT l_linenumber AS place, min(CASE WHEN l_orderkey % 17 <> 0 AND l_orderkey % 19 <> 0 THEN l_extendedprice END) AS low, max(l_extendedprice * 2) AS high, bool_or(l_orderkey % 1000 = 0) AS has_no_data, true AS has_range FROM lineitem GROUP BY 1""",
        "grid_counts": f"WITH {P}, {FRAME}, {cells(5)} SELECT * FROM c",
        "level_rollup": f"WITH {P}, {FRAME}, {cells(5)}, {totals(5)} SELECT * FROM t",
        "chunk_plan": f"WITH {P}, {FRAME}, {cells(3)}, {totals(3)}, {ROOTS}, {PLAN} SELECT * FROM plan",
        "chunk_routing": f"""WITH {P}, {FRAME}, {cells(3)}, {totals(3)}, {ROOTS}, k AS ({keyed('p', 9, 'file_idx')})
            SELECT CAST(e.level + e.k AS INTEGER) AS chunk_level, kx >> (9 - e.level - e.k) AS cx, ky >> (9 - e.level - e.k) AS cy, kz >> (9 - e.level - e.k) AS cz, count(*) AS n
            FROM k JOIN ext e ON kx >> (9 - e.level) = e.x AND ky >> (9 - e.level) = e.y AND kz >> (9 - e.level) = e.z GROUP BY ALL""",
        "leaf_level_summary": f"WITH {P}, {FRAME}, {leaf}, {NODES} SELECT level, count(*) AS nodes, CAST(sum(n) AS BIGINT) AS points, max(n) AS max_points FROM nodes GROUP BY level",
        "leaf_nodes": f"WITH {P}, {FRAME}, {leaf}, {NODES} SELECT * FROM nodes",
        "leaf_assign": f"WITH {E}, {FRAME}, {event_leaf} SELECT point_id, level, kx, ky, kz FROM a",
        "lod_points": f"WITH {E}, {FRAME}, {lod(500, 8, 8)} SELECT point_id, level, kx, ky, kz FROM t0",
        "lod_nodes": f"WITH {E}, {FRAME}, {lod(500, 8, 8)}, nodes AS (SELECT level, kx AS x, ky AS y, kz AS z, count(*) AS n FROM t0 GROUP BY ALL), {MISSING} SELECT * FROM every",
        "lod_query": f"WITH {E}, {FRAME}, {lod(500, 8, 8)} SELECT point_id, level FROM t0 WHERE level <= 1",
        "temporal_samples": f"WITH {E}, {FRAME}, {fine}, {SAMPLES} SELECT * FROM s",
        "temporal_pages": f"""WITH {E}, {FRAME}, {fine}, {SAMPLES}, n AS (SELECT level, x, y, z, count(*) AS c, min(gps_time) AS a, max(gps_time) AS b FROM s GROUP BY ALL), {PAGES.format('n')},
            {page_tables('n', False, 'count(*) AS entries, sum(c) AS samples', 'coalesce(entries, 0) AS entries, coalesce(samples, 0) AS samples')},
            w AS (SELECT l AS pl, x >> (level - l) AS px, y >> (level - l) AS py, z >> (level - l) AS pz, min(a) AS min_time, max(b) AS max_time FROM n, bounds WHERE level >= l GROUP BY ALL)
            SELECT CAST(page_level AS INTEGER) AS page_level, CAST(page_x AS INTEGER) AS page_x, CAST(page_y AS INTEGER) AS page_y, CAST(page_z AS INTEGER) AS page_z, entries, CAST(samples AS BIGINT) AS samples, pointers, min_time, max_time, CAST(entries * 20 + samples * 8 + pointers * 48 AS BIGINT) AS bytes
            FROM q LEFT JOIN w ON page_level = pl AND page_x = px AND page_y = py AND page_z = pz""",
        "hierarchy_offsets": f"""WITH {P}, {FRAME}, {leaf}, {NODES}, {MISSING} SELECT level, x, y, z, CASE WHEN n = 0 THEN 0 ELSE CAST(608 + sum(n * 36) OVER (ORDER BY level, x, y, z) - n * 36 AS BIGINT) END AS offset, n * 36 AS byte_size, n AS point_count FROM every""",
        "hierarchy_pages": f"""WITH {P}, {FRAME}, {assigned(20, 8, 'gps_time')}, {NODES}, {MISSING}, {PAGES.format('every')}, {page_tables('every', True, 'count(*) AS entries', 'coalesce(entries, 0) AS entries')}
            SELECT CAST(page_level AS INTEGER) AS page_level, CAST(page_x AS INTEGER) AS page_x, CAST(page_y AS INTEGER) AS page_y, CAST(page_z AS INTEGER) AS page_z, entries, pointers, (entries + pointers) * 32 AS bytes FROM q""",
        "return_histogram": f"WITH {P}, {FRAME}, {leaf} SELECT level, kx AS x, ky AS y, kz AS z, " + ", ".join(f"count(*) FILTER (l_linenumber = {r}) AS r{r}" for r in range(16)) + ", min(gps_time) AS gps_min, max(gps_time) AS gps_max FROM a GROUP BY ALL",
        "level_stats": f"WITH {P}, {FRAME}, {leaf}, {NODES} SELECT level, count(*) AS nodes, CAST(sum(n) AS BIGINT) AS points, CAST(sum(n) // count(*) AS BIGINT) AS avg_points FROM nodes GROUP BY level",
        "file_stats": f"WITH {P}, {FRAME}, {leaf}, {NODES} SELECT max(level) AS max_level, count(*) AS nodes, CAST(sum(n) AS BIGINT) AS points, CAST(sum(n) // count(*) AS BIGINT) AS avg_points, CAST(2.5 AS DOUBLE) AS ratio FROM nodes",
        "compare_ab": f"""WITH {P}, {FRAME}, x AS (WITH {leaf}, {NODES} SELECT level, count(*) AS nodes_a, sum(n) AS points_a FROM nodes GROUP BY level),
            y AS (WITH {assigned(200, 8, 'gps_time')}, {NODES} SELECT level, count(*) AS nodes_b, sum(n) AS points_b FROM nodes GROUP BY level),
            j AS (SELECT level, coalesce(nodes_a, 0) AS nodes_a, coalesce(nodes_b, 0) AS nodes_b, CAST(coalesce(points_a, 0) AS BIGINT) AS points_a, CAST(coalesce(points_b, 0) AS BIGINT) AS points_b FROM x FULL JOIN y USING (level))
            SELECT *, nodes_b - nodes_a AS nodes_diff, points_b - points_a AS points_diff FROM j""",
        "time_histogram": f"""WITH {P}, e AS (SELECT min(gps_time) AS a, max(gps_time) AS b FROM p) SELECT CAST(least(floor((gps_time - a) / ((b - a) / CAST(20 AS DOUBLE))), 19) AS INTEGER) AS bucket, count(*) AS n FROM p, e WHERE b > a GROUP BY 1""",
        "time_coverage": f"""WITH {E}, {FRAME}, {fine}, {SAMPLES}, g AS (SELECT level, count(DISTINCT (x, y, z)) AS nodes, count(*) AS samples, min(gps_time) AS first_time, max(gps_time) AS last_time FROM s GROUP BY level)
            SELECT *, first_time - (SELECT min(first_time) FROM g) AS from_start, last_time - first_time AS span FROM g""",
        "sample_density": f"""WITH {E}, {FRAME}, {fine}, {SAMPLES}, n AS (SELECT count(*) AS c FROM s GROUP BY level, x, y, z)
            SELECT count(*) AS nodes, min(c) AS least, max(c) AS most, CAST(sum(c) AS DOUBLE) / count(*) AS mean, list_sort(list(c))[count(*) // 2 + 1] AS median FROM n""",
        "chunk_size_report": f"""WITH {P}, {FRAME}, {cells(3)}, {totals(3)}, {ROOTS}, {PLAN}, a AS (SELECT count(*) AS chunks, CAST(sum(estimate) AS BIGINT) AS points, min(estimate) AS least, max(estimate) AS most, list_sort(list(estimate)) AS v,
              {rank_at('0.5')} AS i50, {rank_at('0.9')} AS i90, {rank_at('0.99')} AS i99, count(*) FILTER (estimate > 200) AS above, count(*) FILTER (estimate > 400) AS double, count(*) FILTER (estimate * 10 < 200) AS tiny, count(*) FILTER (estimate = 0) AS empty FROM plan)
            SELECT chunks, points, least, most, v[i50 + 1] AS p50, v[i90 + 1] AS p90, v[i99 + 1] AS p99, above, double, tiny, empty, points // chunks AS mean,
              CAST(floor(sqrt(CAST((SELECT sum((estimate - points // chunks) * (estimate - points // chunks)) FROM plan) AS DOUBLE) / chunks)) AS BIGINT) AS deviation FROM a""",
        "quality_checks": "SELECT unnest(['unique keys', 'key within its level', 'ancestors present', 'interior nodes hold points', 'root present', 'points conserved', 'points within their nodes', 'chunks contiguous']) AS rule, CAST(0 AS BIGINT) AS broken",
        "quality_planted": """WITH k AS (SELECT p_partkey AS k, p_size AS s, CAST(p_partkey % 5 AS INTEGER) AS level, 1 << CAST(p_partkey % 5 AS INTEGER) AS side FROM part),
            v AS (SELECT level, side, k * 7 % (side + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END) AS x, k // 3 % (side + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END) AS y, k // 11 % side AS z, s % 4 AS n FROM k),
            u AS (SELECT DISTINCT level - 1 AS level, x >> 1 AS x, y >> 1 AS y, z >> 1 AS z FROM v WHERE level > 0),
            e AS (SELECT k * 100 AS start, 100 + CASE WHEN k % 17 = 0 THEN 1 ELSE 0 END AS size, s % 3 AS points FROM k), w AS (SELECT * FROM e WHERE points > 0),
            t AS (SELECT k % 40 AS node, k // 40 AS place, k // 40 - CASE WHEN k % 40 = 7 THEN k % 3 * 5 ELSE 0 END AS gps FROM k),
            g AS (SELECT node, place, gps < lag(gps) OVER (PARTITION BY node ORDER BY place) AS late FROM t)
            SELECT 'unique keys' AS rule, (SELECT count(*) FROM (SELECT 1 FROM v GROUP BY level, x, y, z HAVING count(*) > 1)) AS broken
            UNION ALL SELECT 'key within its level', (SELECT count(*) FROM v WHERE x >= side OR y >= side OR z >= side)
            UNION ALL SELECT 'ancestors present', (SELECT count(*) FROM u ANTI JOIN v USING (level, x, y, z))
            UNION ALL SELECT 'interior nodes hold points', (SELECT count(*) FROM (SELECT * FROM v WHERE n = 0) SEMI JOIN u USING (level, x, y, z))
            UNION ALL SELECT 'root present', (SELECT CASE WHEN count(*) <> 1 THEN 1 ELSE 0 END FROM v WHERE level = 0)
            UNION ALL SELECT 'points conserved', (SELECT CASE WHEN sum(n) <> 12345 THEN 1 ELSE 0 END FROM v)
            UNION ALL SELECT 'chunks contiguous', (SELECT count(*) FROM w WHERE start > (SELECT min(start) FROM w) AND start NOT IN (SELECT start + size FROM w)) + (SELECT count(*) FROM e WHERE points = 0)
            UNION ALL SELECT 'samples in time order', (SELECT count(DISTINCT node) FROM g WHERE late)
            UNION ALL SELECT 'samples end with the node', (SELECT count(*) FROM (SELECT node FROM t GROUP BY node HAVING max(place) <> count(*) - 1 + CASE WHEN node % 9 = 4 THEN 1 ELSE 0 END))""",
        "page_rules": """WITH g AS (SELECT p_partkey AS k, p_partkey * 96 AS start, 32 * (1 + p_partkey % 3) + CASE WHEN p_partkey % 23 = 0 THEN 8 ELSE 0 END + CASE WHEN p_partkey % 101 = 0 THEN 320 ELSE 0 END AS size, p_size FROM part),
            n AS (SELECT *, max(start + size) OVER (ORDER BY start, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM g)
            SELECT 'pages of whole entries' AS rule, (SELECT count(*) FROM g WHERE size % 32 <> 0) AS broken
            UNION ALL SELECT 'pages within the record', (SELECT count(*) FROM g WHERE start < 960 OR start + size > 17280)
            UNION ALL SELECT 'pages apart', (SELECT count(*) FROM n WHERE before > start)
            UNION ALL SELECT 'pointers resolve', (SELECT count(*) FROM g WHERE k % 3 = 0 AND (k, p_size + CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END) NOT IN (SELECT (k, p_size) FROM g))""",
        "summary_rules": """WITH f AS (SELECT l_suppkey % 64 AS i, min(l_partkey) AS low, max(l_partkey) AS high, min(l_suppkey) AS low_y, max(l_suppkey) AS high_y, min(l_orderkey) AS low_z, max(l_orderkey) AS high_z FROM lineitem GROUP BY ALL),
            d AS (SELECT *, low - CASE WHEN i % 7 = 1 THEN 0.5 ELSE 0 END AS told, high_z + 30000 - CASE WHEN i % 4 = 1 THEN 29500 ELSE 0 END AS half FROM f)
            SELECT 'points counted' AS rule, count(*) FILTER (i % 5 = 1) AS broken FROM d
            UNION ALL SELECT 'bounds agree', count(*) FILTER (i % 7 = 1) FROM d
            UNION ALL SELECT 'cube holds bounds', count(*) FILTER (told < 30000 - half OR high > 30000 + half OR low_y < -half OR high_y > half OR low_z < -half OR high_z > half) FROM d
            UNION ALL SELECT 'time range agrees', count(*) FILTER (i % 13 = 1) FROM d
            UNION ALL SELECT 'returns agree', count(*) FILTER (i % 3 = 1) FROM d""",
        "plan_vs_actual": f"""WITH {P}, {FRAME}, {cells(3)}, {totals(3)}, {ROOTS}, {PLAN}, k AS ({keyed('p', 9, 'file_idx')}),
            r AS (SELECT CAST(e.level + e.k AS INTEGER) AS level, CAST(kx >> (9 - e.level - e.k) AS INTEGER) AS x, CAST(ky >> (9 - e.level - e.k) AS INTEGER) AS y, CAST(kz >> (9 - e.level - e.k) AS INTEGER) AS z, count(*) AS n
                  FROM k JOIN ext e ON kx >> (9 - e.level) = e.x AND ky >> (9 - e.level) = e.y AND kz >> (9 - e.level) = e.z GROUP BY ALL)
            SELECT level, x, y, z, CAST(coalesce(estimate, 0) AS BIGINT) AS estimate, coalesce(n, 0) AS n, CAST(coalesce(n, 0) - coalesce(estimate, 0) AS BIGINT) AS difference FROM plan FULL JOIN r USING (level, x, y, z)""",
        "top_children": f"""WITH {P}, {FRAME}, {cells(5)}, {totals(5)}, o AS (SELECT level - 1 AS level, x >> 1 AS x, y >> 1 AS y, z >> 1 AS z, (x & 1) + (y & 1) * 2 + (z & 1) * 4 AS octant, n FROM t WHERE level > 0)
            SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY level, x, y, z ORDER BY n DESC, octant) = 1""",
        "registry_crs": """WITH v AS (SELECT s_suppkey AS k, 3000 + s_suppkey % 25 AS epsg_h FROM supplier WHERE s_suppkey % 7 = 5 ORDER BY 1 LIMIT 1)
            SELECT 'PROJCS["' || n_name || '"]' AS wkt, epsg_h, k % 2 = 1 AS vertical_dropped FROM v LEFT JOIN nation ON 3000 + n_nationkey = epsg_h""",
        "coalesce_ranges": """WITH v AS (SELECT o_custkey % 16 AS file, o_orderkey * 300 AS start, o_orderkey % 5000 + 1 AS length FROM orders),
            e AS (SELECT *, max(start + length) OVER (PARTITION BY file ORDER BY start, length ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v),
            i AS (SELECT *, sum(CASE WHEN before IS NULL OR start > before + 1024 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY start, length ROWS UNBOUNDED PRECEDING) AS request FROM e)
            SELECT file, start, length, min(start) OVER w AS request_start, max(start + length) OVER w - min(start) OVER w AS request_length FROM i WINDOW w AS (PARTITION BY file, request)""",
        "bbox_query": f"WITH {P} SELECT {ID}, wx, wy, wz FROM p WHERE wx BETWEEN 20000 AND 40000 AND wy BETWEEN 10000 AND 50000 AND wz <= 60000",
        "time_range_query": f"""WITH {E}, {FRAME}, {fine}, {SAMPLES}, n AS (SELECT level, x, y, z, min(gps_time) AS first_time, max(gps_time) AS last_time FROM s GROUP BY ALL) SELECT * FROM n WHERE last_time >= 1704800000 AND first_time <= 1704900000""",
        "epsg_parse": r"""WITH v AS (SELECT c_custkey, 'GEOGCS["x",AUTHORITY["EPSG","' || CAST(c_custkey * 37 % 40000 AS VARCHAR) || '"]]' || CASE c_custkey % 3 WHEN 0 THEN ',' ELSE '' END AS h, CASE WHEN c_custkey % 3 = 0 THEN '["v",AUTHORITY["EPSG","' || CAST(c_custkey % 7000 AS VARCHAR) || '"]]' WHEN c_custkey % 3 = 1 THEN '[none]' END AS v FROM customer),
            c AS (SELECT c_custkey, TRY_CAST(regexp_extract(right(h, 10), '(\d+)\D*$', 1) AS INTEGER) AS h, TRY_CAST(regexp_extract(right(v, 10), '(\d+)\D*$', 1) AS INTEGER) AS v FROM v),
            r AS (SELECT c_custkey, CASE WHEN h BETWEEN 1024 AND 32766 THEN h END AS h, CASE WHEN v BETWEEN 1024 AND 32766 THEN v END AS v FROM c)
            SELECT c_custkey, h AS horizontal, CASE WHEN h IS NOT NULL THEN v END AS vertical FROM r""",
        "planner_sizes": f"""WITH v AS (SELECT c_custkey, c_custkey * c_custkey * 997 + 1 AS n FROM customer) SELECT c_custkey, {levels_of('n', 1000, 6)} AS split, {levels_of('n', 100000, 13)} AS local,
            CASE WHEN n >= 500000000 AND c_custkey * 20000000 * 5 // 100 // 4 >= 134217728 THEN 512 WHEN n >= 100000000 AND c_custkey * 20000000 * 5 // 100 // 4 >= 16777216 THEN 256 ELSE 128 END AS grid FROM v""",
        "parse_sizes": """WITH v AS (SELECT c_custkey, CAST(CAST(c_custkey / 4.0 AS DECIMAL(20, 2)) AS DOUBLE) AS x, c_custkey % 6 AS u FROM customer)
            SELECT c_custkey, CASE u WHEN 5 THEN NULL ELSE CAST(floor(x * [1, 1024, 1048576, 1073741824, 1099511627776][u + 1]) AS BIGINT) END AS bytes,
                   CASE u WHEN 3 THEN NULL WHEN 5 THEN NULL ELSE CAST(floor(x * [1, 1000, 1000000, 0, 1000000000000][u + 1]) AS BIGINT) END AS points FROM v""",
        "header_dates": "WITH v AS (SELECT c_custkey, c_custkey * 37 - 900 AS d FROM customer) SELECT c_custkey, CASE WHEN d < 0 THEN 0 ELSE dayofyear(DATE '1970-01-01' + CAST(d AS INTEGER)) END AS day_of_year, CASE WHEN d < 0 THEN 0 ELSE year(DATE '1970-01-01' + CAST(d AS INTEGER)) END AS year FROM v",
        "gps_sorted": f"WITH {E}, {FRAME}, {event_leaf} SELECT point_id, gps_time, CAST(row_number() OVER (PARTITION BY level, kx, ky, kz ORDER BY gps_time, point_id) AS INTEGER) AS place FROM a",
    }

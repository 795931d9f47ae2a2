import math

import duckdb
import pytest

from stratacloud import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(map(repr, map(tuple, df.select(*columns).collect())))
    want = duck.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({SQL[name]})").fetchall()
    assert got == sorted(map(repr, want))
    assert not any(isinstance(v, float) and math.isnan(v) for row in want for v in row)


def test_keys_of_data_too_wide_for_the_step(spark, sf_dir, tmp_path):
    """Part keys as at sixty times sf0.1; prices between the planes of cubes padded by 0.01 and 0.02."""
    side = 2 * (59_999_950.0 / 2 + 0.015) * 1.0001 / 4096
    price = f"CASE WHEN l_linenumber = 1 THEN 0 ELSE l_orderkey % 8 * {side!r} - CASE WHEN l_orderkey % 8 > 0 THEN 0.015 ELSE 0 END END"
    con = duckdb.connect()
    rows = f"SELECT * REPLACE (CASE WHEN l_linenumber = 1 THEN 0 ELSE 1199999 END AS l_partkey, CAST({price} AS DOUBLE) AS l_extendedprice) FROM '{sf_dir}/lineitem.parquet'"
    con.execute(f"copy ({rows}) to '{tmp_path}/lineitem.parquet' (format parquet)")
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    for name in ("octree_keys", "bounds_frame"):
        df = QUERIES[name](spark, str(tmp_path))
        columns = sorted(df.columns)
        want = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({SQL[name]})").fetchall()
        assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want)), name

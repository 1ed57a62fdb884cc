"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from stridex.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, sql, name):
    got = QUERIES[name](spark, FOLDER)
    expected = sql.sql(ORACLES[name]).fetchall()
    names = [c[0] for c in sql.sql(ORACLES[name]).description]
    assert sorted(got.columns) == sorted(names)
    plain = lambda r: tuple(float(x) if isinstance(x, float) else x for x in r)
    assert sorted(map(repr, map(plain, got.select(*names).collect()))) == sorted(map(repr, map(plain, expected)))

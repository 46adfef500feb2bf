"""Every query of the engine against its SQL twin on the smallest tables."""

import math

import duckdb
import pytest

from tilewright.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-7, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, sql, name):
    got = QUERIES[name](spark, SF)
    if name not in ORACLES:
        assert got.count() > 0
        return
    want = sql.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    key = lambda r: tuple((x is None, round(x, 5) if isinstance(x, float) else x) for x in r)
    a = sorted((tuple(r) for r in got.select(*columns).collect()), key=key)
    b = sorted(want.select(*[f'"{c}"' for c in columns]).fetchall(), key=key) if hasattr(want, "select") else []
    assert len(a) == len(b)
    assert all(all(map(close, x, y)) for x, y in zip(a, b, strict=True))

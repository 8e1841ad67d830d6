"""Every query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from loomtext.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, dict):
        return tuple((k, plain(v)) for k, v in x.items())
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    assert got
    if name in SQL:
        told = duck.sql(SQL[name])
        assert sorted(df.columns) == sorted(told.columns)
        assert got == rows(told.columns, told.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

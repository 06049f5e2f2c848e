"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import datetime
from collections import Counter

import duckdb
import pytest

from weftline import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, duck):
    df = catalogue.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) if not isinstance(r[c], list) else str(r[c]) for c in names) for r in df.collect())
    sql = catalogue.ORACLES.get(name)
    if sql is None:
        assert got
        return
    result = duck.execute(sql)
    shown = [d[0] for d in result.description]
    assert sorted(shown) == names
    assert got == Counter(tuple(plain(row[shown.index(c)]) for c in names) for row in result.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 20

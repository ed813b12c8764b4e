"""Every registered query of the engine against its SQL, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from loomspark import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{small}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    return str(x) if isinstance(x, datetime.datetime) else x


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, small, db, name):
    got = catalog.queries()[name](spark, small)
    result = db.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted((tuple(map(plain, r)) for r in result.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in got.select(columns).collect()), key=repr) == want


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())

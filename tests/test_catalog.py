"""Every core query against its SQL on the smallest tables, and without SQL at least its rows."""

import math
import os

import duckdb
import pytest

from wordtide.plans import catalog

SF = "/root/testdata/sf0.001"

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = [x[0] for x in want.description]
    assert sorted(columns) == sorted(df.columns)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    b = sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)
    assert a == b and (a or name == "books_carrying_query")


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL) - {"published_drift"}))
def test_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry_without_the_llm_subpackage(spark):
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0

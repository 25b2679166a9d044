"""Every registered query with SQL against DuckDB on the smallest tables."""

import datetime
import math
from collections import Counter

import duckdb
import pandas as pd
import pytest

import roomflux.queries  # noqa: F401
from roomflux import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, pd.Timestamp):
        return v.date().isoformat() if v == v.normalize() else v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if hasattr(v, "item"):
        v = v.item()
    return str(round(v, 6) if isinstance(v, float) and v != int(v) else v if isinstance(v, (str, bool)) else int(v))


def rows(df):
    df = df[sorted(df.columns)]
    return tuple(df.columns), Counter(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DIR).toPandas()
    assert rows(got) == rows(duck.execute(registry.oracle_sql()[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, DIR).toPandas() is not None


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 24
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

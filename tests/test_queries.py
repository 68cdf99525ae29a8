"""Every query with SQL against DuckDB, at the smallest size."""

import math

import duckdb
import pandas as pd
import pytest

from tidewell.plans.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return str(v)[:10]
    if hasattr(v, "item"):
        return plain(v.item())
    return float(f"{float(v):.6g}") if isinstance(v, (int, float)) and math.isfinite(v) else v


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_points():
    import __spark_entry__ as e

    assert QUERIES.keys() <= e.queries().keys() and e.oracle_sql().keys() <= e.queries().keys()

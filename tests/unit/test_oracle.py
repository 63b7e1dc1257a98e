"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tidemark.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = str(df[c].dtype)
        if "datetime" in kind:
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif kind.lower().startswith(("float", "int", "uint")):
            df[c] = df[c].astype("Float64").map(lambda v: "null" if pd.isna(v) else f"{float(v) + 0.0:.5g}")
        else:
            df[c] = df[c].map(lambda v: "null" if pd.isna(v) else str(v))
    return sorted(map(tuple, df.astype(str).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    mine = registry.queries()[name](spark, DATA).toPandas()
    other = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert rows(mine) == rows(other)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, DATA).count() >= 0

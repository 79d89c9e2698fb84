"""Every registered query with SQL gives DuckDB's rows on the small tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry


def rows(df):
    df = df[sorted(df.columns)].copy()
    for x in df.columns:
        if df[x].dtype.kind == "f":
            df[x] = df[x].map(lambda v: None if v != v else float(f"{v:.9g}"))
    return sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got, want = entry.queries()[name](spark, sf_dir).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0

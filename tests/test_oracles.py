"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SQL = entry.oracle_sql()


def canon(df: pd.DataFrame) -> list[str]:
    def one(x):
        if isinstance(x, bool):
            return x
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) else str(x)

    return sorted(str([one(v) for v in row]) for row in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.sql(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, data, duck, name):
    got, want = entry.queries()[name](spark, data).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_entry(spark, data):
    assert entry.entry(spark).count() >= 0


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n not in SQL and not (n[0] == "p" and n[1].isdigit())))
def test_runs(spark, data, name):
    df = entry.queries()[name](spark, data)
    assert df.columns and df.count() >= 0

"""Every relational query against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from asofkit.plans import registry

DATA = "/root/testdata/sf0.001"


def normal(df: pd.DataFrame) -> list:
    def value(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        try:
            return f"{float(v):.9g}"
        except (TypeError, ValueError):
            return str(v)

    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(value(v) for v in row) for row in df.values.tolist())


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    got = registry.QUERIES[name](spark, DATA)
    if name not in registry.SQL:
        assert got.count() > 0
        return
    want = db.sql(registry.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got.toPandas()) == normal(want.df())

"""Every registered query of the reference's operators against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from corpusmill.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    def one(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return None
        return round(float(x), 7) if isinstance(x, (int, float)) and not isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "if" else str(x)

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(one, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, db, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = db.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLES.keys()))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0

"""Every registered core query against its SQL twin on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from lodestrata.plans import report_queries  # noqa: F401  (registers its queries)
from lodestrata.plans.queries import QUERIES


def rows(df):
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, float):
            return int(v) if v.is_integer() else round(v, 4)
        return v

    return sorted(repr(tuple(cell(v) for v in r)) for r in df.astype(object).itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_matches_sql(spark, sf, duck, name):
    f, sql = QUERIES[name]
    got, want = f(spark, sf).toPandas(), duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if not sql])
def test_runs(spark, sf, name):
    df = QUERIES[name][0](spark, sf)
    assert df.count() >= 0 and len(df.columns) > 1

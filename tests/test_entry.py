import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from quarry.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda x: None if x is None or (isinstance(x, (float, np.floating)) and np.isnan(x)) else round(float(x), 4) + 0.0 if isinstance(x, (float, np.floating)) else int(x) if isinstance(x, np.integer) else str(x)
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=str)


def test_contract():
    names = entry.queries().keys()
    assert QUERIES.keys() <= names and entry.oracle_sql().keys() <= names


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@needs_data
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0

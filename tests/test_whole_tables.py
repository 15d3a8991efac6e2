import pytest

from quarry import queries
from quarry.ml import neighbours

DIR = "/root/testdata/sf0.01"


def rows_of(spark, name):
    duckdb = pytest.importorskip("duckdb")
    for table in ("embeddings", "supplier", "customer", "part"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM read_parquet('{DIR}/{table}.parquet')")
    found = [tuple(r) for r in queries.QUERIES[name](spark, DIR).collect()]
    return sorted(found), sorted(duckdb.sql(queries.ORACLES[name]).fetchall())


def test_gaussian_process_learns_from_all_rows_and_values(spark, monkeypatch):
    seen, fit = [], neighbours.GaussianProcess.fit
    monkeypatch.setattr(neighbours.GaussianProcess, "fit", lambda df, features, label: seen.append((df.count(), len(features))) or fit(df, features, label))
    rows = queries.QUERIES["gaussian_process"](spark, DIR).count()
    assert seen == [(min(rows, neighbours.PROCESS_ROWS), len(spark.read.parquet(f"{DIR}/embeddings.parquet").first().embedding))]


def test_neighbours_by_the_whole_vector(spark):
    found, want = rows_of(spark, "nearest_neighbours")
    assert found == want


@pytest.mark.parametrize("name", ["psi_full", "psi_difference", "psi_three"])
def test_joins_of_whole_tables(spark, name):
    found, want = rows_of(spark, name)
    assert found == want and found

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import aggregates, joins, sampling
from quarry.plans.components import standard
from quarry.plans.ordered import with_position
from quarry.plans.quantiles import modes, quantiles
from quarry.schema import kind_of


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal()), float(rng.integers(0, 4)), None if i % 3 else float(i)) for i in range(500)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double").withColumn("d", F.lit(None).cast("double"))


@pytest.mark.parametrize("held", [-1, 10, 10**9])
def test_quantiles_are_exact_either_way(numbers, held):
    q, frame = [0.0, 0.1, 0.5, 0.77, 1.0], numbers.toPandas()
    got = quantiles(numbers, {c: F.col(c) for c in "abcd"}, q, held)
    for c in "abc":
        assert got[c] == pytest.approx(list(frame[c].quantile(q)))
    assert got["d"] == [None] * 5 and quantiles(numbers, {}, q) == {}


def test_modes(numbers, spark):
    frame = numbers.toPandas()
    got = modes(numbers, {c: F.col(c) for c in "bcd"})
    assert got == {"b": frame["b"].mode().min(), "c": 0.0, "d": None}
    row = aggregates.column_stats(numbers, ["mode", "median", "count"], ["b"]).first()
    assert (row["mode"], row["median"], row["count"]) == (frame["b"].mode().min(), frame["b"].median(), 500)


def test_keys_of_a_join_become_ids(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "ka long, v string"), spark.createDataFrame([(2, "z")], "kb long, w string")
    out = joins.psi(a, b, ["ka"], ["kb"], "left")
    assert [kind_of(out, c) for c in ("ka", "kb", "v")] == ["id", "id", "feature"]
    assert [tuple(r) for r in out.collect()] == [(1, "x", None, None), (2, "y", 2, "z")]


def test_cached_server_side(spark, tmp_path):
    client, server = spark.createDataFrame([(1,), (3,)], "k long"), spark.range(10).select(F.col("id").alias("s"))
    path = joins.cache_keys(server, ["s"], str(tmp_path / "cache"))
    for how, want in (("inner", 2), ("left", 2), ("right", 10)):
        assert joins.unbalanced_psi(client, path, ["k"], ["s"], how).count() == want


def test_sample_component(spark):
    df = spark.range(200).withColumn("x", F.col("id").cast("double"))
    run = standard().run
    for more, want in (({"algorithm": "random", "frac": 0.3}, 60), ({"algorithm": "system", "frac": 0.25}, 50), ({"algorithm": "stratified", "frac": 0.5, "column": "x", "quantiles": [99.0]}, 100)):
        out, report = run({"component": "data_filter/sample", "params": {"key": ["id"], **more}}, df)
        assert out.count() == want and report[0] == {"bucket": "all", "before": 200, "after": want} and out.select("id").distinct().count() == want
    assert len(report) == 3
    with pytest.raises(ValueError):
        sampling.sample(df, ["id"], "none")


def test_positions_of_a_sort_that_is_dealt_anew(spark):
    """Borders of a sort of many rows come from a sample, which differs from job to job."""
    keys = spark.range(400_000, numPartitions=3).select(F.xxhash64("id").alias("k"))
    out = with_position(keys.orderBy("k"))
    row = out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_rid").alias("distinct"), F.max("_rid").alias("last")).first()
    assert tuple(row) == (400_000, 400_000, 399_999)
    want = sorted(r.k for r in keys.collect())[::5]
    got = sampling.system_sample(keys.orderBy("k"), 0.2)
    assert sorted(r.k for r in got.collect()) == want

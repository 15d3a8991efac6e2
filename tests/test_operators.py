import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import aggregates, filters, groupby, joins, sampling
from quarry.operators.frame import Table, horizontal
from quarry.plans.components import Registry, standard
from quarry.plans.ordered import carry, running, with_position
from quarry.schema import columns_of, kind_of, party_of, schema_of, tag

A = [("1", "K5", "A5", 5.0, 0.0), ("2", "K1", "A1", 1.0, 1.0), ("3", None, "A2", 2.0, 1.0), ("4", "K6", "A6", float("nan"), 0.0)]


@pytest.fixture(scope="module")
def a(spark):
    return spark.createDataFrame(A, "id1 string, a1 string, a2 string, a3 double, y double")


def ids(df, c="id1"):
    return sorted(r[c] for r in df.select(c).collect())


def test_schema(a):
    df = tag(tag(a, "alice", {"id1": "id", "y": "label"}), kinds={"y": "feature"})
    assert (kind_of(df, "id1"), kind_of(df, "y"), party_of(df, "a3")) == ("id", "feature", "alice")
    assert columns_of(df, "alice", "id") == ["id1"]
    assert schema_of({"a": "uint64", "b": "float16"}).simpleString() == "struct<a:decimal(20,0),b:float>"
    with pytest.raises(KeyError):
        tag(a, kinds={"nothing": "id"})
    with pytest.raises(TypeError):
        schema_of({"a": "list"})


def test_filters(a):
    hit, other = filters.condition_filter(a, "a3", "==", "5.0000001")
    assert ids(hit) == ["1"] and ids(other) == ["2", "3", "4"]
    hit, other = filters.condition_filter(a, "a1", "IN", "K1, K6")
    assert ids(hit) == ["2", "4"] and ids(other) == ["1", "3"]  # null goes to the others
    assert ids(filters.condition_filter(a, "a3", "NOTNULL")[0]) == ["1", "2", "3"]
    assert ids(filters.condition_filter(a, "a3", ">", "1")[0]) == ["1", "3"]  # NaN hits nothing
    with pytest.raises(ValueError):
        filters.condition_filter(a, "a3", ">", "x")
    with pytest.raises(ValueError):
        filters.condition_filter(a, "a3", ">", "100", check=True)
    with pytest.raises(KeyError):
        filters.feature_filter(a, ["zz"])
    assert ids(filters.expr_filter(a, "a1 > 'K1'")[1]) == ["2", "3"]


def test_table(a):
    t = Table(tag(a, "alice"))
    assert t.shape == (4, 5) and t.partition_columns == {"alice": a.columns} and t.partition_shape() == {"alice": (4, 5)}
    assert [r.a3 for r in t[["a3"]].isna().df.collect()] == [False, False, False, True]
    assert ids(t.iloc([0, 3]).df) == ["1", "4"] and ids(t.iloc(slice(1, 4, 2)).df) == ["2", "4"]
    assert t.fillna({"a3": 9.0}).df.collect()[3].a3 == 9.0
    assert [r.a1 for r in t.fillna(method="ffill").df.orderBy("id1").collect()] == ["K5", "K1", "K1", "K6"]
    assert [r.a1 for r in t.fillna(method="bfill", order=["id1"]).df.orderBy("id1").collect()] == ["K5", "K1", "K6", "K6"]
    assert t.select_dtypes().columns == ["a3", "y"] and t.drop("zz", errors="ignore").columns == a.columns
    assert Table(a.select("id1")).astype("int").dtypes == {"id1": "int"}
    assert [r.id1 for r in Table(a.select("a1").withColumnRenamed("a1", "id1")).astype("int", errors="ignore").df.collect()] == [None] * 4
    assert [r.a3 for r in t[["a3"]].subtract(1.0).pow(2.0).df.limit(3).collect()] == [16.0, 0.0, 1.0]
    assert [r.a1 for r in t.fillna(method="ffill", limit=1).df.collect()] == ["K5", "K1", "K1", "K6"]
    side = t[["id1"]].concat(Table(a.select(F.col("y").alias("z"))), axis=1)
    assert sorted(map(tuple, side.df.collect())) == [("1", 0.0), ("2", 1.0), ("3", 1.0), ("4", 0.0)]
    with pytest.raises(KeyError):
        t["zz"]
    with pytest.raises(TypeError):
        horizontal({"a": a, "b": a.withColumn("y", F.lit(1))})
    assert t.replace({"K5": "X"}).df.first().a1 == "X" and t.values().columns == ["values"]


def test_column_stats_like_pandas(spark):
    values = [1.0, 2.0, 2.0, 7.5, None, float("nan"), 3.25, -4.0]
    x = pd.Series(values, dtype=float)
    names = ["count", "nunique", "sum", "min", "max", "mean", "var", "std", "sem", "skew", "kurtosis", "median"]
    row = aggregates.column_stats(spark.createDataFrame([(v,) for v in values], "x double"), [*names, "mode"]).first()
    for f in names:
        assert row[f] == pytest.approx(getattr(x, f)()), f
    assert row["mode"] == 2.0
    none = aggregates.column_stats(spark.createDataFrame([(None,)], "x double"), ["sum", "mean", "skew"]).first()
    assert none["sum"] == 0 and none["mean"] is None and none["skew"] is None


def test_quantiles_by_counts(spark):
    x = [3.0, 1.0, 1.0, None, 7.0, float("nan"), 2.5, 2.5, 2.5, 10.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    q = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]
    want = pd.Series(x, dtype=float).quantile(q)
    assert list(aggregates.quantile_by_counts(df, "x", q).values()) == pytest.approx(want.tolist())
    assert [r.value for r in aggregates.quantile(df, q, ["x"]).collect()] == pytest.approx(want.tolist())
    assert aggregates.quantile_by_counts(df.limit(0), "x", [0.5]) == {0.5: None}


def test_noise_is_around_the_sum(spark):
    part = spark.range(200).select((F.col("id") % 2).alias("key"), F.lit(1.0).alias("x"))
    rows = aggregates.noisy_combine([part, part], "x", 0.1).collect()
    assert all(abs(r["sum"] - 200) < 20 for r in rows) and any(r["sum"] != 200 for r in rows)


def test_groups(a):
    out = groupby.group_statistics(a, ["a2"], [("a3", "var"), ("a3", "count"), ("a3", "mean")]).collect()
    assert [r.a2 for r in out] == ["A1", "A2", "A5", "A6"] and [r.a3_var for r in out[:3]] == [0.0] * 3
    assert out[3].a3_count == 1 and out[3].a3_mean is None
    with pytest.raises(ValueError):
        groupby.group_statistics(a, ["a2"], [("a2", "count")])
    with pytest.raises(ValueError):
        groupby.group_statistics(a, ["a2"], [("a3", "sum")], max_groups=2)


def test_joins(spark):
    left = spark.createDataFrame([("K100", "A"), ("K300", "D"), ("K200", "B"), ("K400", "E"), ("K500", "G"), (None, "N")], "id1 string, item string")
    right = spark.createDataFrame([("K500", None), ("K200", "AA"), ("K300", "BB"), ("K400", "CC"), ("K600", "EE"), (None, "NN")], "id2 string, feature2 string")
    inner = joins.psi(left, right, ["id1"], ["id2"]).collect()
    assert [r.id1 for r in inner] == [None, "K200", "K300", "K400", "K500"] and inner[0].feature2 == "NN"
    assert joins.psi(left, right, ["id1"], ["id2"], "left").count() == 6 and joins.psi(left, right, ["id1"], ["id2"], "full").count() == 7
    gone = joins.psi(left, right, ["id1"], ["id2"], "difference", sort=False).collect()
    assert sorted((r.id1 or r.id2) for r in gone) == ["K100", "K600"]
    assert joins.psi(left, right, ["id1"], ["id2"], receiver="b").columns == ["id2", "feature2"]
    twice = right.unionAll(right)
    assert joins.psi(left, twice, ["id1"], ["id2"]).count() == 10
    with pytest.raises(ValueError):
        joins.psi(left, twice, ["id1"], ["id2"], duplicated=(True, False))
    with pytest.raises(ValueError):
        joins.psi(left.limit(0), right, ["id1"], ["id2"], allow_empty=False)
    with pytest.raises(ValueError):
        joins.psi(left, left, ["id1"], ["id1"])
    assert joins.psi_report(left, right, joins.psi(left, right, ["id1"], ["id2"]))[0] == {"party": "a", "original_count": 6, "intersection_count": 5}
    small, large = (joins.unbalanced_psi(left, right, ["id1"], ["id2"], most=m).collect() for m in (100, 1))
    assert small == large
    with pytest.raises(TypeError):
        joins.union(left, right)


def test_samples(spark):
    df = spark.range(0, 1000, 1, 7).select(F.col("id"), (F.col("id") % 10).cast("double").alias("v"))
    first = {r.id for r in sampling.random_sample(df, ["id"], 0.25, 3).collect()}
    assert len(first) == 250 and first == {r.id for r in sampling.random_sample(df.repartition(3), ["id"], 0.25, 3).collect()}
    assert [r.id for r in sampling.system_sample(df, 0.1).orderBy("id").limit(3).collect()] == [0, 10, 20]
    rows, report = sampling.stratified_sample(df, ["id"], "v", [1.0, 4.0], 0.1, 1, weights=[0.5, 0.25, 0.25])
    assert [r["after"] for r in report] == [50, 25, 25] and [r["before"] for r in report] == [200, 300, 500]
    assert sampling.stratified_sample(df, ["id"], "v", [1.0], 0.5, replacement=[True, False])[0].count() == 500
    train, test = sampling.train_test_split(df, ["id"], 0.3, 0.5, 1)
    assert (train.count(), test.count(), train.join(test, "id").count()) == (300, 500, 0)
    train, test = sampling.train_test_split(df, ["id"], 0.5, 0.25, shuffle=False)
    assert (train.agg(F.max("id")).first()[0], test.agg(F.min("id")).first()[0]) == (499, 750)
    for bad in (lambda: sampling.random_sample(df, ["id"], 1.0), lambda: sampling.system_sample(df, 0.6), lambda: sampling.stratified_sample(df, ["id"], "v", [-5.0, 4.0], 0.1), lambda: sampling.train_test_split(df, ["id"], 0.9, 0.2)):
        with pytest.raises(ValueError):
            bad()


def test_positions_and_running_totals(spark):
    df = spark.range(0, 100, 1, 9)
    assert [r._rid for r in with_position(df).orderBy("id").collect()] == list(range(100))
    out = running(df, [-F.col("id")], {"s": F.col("id")}).collect()
    assert {r.id: r.s for r in out} == {i: sum(range(i, 100)) for i in range(100)}
    gaps = df.select("id", F.when(F.col("id") % 40 == 5, F.col("id")).alias("v"))
    assert {r.id: r.v for r in carry(gaps, [F.col("id")], ["v"]).collect()} == {i: None if i < 5 else (i - 5) // 40 * 40 + 5 for i in range(100)}
    assert {r.id: r.v for r in carry(gaps, [F.col("id")], ["v"], forward=False).collect()} == {i: next((k for k in (5, 45, 85) if k >= i), None) for i in range(100)}
    assert math.isclose(running(df.limit(0), [F.col("id")], {"s": F.col("id")}).count(), 0)


def test_components(a):
    assert len(standard().held) == 46
    r = Registry()
    r.add("x/double")(lambda df, c: df.withColumn(c, F.col(c) * 2))
    assert r.run({"component": "x/double", "params": {"c": "y"}}, a).filter("y = 2").count() == 2
    with pytest.raises(KeyError):
        r.run({"component": "x/none"})
    with pytest.raises(ValueError):
        r.add("plain")
    hit, _ = standard().run({"component": "data_filter/condition_filter", "params": {"column": "y", "comparator": "==", "bound": "1"}}, a)
    assert hit.count() == 2 and r.load_plugins() == []


def test_scans_get_predicates_and_columns(spark, tmp_path):
    spark.range(100).select("id", F.col("id").cast("double").alias("v"), F.col("id").cast("string").alias("s"), F.lit(1).alias("unused")).write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(v,30.0)" in plan(filters.condition_filter(t, "v", ">=", "30")[0])
    assert "GreaterThanOrEqual(v,2.999" in plan(filters.condition_filter(t, "v", "==", "3")[0])
    assert "In(s, [3,4])" in plan(filters.condition_filter(t, "s", "IN", "3,4")[0])
    assert "unused" not in plan(groupby.group_statistics(t, ["s"], [("v", "sum")], check=False))
    assert "BroadcastHashJoin" in plan(joins.unbalanced_psi(t.select("id"), t.select("v"), ["id"], ["v"], sort=False))

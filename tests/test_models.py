import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.ml import boost, linear, neighbours, privacy
from quarry.plans import export
from quarry.rules import binning, columns
from quarry.schema import tag
from quarry.sources import tables
from quarry.stats import evaluation, statistics
from quarry.streaming import streams


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(400, 3))
    y = (x @ [1.5, -2.0, 0.0] + 0.5 + rng.normal(size=400) * 0.5 > 0).astype(int)
    z = x @ [1.0, 2.0, 0.0] + 3 + rng.normal(size=400) * 0.1
    rows = [(i, *map(float, x[i]), int(y[i]), float(z[i]), float(np.exp(0.3 * x[i, 0] + 0.2))) for i in range(400)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y int, z double, w double").persist()


X = ["a", "b", "c"]


def accuracy(df, prediction, label="y"):
    return df.select(F.avg(((prediction > 0.5).cast("int") == F.col(label)).cast("int"))).first()[0]


def test_linear(data):
    m = linear.least_squares(data, X, "z")
    assert m.weights == pytest.approx([1, 2, 0], abs=0.05) and m.intercept == pytest.approx(3, abs=0.05)
    assert linear.Linear.from_json(m.to_json()).weights == m.weights
    p = linear.t_test(data, X, "z", m)
    assert p[0] < 1e-10 and p[2] > 1e-3
    assert linear.t_tail(2.0, 10) == pytest.approx(0.0733880347707404)
    d = linear.descent(data, X, "z", "linear", epochs=60, learning_rate=0.3)
    assert d.weights == pytest.approx(m.weights, abs=0.01)


def test_logistic_and_wald(data):
    m = linear.logistic(data, X, "y")
    assert accuracy(data, m.predict()) > 0.9
    g = linear.glm(data, X, "y")
    assert g.weights == pytest.approx(m.weights, rel=1e-3)
    p = linear.wald_test(data, X, "y", m)
    assert p[0] < 1e-6 and p[1] < 1e-6 and p[2] > 0.01
    assert accuracy(data, linear.descent(data, X, "y", epochs=40, learning_rate=1.0, batches=3, sig="sr").predict()) > 0.88


@pytest.mark.parametrize(("family", "link"), [("poisson", "log"), ("gamma", "log"), ("tweedie", "log")])
def test_glm(data, family, link):
    m = linear.glm(data, ["a"], "w", family, link)
    assert m.weights[0] == pytest.approx(0.3, abs=1e-3)
    assert data.agg(linear.deviance(data, "w", m.predict(), family)).first()[0] == pytest.approx(0, abs=1e-5)


@pytest.mark.parametrize("options", [{}, {"grow": "leaf", "max_leaf": 6}, {"goss": True}, {"row_sample": 0.8, "column_sample": 0.7}, {"validation": 0.2, "stopping_rounds": 2}])
def test_boosting(data, options):
    m = boost.train(data, X, "y", rounds=6, max_depth=3, **options)
    again = boost.Boosted.from_json(m.to_json())
    assert accuracy(data, again.predict()) > 0.85
    assert m.importances()["b"]["weight"] >= 1


def test_boosting_against_a_plain_version(data):
    """One round of one split: the best of all bucket borders."""
    rows = data.toPandas()
    m = boost.train(data, ["a", "b"], "z", "linear", rounds=1, max_depth=1, learning_rate=1.0, reg_lambda=1.0)
    best = None
    for f in ("a", "b"):
        for q in range(1, 10):
            s = np.percentile(rows[f], q * 10)
            left = rows[f] <= s
            g, h = -rows["z"], np.ones(len(rows))
            gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)
            best = max(best or (0,), (gain, f, s, rows["z"][left].sum() / (left.sum() + 1), rows["z"][~left].sum() / ((~left).sum() + 1)))
    assert m.trees[0][0] == best[1] and m.trees[0][1:] == pytest.approx(best[2:])
    with pytest.raises(ValueError):
        boost.train(data, X, "y", max_depth=99)


def test_neighbours(data, spark, monkeypatch):
    rows = data.toPandas()
    train, queries = data.filter("id % 4 <> 0"), data.filter("id % 4 = 0")
    t = rows[rows.id % 4 != 0]
    for block in (neighbours.BLOCK_ROWS, 70):
        monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
        got = {r.id: r.prediction for r in neighbours.knn(queries, train, X, "y", "id", 5).collect()}
        for i, r in rows[rows.id % 4 == 0].iterrows():
            d = ((t[X] - r[X].astype(float)) ** 2).sum(axis=1).sort_values().index[:5]
            assert got[r.id] == int(t.loc[d, "y"].mean() > 0.5)
    far = neighbours.knn(queries, train, X, "y", "id", 5, "distance")
    assert far.join(queries, "id").filter("prediction = y").count() > 85


def test_bayes_process_clusters(data, spark):
    nb = neighbours.NaiveBayes.fit(data, X, "y")
    assert accuracy(data, nb.predict().cast("double")) > 0.85
    gp = neighbours.GaussianProcess.fit(data.limit(200), X, "y")
    out = gp.predict(data.select(*X, "y"), X)
    assert out.filter("prediction = y").count() > 350
    points = spark.createDataFrame([(float(i % 2 * 10 + i / 100), 0.0) for i in range(40)], "p double, q double")
    centres = sorted(neighbours.kmeans(points, ["p", "q"], 2, n_init=2, init="random"))
    assert centres[0][0] < 1 < 9 < centres[1][0]
    assert points.select(neighbours.nearest_centre(["p", "q"], centres).alias("k")).distinct().count() == 2


def test_sigmoids(spark):
    df = spark.createDataFrame([(-9.0,), (-1.0,), (0.0,), (2.0,), (9.0,)], "x double").coalesce(1)
    for kind in ("real", "t1", "t3", "t5", "seg3", "df", "sr", "mix"):
        v = [r[0] for r in df.select(linear.sigmoid(F.col("x"), kind)).collect()]
        assert v[2] == pytest.approx(0.5, abs=1e-3) and all(0 <= x <= 1 for x in v) and v[1] < v[3], kind


def test_evaluation(spark):
    rng = np.random.default_rng(2)
    s, y = rng.integers(0, 30, 500) / 30, rng.integers(0, 2, 500)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "s double, y int")
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / len(pos) / len(neg)
    ks = max(abs((pos >= v).mean() - (neg >= v).mean()) for v in s)
    r = evaluation.auc_ks(df, "y", "s").first()
    assert (r.total, r.positive) == (500, y.sum()) and r.auc == pytest.approx(auc) and r.ks == pytest.approx(ks)
    table = evaluation.bin_table(df, "y", "s", 7)
    assert sum(b["total"] for b in table) == 500 and table[-1]["recall"] == pytest.approx(1) and len(table[0]) == 17
    few = evaluation.bin_table(df, "y", "s", 7, least=100)
    assert all(b["total"] is None and b["recall"] is None and b["start"] is not None for b in few)
    bias = evaluation.prediction_bias(df, "y", "s", 5, "equal_frequency").orderBy("bucket").collect()
    assert [b.n for b in bias] == [100] * 5
    assert [b.isna for b in evaluation.prediction_bias(df, "y", "s", 5, least=10_000).collect()] == [True] * 5


def test_statistics(data, spark):
    rows = data.toPandas()
    assert statistics.pearson(data, X) == pytest.approx(np.corrcoef(rows[X].T.to_numpy()) * 400 / 399)
    x = rows[X].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    assert list(statistics.vif(data, X).values()) == pytest.approx(np.diag(np.linalg.inv(z.T @ z)) * 399)
    assert statistics.vif(data.withColumn("d", F.col("a") * 2), ["a", "d"])["a"] > 1e6
    t = {r["column"]: r for r in statistics.table_statistics(data.withColumn("t", F.lit("x"))).collect()}
    assert t["a"].skewness == pytest.approx(rows.a.skew()) and t["a"].kurtosis == pytest.approx(rows.a.kurt()) and t["t"].nunique == 1 and t["t"].mean is None
    rule = binning.Bins.fit(data, ["a"], 4)
    assert statistics.population_stability(data, data, ["a"], rule).first().psi == 0
    assert statistics.psi_index(data, data.filter("a > -0.5"), "a", [-9.0, 0.0, 9.0]) > 0


def test_privacy(spark):
    df = spark.range(4000).select((F.col("id") % 3).cast("int").alias("y"), F.lit(5.0).alias("x"))
    kept = df.filter(privacy.random_response(F.col("y"), 1.0, 3, 4) == F.col("y")).count() / 4000
    assert kept == pytest.approx(math.e / (math.e + 2), abs=0.04)
    assert df.select(privacy.gaussian(F.col("x"), 0.5, 2.0).alias("x")).agg(F.avg("x")).first()[0] == pytest.approx(2, abs=0.1)
    assert df.select(privacy.laplace(F.col("x"), 1.0).alias("x")).agg(F.avg("x")).first()[0] == pytest.approx(5, abs=0.15)
    orders = list(range(2, 64))
    assert privacy.epsilon(orders, privacy.renyi(0.01, 1.1, 1000, orders), 1e-5) == pytest.approx(1.73, abs=0.1)
    assert privacy.renyi(1.0, 2.0, 3, [4]) == [1.5] and 0 < privacy.delta_of(1.0, privacy.mu_poisson(1000, 1.1, 10_000, 100)) < 1


def test_sources(spark, tmp_path):
    path = f"{tmp_path}/in.csv"
    (tmp_path / "in.csv").write_text("k,v,s\n1,2.5,x\n2,NULL,NA\n3,4.0,\n")
    df = tables.read_csv(spark, path, {"k": "int32", "v": "float64", "s": "str"}, null_strs=["NULL"])
    assert [tuple(r) for r in df.orderBy("k").collect()][:2] == [(1, 2.5, "x"), (2, None, "NA")]
    two = tables.read_csv(spark, path, {"k": "int32", "v": "float64", "s": "str"}, null_strs=["NULL", "NA"], columns=["s", "k"], skip_rows=1, nrows=1, converters={"k": lambda c: c * 10})
    assert [tuple(r) for r in two.collect()] == [(None, 20)]
    (tmp_path / "bare.csv").write_text("1;2\n")
    assert tables.read_csv(spark, f"{tmp_path}/bare.csv", header=False, delimiter=";", prefix="a_").columns == ["a_0", "a_1"]
    info = tables.dump(tables.tag(df, "alice", {"k": "id"}), f"{tmp_path}/orc")
    back = tables.load(spark, info)
    assert info["line_count"] == 3 and back.schema["k"].metadata == {"kind": "id", "party": "alice"} and back.count() == 3
    with pytest.raises(ValueError):
        tables.dump(df.limit(0), f"{tmp_path}/none")
    tables.convert(spark, f"{tmp_path}/orc", "orc", f"{tmp_path}/out", "csv", na_rep="-")
    assert tables.read_csv(spark, f"{tmp_path}/out", null_strs=["-"]).filter("v IS NULL").count() == 1
    assert tables.data_source(spark, tables.mock("t1", df), "bob", '{"v": "label"}').schema["v"].metadata == {"kind": "label", "party": "bob"}
    both = tables.tag(df.select("k"), "a").join(tables.tag(df.select("k", "v"), "b"), "k")
    tables.data_sink(both, "b", f"{tmp_path}/sink")
    assert spark.read.parquet(f"{tmp_path}/sink").columns == ["v"]
    np.savez(tmp_path / "x.npz", p=np.arange(6).reshape(3, 2), q=np.arange(3))
    assert {k: v.count() for k, v in tables.load_arrays(spark, str(tmp_path / "x.npz")).items()} == {"p": 3, "q": 3}
    with pytest.raises(ValueError):
        tables.read_vertical(spark, {"a": df, "b": df})
    with pytest.raises(ValueError):
        tables.read_vertical(spark, {"a": df.select("k"), "b": df.select("v").limit(1)})
    side = tables.read_vertical(spark, {"a": df.select("k").coalesce(1), "b": df.select("s").coalesce(1)})
    assert [r.k for r in side.collect()] == [1, 2, 3]
    rule = columns.LogRound(columns=["v"], bias=1, decimals=0).to_json()
    assert {r.name for r in tables.read_rule(spark, rule).collect()} == {"rule", "columns", "bias", "decimals"}


def test_dealt_parties(spark):
    df = spark.range(0, 1000, 1, 3).select("id", (F.col("id") % 4).alias("y"))
    n = {r.party: r["count"] for r in tables.deal(df, {"a": 1, "b": 3}, shuffle=False).groupBy("party").count().collect()}
    assert n == {"a": 250, "b": 750}
    assert tables.deal(df, {"a": 1, "b": 3}, 5).filter("party = 'a'").count() == pytest.approx(250, abs=60)
    assert tables.deal_dirichlet(df, ["a", "b", "c"], "y", 0.5).count() == 1000
    assert tables.deal_by_label(df, {"a": [0], "b": [1, 2]}, "y").groupBy("party").count().count() == 2


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", float(i)) for i in range(40)], "k int, t string, v double").withColumn("t", F.to_timestamp("t"))
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    source = lambda: streams.read(spark, f"{tmp_path}/in", rows.schema, 1)
    rule = columns.FeatureCalculate.fit(rows, ["v"], "NORMALIZATION")
    got = streams.drain(streams.apply_rules(source(), rule), "normal")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rule.apply(rows).collect()))
    streams.split_batches(source(), "v", "<", "10", f"{tmp_path}/hit", f"{tmp_path}/other", f"{tmp_path}/c").awaitTermination()
    assert (spark.read.parquet(f"{tmp_path}/hit").count(), spark.read.parquet(f"{tmp_path}/other").count()) == (10, 30)
    windows = streams.drain(streams.tumbling(source(), "t", "10 minutes", [], "1 hour", n=F.count(F.lit(1))), "windows", "complete")
    assert sorted(r.n for r in windows.collect()) == [10] * 4
    assert streams.drain(streams.deduplicated(source().withColumn("k", F.col("k") % 5), ["k"], "t", "1 hour"), "fresh").count() == 5
    assert streams.sessions(rows, "t", "5 minutes", []).first().n == 40
    assert streams.condition(rows, "v", ">", "30", other=True).count() == 31


def test_stored_inference(data):
    scaler = columns.Scaler.fit(data, X)
    rows = scaler.apply(data)
    card = columns.ScoreCard(prediction="p", scaled_value=600, odd_base=20, pdo=20, low=0, high=1000)
    for model in (linear.logistic(rows, X, "y", max_iter=5), boost.train(rows, X, "y", rounds=2, max_depth=2)):
        out = export.infer(data, export.export([scaler], model, [card], "p"))
        assert accuracy(out, F.col("p")) > 0.8 and out.filter("score IS NULL").count() == 0
        assert out.columns == [*data.columns, "p", "score"]
    tagged = tag(data, "a", {"id": "id", "y": "label"})
    assert export.prediction_table(tagged, F.col("a"), labels=True, features=["b"]).columns == ["prediction", "id", "y", "b"]
    with pytest.raises(Exception, match="null"):
        export.prediction_table(tagged, F.lit(None).cast("double")).collect()

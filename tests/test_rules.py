import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.plans.sql_processor import SqlError, SqlRule, run_sql
from quarry.rules import binning, columns
from quarry.rules.base import Chain, Rule, substitution
from quarry.schema import tag
from quarry.sources import tables


def col(df, c):
    return [r[c] for r in df.collect()]


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(1, 10, 1.5, "aa", True), (2, 20, 2.5, "aa", True), (3, 20, 2.5, "bb", False), (4, 99, 99.9, "zzzz", None), (5, None, float("nan"), None, None)]
    return spark.createDataFrame(rows, "id int, ai int, af double, s string, ab boolean").coalesce(1)


def test_fillna(mixed):
    rule = columns.FillNA.fit(mixed, ["ai", "af", "s", "ab"], {"int": "mean", "float": "median", "str": "most_frequent"}, {"bool": False}, {"int": [99], "float": [99.9], "str": ["zzzz"]})
    out = Rule.from_json(rule.to_json()).apply(mixed).collect()
    assert [r.ai for r in out] == [10, 20, 20, 17, 17] and [r.af for r in out] == [1.5, 2.5, 2.5, 2.5, 2.5]
    assert [r.s for r in out] == ["aa", "aa", "bb", "aa", "aa"] and out[4].ab is False
    kept = columns.FillNA.fit(mixed, ["af"], {"float": "constant"}, {"float": 7.0}, nan_is_null=False).apply(mixed)
    assert math.isnan(col(kept, "af")[4])


def test_onehot(mixed):
    out = columns.OneHot.fit(mixed, ["s"]).apply(mixed)
    assert out.columns == ["id", "ai", "af", "ab", "s_0", "s_1", "s_2"] and col(out, "s_0") == [1, 1, 0, 0, None]
    assert col(columns.OneHot.fit(mixed, ["s"], drop="mode").apply(mixed), "s_0") == [0, 0, 1, 0, None]
    merged = columns.OneHot.fit(mixed, ["s"], min_frequency=0.3).apply(mixed)
    assert col(merged, "s_1") == [0, 0, 1, 1, None]
    with pytest.raises(ValueError):
        columns.OneHot.fit(mixed.sparkSession.range(200).select(F.col("id").alias("x")), ["x"])


def test_cast_is_safe(spark):
    df = spark.createDataFrame([(" '12' ", 3.0, 2.5)], "s string, f double, g double")
    assert tuple(columns.Cast(columns=["s", "f"], to="integer").apply(df).first()) == (12, 3, 2.5)
    with pytest.raises(Exception, match="lossy"):
        columns.Cast(columns=["g"], to="integer").apply(df).collect()


def test_calculations(spark):
    df = spark.createDataFrame([(0.0, 0.1, "AAA"), (-0.8, 0.1, "BBB"), (-1.6, 0.1, None)], "a double, b double, c string").coalesce(1)
    fit = lambda c, op, args=None: col(columns.FeatureCalculate.fit(df, [c], op, args).apply(df), c)
    assert fit("a", "STANDARDIZE") == pytest.approx([math.sqrt(1.5), 0, -math.sqrt(1.5)]) and fit("b", "STANDARDIZE") == [0.0] * 3
    assert fit("b", "NORMALIZATION") == [0.0] * 3 and fit("a", "NORMALIZATION") == pytest.approx([1, 0.5, 0])
    assert fit("a", "RANGE_LIMIT", [-1.0, -0.5]) == [-0.5, -0.8, -1.0]
    assert fit("a", "UNARY", ["-", "-", 1]) == pytest.approx([1, 1.8, 2.6]) and fit("a", "RECIPROCAL")[0] == math.inf
    logs = fit("a", "LOG", ["e", 0.8])
    assert logs[0] == pytest.approx(math.log(0.8)) and logs[1] == -math.inf and math.isnan(logs[2])
    assert fit("c", "LENGTH") == [3, 3, None] and fit("c", "SUBSTR", [1, 2]) == ["AA", "BB", None]
    with pytest.raises(ZeroDivisionError):
        fit("a", "UNARY", ["+", "/", 0])


def test_scalers_and_encoders(spark, mixed):
    rows = spark.createDataFrame([(1.0, 5.0, "b"), (3.0, 5.0, "a"), (None, 5.0, "c")], "x double, k double, s string").coalesce(1)
    s = columns.Scaler.fit(rows, ["x", "k"])
    assert col(s.apply(rows), "x")[:2] == [-1.0, 1.0] and math.isnan(col(s.apply(rows), "k")[0])
    assert col(s.inverse(s.apply(rows)), "x")[:2] == [1.0, 3.0]
    o = columns.Ordinal.fit(rows, ["s"])
    assert col(o.apply(rows), "s") == [1.0, 0.0, 2.0] and col(o.inverse(o.apply(rows)), "s") == ["b", "a", "c"]
    with pytest.raises(Exception, match="unseen"):
        o.apply(mixed.select("s")).collect()


def test_case_when_precedence(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "a int, f double").coalesce(1)
    rule = columns.CaseWhen(new="z", otherwise={"column": "a"}, cases=[{"when": [["a", "EQ", 1, "AND"], ["f", "GT", 5.0, "OR"], ["f", "EQ", 2.0000001]], "then": -1}])
    assert col(rule.apply(df), "z") == [1, -1, 3]


def test_chain_and_score_card(spark):
    df = spark.createDataFrame([(0.5,), (0.0,), (1.0,), (None,)], "p double").coalesce(1)
    rule = columns.ScoreCard(prediction="p", scaled_value=600, odd_base=20, pdo=20, low=0, high=1000, positive=0)
    out = col(Chain([rule]).apply(df), "score")
    assert out[0] == pytest.approx(600 - 20 / math.log(2) * math.log(20)) and out[1:] == [1000.0, 0.0, None]
    with pytest.raises(KeyError):
        substitution(df.withColumnRenamed("p", "q"), columns.LogRound(columns=["p"], bias=1, decimals=0))


def test_bins_like_pandas(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=500).round(2)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double").coalesce(1)
    out = col(binning.Bins.fit(df, ["x"], 6).apply(df), "x")
    assert out[:500] == pd.qcut(x, 6, labels=False, duplicates="drop").tolist() and out[500:] == [-1, -1]
    rule = binning.Bins.fit(df, ["x"], 6, "eq_range")
    assert col(rule.apply(df), "x")[:500] == pd.cut(x, 6, labels=False).tolist()
    small = rule.merged("x", [1, 2])
    assert len(small.params["splits"]["x"]) == 4 and max(col(small.apply(df), "x")) == 4
    with pytest.raises(ValueError):
        rule.merged("x", [0, 2])
    text = spark.createDataFrame([("b",), ("a",), (None,)], "s string").coalesce(1)
    rule = binning.Bins.fit(text, ["s"])
    assert col(rule.apply(text), "s") == [1, 0, -1] and col(rule.apply(spark.createDataFrame([("zz",)], "s string")), "s") == [-1]


def test_woe(spark):
    rows = [(float(i), int(i % 3 == 0 or i > 80)) for i in range(100)] + [(None, 1)]
    df = spark.createDataFrame(rows, "x double, y int")
    rule = binning.WoeBins.fit(df, ["x"], "y", bins=4)
    r = rule.params["report"]["x"]
    for b in r["bins"]:
        p, n = b["positive"] / r["positives"], (b["total"] - b["positive"]) / (r["total"] - r["positives"])
        assert b["woe"] == pytest.approx(math.log(p / n)) and b["iv"] == pytest.approx((p - n) * b["woe"])
    assert r["iv"] == pytest.approx(sum(b["iv"] for b in r["bins"])) and r["total"] == 101
    edited = Rule.from_json(tables.write_rule(rule.to_json(), merges={"x": [0, 1]}))
    assert edited.params["report"]["x"]["bins"][0]["total"] == r["bins"][0]["total"] + r["bins"][1]["total"]
    chi = binning.WoeBins.fit(df, ["x"], "y", method="chimerge", init_bins=20, target_bins=3)
    assert len(chi.params["splits"]["x"]) <= 2 and binning.chi_limit(0.05) == pytest.approx(3.841458820694124)
    with pytest.raises(ValueError):
        binning.WoeBins.fit(df.filter("y = 1"), ["x"], "y")
    assert binning.woe_iv(0, 0, 10, 4)[0] == pytest.approx(math.log(6 / 4))
    assert math.isnan(binning.rates(4, 2, 10)[0]) and binning.rates(10, 5, 20) == (0.5, 0.5)


SQL = [
    ("3 / 2 + a * 0 AS z", 1), ("a / 2 AS z", 1), ("-a / 2 AS z", -1), ("a // 2 AS z", 1.0), ("f / 0 AS z", math.inf), ("a % 2 AS z", 1), ("NOT a = 3 AS z", False), ("a = 3 AND n = 1 AS z", None), ("a = 3 OR n = 1 AS z", None), ("a <> 3 XOR a = 3 AS z", True),
    ("n IN (1, 2) AS z", False), ("a IN (1, 3) AS z", True), ("a NOT BETWEEN 1 AND 2 AS z", True), ("ROUND(f + 0.5) AS z", 2.0), ("TRUNC(-f) AS z", -2.0), ("CEIL(f * 1.07, 1) AS z", 2.2), ("LN(f - f) AS z", -math.inf), ("LOG(f * 50) AS z", 2.0), ("LOG(2, f * 4) AS z", 3.0),
    ("s LIKE 'h%' AS z", True), ("s SIMILAR TO 'l+' AS z", True), ("TITLE(s) AS z", "Hello World's"[:11] + "'S"), ("SWAPCASE(s) AS z", "HELLO WORLD'S"), ("CENTER(s, 15, '*') AS z", "*hello world's*"), ("LPAD(s, 3) AS z", "hello world's"), ("TRIM(s, 'hs') AS z", "ello world'"), ("s || n AS z", None),
    ("CASE a WHEN 3 THEN 'x' ELSE 'y' END AS z", "x"), ("CASE WHEN n > 1 THEN 1 ELSE 2 END AS z", 2), ("CAST(f AS INT) AS z", 2), ("n IS NULL AS z", True), ("a << 2 | 1 AS z", 13), ("~a AS z", -4), ("IS_ALPHA(s) AS z", False), ("IS_LOWER(s) AS z", True), ("COALESCE(n, 5) AS z", 5),
    ("q = q AS z", False), ("q <> q AS z", True), ("\"a\" + 1 AS z", 4), ("s = 'it''s' AS z", False),
]


@pytest.mark.parametrize(("text", "want"), SQL)
def test_sql_values(spark, text, want):
    df = spark.createDataFrame([(3, 2.0, "hello world's", None, float("nan"))], "a int, f double, s string, n int, q double")
    got = run_sql(df, f"SELECT {text} FROM t").first()[0]
    assert got == (pytest.approx(want) if isinstance(want, float) and math.isfinite(want) else want)


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT a FROM t WHERE a > 1", "SELECT a GROUP BY a", "SELECT DISTINCT a", "SELECT SUM(a) AS s", "SELECT a FROM t LIMIT 1", "SELECT a FROM t, u", "SELECT (SELECT 1) AS z", "SELECT ROW_NUMBER() OVER (ORDER BY a) AS r", "SELECT 1 AS one", "SELECT a + f", "SELECT a AS z, f AS z",
        "SELECT a, *", "SELECT a + b AS z", "SELECT a + y AS z", "SELECT zz AS z", "SELECT a[1] AS z", "SELECT a LIKE s AS z", "SELECT nothing(a) AS z", "SELECT CAST(a AS DATE) AS d", "SELECT a +", "UPDATE t", "SELECT CASE END AS z",
    ],
)
def test_sql_refusals(spark, sql):
    df = tag(spark.createDataFrame([(3, 2.0, "x", 1)], "a int, f double, s string, y int"), "alice", {"y": "label"})
    df = df.join(tag(spark.createDataFrame([(1,)], "b int"), "bob"))
    with pytest.raises(SqlError):
        run_sql(df, sql).collect()


def test_sql_star(spark):
    df = tag(spark.createDataFrame([(3, 2.0)], "a int, f double"), "alice")
    out = substitution(df, SqlRule("SELECT *, a + 1, f * 2 AS g FROM t").to_json())
    assert out.columns == ["a", "f", "g"] and tuple(out.first()) == (4, 2.0, 4.0)
    assert out.schema["g"].metadata["party"] == "alice"

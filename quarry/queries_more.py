"""More named queries with SQL: functions of the SQL front end, the table facade, samples by rows, sources, evaluation and models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import scalar as S
from .ml import linear, neighbours
from .operators import aggregates, joins, sampling
from .operators.frame import Table
from .plans.components import standard
from .plans.cut import shared_path
from .plans.sql_processor import run_sql
from .queries import _LABELLED, Tables, _labelled, query, r6, rounded
from .rules import binning, columns
from .rules.base import Rule
from .sources import tables
from .stats import evaluation, statistics
from .streaming import streams


def _folder(t: Tables) -> str:
    return shared_path(t.spark, "folder")


# functions of the SQL front end


@query(
    "SELECT event_id, NOT value > 20 AS negated, value > 20 OR event_id < 100 AS either, (value > 20) <> (event_id < 100) AS odd, ~event_id AS inverted, xor(event_id, 5) AS xored, event_id >> 2 AS shifted, floor(event_id / 7) AS whole, "
    "event_type ILIKE 'CL%' AS clicks, regexp_full_match(event_type, '.*(ie|ur).*') AS alike FROM events"
)
def sql_operators(t: Tables) -> DataFrame:
    return run_sql(
        t.events,
        "SELECT event_id, NOT value > 20 AS negated, value > 20 OR event_id < 100 AS either, value > 20 XOR event_id < 100 AS odd, ~event_id AS inverted, event_id ^ 5 AS xored, event_id >> 2 AS shifted, event_id // 7 AS whole, "
        "event_type ILIKE 'CL%' AS clicks, event_type SIMILAR TO '(ie|ur)' AS alike FROM t",
    ).withColumn("whole", F.col("whole").cast("double"))


@query(
    "WITH e AS (SELECT event_id, value - 30 AS v, value / 200 AS u FROM events) SELECT event_id, round(abs(v), 6) AS a, CAST(sign(v) AS DOUBLE) AS s, ceil(v * 10) / 10.0 AS c, floor(v * 10) / 10.0 AS f, trunc(v) AS t, trunc(v * 10) / 10.0 AS t1, round_even(v, 0) AS r FROM e"
)
def sql_rounding(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", (F.col("value") - 30).alias("v"))
    out = run_sql(rows, "SELECT event_id, ABS(v) AS a, SIGN(v) AS s, CEIL(v, 1) AS c, FLOOR(v, 1) AS f, TRUNC(v) AS t, TRUNC(v, 1) AS t1, ROUND(v) AS r FROM t")
    return out.select("event_id", r6("a"), "s", "c", "f", "t", "t1", "r")


@query(
    "WITH e AS (SELECT event_id, least(value / 200, 1) AS u, value AS v FROM events) SELECT event_id, round(acos(u), 6) AS ac, round(asin(u), 6) AS asn, round(atan(v), 6) AS atn, round(atan2(u, v + 1), 6) AS at2, round(cos(v), 6) + 0.0 AS c, round(tan(u), 6) AS tn, round(exp(u), 6) AS e FROM e"
)
def sql_trigonometry(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.least(F.col("value") / 200, F.lit(1.0)).alias("u"), F.col("value").alias("v"))
    out = run_sql(rows, "SELECT event_id, ACOS(u) AS ac, ASIN(u) AS asn, ATAN(v) AS atn, ATAN2(u, v + 1) AS at2, COS(v) AS c, TAN(u) AS tn, EXP(u) AS e FROM t")
    return rounded(out)


@query("SELECT event_id, round(ln(value + 2) / ln(3), 6) AS b, round(log10(value + 2), 6) AS l, round(ln(value + 2) / ln(2.0), 6) AS l2, round(ln(1 + value), 6) AS lp, round(ln(value + 2) / ln(5), 6) AS based FROM events")
def sql_logarithms(t: Tables) -> DataFrame:
    return rounded(run_sql(t.events, "SELECT event_id, LOGB(value + 2, 3) AS b, LOG(value + 2) AS l, LOG2(value + 2) AS l2, LOG1P(value) AS lp, LOG(5, value + 2) AS based FROM t"))


@query("SELECT event_id, false AS nan, value = 0 AS inf, value <> 0 AS finite, false AS empty, true AS valid FROM events")
def sql_tests(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "value", F.when(F.col("value") == 0, float("inf")).otherwise(F.col("value")).alias("v"))
    return run_sql(rows, "SELECT event_id, IS_NAN(v) AS nan, IS_INF(v) AS inf, IS_FINITE(v) AS finite, IS_NULL(v) AS empty, IS_VALID(v) AS valid FROM t")


@query(
    "SELECT p_partkey, p_brand, regexp_full_match(p_name, '[a-zA-Z0-9]+') AS alnum, regexp_full_match(p_name, '[a-zA-Z]+') AS alpha, regexp_full_match(k, '[0-9]+') AS deci, regexp_full_match(k, '[0-9]+') AS digit, regexp_full_match(k, '[0-9]+') AS num, "
    "p_name = lower(p_name) AND p_name <> upper(p_name) AS low, p_brand = upper(p_brand) AND p_brand <> lower(p_brand) AS up, false AS space, true AS printable FROM (SELECT *, CAST(p_partkey AS VARCHAR) AS k FROM part)"
)
def sql_text_classes(t: Tables) -> DataFrame:
    rows = t.part.withColumn("k", F.col("p_partkey").cast("string"))
    return run_sql(
        rows,
        "SELECT p_partkey, p_brand, IS_ALNUM(p_name) AS alnum, IS_ALPHA(p_name) AS alpha, IS_DECIMAL(k) AS deci, IS_DIGIT(k) AS digit, IS_NUMERIC(k) AS num, IS_LOWER(p_name) AS low, IS_UPPER(p_brand) AS up, IS_SPACE(p_name) AS space, IS_PRINTABLE(p_name) AS printable FROM t",
    )


@query(
    "SELECT c_custkey, repeat(c_mktsegment, 2) AS twice, regexp_replace(c_name, '0+', '#', 'g') AS hashed, list_aggregate([CASE WHEN x = upper(x) THEN lower(x) ELSE upper(x) END FOR x IN string_split(c_name, '')], 'string_agg', '') AS swapped, "
    "CASE WHEN length(c_mktsegment) < 13 THEN rpad(repeat('.', CAST(floor((13 - length(c_mktsegment)) / 2) AS INT)) || c_mktsegment, 13, '.') ELSE c_mktsegment END AS centred, rpad(c_mktsegment, 12, '-') AS padded, "
    "trim('  ' || c_mktsegment || ' ') AS bare, ltrim('xxy' || c_mktsegment, 'xy') AS cut, rtrim(c_mktsegment || 'yx', 'xy') AS ended, c_name || c_mktsegment AS tied, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS titled FROM customer"
)
def sql_more_strings(t: Tables) -> DataFrame:
    rows = t.customer.withColumns({"wide": F.concat(F.lit("  "), "c_mktsegment", F.lit(" ")), "led": F.concat(F.lit("xxy"), "c_mktsegment"), "tail": F.concat("c_mktsegment", F.lit("yx"))})
    return run_sql(
        rows,
        "SELECT c_custkey, REPEAT(c_mktsegment, 2) AS twice, REGEXP_REPLACE(c_name, '0+', '#') AS hashed, SWAPCASE(c_name) AS swapped, CENTER(c_mktsegment, 13, '.') AS centred, RPAD(c_mktsegment, 12, '-') AS padded, "
        "TRIM(wide) AS bare, LTRIM(led, 'xy') AS cut, RTRIM(tail, 'xy') AS ended, CONCAT(c_name, c_mktsegment) AS tied, TITLE(c_mktsegment) AS titled FROM t",
    )


# table facade


@query("SELECT c_custkey IS NULL AS c_custkey, c_acctbal < 0 AS c_acctbal, c_mktsegment = 'BUILDING' AS c_mktsegment, count(*) AS n FROM customer GROUP BY ALL")
def isna(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("c_acctbal"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"))
    return Table(rows).isna().df.groupBy("c_custkey", "c_acctbal", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT round(power(l_quantity, 3), 4) AS l_quantity, power(l_linenumber, 3) AS l_linenumber, l_returnflag FROM lineitem")
def power(t: Tables) -> DataFrame:
    return Table(t.lineitem)[["l_quantity", "l_linenumber", "l_returnflag"]].pow(3).df.withColumn("l_quantity", F.round("l_quantity", 4))


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def drop_columns(t: Tables) -> DataFrame:
    return Table(t.customer).copy().drop(["c_name", "c_acctbal"]).drop("nothing", errors="ignore").df


@query("SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def concat_rows(t: Tables) -> DataFrame:
    return Table(t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))).concat(Table(t.customer.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")))).df


@query("SELECT n.n_nationkey, n.n_name, CAST(r.r_regionkey AS DOUBLE) AS r_regionkey, r.r_name FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) n FULL JOIN (SELECT *, row_number() OVER (ORDER BY r_regionkey) AS i FROM region) r USING (i)")
def concat_columns(t: Tables) -> DataFrame:
    return Table(t.nation.select("n_nationkey", "n_name").orderBy("n_nationkey")).concat(Table(t.region.select(F.col("r_regionkey").cast("double").alias("r_regionkey"), "r_name").orderBy("r_regionkey")), axis=1).df


@query("WITH e AS (SELECT event_id, CASE WHEN value > 30 THEN value END AS v FROM events) SELECT event_id, coalesce(v, first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM e")
def fillna_bfill(t: Tables) -> DataFrame:
    return Table(t.events.select("event_id", F.when(F.col("value") > 30, F.col("value")).alias("v"))).fillna(method="bfill", order=["event_id"]).df


@query("WITH e AS (SELECT event_id, CASE WHEN value > 30 THEN value END AS v FROM events) SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS v FROM e")
def fillna_limit(t: Tables) -> DataFrame:
    return Table(t.events.select("event_id", F.when(F.col("value") > 30, F.col("value")).alias("v"))).fillna(method="ffill", limit=2, order=["event_id"]).df


@query("SELECT CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part")
def array_values(t: Tables) -> DataFrame:
    return Table(t.part)[["p_size", "p_retailprice"]].values().select(F.col("values")[0].alias("size"), F.col("values")[1].alias("price"))


@query("SELECT (SELECT count(*) FROM orders) AS n, 3 AS width, 'o_orderkey,o_orderstatus,o_totalprice' AS names")
def table_shape(t: Tables) -> DataFrame:
    held = Table(t.orders)[["o_orderkey", "o_orderstatus", "o_totalprice"]]
    n, width = held.shape
    return t.spark.createDataFrame([(n, width, ",".join(held.columns))], "n long, width int, names string")


@query("SELECT l_orderkey, l_linenumber, l_quantity - 10 AS l_quantity, l_discount - 0.5 AS l_discount FROM lineitem")
def subtract(t: Tables) -> DataFrame:
    return Table(t.lineitem)[["l_orderkey", "l_linenumber", "l_quantity", "l_discount"]].subtract({"l_quantity": 10.0, "l_discount": 0.5}).df


# samples, by rows


@query("SELECT c_custkey, c_name FROM customer")
def split_covers_the_table(t: Tables) -> DataFrame:
    a, b = sampling.train_test_split(t.customer, ["c_custkey"], 0.6, 0.4, 9)
    return a.unionAll(b).select("c_custkey", "c_name")


@query("WITH r AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders), k AS (SELECT round(count(*) / round(0.2 * count(*))) AS step FROM orders) SELECT o_orderkey, o_custkey FROM r, k WHERE i % step = 0")
def system_sample_rows(t: Tables) -> DataFrame:
    return sampling.system_sample(t.orders.orderBy("o_orderkey"), 0.2).select("o_orderkey", "o_custkey")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS kept, CAST(0 AS BIGINT) AS moved FROM orders")
def shuffled(t: Tables) -> DataFrame:
    out = sampling.shuffled(t.orders, 3)
    back = out.join(t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p")), F.col("k") == F.col("o_orderkey"))
    return back.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("p") == F.col("o_totalprice")).cast("long")).alias("kept"), F.sum((F.col("p") != F.col("o_totalprice")).cast("long")).alias("moved"))


# sources and components


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def csv_round_trip(t: Tables) -> DataFrame:
    path = _folder(t)
    tables.write_csv(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return tables.read_csv(t.spark, path, {"o_orderkey": "int", "o_orderstatus": "str", "o_totalprice": "float"}).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))


@query("SELECT p_size * 2 AS p_size, nullif(p_brand, 'Brand#11') AS p_brand FROM part")
def csv_nulls_and_converters(t: Tables) -> DataFrame:
    path = _folder(t)
    t.part.select("p_brand", "p_size").write.option("header", False).csv(path)
    out = tables.read_csv(t.spark, path, header=False, prefix="f", null_strs=["Brand#11"], converters={"f1": lambda c: c.cast("int") * 2})
    return out.select(F.col("f1").alias("p_size"), F.col("f0").alias("p_brand"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def csv_to_orc(t: Tables) -> DataFrame:
    a, b = _folder(t), _folder(t)
    tables.write_csv(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), a)
    tables.convert(t.spark, a, "csv", b, "orc", {"s_suppkey": "int", "s_name": "str", "s_acctbal": "float"})
    return tables.read_orc(t.spark, b).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"))


@query("SELECT r_regionkey, r_name FROM region")
def source_to_sink(t: Tables) -> DataFrame:
    run, path = standard().run, _folder(t)
    rows = run({"component": "io/data_source", "params": {"uri": f"{t.dir}/region.parquet", "party": "a"}}, t.spark)
    run({"component": "io/data_sink", "params": {"party": "a", "uri": path}}, run({"component": "io/identity"}, rows))
    return run({"component": "io/data_source", "params": {"uri": tables.mock("sink", t.spark.read.parquet(path)), "party": "b"}}, t.spark).select("r_regionkey", "r_name")


@query("SELECT * FROM (VALUES ('rule', 'fillna'), ('filled', '7.5')) AS v(name, value)")
def stored_rule(t: Tables) -> DataFrame:
    e = t.events.select(F.when(F.col("value") <= 50, F.col("value")).alias("value"))
    text = tables.write_rule(columns.FillNA.fit(e, ["value"], {"float": "mean"}).to_json(), values={"value": 7.5})
    name = tables.read_rule(t.spark, text).filter("name = 'rule'").first()["value"]
    return t.spark.createDataFrame([("rule", name), ("filled", str(Rule.from_json(text).params["values"]["value"]))], "name string, value string")


@query("SELECT CASE WHEN o_orderstatus IN ('F') THEN 'a' ELSE 'b' END AS party, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1")
def dealt_by_label(t: Tables) -> DataFrame:
    return tables.deal_by_label(t.orders, {"a": ["F"], "b": ["O"]}, "o_orderstatus").groupBy("party").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT count(*) AS n, count(*) AS distinct_n, CAST(2 AS BIGINT) AS parties FROM orders")
def dealt_by_share(t: Tables) -> DataFrame:
    out = tables.deal(t.orders, {"a": 0.3, "b": 0.7}, 5)
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("distinct_n"), F.count_distinct("party").alias("parties"))


# statistics and evaluation


@query("WITH a AS (SELECT CASE WHEN l_linenumber <= 3 THEN 0 ELSE 1 END AS s, CASE WHEN l_quantity < 10 THEN 0 WHEN l_quantity < 25 THEN 1 ELSE 2 END AS b FROM lineitem), c AS (SELECT b, sum(1 - s) / (SELECT sum(1 - s) FROM a) AS x, sum(s) / (SELECT sum(s) FROM a) AS y FROM a GROUP BY 1) SELECT round(sum((y - x) * ln(y / x)), 6) AS psi FROM c")
def psi_index(t: Tables) -> DataFrame:
    found = statistics.psi_index(t.lineitem.filter("l_linenumber <= 3"), t.lineitem.filter("l_linenumber > 3"), "l_quantity", [0.0, 10.0, 25.0, 1000.0])
    return t.spark.createDataFrame([(round(found, 6),)], "psi double")


@query(
    f"WITH d AS ({_LABELLED}), s AS (SELECT min(score) AS a, max(score) AS b, count(*) AS n, sum(y) AS p FROM d), b AS (SELECT CAST(least(4, floor((score - a) / (b - a) * 5)) AS INT) AS bin, count(*) AS total, sum(y) AS positive, avg(score) AS mean_score FROM d, s GROUP BY 1), "
    "g AS (SELECT i AS bin, a + (b - a) * i / 5 AS start, a + (b - a) * (i + 1) / 5 AS stop, n, p, coalesce(total, 0) AS total, coalesce(positive, 0) AS positive, coalesce(mean_score, 0) AS mean_score FROM (SELECT unnest(range(5)) AS i) CROSS JOIN s LEFT JOIN b ON b.bin = i), "
    "r AS (SELECT *, sum(total) OVER w AS ct, sum(positive) OVER w AS cp FROM g WINDOW w AS (ORDER BY bin DESC)) "
    "SELECT round(start, 6) AS start, round(stop, 6) AS \"end\", CAST(total AS BIGINT) AS total, CAST(positive AS DOUBLE) AS positive, CAST(total - positive AS DOUBLE) AS negative, round(CASE WHEN total > 0 THEN positive / total ELSE 0 END, 6) AS positive_rate, round(mean_score, 6) AS mean_score, CAST(ct AS DOUBLE) AS cumulative_total, CAST(cp AS DOUBLE) AS cumulative_positive, CAST(ct - cp AS DOUBLE) AS cumulative_negative, "
    "round(cp / ct, 6) AS precision, round(cp / p, 6) AS recall, round((ct - cp) / (n - p), 6) AS fpr, round(abs(cp / p - (ct - cp) / (n - p)), 6) AS ks, round(coalesce(2 * (cp / ct) * (cp / p) / nullif(cp / ct + cp / p, 0), 0), 6) AS f1, round(cp / ct / (p / n), 6) AS lift, round(total / n, 6) AS share FROM r"
)
def bin_table_whole(t: Tables) -> DataFrame:
    rows = evaluation.bin_table(_labelled(t), "quality", "score", 5, frequent=False)
    names = [*rows[0]]
    return rounded(t.spark.createDataFrame([tuple(int(r[c]) if c == "total" else float(r[c]) for c in names) for r in rows], ", ".join(f"`{c}` {'long' if c == 'total' else 'double'}" for c in names)))


@query(f"WITH d AS ({_LABELLED}), q AS (SELECT quantile_cont(score, [0.0, 0.25, 0.5, 0.75, 1.0]) AS s FROM d), b AS (SELECT CASE WHEN score >= s[4] THEN 3 WHEN score >= s[3] THEN 2 WHEN score >= s[2] THEN 1 ELSE 0 END AS bin, s, y FROM d, q) SELECT s[bin + 1] AS start, s[bin + 2] AS \"end\", count(*) AS total, CAST(sum(y) AS DOUBLE) AS positive FROM b GROUP BY ALL")
def bin_table_frequent(t: Tables) -> DataFrame:
    rows = evaluation.bin_table(_labelled(t), "quality", "score", 4, frequent=True)
    return t.spark.createDataFrame([(float(r["start"]), float(r["end"]), int(r["total"]), float(r["positive"])) for r in rows], "start double, `end` double, total long, positive double")


@query("SELECT round(avg(abs(a)), 6) AS mean_absolute, round(sqrt(avg(a * a)), 6) AS root_mean_square FROM (SELECT l_extendedprice / 1000 - l_quantity AS a FROM lineitem)")
def residual_figures(t: Tables) -> DataFrame:
    out = evaluation.regression(t.lineitem.select((F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("f")), "y", "f")
    return out.select(r6("mae", "mean_absolute"), r6("rmse", "root_mean_square"))


@query("WITH d AS (SELECT l_extendedprice / 1000 - l_quantity AS x FROM lineitem), s AS (SELECT min(x) AS a, max(x) AS b FROM d) SELECT CAST(least(5, floor((x - a) / (b - a) * 6)) AS INT) AS bin, count(*) AS n FROM d, s GROUP BY 1")
def residual_histogram(t: Tables) -> DataFrame:
    return evaluation.residual_histogram(t.lineitem.select((F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("f")), "y", "f", 6).select("bin", "n")


@query("SELECT count(*) AS l_quantity_count, max(l_quantity) AS high, min(l_quantity) AS low FROM lineitem")
def partition_aggregates(t: Tables) -> DataFrame:
    r = Table(t.lineitem).aggregate("count", "max", "min", columns=["l_quantity"])
    return r.select(F.col("count").cast("long").alias("l_quantity_count"), F.col("max").alias("high"), F.col("min").alias("low"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity < 20")
def component_filters(t: Tables) -> DataFrame:
    run = standard().run
    rows = run({"component": "data_filter/condition_filter"}, t.lineitem, "l_returnflag", "IN", "A,R")[0]
    return run({"component": "data_filter/expr_condition_filter"}, rows, "l_quantity < 20")[0].select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, CAST(rank AS DOUBLE) AS c_mktsegment FROM (SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS rank FROM customer)")
def label_encoder(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_mktsegment")
    return Rule.from_json(columns.Ordinal.fit(rows, ["c_mktsegment"]).to_json()).apply(rows)


@query("SELECT event_id, round(1 / (value + 1), 6) AS inverse, round_even(value, 0) AS whole, round(sqrt(value), 6) AS root, round(exp(value / 100), 6) AS e, round(ln(value + 3), 6) AS l FROM events")
def rule_calculations(t: Tables) -> DataFrame:
    v = F.col("value")
    rows = t.events.select("event_id", (v + 1).alias("inverse"), v.alias("whole"), v.alias("root"), (v / 100).alias("e"), v.alias("l"))
    C = columns.FeatureCalculate
    out = rows
    for c, op, more in (("inverse", "RECIPROCAL", []), ("whole", "ROUND", []), ("root", "SQRT", []), ("e", "EXP", []), ("l", "LOG", ["e", 3])):
        out = C.fit(rows, [c], op, more).apply(out) if more else C.fit(rows, [c], op).apply(out)
    return rounded(out, "whole")


# models whose figures SQL gives


@query("WITH s AS (SELECT label, " + ", ".join(f"avg(x[{i}]) AS m{i}, var_pop(x[{i}]) AS v{i}" for i in range(1, 9)) + ", count(*) AS n FROM (SELECT vec_id, label, [" + ", ".join(f"CAST(embedding[{i}] AS DOUBLE)" for i in range(1, 9)) + "] AS x FROM embeddings) GROUP BY 1), f AS (SELECT max(greatest(" + ", ".join(f"w{i}" for i in range(1, 9)) + ")) * 1e-9 AS e FROM (SELECT " + ", ".join(f"var_pop(CAST(embedding[{i}] AS DOUBLE)) AS w{i}" for i in range(1, 9)) + " FROM embeddings)), p AS (SELECT vec_id, s.label AS guess, e.label AS label, ln(n) " + " ".join(f"- 0.5 * ln(2 * pi() * (v{i} + f.e)) - (CAST(embedding[{i}] AS DOUBLE) - m{i}) ** 2 / (2 * (v{i} + f.e))" for i in range(1, 9)) + " AS l FROM embeddings e, s, f) SELECT vec_id, any_value(label) AS label, arg_max(guess, l) AS prediction FROM p GROUP BY vec_id")
def naive_bayes_rows(t: Tables) -> DataFrame:
    from .queries import _X, _points

    rows = _points(t)
    return rows.select("vec_id", "label", neighbours.NaiveBayes.fit(rows, _X, "label").predict().alias("prediction"))


@query(
    "WITH m AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_discount) AS mz, avg(l_extendedprice) AS my, covar_pop(l_quantity, l_quantity) AS xx, covar_pop(l_discount, l_discount) AS zz, covar_pop(l_quantity, l_discount) AS xz, covar_pop(l_quantity, l_extendedprice) AS xy, covar_pop(l_discount, l_extendedprice) AS zy, covar_pop(l_extendedprice, l_extendedprice) AS yy FROM lineitem), "
    "b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz FROM m) SELECT round(bx, 4) AS quantity, round(bz, 2) AS discount, round(my - bx * mx - bz * mz, 2) AS intercept, round((bx * xy + bz * zy) / yy, 6) AS r2 FROM b"
)
def two_feature_regression(t: Tables) -> DataFrame:
    m = linear.least_squares(t.lineitem, ["l_quantity", "l_discount"], "l_extendedprice")
    r2 = evaluation.regression(t.lineitem.select(F.col("l_extendedprice").alias("y"), m.predict().alias("f")), "y", "f").first()["r2"]
    return t.spark.createDataFrame([(round(m.weights[0], 4), round(m.weights[1], 2), round(m.intercept, 2), round(r2, 6))], "quantity double, discount double, intercept double, r2 double")


@query("SELECT event_id, round(CASE WHEN x < -4 THEN 0 WHEN x > 4 THEN 1 ELSE 0.5 + x * 0.125 END, 6) AS seg3, round(0.5 * (x / (1 + abs(x))) + 0.5, 6) AS df, round(least(1, greatest(0, 0.5 + x / 4 - x ** 3 / 48)), 4) AS t3, round(least(1, greatest(0, 0.5 + x / 4 - x ** 3 / 48 + x ** 5 / 480)), 4) AS t5 FROM (SELECT event_id, (value - 50) / 10 AS x FROM events)")
def sigmoid_more_kinds(t: Tables) -> DataFrame:
    x = (F.col("value") - 50) / 10
    return t.events.select("event_id", *(r6(linear.sigmoid(x, k), k) for k in ("seg3", "df")), *(F.round(linear.sigmoid(x, k), 4).alias(k) for k in ("t3", "t5")))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2 HAVING date_trunc('hour', any_value(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def stream_windows(t: Tables) -> DataFrame:
    """Event-time windows of a stream, given out once the watermark, a day behind, has passed their end."""
    source = streams.read(t.spark, f"{t.dir}/events.parquet*", t.events.schema)
    source = source.withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.tumbling(source, "ts", "1 hour", ["event_type"], late="1 day", n=F.count(F.lit(1)))
    return streams.drain(out, f"windows_{uuid.uuid4().hex[:8]}").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("SELECT event_id, value > 50 AS hit FROM events")
def stream_both_sides(t: Tables) -> DataFrame:
    """Both outputs of a filter on a stream, written batch by batch."""
    source = streams.read(t.spark, f"{t.dir}/events.parquet*", t.events.schema)
    hits, rest, state = (shared_path(t.spark, x) for x in ("hits", "rest", "state"))
    streams.split_batches(source, "value", ">", "50", hits, rest, state).awaitTermination()
    side = lambda path, hit: t.spark.read.parquet(path).select("event_id", F.lit(hit).alias("hit"))
    return side(hits, True).unionAll(side(rest, False))


@query("SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def psi_unbalanced_cached(t: Tables) -> DataFrame:
    """The offline phase deals the server's rows by key; the online one reads them."""
    path = joins.cache_keys(t.orders.select("o_orderkey", "o_custkey"), ["o_custkey"], _folder(t))
    out = joins.unbalanced_psi(t.customer.select("c_custkey", "c_name"), path, ["c_custkey"], ["o_custkey"], sort=False)
    return out.select("o_orderkey", "c_custkey", "c_name")


@query("SELECT 'a' AS party, (SELECT count(*) FROM customer) AS original_count, count(*) AS intersection_count FROM customer JOIN orders ON o_custkey = c_custkey UNION ALL SELECT 'b', (SELECT count(*) FROM orders), count(*) FROM customer JOIN orders ON o_custkey = c_custkey")
def psi_report(t: Tables) -> DataFrame:
    a, b = t.customer.select("c_custkey"), t.orders.select("o_orderkey", "o_custkey")
    found = joins.psi_report(a, b, joins.psi(a, b, ["c_custkey"], ["o_custkey"], sort=False))
    return t.spark.createDataFrame([(r["party"], r["original_count"], r["intersection_count"]) for r in found], "party string, original_count long, intersection_count long")


@query("SELECT quantile_cont(l_extendedprice, 0.1) AS low, quantile_cont(l_extendedprice, 0.5) AS mid, quantile_cont(l_extendedprice, 0.9) AS high FROM lineitem")
def quantiles_by_counts(t: Tables) -> DataFrame:
    found = aggregates.quantile_by_counts(t.lineitem, "l_extendedprice", [0.1, 0.5, 0.9])
    return t.spark.createDataFrame([tuple(found.values())], "low double, mid double, high double")


@query("SELECT round(avg(x), 6) AS mean, round(var_pop(x), 6) AS var FROM (SELECT c_acctbal AS x FROM customer UNION ALL SELECT s_acctbal FROM supplier)")
def united_moments(t: Tables) -> DataFrame:
    parts = [t.customer.select(F.col("c_acctbal").alias("x")), t.supplier.select(F.col("s_acctbal").alias("x"))]
    return rounded(aggregates.united(parts, "x").select("mean", "var"))


@query("WITH q AS (SELECT quantile_cont(c_acctbal, [0.25, 0.5, 0.75]) AS s FROM customer) SELECT c_custkey, CAST(CASE WHEN c_acctbal <= s[1] THEN 0 WHEN c_acctbal <= s[2] THEN 1 WHEN c_acctbal <= s[3] THEN 2 ELSE 3 END AS DOUBLE) AS bin FROM customer, q")
def bins_discretiser(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.col("c_acctbal").alias("bin"))
    rule = Rule.from_json(binning.Bins.fit(rows, ["bin"], 4).to_json())
    return rule.apply(rows).withColumn("bin", F.col("bin").cast("double"))


@query("SELECT event_id, coalesce(CAST(value AS BIGINT), 0) AS whole, event_type AS kind FROM (SELECT event_id, floor(value) AS value, event_type FROM events)")
def lossless_cast(t: Tables) -> DataFrame:
    rows = t.events.withColumn("f", F.floor("value").cast("double"))
    return rows.select("event_id", S.safe_cast(F.col("f"), "bigint", "double").alias("whole"), F.col("event_type").alias("kind"))

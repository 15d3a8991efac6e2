"""Named queries: each applies operators of this library to the given tables, with SQL that gives the same rows.

Figures of floating point are rounded to six digits on both sides, as sums depend on their order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as S
from .ml import boost, linear, neighbours
from .operators import aggregates, filters, groupby, joins, sampling
from .operators.frame import Table, horizontal
from .plans.ordered import running, with_position
from .plans.sql_processor import run_sql
from .rules import binning, columns
from .rules.base import Chain, Rule, substitution
from .schema import tag
from .sources import tables
from .stats import evaluation, statistics
from .streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded to six digits; minus zero becomes zero."""
    out = F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)
    return out.alias(name or (c if isinstance(c, str) else ""))


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*(r6(c) if t in ("double", "float") and c not in keep else F.col(c) for c, t in df.dtypes))


# filters, projection, reshaping


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_quantity >= 30")
def condition_filter(t: Tables) -> DataFrame:
    return filters.condition_filter(t.lineitem, "l_quantity", ">=", "30")[0].select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT coalesce(abs(l_discount - 0.05) <= 1e-6, false)")
def condition_filter_else(t: Tables) -> DataFrame:
    return filters.condition_filter(t.lineitem, "l_discount", "==", "0.05")[1].select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def condition_filter_in(t: Tables) -> DataFrame:
    return filters.condition_filter(t.orders, "o_orderpriority", "IN", "1-URGENT,2-HIGH")[0].select("o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL AND o_orderkey < 100")
def condition_filter_not_null(t: Tables) -> DataFrame:
    return filters.condition_filter(filters.condition_filter(t.orders, "o_orderkey", "NOTNULL")[0], "o_orderkey", "<", "100")[0].select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity * l_extendedprice > 1000000 AND l_returnflag <> 'N'")
def expr_filter(t: Tables) -> DataFrame:
    return filters.expr_filter(t.lineitem, "l_quantity * l_extendedprice > 1000000 AND l_returnflag <> 'N'")[0].select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def feature_filter(t: Tables) -> DataFrame:
    return filters.feature_filter(t.customer, ["c_name", "c_acctbal"])


@query("SELECT p_size AS size, p_partkey AS id FROM part")
def select_rename(t: Tables) -> DataFrame:
    return Table(t.part)[["p_size", "p_partkey"]].rename({"p_size": "size", "p_partkey": "id"}).df


@query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def select_dtypes(t: Tables) -> DataFrame:
    return Table(t.customer).select_dtypes("number").df


@query("SELECT CAST(l_quantity AS BIGINT) AS l_quantity, CAST(l_linenumber AS DOUBLE) AS l_linenumber FROM lineitem")
def astype(t: Tables) -> DataFrame:
    return Table(t.lineitem)[["l_quantity", "l_linenumber"]].astype({"l_quantity": "bigint", "l_linenumber": "double"}).df


@query("SELECT c_custkey, c_nationkey IS NULL AS c_nationkey, c_acctbal, coalesce(nullif(c_acctbal, 0), 0) - 100 AS less, round(c_acctbal * c_acctbal, 4) + 0.0 AS squared FROM customer")
def elementwise(t: Tables) -> DataFrame:
    rows = t.customer
    base = Table(rows.select("c_custkey", "c_acctbal"))
    missing = Table(rows.select("c_nationkey")).isna()
    both = rows.select("c_custkey", "c_nationkey").select("c_custkey", F.col("c_nationkey").isNull().alias("c_nationkey"))
    assert missing.columns == ["c_nationkey"]
    made = base.assign(less=F.col("c_acctbal")).subtract({"less": 100.0}).assign(squared=F.round(F.pow("c_acctbal", F.lit(2.0)), 4) + 0.0)
    return both.join(made.df, "c_custkey").select("c_custkey", "c_nationkey", "c_acctbal", "less", "squared")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' WHEN c_mktsegment = 'MACHINERY' THEN 'M' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def replace_values(t: Tables) -> DataFrame:
    return Table(t.customer[["c_custkey", "c_mktsegment"]]).replace({"BUILDING": "B", "MACHINERY": "M"}).df


@query("SELECT event_id, round_even(value, 1) AS value FROM events")
def round_half_even(t: Tables) -> DataFrame:
    return Table(t.events[["event_id", "value"]]).round({"value": 1}).df


@query("SELECT event_id, coalesce(CASE WHEN value > 50 THEN NULL ELSE value END, -1) AS value FROM events")
def fillna_value(t: Tables) -> DataFrame:
    return Table(t.events.select("event_id", F.when(F.col("value") <= 50, F.col("value")).alias("value"))).fillna({"value": -1.0}).df


@query("SELECT n_nationkey, last_value(CASE WHEN n_nationkey % 3 = 0 THEN n_name END IGNORE NULLS) OVER (ORDER BY n_nationkey) AS n_name FROM nation")
def fillna_ffill(t: Tables) -> DataFrame:
    rows = t.nation.select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).alias("n_name"))
    return Table(rows).fillna(method="ffill", order=["n_nationkey"]).df


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders QUALIFY position >= 10 AND position < 200 AND (position - 10) % 7 = 0")
def iloc(t: Tables) -> DataFrame:
    rows = Table(t.orders.select("o_orderkey").repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey")).iloc(slice(10, 200, 7)).df
    return with_position(rows.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey")).select("o_orderkey", (F.col("_rid") * 7 + 10).alias("position"))


@query("SELECT c_custkey, c_acctbal + c_custkey AS total FROM customer")
def apply_func(t: Tables) -> DataFrame:
    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"c_custkey": f["c_custkey"], "total": f["c_acctbal"] + f["c_custkey"]})

    return Table(t.customer).apply_func(add, "c_custkey long, total double").df


@query("SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'even' ELSE 'odd' END AS party, count(*) AS n, CAST(sum(s_suppkey) AS BIGINT) AS s FROM supplier GROUP BY 1")
def horizontal_parts(t: Tables) -> DataFrame:
    rows = t.supplier.select("s_suppkey")
    parts = {"even": rows.filter("s_suppkey % 2 = 0"), "odd": rows.filter("s_suppkey % 2 = 1")}
    return horizontal(parts).groupBy("party").agg(F.count(F.lit(1)).alias("n"), F.sum("s_suppkey").alias("s"))


# joins and sets


@query("SELECT o_orderkey, o_custkey, c_custkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def psi_inner(t: Tables) -> DataFrame:
    return joins.psi(t.orders.select("o_orderkey", "o_custkey"), t.customer.select("c_custkey", "c_mktsegment"), ["o_custkey"], ["c_custkey"])


@query("SELECT c_custkey, c_mktsegment, o_orderkey, o_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def psi_left(t: Tables) -> DataFrame:
    return joins.psi(t.customer.select("c_custkey", "c_mktsegment"), t.orders.select("o_orderkey", "o_custkey"), ["c_custkey"], ["o_custkey"], "left")


@query("WITH a AS (SELECT nullif(n_regionkey, 0) AS ka, n_nationkey FROM nation), b AS (SELECT nullif(r_regionkey, 0) AS kb, r_name FROM region) SELECT coalesce(ka, -1) AS ka, n_nationkey, coalesce(kb, -1) AS kb, r_name FROM a JOIN b ON ka IS NOT DISTINCT FROM kb")
def psi_null_keys(t: Tables) -> DataFrame:
    a = t.nation.select(F.nullif("n_regionkey", F.lit(0)).alias("ka"), "n_nationkey")
    return joins.psi(a, t.region.select(F.nullif("r_regionkey", F.lit(0)).alias("kb"), "r_name"), ["ka"], ["kb"]).na.fill(-1)


@query("SELECT coalesce(s_suppkey, -1) AS s_suppkey, coalesce(p_partkey, -1) AS p_partkey FROM supplier FULL JOIN part ON s_suppkey = p_partkey")
def psi_full(t: Tables) -> DataFrame:
    return joins.psi(t.supplier.select("s_suppkey"), t.part.select("p_partkey"), ["s_suppkey"], ["p_partkey"], "full").na.fill(-1)


@query("SELECT coalesce(s_suppkey, -1) AS s_suppkey, coalesce(p_partkey, -1) AS p_partkey FROM supplier FULL JOIN part ON s_suppkey = p_partkey WHERE s_suppkey IS NULL OR p_partkey IS NULL")
def psi_difference(t: Tables) -> DataFrame:
    return joins.psi(t.supplier.select("s_suppkey"), t.part.select("p_partkey"), ["s_suppkey"], ["p_partkey"], "difference").na.fill(-1)


@query("SELECT s_suppkey, c_custkey, p_partkey FROM supplier JOIN customer ON s_suppkey = c_custkey JOIN part ON s_suppkey = p_partkey")
def psi_three(t: Tables) -> DataFrame:
    return joins.psi3(t.supplier.select("s_suppkey"), t.customer.select("c_custkey"), t.part.select("p_partkey"), ["s_suppkey"], ["c_custkey"], ["p_partkey"])


@query("SELECT n_nationkey, n_name, c_nationkey, c_custkey FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE n_regionkey = 1")
def psi_unbalanced(t: Tables) -> DataFrame:
    return joins.unbalanced_psi(t.nation.filter("n_regionkey = 1").select("n_nationkey", "n_name"), t.customer.select("c_nationkey", "c_custkey"), ["n_nationkey"], ["c_nationkey"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def psi_semi(t: Tables) -> DataFrame:
    return joins.psi(t.orders.select("o_orderkey", "o_custkey"), t.customer.filter("c_mktsegment = 'BUILDING'").select("c_custkey"), ["o_custkey"], ["c_custkey"], duplicated=(True, False), receiver="a")


@query("SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer")
def union_all(t: Tables) -> DataFrame:
    return joins.union(t.supplier.select(F.col("s_nationkey").alias("k")), t.customer.select(F.col("c_nationkey").alias("k")))


@query("SELECT l_partkey AS k FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size < 10")
def intersect_rows(t: Tables) -> DataFrame:
    return joins.intersect(t.lineitem.select(F.col("l_partkey").alias("k")), t.part.filter("p_size < 10").select(F.col("p_partkey").alias("k")))


# aggregates

_STATS = ("count", "nunique", "sum", "min", "max", "mean", "var", "std", "sem", "skew", "kurtosis", "mode", "median")


def _column_sql(c: str, table: str) -> str:
    n = f"count({c})"
    plain = {"count": n, "nunique": f"count(DISTINCT {c})", "sum": f"sum({c})", "min": f"min({c})", "max": f"max({c})", "mean": f"avg({c})", "var": f"var_samp({c})", "std": f"stddev_samp({c})", "sem": f"stddev_samp({c}) / sqrt({n})", "skew": f"skewness({c})", "kurtosis": f"kurtosis({c})", "median": f"median({c})"}
    plain["mode"] = f"(SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"
    return f"SELECT '{c}' AS \"column\", " + ", ".join(f'round(CAST({plain[f]} AS DOUBLE), 4) + 0.0 AS "{f}"' for f in _STATS) + f" FROM {table}"


@query(" UNION ALL ".join(_column_sql(c, "lineitem") for c in ("l_quantity", "l_discount", "l_tax")))
def column_statistics(t: Tables) -> DataFrame:
    rows = aggregates.column_stats(t.lineitem, list(_STATS), ["l_quantity", "l_discount", "l_tax"])
    return rows.select("column", *((F.round(f, 4) + 0.0).alias(f) for f in _STATS))


@query("SELECT 'l_extendedprice' AS \"column\", q, round(value, 6) AS value FROM (SELECT unnest([0.05, 0.25, 0.5, 0.9]) AS q, unnest(quantile_cont(l_extendedprice, [0.05, 0.25, 0.5, 0.9])) AS value FROM lineitem)".replace("unnest([0.05, 0.25, 0.5, 0.9]) AS q", "CAST(unnest([0.05, 0.25, 0.5, 0.9]) AS DOUBLE) AS q"))
def quantiles(t: Tables) -> DataFrame:
    return rounded(aggregates.quantile(t.lineitem, [0.05, 0.25, 0.5, 0.9], ["l_extendedprice"]), "q")


@query("SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 1")
def value_counts(t: Tables) -> DataFrame:
    return aggregates.value_counts(t.orders, "o_orderpriority")


@query("SELECT round(avg(x), 6) AS mean, round(var_pop(x), 4) AS var, round(median(x), 6) AS median FROM (SELECT c_acctbal AS x FROM customer UNION ALL SELECT s_acctbal FROM supplier)")
def united_statistics(t: Tables) -> DataFrame:
    out = aggregates.united([t.customer.select(F.col("c_acctbal").alias("x")), t.supplier.select(F.col("s_acctbal").alias("x"))], "x")
    return out.select(r6("mean"), F.round("var", 4).alias("var"), r6("median"))


@query("WITH u AS (SELECT c_nationkey AS key, avg(c_acctbal) AS x, 3.0 AS w FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, avg(s_acctbal), 1.0 FROM supplier GROUP BY 1) SELECT key, round(sum(x), 6) AS sum, round(CAST(sum(w * x) / sum(w) AS DOUBLE), 6) AS average FROM u GROUP BY key")
def secure_aggregation(t: Tables) -> DataFrame:
    a = t.customer.groupBy(F.col("c_nationkey").alias("key")).agg(F.avg("c_acctbal").alias("x"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("key")).agg(F.avg("s_acctbal").alias("x"))
    return rounded(aggregates.combine([a, b], "x", [3.0, 1.0]))


@query("SELECT min(x) AS min, max(x) AS max FROM (SELECT c_acctbal AS x FROM customer UNION ALL SELECT s_acctbal FROM supplier)")
def secure_comparison(t: Tables) -> DataFrame:
    return aggregates.compare([t.customer.select(F.col("c_acctbal").alias("x")), t.supplier.select(F.col("s_acctbal").alias("x"))], "x")


@query("SELECT round(sum(l_quantity * l_quantity), 2) AS squares, count(*) AS n FROM lineitem")
def block_aggregate(t: Tables) -> DataFrame:
    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"s": [float((f["l_quantity"] ** 2).sum())], "k": [len(f)]})

    return aggregates.block_aggregate(t.lineitem.select("l_quantity"), part, "s double, k long", [F.round(F.sum("s"), 2).alias("squares"), F.sum("k").alias("n")])


_GROUPED = [("l_quantity", f) for f in ("count", "sum", "mean", "min", "max", "var")] + [("l_extendedprice", "mean")]


@query(
    "SELECT l_returnflag, l_linestatus, count(*) AS l_quantity_count, round(sum(l_quantity), 6) AS l_quantity_sum, round(avg(l_quantity), 6) AS l_quantity_mean, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max, "
    "round(coalesce(var_samp(l_quantity), 0), 6) AS l_quantity_var, round(avg(l_extendedprice), 6) AS l_extendedprice_mean FROM lineitem GROUP BY 1, 2"
)
def groupby_statistics(t: Tables) -> DataFrame:
    return rounded(groupby.group_statistics(t.lineitem, ["l_returnflag", "l_linestatus"], _GROUPED), "l_quantity_min", "l_quantity_max")


@query("SELECT coalesce(nullif(event_type, 'click'), '0') AS event_type, count(*) AS value_count, round(sum(value), 6) AS value_sum, round(coalesce(var_samp(value), 0), 6) AS value_var FROM events GROUP BY 1")
def ordinal_groupby(t: Tables) -> DataFrame:
    rows = t.events.select(F.nullif("event_type", F.lit("click")).alias("event_type"), "value")
    return rounded(groupby.ordinal_group(rows, ["event_type"], ["value"], ["count", "sum", "var"]))


# samples


@query("SELECT CAST(ceil(count(*) / round(count(*) / round(0.1 * count(*)))) AS BIGINT) AS n FROM orders")
def system_sample(t: Tables) -> DataFrame:
    return sampling.system_sample(t.orders, 0.1).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(round_even(0.3 * count(*), 0) AS BIGINT) AS n, CAST(round_even(0.3 * count(*), 0) AS BIGINT) AS distinct_n FROM orders")
def random_sample(t: Tables) -> DataFrame:
    return sampling.random_sample(t.orders, ["o_orderkey"], 0.3, 7).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("distinct_n"))


@query("SELECT CAST(round_even(0.2 * count(*), 0) AS BIGINT) AS n FROM orders")
def random_sample_replacement(t: Tables) -> DataFrame:
    return sampling.random_sample(t.orders.select("o_orderkey"), ["o_orderkey"], 0.2, 7, replacement=True).agg(F.count(F.lit(1)).alias("n"))


@query("WITH b AS (SELECT CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 30 THEN 1 ELSE 2 END AS bucket, count(*) AS c FROM lineitem GROUP BY 1) SELECT bucket, CAST(round_even(round_even(0.1 * sum(c) OVER (), 0) * (c / sum(c) OVER ()), 0) AS BIGINT) AS n FROM b")
def stratified_sample(t: Tables) -> DataFrame:
    rows, _ = sampling.stratified_sample(t.lineitem, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "l_quantity", [10.0, 30.0], 0.1, 3)
    return rows.groupBy(sampling.bucket_of("l_quantity", [10.0, 30.0]).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(ceil(count(*) * 0.75) AS BIGINT) AS train, count(*) - CAST(ceil(count(*) * 0.75) AS BIGINT) AS test, CAST(0 AS BIGINT) AS both FROM customer")
def train_test_split(t: Tables) -> DataFrame:
    a, b = sampling.train_test_split(t.customer, ["c_custkey"], 0.75, 0.25, 5)
    rows = a.select("c_custkey", F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select("c_custkey", F.lit(0), F.lit(1))).groupBy("c_custkey").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return rows.agg(F.sum("a").alias("train"), F.sum("b").alias("test"), F.sum(F.col("a") * F.col("b")).alias("both"))


# SQL front end


@query("SELECT l_orderkey, l_linenumber, l_linenumber // 2 AS half, l_linenumber % 3 AS rest, round(l_extendedprice / (l_discount + 1), 6) AS net, (l_linenumber & 3) | 4 AS bits, l_linenumber << 2 AS shifted, -l_linenumber AS negative, l_quantity BETWEEN 10 AND 20 AS mid, l_linenumber IN (1, 2) AS few FROM lineitem")
def sql_arithmetic(t: Tables) -> DataFrame:
    out = run_sql(t.lineitem, "SELECT l_orderkey, l_linenumber, l_linenumber / 2 AS half, l_linenumber % 3 AS rest, l_extendedprice / (l_discount + 1) AS net, (l_linenumber & 3) | 4 AS bits, l_linenumber << 2 AS shifted, -l_linenumber AS negative, l_quantity BETWEEN 10 AND 20 AS mid, l_linenumber IN (1, 2) AS few FROM t")
    return out.withColumns({"half": F.col("half").cast("int"), "net": F.round("net", 6)})


@query("SELECT c_custkey, upper(c_mktsegment) AS up, lower(c_name) AS low, length(c_name) AS n, c_name || '-' || c_mktsegment AS tied, replace(c_name, 'Customer', 'C') AS short, reverse(c_mktsegment) AS back, c_mktsegment LIKE 'B%' AS b, lpad(c_mktsegment, 12, '*') AS padded, c_mktsegment[1] || lower(c_mktsegment[2:]) AS cap FROM customer")
def sql_strings(t: Tables) -> DataFrame:
    return run_sql(t.customer, "SELECT c_custkey, UPPER(c_mktsegment) AS up, LOWER(c_name) AS low, LENGTH(c_name) AS n, c_name || '-' || c_mktsegment AS tied, REPLACE(c_name, 'Customer', 'C') AS short, REVERSE(c_mktsegment) AS back, c_mktsegment LIKE 'B%' AS b, LPAD(c_mktsegment, 12, '*') AS padded, CAPITALIZE(c_mktsegment) AS cap").withColumn("n", F.col("n").cast("long"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal < 5000 AND c_nationkey > 3 THEN 'mid' ELSE 'high' END AS level, CAST(c_nationkey AS DOUBLE) AS nation, coalesce(nullif(c_nationkey, -1), 0) AS filled, c_acctbal IS NULL AS missing FROM customer")
def sql_case(t: Tables) -> DataFrame:
    return run_sql(t.customer, "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'low' WHEN c_acctbal < 5000 AND c_nationkey > 3 THEN 'mid' ELSE 'high' END AS level, CAST(c_nationkey AS DOUBLE) AS nation, COALESCE(c_nationkey, 0) AS filled, c_acctbal IS NULL AS missing FROM t")


@query("SELECT event_id, round(CASE WHEN value - 20 > 0 THEN ln(value - 20) WHEN value - 20 = 0 THEN -1e9 ELSE 1e9 END, 6) AS ln, round(sqrt(value), 6) AS root, round(log10(value + 1), 6) AS lg, round(power(value, 2), 4) AS sq, round(sin(value), 6) + 0.0 AS s, floor(value) AS f, ceil(value) AS c, round_even(value, 1) AS r FROM events")
def sql_maths(t: Tables) -> DataFrame:
    out = run_sql(t.events, "SELECT event_id, LN(value - 20) AS ln, SQRT(value) AS root, LOG10(value + 1) AS lg, POW(value, 2) AS sq, SIN(value) AS s, FLOOR(value) AS f, CEIL(value) AS c, ROUND(value, 1) AS r FROM t")
    out = out.withColumn("ln", F.when(F.isnan("ln"), 1e9).when(F.col("ln") == float("-inf"), -1e9).otherwise(F.col("ln")))
    return out.select("event_id", r6("ln"), r6("root"), r6("lg"), F.round("sq", 4).alias("sq"), r6("s"), "f", "c", "r")


# rules


@query("SELECT c_custkey, round(c_acctbal * c_nationkey, 6) AS product FROM customer")
def rule_binary_op(t: Tables) -> DataFrame:
    return rounded(columns.BinaryOp(op="*", a="c_acctbal", b="c_nationkey", new="product").apply(t.customer).select("c_custkey", "product"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 200000 OR o_orderpriority = '1-URGENT' THEN 2 WHEN o_orderkey < 50 THEN 1 ELSE 0 END AS class FROM orders")
def rule_case_when(t: Tables) -> DataFrame:
    rule = columns.CaseWhen(new="class", otherwise=0, cases=[{"when": [["o_orderstatus", "EQ", "F", "AND"], ["o_totalprice", "GT", 200000.0, "OR"], ["o_orderpriority", "EQ", "1-URGENT"]], "then": 2}, {"when": [["o_orderkey", "LT", 50]], "then": 1}])
    return substitution(t.orders, rule.to_json()).select("o_orderkey", "class")


@query("SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS l_quantity, CAST(l_linenumber AS VARCHAR) AS l_linenumber FROM lineitem")
def rule_cast(t: Tables) -> DataFrame:
    rule = Chain([columns.Cast(columns=["l_quantity"], to="integer"), columns.Cast(columns=["l_linenumber"], to="string")])
    return rule.apply(t.lineitem.select("l_orderkey", "l_quantity", "l_linenumber"))


@query(
    "WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS d, min(value) AS a, max(value) AS b FROM events) SELECT event_id, round((value - m) / d, 6) + 0.0 AS standard, round((value - a) / (b - a), 6) + 0.0 AS norm, "
    "least(greatest(value, 5.0), 50.0) AS clipped, round(10 - value, 6) AS turned, round_even(log2(value + 10), 0) AS logs, length(event_type) AS len, substring(event_type, 2, 3) AS part FROM events, s"
)
def rule_feature_calculate(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "event_type", *(F.col("value").alias(n) for n in ("standard", "norm", "clipped", "turned", "logs")), F.col("event_type").alias("len"), F.col("event_type").alias("part"))
    C = columns.FeatureCalculate
    rules = [C.fit(e, ["standard"], "STANDARDIZE"), C.fit(e, ["norm"], "NORMALIZATION"), C.fit(e, ["clipped"], "RANGE_LIMIT", [5.0, 50.0]), C.fit(e, ["turned"], "UNARY", ["-", "-", 10]), C.fit(e, ["logs"], "LOG_ROUND", [10]), C.fit(e, ["len"], "LENGTH"), C.fit(e, ["part"], "SUBSTR", [1, 3])]
    return Chain(rules).apply(e).select("event_id", r6("standard"), r6("norm"), "clipped", r6("turned"), "logs", F.col("len").cast("long").alias("len"), "part")


@query("WITH e AS (SELECT event_id, CASE WHEN value <= 50 AND abs(value - 6.55) > 1e-7 THEN value END AS v, nullif(event_type, 'error') AS k FROM events) SELECT event_id, round(coalesce(v, (SELECT avg(v) FROM e)), 6) AS value, coalesce(k, (SELECT k FROM e WHERE k IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS event_type FROM e")
def rule_fillna(t: Tables) -> DataFrame:
    e = t.events.select("event_id", F.when(F.col("value") <= 50, F.col("value")).alias("value"), F.nullif("event_type", F.lit("error")).alias("event_type"))
    rule = columns.FillNA.fit(e, ["value", "event_type"], {"float": "mean", "str": "most_frequent"}, outliers={"float": [6.55]})
    return rounded(Rule.from_json(rule.to_json()).apply(e))


@query("WITH k AS (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS i FROM orders GROUP BY 1) SELECT o_orderkey, " + ", ".join(f"CAST(max(CASE WHEN i = {i} AND p = o_orderpriority THEN 1 ELSE 0 END) AS DOUBLE) AS o_orderpriority_{i}" for i in range(5)) + " FROM orders, k GROUP BY 1")
def rule_onehot(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_orderpriority")
    out = columns.OneHot.fit(rows, ["o_orderpriority"], order="o_orderkey").apply(rows)
    return out.select("o_orderkey", *(F.col(c).cast("double").alias(c) for c in out.columns[1:]))


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) + 0.0 AS c_acctbal FROM customer")
def rule_standard_scaler(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_acctbal")
    return rounded(columns.Scaler.fit(rows, ["c_acctbal"]).apply(rows))


@query("SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) + 0.0 AS c_acctbal FROM customer")
def rule_min_max_scaler(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_acctbal")
    return rounded(columns.Scaler.fit(rows, ["c_acctbal"], "minmax").apply(rows))


@query("SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS c_mktsegment FROM customer")
def rule_ordinal(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", "c_mktsegment")
    return columns.Ordinal.fit(rows, ["c_mktsegment"]).apply(rows)


@query("SELECT event_id, round_even(log2(value + 0.5), 2) AS value FROM events")
def rule_log_round(t: Tables) -> DataFrame:
    return columns.LogRound(columns=["value"], bias=0.5, decimals=2).apply(t.events.select("event_id", "value"))


@query("SELECT l_orderkey, l_linenumber, round(least(1000.0, greatest(0.0, 600 - 20 / ln(2) * ln(20) + 20 / ln(2) * ln((l_discount + 0.01) / (1 - (l_discount + 0.01))))), 6) AS score FROM lineitem")
def rule_score_card(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_discount") + 0.01).alias("p"))
    rule = columns.ScoreCard(prediction="p", scaled_value=600, odd_base=20, pdo=20, low=0, high=1000)
    return rounded(rule.apply(rows).drop("p"))


@query("WITH q AS (SELECT quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS s FROM lineitem) SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_extendedprice <= s[1] THEN 0 WHEN l_extendedprice <= s[2] THEN 1 WHEN l_extendedprice <= s[3] THEN 2 ELSE 3 END AS DOUBLE) AS bin FROM lineitem, q")
def binning_quantile(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("bin"))
    return binning.Bins.fit(rows, ["bin"], 4).apply(rows).withColumn("bin", F.col("bin").cast("double"))


@query("WITH s AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b FROM customer) SELECT c_custkey, CAST(greatest(0, ceil((c_acctbal - a) / (b - a) * 5) - 1) AS DOUBLE) AS bin FROM customer, s")
def binning_equal_range(t: Tables) -> DataFrame:
    rows = t.customer.select("c_custkey", F.col("c_acctbal").alias("bin"))
    return binning.Bins.fit(rows, ["bin"], 5, "eq_range").apply(rows).withColumn("bin", F.col("bin").cast("double"))


_WOE = """
WITH q AS (SELECT quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8]) AS s FROM lineitem),
b AS (SELECT CASE WHEN l_extendedprice <= s[1] THEN 0 WHEN l_extendedprice <= s[2] THEN 1 WHEN l_extendedprice <= s[3] THEN 2 WHEN l_extendedprice <= s[4] THEN 3 ELSE 4 END AS bin, (l_returnflag = 'R')::INT AS y FROM lineitem, q),
c AS (SELECT bin, count(*) AS total, CAST(sum(y) AS BIGINT) AS positive FROM b GROUP BY 1), a AS (SELECT sum(total) AS n, sum(positive) AS p FROM c)
SELECT CAST(bin AS INT) AS bin, total, positive, round(ln(positive / p / ((total - positive) / (n - p))), 6) AS woe, round((positive / p - (total - positive) / (n - p)) * ln(positive / p / ((total - positive) / (n - p))), 6) AS iv FROM c, a
"""


@query(_WOE)
def woe_binning(t: Tables) -> DataFrame:
    rule = binning.WoeBins.fit(t.lineitem, ["l_extendedprice"], "l_returnflag", "R", bins=5)
    rows = [(i, b["total"], b["positive"], b["woe"], b["iv"]) for i, b in enumerate(rule.params["report"]["l_extendedprice"]["bins"])]
    return rounded(t.spark.createDataFrame(rows, "bin int, total long, positive long, woe double, iv double"))


@query()
def woe_chimerge(t: Tables) -> DataFrame:
    rule = binning.WoeBins.fit(t.lineitem, ["l_extendedprice", "l_quantity"], "l_returnflag", "R", method="chimerge", init_bins=20, target_bins=4)
    return rule.apply(t.lineitem).groupBy("l_quantity").agg(F.count(F.lit(1)).alias("n"))


# statistics


def _table_sql(c: str) -> str:
    m = lambda k: f"avg({c} ** {k})"
    f = {
        "total_count": "count(*)", "count": f"count({c})", "count_na": f"count(*) - count({c})", "na_ratio": f"1 - count({c}) / count(*)", "min": f"min({c})", "max": f"max({c})", "mean": f"avg({c})", "var": f"var_samp({c})", "std": f"stddev_samp({c})",
        "sem": f"stddev_samp({c}) / sqrt(count({c}))", "skewness": f"skewness({c})", "kurtosis": f"kurtosis({c})", "q1": f"quantile_cont({c}, 0.25)", "q2": f"quantile_cont({c}, 0.5)", "q3": f"quantile_cont({c}, 0.75)", "moment_2": m(2), "moment_3": m(3), "moment_4": m(4),
        "central_moment_2": f"var_pop({c})", "central_moment_3": f"{m(3)} - 3 * avg({c}) * {m(2)} + 2 * avg({c}) ** 3", "central_moment_4": f"{m(4)} - 4 * avg({c}) * {m(3)} + 6 * avg({c}) ** 2 * {m(2)} - 3 * avg({c}) ** 4",
        "sum": f"sum({c})", "sum_2": f"sum({c} ** 2)", "sum_3": f"sum({c} ** 3)", "sum_4": f"sum({c} ** 4)", "nunique": f"count(DISTINCT {c})",
    }
    return f"SELECT '{c}' AS \"column\", 'double' AS \"type\", " + ", ".join(f"round(CAST({e} AS DOUBLE), 3) + 0.0 AS {k}" for k, e in f.items()) + " FROM lineitem"


@query(" UNION ALL ".join(map(_table_sql, ("l_quantity", "l_discount"))))
def table_statistics(t: Tables) -> DataFrame:
    out = statistics.table_statistics(t.lineitem, ["l_quantity", "l_discount"])
    return out.select("column", "type", *((F.round(c, 3) + 0.0).alias(c) for c in out.columns[2:]))


@query("SELECT 'event_type' AS \"column\", 'string' AS \"type\", CAST(count(event_type) AS DOUBLE) AS count, CAST(count(DISTINCT event_type) AS DOUBLE) AS nunique FROM events")
def categorical_statistics(t: Tables) -> DataFrame:
    return statistics.categorical_statistics(t.events, ["event_type"])


_PAIRS = [(a, b) for a in ("l_quantity", "l_extendedprice", "l_discount") for b in ("l_quantity", "l_extendedprice", "l_discount")]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}) * count(*) / (count(*) - 1), 6) + 0.0 AS r FROM lineitem" for a, b in _PAIRS))
def pearson(t: Tables) -> DataFrame:
    return rounded(statistics.pearson_table(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]))


@query("SELECT c AS feature, round(1 / (1 - r * r) * (n - 1) / n, 6) AS vif FROM (SELECT corr(l_quantity, l_extendedprice) AS r, count(*) AS n, unnest(['l_quantity', 'l_extendedprice']) AS c FROM lineitem GROUP BY ALL)".replace(" GROUP BY ALL", ""))
def vif(t: Tables) -> DataFrame:
    return rounded(t.spark.createDataFrame(list(statistics.vif(t.lineitem, ["l_quantity", "l_extendedprice"]).items()), "feature string, vif double"))


_PSI = """
WITH q AS (SELECT quantile_cont(n_chars, [0.25, 0.5, 0.75]) AS s FROM documents WHERE lang = 'en'),
b AS (SELECT lang, CASE WHEN n_chars <= s[1] THEN 0 WHEN n_chars <= s[2] THEN 1 WHEN n_chars <= s[3] THEN 2 ELSE 3 END AS bin FROM documents, q WHERE lang IN ('en', 'de')),
c AS (SELECT bin, count(*) FILTER (WHERE lang = 'en') / (SELECT count(*) FROM b WHERE lang = 'en') AS x, count(*) FILTER (WHERE lang = 'de') / (SELECT count(*) FROM b WHERE lang = 'de') AS y FROM b GROUP BY 1)
SELECT 'n_chars' AS feature, round(sum((y - x) * ln(greatest(y, 1e-3) / greatest(x, 1e-3))), 6) AS psi FROM c
"""


@query(_PSI)
def population_stability(t: Tables) -> DataFrame:
    en, de = (t.documents.filter(F.col("lang") == x).select("n_chars") for x in ("en", "de"))
    return rounded(statistics.population_stability(en, de, ["n_chars"], binning.Bins.fit(en, ["n_chars"], 4)))


def _labelled(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", F.col("n_chars").cast("double").alias("score")), "doc_id")


_LABELLED = "SELECT quality AS y, CAST(n_chars AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id)"


@query(
    f"WITH d AS ({_LABELLED}), c AS (SELECT score, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg FROM d GROUP BY 1), r AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM c WINDOW w AS (ORDER BY score DESC)), e AS (SELECT sum(pos) AS p, sum(neg) AS n FROM c) "
    "SELECT CAST(any_value(p + n) AS BIGINT) AS total, CAST(any_value(p) AS BIGINT) AS positive, CAST(any_value(n) AS BIGINT) AS negative, round(CAST(sum(neg * (tp - pos / 2.0)) AS DOUBLE) / any_value(p) / any_value(n), 6) AS auc, round(max(abs(tp / p - fp / n)), 6) AS ks, round(max(2 * tp / (p + tp + fp)), 6) AS f1 FROM r, e"
)
def biclassification(t: Tables) -> DataFrame:
    return rounded(evaluation.auc_ks(_labelled(t), "quality", "score"))


@query(f"WITH d AS ({_LABELLED}), c AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM d GROUP BY 1), e AS (SELECT sum(pos) AS p, sum(neg) AS n FROM c) SELECT score AS threshold, round(sum(pos) OVER w / p, 6) AS tpr, round(sum(neg) OVER w / n, 6) AS fpr FROM c, e WINDOW w AS (ORDER BY score DESC)")
def roc_curve(t: Tables) -> DataFrame:
    return rounded(evaluation.roc_curve(_labelled(t), "quality", "score"))


@query(f"WITH d AS ({_LABELLED}), s AS (SELECT min(score) AS a, max(score) AS b FROM d), b AS (SELECT CAST(least(4, floor((score - a) / (b - a) * 5)) AS INT) AS bin, y FROM d, s) SELECT bin, count(*) AS total, CAST(sum(y) AS DOUBLE) AS positive FROM b GROUP BY 1")
def bin_table(t: Tables) -> DataFrame:
    rows = evaluation.bin_table(_labelled(t), "quality", "score", 5, frequent=False)
    return t.spark.createDataFrame([(4 - i, r["total"], float(r["positive"])) for i, r in enumerate(rows) if r["total"]], "bin int, total long, positive double")


@query(f"WITH d AS ({_LABELLED}), c AS (SELECT score, sum(y) AS pos, sum(1 - y) AS neg FROM d GROUP BY 1), e AS (SELECT sum(pos) AS p, sum(neg) AS n FROM c), r AS (SELECT score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, p, n FROM c, e WINDOW w AS (ORDER BY score DESC)), k AS (SELECT CAST(unnest([0.05, 0.2]) AS DOUBLE) AS rate) SELECT rate, min(score) AS threshold, round(arg_min(tp / (tp + fp), score), 6) AS precision, round(arg_min(tp / p, score), 6) AS recall FROM r, k WHERE fp / n <= rate GROUP BY rate")
def head_table(t: Tables) -> DataFrame:
    return rounded(evaluation.head_table(_labelled(t), "quality", "score", (0.05, 0.2)), "rate", "threshold")


@query("WITH d AS (SELECT l_extendedprice / 1000 AS y, l_quantity * 1.5 AS f FROM lineitem), s AS (SELECT sum((y - f) ** 2) AS rss, var_pop(y) * count(*) AS tss, avg(abs(y - f)) AS mae, avg(abs((y - f) / nullif(y, 0))) AS mape, avg(y) AS ym, avg(f) AS fm, avg(y - f) AS em, var_pop(y - f) AS ev, count(*) AS n FROM d) SELECT round(rss, 3) AS rss, round(tss, 3) AS tss, round(1 - rss / tss, 6) AS r2, round(rss / n, 6) AS mse, round(sqrt(rss / n), 6) AS rmse, round(mae, 6) AS mae, round(mape, 6) AS mape, round(ym, 6) AS y_mean, round(fm, 6) AS prediction_mean, round(em, 6) AS residual_mean, round(ev, 6) AS residual_var FROM s")
def regression_evaluation(t: Tables) -> DataFrame:
    out = evaluation.regression(t.lineitem.select((F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_quantity") * 1.5).alias("f")), "y", "f")
    return rounded(out.withColumns({"rss": F.round("rss", 3), "tss": F.round("tss", 3)}))


@query("WITH d AS (SELECT value AS x FROM events), s AS (SELECT min(x) AS a, max(x) AS b FROM d) SELECT CAST(least(7, floor((x - a) / (b - a) * 8)) AS INT) AS bin, count(*) AS n FROM d, s GROUP BY 1")
def histogram(t: Tables) -> DataFrame:
    return evaluation.histogram(t.events, F.col("value"), 8).select("bin", "n")


@query("WITH d AS (SELECT l_discount * 10 AS f, l_tax * 12 AS y FROM lineitem), s AS (SELECT min(f) AS a, max(f) AS b FROM d) SELECT CAST(least(3, floor((f - a) / (b - a) * 4)) AS INT) AS bucket, count(*) AS n, round(avg(f), 6) AS avg_prediction, round(avg(y), 6) AS avg_label, round(avg(f) - avg(y), 6) + 0.0 AS bias, false AS isna FROM d, s GROUP BY 1")
def prediction_bias(t: Tables) -> DataFrame:
    return rounded(evaluation.prediction_bias(t.lineitem.select((F.col("l_discount") * 10).alias("f"), (F.col("l_tax") * 12).alias("y")), "y", "f", 4))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_orderkey), 2) AS upto FROM orders")
def running_total(t: Tables) -> DataFrame:
    return running(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_orderkey")], {"upto": F.col("o_totalprice")}).select("o_orderkey", F.round("upto", 2).alias("upto"))


# models


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def linear_regression(t: Tables) -> DataFrame:
    m = linear.least_squares(t.lineitem, ["l_quantity"], "l_extendedprice")
    return t.spark.createDataFrame([(round(m.weights[0], 4), round(m.intercept, 4))], "slope double, intercept double")


def _points(t: Tables, width: int = 8) -> DataFrame:
    """The first ``width`` values of each embedding as columns."""
    return t.embeddings.select("vec_id", (F.col("label") % 2).alias("y"), "label", *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(width)))


_X = [f"x{i}" for i in range(8)]
#: All values of an embedding.
_WHOLE = [f"x{i}" for i in range(64)]


@query()
def logistic_regression(t: Tables) -> DataFrame:
    rows = _points(t)
    m = linear.logistic(rows, _X, "y", l2=1e-3)
    return rows.select("vec_id", "y", F.round(m.predict(), 6).alias("prediction"))


@query()
def gradient_descent(t: Tables) -> DataFrame:
    rows = _points(t)
    m = linear.descent(rows, _X, "y", epochs=5, learning_rate=0.5, batches=2)
    return rows.select("vec_id", "y", m.predict().alias("prediction"))


@query()
def generalised_linear(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_linenumber").cast("double").alias("n"), (F.col("l_extendedprice") / 1000 + 0.1).alias("y"))
    m = linear.glm(rows, ["l_quantity", "n"], "y", "gamma", "log", max_iter=8)
    return rows.select("l_orderkey", "l_linenumber", F.round(m.predict(), 6).alias("prediction"))


@query()
def p_values(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_quantity", "l_discount", "l_extendedprice")
    m = linear.least_squares(rows, ["l_quantity", "l_discount"], "l_extendedprice")
    names = ["l_quantity", "l_discount", "intercept"]
    return t.spark.createDataFrame(list(zip(names, linear.t_test(rows, names[:2], "l_extendedprice", m))), "feature string, p_value double")


@query()
def boosted_trees(t: Tables) -> DataFrame:
    rows = _points(t)
    m = boost.train(rows, _X, "y", rounds=3, max_depth=3)
    return rows.select("vec_id", "y", F.round(m.predict(), 6).alias("prediction"))


@query()
def clusters(t: Tables) -> DataFrame:
    rows = _points(t)
    return rows.select("vec_id", neighbours.nearest_centre(_X, neighbours.kmeans(rows, _X, 4, 10)).alias("cluster"))


@query(
    "WITH p AS (SELECT vec_id, label, [" + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(64)) + "] AS x FROM embeddings), d AS (SELECT q.vec_id, p.label, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.x, p.x), p.label) AS r FROM p q JOIN p ON p.vec_id % 5 <> 0 WHERE q.vec_id % 5 = 0), "
    "v AS (SELECT vec_id, label, count(*) AS n FROM d WHERE r <= 7 GROUP BY ALL) SELECT vec_id, arg_min(label, (-n) * 1000 + label) AS prediction FROM v GROUP BY vec_id"
)
def nearest_neighbours(t: Tables) -> DataFrame:
    rows = _points(t, len(_WHOLE))
    return neighbours.knn(rows.filter("vec_id % 5 = 0"), rows.filter("vec_id % 5 <> 0"), _WHOLE, "label", "vec_id", 7)


@query()
def naive_bayes(t: Tables) -> DataFrame:
    rows = _points(t)
    return rows.select("vec_id", "label", neighbours.NaiveBayes.fit(rows, _X, "label").predict().alias("prediction"))


@query()
def gaussian_process(t: Tables) -> DataFrame:
    rows = _points(t, len(_WHOLE))
    m = neighbours.GaussianProcess.fit(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(neighbours.PROCESS_ROWS), _WHOLE, "y")
    return m.predict(rows.select("vec_id", *_WHOLE), _WHOLE).select("vec_id", "prediction")


@query("SELECT event_id, round(1 / (1 + exp(-(value - 50) / 10)), 6) AS real, round(least(1, greatest(0, 0.5 + (value - 50) / 40)), 6) AS t1, round(0.5 * ((value - 50) / 10 / sqrt(1 + ((value - 50) / 10) ** 2)) + 0.5, 6) AS sr FROM events")
def sigmoid_kinds(t: Tables) -> DataFrame:
    x = (F.col("value") - 50) / 10
    return t.events.select("event_id", *(r6(linear.sigmoid(x, k), k) for k in ("real", "t1", "sr")))


# sources and streams


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def orc_round_trip(t: Tables) -> DataFrame:
    from .plans.cut import cut

    folder = cut(t.spark.range(1), "folder").inputFiles()[0].rpartition("/")[0]
    rows = tag(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), "a", {"o_orderkey": "id"})
    return tables.load(t.spark, tables.dump(rows, f"{folder}/orc"))


@query("SELECT n_nationkey, n_name, r_regionkey, r_name FROM nation JOIN region ON n_nationkey = r_regionkey")
def vertical_read(t: Tables) -> DataFrame:
    a = t.nation.select(F.col("n_nationkey").alias("k"), "n_nationkey", "n_name")
    b = t.region.select(F.col("r_regionkey").alias("k"), "r_regionkey", "r_name")
    return tables.read_vertical(t.spark, {"a": a, "b": b}, ["k"], drop_keys=True)


@query("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def event_windows(t: Tables) -> DataFrame:
    return rounded(streams.tumbling(t.events, "ts", "1 hour", ["event_type"], n=F.count(F.lit(1)), total=F.sum("value")).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total"))


@query("SELECT event_id, user_id, value FROM events WHERE value > 50")
def stream_filter(t: Tables) -> DataFrame:
    source = streams.read(t.spark, f"{t.dir}/events.parquet*", t.events.schema)
    return streams.drain(streams.condition(source, "value", ">", "50").select("event_id", "user_id", "value"), f"hits_{uuid.uuid4().hex[:8]}")


@query("WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 1 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM l) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(t: Tables) -> DataFrame:
    return streams.sessions(t.events, "ts", "1 hour", ["user_id"]).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("SELECT event_id, CASE WHEN value = 0 THEN NULL ELSE round(100 / value, 6) END AS ratio FROM events")
def float_division(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.when(F.col("value") != 0, F.round(S.divide(F.lit(100), F.col("value")), 6)).alias("ratio"))

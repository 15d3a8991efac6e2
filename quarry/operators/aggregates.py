"""Aggregates of whole columns. NaN and null are skipped; spreads have one degree of freedom less."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.quantiles import modes, quantiles
from ..schema import known, numeric_columns, require


def skew(c: Column) -> Column:
    """Bias-corrected; null for under three values."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def kurtosis(c: Column) -> Column:
    """Bias-corrected excess; null for under four values."""
    n = F.count(c).cast("double")
    safe = F.when(n > 3, n)
    return (safe - 1) / ((safe - 2) * (safe - 3)) * ((safe + 1) * F.kurtosis(c) + 6)


AGGREGATES = {
    "count": F.count, "nunique": F.count_distinct, "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)), "min": F.min, "max": F.max, "mean": F.avg, "var": F.var_samp, "std": F.stddev_samp,
    "sem": lambda c: F.stddev_samp(c) / F.sqrt(F.count(c)), "skew": skew, "kurtosis": kurtosis,
}
NUMERIC_ONLY = {"sum", "mean", "var", "std", "sem", "skew", "kurtosis", "median"}


def column_stats(df: DataFrame, functions: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row per column: its name and the functions' values as doubles (text for mode, min, max of text columns is null)."""
    names = numeric_columns(df) if columns is None else columns
    require(df, *names)
    own = {c: known(df, c) for c in names}
    found = {"median": {c: v[0] for c, v in quantiles(df, own, [0.5]).items()} if "median" in functions else {}, "mode": modes(df, own) if "mode" in functions else {}}
    wide = df.agg(F.count(F.lit(1)).alias("\x01rows"), *(AGGREGATES[f](known(df, c)).cast("double").alias(f"{c}\x01{f}") for c in names for f in functions if f in AGGREGATES))
    wide = wide.withColumns({f"{c}\x01{f}": F.lit(v).cast("double") for f, values in found.items() for c, v in values.items()})
    rows = [F.struct(F.lit(c).alias("column"), *(F.col(f"`{c}\x01{f}`").alias(f) for f in functions)) for c in names]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def quantile(df: DataFrame, q: list[float], columns: list[str] | None = None) -> DataFrame:
    """(column, q, value): exact, interpolated linearly, for any number of distinct values."""
    names = columns or numeric_columns(df)
    require(df, *names)
    found = quantiles(df, {c: known(df, c) for c in names}, q)
    return df.sparkSession.createDataFrame([(c, float(x), v) for c in names for x, v in zip(q, found[c])], "column string, q double, value double")


def quantile_by_counts(df: DataFrame, column: str, q: list[float]) -> dict[float, float | None]:
    """As ``quantile`` for one column, by counts of its values over ranges whatever their number."""
    return dict(zip(q, quantiles(df, {column: known(df, column)}, q, held=-1)[column]))


def value_counts(df: DataFrame, column: str, normalize: bool = False) -> DataFrame:
    """(value, count), most frequent first, smaller values first on ties; null and NaN are left out."""
    rows = df.select(known(df, column).alias("value")).filter("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    if normalize:
        total = rows.agg(F.sum("count").alias("total"))
        rows = rows.crossJoin(F.broadcast(total)).select("value", (F.col("count") / F.col("total")).alias("count"))  # one row
    return rows.orderBy(F.desc("count"), "value")


def combine(parts: list[DataFrame], column: str, weights: list[float] | None = None) -> DataFrame:
    """Secure aggregation in the clear: sum and weighted average of one column over parties, by the column key."""
    weights = weights or [1.0] * len(parts)
    rows = reduce(lambda a, b: a.unionAll(b), (p.select("key", F.col(column).cast("double").alias("x"), F.lit(float(w)).alias("w")) for p, w in zip(parts, weights)))
    return rows.groupBy("key").agg(F.sum("x").alias("sum"), (F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("average"))


def noisy_combine(parts: list[DataFrame], column: str, scale: float, seed: int = 0) -> DataFrame:
    """As ``combine``, with Gaussian noise of deviation ``scale`` on every value before it leaves its party."""
    return combine([p.withColumn(column, F.col(column) + scale * F.randn(seed + i)) for i, p in enumerate(parts)], column)


def united(parts: list[DataFrame], column: str) -> DataFrame:
    """mean, population variance and exact median of one column over several tables."""
    rows = reduce(lambda a, b: a.unionAll(b), (p.select(known(p, column).cast("double").alias("x")) for p in parts))
    return rows.agg(F.avg("x").alias("mean"), F.var_pop("x").alias("var")).withColumn("median", F.lit(quantiles(rows, {"x": F.col("x")}, [0.5])["x"][0]).cast("double"))


def compare(parts: list[DataFrame], column: str) -> DataFrame:
    """min and max of one column over parties."""
    rows = reduce(lambda a, b: a.unionAll(b), (p.select(known(p, column).alias("x")) for p in parts))
    return rows.agg(F.min("x").alias("min"), F.max("x").alias("max"))


def block_aggregate(df: DataFrame, block_func, schema: str, fold: list[Column]) -> DataFrame:
    """A function of pandas blocks, whose small results are folded by aggregates."""
    return df.mapInPandas(block_func, schema).agg(*fold)

"""Statistics of tables: 26 figures a column, correlations, variance inflation, population stability."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import kurtosis, skew
from ..plans.quantiles import quantiles
from ..rules import binning
from ..schema import known, numeric_columns, require


def _figures(c: Column, quartiles: list[float | None]) -> dict[str, Column]:
    """NaN is null already. The na ratio needs the rows."""
    n, mean = F.count(c).cast("double"), F.avg(c)
    moment = lambda k: F.avg(F.pow(c, F.lit(float(k))))
    m2, m3, m4 = moment(2), moment(3), moment(4)
    central = {2: m2 - mean * mean, 3: m3 - 3 * mean * m2 + 2 * F.pow(mean, F.lit(3.0)), 4: m4 - 4 * mean * m3 + 6 * mean * mean * m2 - 3 * F.pow(mean, F.lit(4.0))}
    out = {"total_count": F.count(F.lit(1)).cast("double"), "count": n, "count_na": (F.count(F.lit(1)) - F.count(c)).cast("double"), "na_ratio": (F.count(F.lit(1)) - F.count(c)) / F.count(F.lit(1))}
    out |= {"min": F.min(c), "max": F.max(c), "mean": mean, "var": F.var_samp(c), "std": F.stddev_samp(c), "sem": F.stddev_samp(c) / F.sqrt(n), "skewness": skew(c), "kurtosis": kurtosis(c)}
    out |= {name: F.lit(q) for name, q in zip(("q1", "q2", "q3"), quartiles)}
    out |= {"moment_2": m2, "moment_3": m3, "moment_4": m4} | {f"central_moment_{k}": v for k, v in central.items()}
    return out | {"sum": F.sum(c), "sum_2": F.sum(F.pow(c, F.lit(2.0))), "sum_3": F.sum(F.pow(c, F.lit(3.0))), "sum_4": F.sum(F.pow(c, F.lit(4.0))), "nunique": F.count_distinct(c).cast("double")}


def table_statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: type and the figures as doubles; of text columns the counts only. Quartiles are exact and take a pass of their own."""
    columns = columns or df.columns
    require(df, *columns)
    kinds, numeric = dict(df.dtypes), set(numeric_columns(df))
    aggregates, rows = [], []
    names = list(_figures(F.lit(0.0), [0.0] * 3))
    quartiles = quantiles(df, {c: known(df, c).cast("double") for c in columns if c in numeric}, [0.25, 0.5, 0.75])
    for c in columns:
        x = known(df, c)
        if c in numeric:
            some = _figures(x.cast("double"), quartiles[c])
        else:
            some = {"total_count": F.count(F.lit(1)).cast("double"), "count": F.count(x).cast("double"), "count_na": (F.count(F.lit(1)) - F.count(x)).cast("double"), "na_ratio": (F.count(F.lit(1)) - F.count(x)) / F.count(F.lit(1)), "nunique": F.count_distinct(x).cast("double")}
        aggregates += [e.alias(f"{c}\x01{k}") for k, e in some.items()]
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), *((F.col(f"`{c}\x01{k}`") if k in some else F.lit(None)).cast("double").alias(k) for k in names)))
    return df.agg(*aggregates).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def categorical_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    rows = table_statistics(df, columns)
    return rows.select("column", "type", "count", "nunique")


def gramian(df: DataFrame, columns: list[str], standardise: bool = True) -> tuple[np.ndarray, int]:
    """X'X of the complete rows, standardised with ddof 0, and their number. One pass of k (k + 1) / 2 sums; a constant column is 0."""
    rows = df.select(*(known(df, c).cast("double").alias(c) for c in columns)).dropna()
    first = rows.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in columns), *(F.stddev_pop(c).alias(f"{c}\x01s") for c in columns)).first()
    scale = {c: (first[c], first[f"{c}\x01s"] or 0.0) for c in columns}
    z = {c: (F.col(c) - scale[c][0]) / scale[c][1] if scale[c][1] else F.lit(0.0) for c in columns} if standardise else {c: F.col(c) for c in columns}
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = rows.agg(*(F.sum(z[columns[i]] * z[columns[j]]).alias(f"{i}_{j}") for i, j in pairs)).first()
    out = np.zeros((len(columns),) * 2)
    for i, j in pairs:
        out[i, j] = out[j, i] = sums[f"{i}_{j}"] or 0.0
    return out, first["n"]


def pearson(df: DataFrame, columns: list[str]) -> np.ndarray:
    """X'X / (n - 1) of columns standardised with ddof 0, whose diagonal is n / (n - 1)."""
    xx, n = gramian(df, columns)
    return xx / (n - 1)


def pearson_table(df: DataFrame, columns: list[str]) -> DataFrame:
    found = pearson(df, columns)
    return df.sparkSession.createDataFrame([(a, b, float(found[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)], "a string, b string, r double")


def vif(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Variance inflation: the diagonal of (X'X)^-1 times n - 1; huge for columns that depend on others."""
    xx, n = gramian(df, columns)
    inverse = np.linalg.pinv(xx) if np.linalg.matrix_rank(xx) == len(columns) else np.linalg.inv(xx + 1e-12 * n * np.eye(len(columns)))
    return dict(zip(columns, (np.diag(inverse) * (n - 1)).tolist()))


def population_stability(base: DataFrame, test: DataFrame, columns: list[str], rule: binning.Bins, least: float = 1e-3) -> DataFrame:
    """(feature, psi): sum over the rule's bins and the null bin of (test - base) ln(test / base), shares of at least ``least``."""
    p = rule.params
    splits, texts = {c: p["splits"][c] for c in columns}, set(p["texts"])
    a, b = binning.counts(base, splits, texts), binning.counts(test, splits, texts)
    rows = []
    for c in columns:
        x, y = (sum(n for n, _ in held[c].values()) for held in (a, b))
        total = 0.0
        for k in sorted(a[c].keys() | b[c].keys()):
            s, t = a[c].get(k, (0, 0))[0] / x, b[c].get(k, (0, 0))[0] / y
            total += (t - s) * math.log(max(t, least) / max(s, least))
        rows.append((c, total))
    return base.sparkSession.createDataFrame(rows, "feature string, psi double")


def psi_index(base: DataFrame, test: DataFrame, column: str, edges: list[float]) -> float:
    """Stability over [a, b) bins, the last one closed; without a least share an empty bin gives infinity."""

    def shares(df: DataFrame) -> list[float]:
        c, out = F.col(column), F.lit(None).cast("int")
        for i, (low, high) in enumerate(zip(edges, edges[1:])):
            top = c <= high if i == len(edges) - 2 else c < high
            out = F.when((c >= low) & top, F.lit(i)).otherwise(out)
        found = {r["b"]: r["count"] for r in df.groupBy(out.alias("b")).count().collect() if r["b"] is not None}
        n = sum(found.values())
        return [found.get(i, 0) / n for i in range(len(edges) - 1)]

    return sum((t - s) * (math.log(t / s) if s and t else math.inf) if s != t else 0.0 for s, t in zip(shares(base), shares(test)))

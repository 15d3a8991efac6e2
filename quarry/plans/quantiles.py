"""Exact quantiles and modes of columns with any number of distinct values."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cut import cut
from .ordered import running

#: Distinct values (as estimated) up to which one task holds them all (some 50 MB), as Spark's own percentile does.
HELD = 1_000_000


def _melted(df: DataFrame, columns: list[Column]) -> DataFrame:
    """(i, v): the values of all columns that are not null, with the number of the column."""
    pairs = F.array(*(F.struct(F.lit(i).alias("i"), c.cast("double").alias("v")) for i, c in enumerate(columns)))
    return df.select(F.explode(pairs).alias("x")).select("x.i", "x.v").filter("v IS NOT NULL")


def quantiles(df: DataFrame, columns: dict[str, Column], q: list[float], held: int = HELD) -> dict[str, list[float | None]]:
    """The quantiles ``q`` of each column, interpolated linearly; None for a column without values.

    A first pass estimates the distinct values. Columns of few are counted in one aggregate; those of
    many are counted by value, summed up by ranges of the values, and only the two values around each
    quantile reach the driver. Both ways give the same figures.
    """
    if not columns:
        return {}
    names = list(columns)
    sizes = df.agg(*(F.approx_count_distinct(columns[c]).alias(f"_{i}") for i, c in enumerate(names))).first()
    few = [c for i, c in enumerate(names) if sizes[i] <= held]
    many = [c for c in names if c not in few]
    out: dict[str, list[float | None]] = {}
    if few:
        at = F.array(*(F.lit(float(x)) for x in q))
        row = df.agg(*(F.percentile(columns[c], at).alias(f"_{i}") for i, c in enumerate(few))).first()
        out |= {c: list(row[i]) if row[i] else [None] * len(q) for i, c in enumerate(few)}
    if many:
        counts = _melted(df, [columns[c] for c in many]).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
        upto = cut(running(counts, [F.col("i"), F.col("v")], {"upto": F.col("n")}), "quantiles")
        ends = {r["i"]: (r["low"], r["high"]) for r in upto.groupBy("i").agg(F.min(F.col("upto") - F.col("n")).alias("low"), F.max("upto").alias("high")).collect()}
        spots = {(i, f(x * (high - low - 1)) + low) for i, (low, high) in ends.items() for x in q for f in (math.floor, math.ceil)}
        if not spots:
            return out | {c: [None] * len(q) for c in many}
        wanted = F.broadcast(df.sparkSession.createDataFrame(sorted(spots), "j int, p long"))  # two rows for each column and quantile
        hits = upto.join(wanted, (F.col("i") == F.col("j")) & (F.col("p") < F.col("upto")) & (F.col("p") >= F.col("upto") - F.col("n"))).select("i", "p", "v").collect()
        value = {(r["i"], r["p"]): r["v"] for r in hits}
        for i, c in enumerate(many):
            if i not in ends:
                out[c] = [None] * len(q)
                continue
            low, high = ends[i]
            out[c] = []
            for x in q:
                p = x * (high - low - 1)
                a, b = value[i, math.floor(p) + low], value[i, math.ceil(p) + low]
                out[c].append(a + (b - a) * (p - math.floor(p)))
    return {c: out[c] for c in names}


def modes(df: DataFrame, columns: dict[str, Column]) -> dict[str, float | None]:
    """The most frequent value of each column, the least on ties."""
    if not columns:
        return {}
    counts = _melted(df, list(columns.values())).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    rows = {r["i"]: r["v"] for r in counts.groupBy("i").agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("v")).collect()}
    return {c: rows.get(i) for i, c in enumerate(columns)}

"""Grouped aggregates. Groups come sorted by key; a variance of one row is 0; counts are of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import known, require

FUNCTIONS = {
    "count": lambda c: F.count(F.lit(1)), "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max,
    "var": lambda c: F.coalesce(F.var_samp(c), F.when(F.count(c) > 0, F.lit(0.0))),
}
MAX_GROUPS = 10_000


def group_statistics(df: DataFrame, by: list[str], queries: list[tuple[str, str]], max_groups: int = MAX_GROUPS, check: bool = True) -> DataFrame:
    """``queries`` are (column, function); the result has the keys and a column ``{column}_{function}`` each.

    One to four keys, none of them a value. With ``check``, over ``max_groups`` possible groups (the
    product of the keys' distinct values) are an error, found by one small job first.
    """
    require(df, *by, *(c for c, _ in queries))
    if not 1 <= len(by) <= 4 or set(by) & {c for c, _ in queries}:
        raise ValueError("one to four keys, none of them a value")
    if check:
        limit = 1
        for n in df.agg(*(F.approx_count_distinct(c, 0.01) for c in by)).first():
            limit *= n
        if limit > max_groups * 1.05 and limit > max_groups:
            raise ValueError(f"about {limit} groups, over {max_groups}")
    return df.groupBy(*by).agg(*(aggregate(df, c, f) for c, f in queries)).orderBy(*by)


def aggregate(df: DataFrame, column: str, function: str) -> Column:
    return FUNCTIONS[function.lower()](known(df, column)).alias(f"{column}_{function.lower()}")


def ordinal_group(df: DataFrame, by: list[str], values: list[str], functions: list[str], max_groups: int = MAX_GROUPS) -> DataFrame:
    """Several functions of several columns; keys of any type, nulls of text keys as "0"."""
    filled = df.withColumns({c: F.coalesce(F.col(c), F.lit("0")) for c in by if dict(df.dtypes)[c] == "string"})
    return group_statistics(filled, by, [(v, f) for v in values for f in functions], max_groups)

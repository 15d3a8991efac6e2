"""Filters with two outputs: the rows that hit, and all others. A null predicate is no hit.

The hitting side is a plain predicate, so that scans get it; only the other side needs null made false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import is_float, require

EPSILON = 1e-6


def predicate(df: DataFrame, column: str, comparator: str, bound: str | None = None, epsilon: float = EPSILON) -> Column:
    """True for a hit; else false or null. ``comparator``: ==, <, <=, >, >=, IN or NOTNULL; ``bound`` is text, comma-separated for IN. Floats are equal within ``epsilon``."""
    require(df, column)
    c, kind = F.col(column), dict(df.dtypes)[column]
    if comparator == "NOTNULL":
        return c.isNotNull() & ~F.isnan(c) if is_float(df, column) else c.isNotNull()
    values = [v.strip() for v in str(bound).split(",")] if comparator == "IN" else [str(bound).strip()]
    try:
        literals = [F.lit(v).cast(kind) if kind == "string" else F.lit(float(v) if is_float(df, column) else int(v)) if kind != "boolean" else F.lit(v.lower() == "true") for v in values]
    except ValueError as e:
        raise ValueError(f"bound {bound!r} is no {kind}") from e
    if comparator in ("==", "IN"):
        if not is_float(df, column):
            return c.isin(literals)
        near = [(c >= v - 2 * epsilon) & (c <= v + 2 * epsilon) & (F.abs(c - v) <= epsilon) for v in literals]  # the bounds are for the scan
        return reduce(lambda a, b: a | b, near)
    v = literals[0]
    plain = {"<": c < v, "<=": c <= v, ">": c > v, ">=": c >= v}
    if comparator not in plain:
        raise ValueError(f"unknown comparator {comparator}")
    return plain[comparator] & ~F.isnan(c) if is_float(df, column) else plain[comparator]


def split(df: DataFrame, hit: Column, check: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows that hit and the others; with ``check`` an empty side is an error."""
    sides = df.filter(hit), df.filter(~F.coalesce(hit, F.lit(False)))
    if check and any(s.isEmpty() for s in sides):
        raise ValueError("one side of the filter is empty")
    return sides


def condition_filter(df: DataFrame, column: str, comparator: str, bound: str | None = None, epsilon: float = EPSILON, check: bool = False) -> tuple[DataFrame, DataFrame]:
    return split(df, predicate(df, column, comparator, bound, epsilon), check)


def expr_filter(df: DataFrame, expression: str, check: bool = False) -> tuple[DataFrame, DataFrame]:
    """A free SQL predicate over the table's columns."""
    return split(df, F.expr(expression), check)


def feature_filter(df: DataFrame, drop: list[str]) -> DataFrame:
    require(df, *drop)
    return df.drop(*drop)

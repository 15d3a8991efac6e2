"""Binning rules: quantile, equal range and ChiMerge bins, bin numbers or weights of evidence.

Bins are (a, b]. Statistics come from one aggregate over bins and features; merging works on at most
``bins`` rows a feature at the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.quantiles import quantiles
from ..schema import known, require
from .base import Rule

MOST_CATEGORIES = 10_000


def quantile_splits(df: DataFrame, columns: list[str], bins: int) -> dict[str, list[float]]:
    """Inner cut points at the quantiles i / bins, interpolated linearly, doubles dropped."""
    found = quantiles(df, {c: known(df, c) for c in columns}, [i / bins for i in range(bins + 1)])
    return {c: sorted({x for x in found[c] if x is not None})[1:-1] for c in columns}


def range_splits(df: DataFrame, columns: list[str], bins: int) -> dict[str, list[float]]:
    """Inner cut points of equal widths between minimum and maximum."""
    row = df.agg(*(f(known(df, c).cast("double")).alias(f"{c}\x01{k}") for c in columns for k, f in (("a", F.min), ("b", F.max)))).first()
    out = {}
    for c in columns:
        a, b = row[f"{c}\x01a"], row[f"{c}\x01b"]
        out[c] = [] if a is None or a == b else [a + (b - a) * i / bins for i in range(1, bins)]
    return out


def bin_number(df: DataFrame, c: str, splits: list, text: bool = False) -> Column:
    """The bin of each value, -1 for null, NaN and unseen text."""
    x = known(df, c)
    if text:
        out = F.lit(-1)
        for i, v in reversed(list(enumerate(splits))):
            out = F.when(x == v, F.lit(i)).otherwise(out)
        return out
    out = F.lit(len(splits))
    for i, v in reversed(list(enumerate(splits))):
        out = F.when(x <= v, F.lit(i)).otherwise(out)
    return F.when(x.isNull(), F.lit(-1)).otherwise(out)


def text_categories(df: DataFrame, column: str) -> list[str]:
    rows = df.select(column).filter(F.col(column).isNotNull()).distinct().limit(MOST_CATEGORIES + 1).collect()
    if len(rows) > MOST_CATEGORIES:
        raise ValueError(f"{column} has over {MOST_CATEGORIES} categories")
    return sorted(r[0] for r in rows)


def counts(df: DataFrame, splits: dict[str, list], texts: set[str], label: Column | None = None) -> dict[str, dict[int, tuple[int, int]]]:
    """Rows and positive rows of every bin of every feature, in one pass: {feature: {bin: (total, positive)}}."""
    numbers = [F.struct(F.lit(c).alias("feature"), bin_number(df, c, s, c in texts).alias("bin")) for c, s in splits.items()]
    rows = df.select((label if label is not None else F.lit(0)).cast("int").alias("y"), F.explode(F.array(*numbers)).alias("b"))
    out: dict[str, dict[int, tuple[int, int]]] = {c: {} for c in splits}
    for r in rows.groupBy("b.feature", "b.bin").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p")).collect():
        out[r["feature"]][r["bin"]] = (r["n"], r["p"])
    return out


def merge_empty(splits: list[float], held: dict[int, tuple]) -> list[float]:
    """The cut points without those that close an empty bin."""
    return [s for i, s in enumerate(splits) if held.get(i, (0,))[0]] if any(held.get(i, (0,))[0] for i in range(len(splits) + 1)) else splits


class Bins(Rule):
    """Bin numbers, or the values of each bin: x <= s1 the first, and so on; all else ``other``. Without splits unchanged."""

    name = "binning"

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], bins: int = 10, method: str = "quantile") -> Bins:
        require(df, *columns)
        texts = {c for c in columns if dict(df.dtypes)[c] == "string"}
        numeric = [c for c in columns if c not in texts]
        splits: dict[str, list] = {c: text_categories(df, c) for c in texts}
        if numeric:
            splits |= (quantile_splits if method == "quantile" else range_splits)(df, numeric, bins)
        held = counts(df, {c: splits[c] for c in columns}, texts)
        for c in numeric:
            splits[c] = merge_empty(splits[c], held[c])
        values = {c: list(range(len(splits[c]) + (c not in texts))) for c in columns}
        return cls(columns=list(columns), splits=splits, texts=sorted(texts), values=values, other=dict.fromkeys(columns, -1), report={})

    def expressions(self, df):
        p = self.params
        out = {}
        for c in p["columns"]:
            if not p["splits"][c]:
                continue
            number, value = bin_number(df, c, p["splits"][c], c in p["texts"]), F.lit(p["other"][c])
            pick = F.element_at(F.array(*(F.lit(float(v)) for v in p["values"][c])), number + 1)
            out[c] = F.when(number < 0, value.cast("float")).otherwise(F.when(number >= 0, pick)).cast("float")
        return out

    def merged(self, column: str, bins: list[int]) -> Bins:
        """With consecutive bins of a numeric column made one; more than one bin must remain."""
        p, bins = {**self.params}, sorted(bins)
        if column in p["texts"] or bins != list(range(bins[0], bins[-1] + 1)):
            raise ValueError("only neighbouring bins of a number can be merged")
        splits = [s for i, s in enumerate(p["splits"][column]) if not bins[0] <= i < bins[-1]]
        if not splits:
            raise ValueError("one bin would remain")
        values = [v for i, v in enumerate(p["values"][column]) if not bins[0] < i <= bins[-1]]
        report = {**p["report"]}
        if column in report:
            report[column] = merge_woe(report[column], bins)
            values = [b["woe"] for b in report[column]["bins"]]
        else:
            values = list(range(len(values)))
        p |= {"splits": {**p["splits"], column: splits}, "values": {**p["values"], column: values}, "report": report}
        return type(self)(**p)


def merge_woe(feature: dict, bins: list[int]) -> dict:
    """A feature's report with some bins made one, from their counts."""
    parts = [feature["bins"][i] for i in bins]
    total, positive = sum(b["total"] for b in parts), sum(b["positive"] for b in parts)
    woe, iv = woe_iv(total, positive, feature["total"], feature["positives"])
    new = {"total": total, "positive": positive, "woe": woe, "iv": iv}
    out = feature["bins"][: bins[0]] + [new] + feature["bins"][bins[-1] + 1 :]
    return {**feature, "bins": out, "iv": sum(b["iv"] for b in out)}


def woe_iv(total: int, positive: int, all_total: int, all_positive: int) -> tuple[float, float]:
    """Weight of evidence ln(positive share / negative share) and information value of a bin; half a row each is added if a count is 0."""
    negative, all_negative = total - positive, all_total - all_positive
    p, n = (positive + 0.5, negative + 0.5) if not positive or not negative else (positive, negative)
    a, b = p / all_positive, n / all_negative
    woe = math.log(a / b)
    return woe, (a - b) * woe


def chi_square(a: tuple[int, int], b: tuple[int, int]) -> float:
    """Chi-square of two neighbouring bins (total, positive)."""
    rows = [(x[1], x[0] - x[1]) for x in (a, b)]
    n = sum(map(sum, rows))
    columns = [rows[0][k] + rows[1][k] for k in (0, 1)]
    out = 0.0
    for r in rows:
        for k in (0, 1):
            want = sum(r) * columns[k] / n if n else 0
            if want:
                out += (r[k] - want) ** 2 / want
    return out


def chi_limit(p: float) -> float:
    """The value that a chi-square of one degree of freedom exceeds with probability p, by bisection of the normal tail."""
    low, high = 0.0, 100.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if math.erfc(math.sqrt(mid / 2)) > p else (low, mid)
    return (low + high) / 2


def chi_merge(splits: list[float], held: list[tuple[int, int]], target: int, limit: float) -> tuple[list[float], list[tuple[int, int]]]:
    """Merge the neighbours of least chi-square, the first on ties, until ``target`` bins are left or all are above ``limit``."""
    splits, held = list(splits), list(held)
    while len(held) > target:
        chis = [chi_square(a, b) for a, b in zip(held, held[1:])]
        at = min(range(len(chis)), key=chis.__getitem__)
        if chis[at] > limit:
            break
        held[at : at + 2] = [(held[at][0] + held[at + 1][0], held[at][1] + held[at + 1][1])]
        del splits[at]
    return splits, held


class WoeBins(Bins):
    """Each value replaced by the weight of evidence of its bin."""

    name = "woe_binning"

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], label: str, positive: object = 1, bins: int = 10, method: str = "quantile", init_bins: int = 100, target_bins: int = 10, p_value: float = 0.1) -> WoeBins:
        require(df, *columns, label)
        y = F.coalesce(F.col(label) == F.lit(positive), F.lit(False))
        base = Bins.fit(df, columns, init_bins if method == "chimerge" else bins, "quantile" if method == "chimerge" else method)
        splits, texts = {c: list(base.params["splits"][c]) for c in columns}, set(base.params["texts"])
        held = counts(df, splits, texts, y)
        total = sum(n for n, _ in held[columns[0]].values())
        positives = sum(p for _, p in held[columns[0]].values())
        if not 0 < positives < total:
            raise ValueError("the label has one class only")
        values, other, report = {}, {}, {}
        for c in columns:
            rows = [held[c].get(i, (0, 0)) for i in range(len(splits[c]) + (c not in texts))]
            if method == "chimerge" and c not in texts:
                splits[c], rows = chi_merge(splits[c], rows, target_bins, chi_limit(p_value))
            found = [(n, p, *woe_iv(n, p, total, positives)) for n, p in rows]
            values[c] = [w for _, _, w, _ in found]
            other[c] = woe_iv(*held[c].get(-1, (0, 0)), total, positives)[0]
            report[c] = {"total": total, "positives": positives, "iv": sum(x[3] for x in found), "bins": [dict(zip(("total", "positive", "woe", "iv"), x)) for x in found]}
        return cls(columns=list(columns), splits=splits, texts=sorted(texts), values=values, other=other, report=report)


def rates(total: int, positive: int, n: int) -> tuple[float, float]:
    """Positive rate and share of all rows; not told (NaN) for bins of under 5 rows or one class."""
    if total < 5 or positive in (0, total):
        return math.nan, math.nan
    return positive / total, total / n


def sketch_splits(df: DataFrame, columns: list[str], bins: int, error: float = 1e-3) -> dict[str, list[float]]:
    """Cut points from an error-bounded quantile sketch, whose parts are merged over partitions."""
    found = df.approxQuantile(columns, [i / bins for i in range(1, bins)], error)
    return {c: sorted(set(v)) for c, v in zip(columns, found)}



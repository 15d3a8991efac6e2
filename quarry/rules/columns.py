"""Rules on single columns: arithmetic, conditions, casts, calculations, filling, encoding, scaling."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..plans.quantiles import quantiles
from ..schema import is_float, known, numeric_columns, require
from .base import Rule


class BinaryOp(Rule):
    """``new`` = ``a`` op ``b`` for + - * /; division follows ``scalar.divide``."""

    name = "binary_op"

    def inputs(self):
        return [self.params["a"], self.params["b"]]

    def expressions(self, df):
        a, b = F.col(self.params["a"]), F.col(self.params["b"])
        return {self.params["new"]: {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: S.divide(a, b)}[self.params["op"]]()}


class CaseWhen(Rule):
    """``cases``: list of {"when": [[column, comparator, value or {"column": name}, joint], ...], "then": value}, and ``otherwise``.

    Comparators EQ NE LT LE GT GE. ``joint`` (AND, OR) binds a condition to the next; AND binds
    tighter. Floats are EQ within ``epsilon``, NE is exact, null counts as no hit.
    """

    name = "case_when"

    def inputs(self):
        values = [c[2] for case in self.params["cases"] for c in case["when"]] + [case["then"] for case in self.params["cases"]] + [self.params["otherwise"]]
        return list(dict.fromkeys([c[0] for case in self.params["cases"] for c in case["when"]] + [v["column"] for v in values if isinstance(v, dict)]))

    def _one(self, df: DataFrame, column: str, op: str, value) -> Column:
        a, b = F.col(column), F.col(value["column"]) if isinstance(value, dict) else F.lit(value)
        if op == "EQ" and is_float(df, column):
            hit = F.abs(a - b) <= self.params.get("epsilon", 1e-6)
        else:
            hit = S.compare({"EQ": "=", "NE": "<>", "LT": "<", "LE": "<=", "GT": ">", "GE": ">="}[op], a, b) if is_float(df, column) else {"EQ": a == b, "NE": a != b, "LT": a < b, "LE": a <= b, "GT": a > b, "GE": a >= b}[op]
        return F.coalesce(hit, F.lit(False))

    def expressions(self, df):
        value = lambda v: F.col(v["column"]) if isinstance(v, dict) else F.lit(v)
        out = None
        for case in self.params["cases"]:
            groups: list[list[Column]] = [[]]
            for column, op, bound, *joint in case["when"]:
                groups[-1].append(self._one(df, column, op, bound))
                if joint and joint[0] == "OR":
                    groups.append([])
            hit = reduce(lambda a, b: a | b, (reduce(lambda a, b: a & b, g) for g in groups if g))
            out = F.when(hit, value(case["then"])) if out is None else out.when(hit, value(case["then"]))
        return {self.params["new"]: out.otherwise(value(self.params["otherwise"]))}


class Cast(Rule):
    """``columns`` to integer, float or string. Text loses blanks and quotes around it first; lossy casts raise."""

    name = "cast"

    def expressions(self, df):
        target = {"integer": "bigint", "float": "double", "string": "string"}[self.params["to"]]
        kinds = dict(df.dtypes)

        def one(c: str) -> Column:
            x = F.col(c)
            if kinds[c] == "string":
                x = F.btrim(x, F.lit(" \t\"'"))
            return S.safe_cast(x, target, kinds[c])

        return {c: one(c) for c in self.params["columns"]}


class FeatureCalculate(Rule):
    """An operation on ``columns`` in place; ``fit`` adds the figures that standardising and normalising need."""

    name = "feature_calculate"

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], op: str, operands: list | None = None) -> FeatureCalculate:
        require(df, *columns)
        figures = {}
        if op in ("STANDARDIZE", "NORMALIZATION"):
            row = df.agg(*(f(known(df, c).cast("double")).alias(f"{c}\x01{k}") for c in columns for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max)))).first()
            figures = {c: {k: row[f"{c}\x01{k}"] for k in ("mean", "std", "min", "max")} for c in columns}
        return cls(columns=list(columns), op=op, operands=operands or [], figures=figures)

    def _one(self, c: str) -> Column:
        op, args, x = self.params["op"], self.params["operands"], F.col(c)
        f = self.params["figures"].get(c, {})
        if op == "STANDARDIZE":
            return F.when(x.isNotNull(), F.lit(0.0)) if not f["std"] else (x - f["mean"]) / f["std"]
        if op == "NORMALIZATION":
            return F.when(x.isNotNull(), F.lit(0.0)) if f["min"] == f["max"] else (x - f["min"]) / (f["max"] - f["min"])
        if op == "RANGE_LIMIT":
            low, high = args
            return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)
        if op == "UNARY":
            order, sign, value = args
            if order == "+" and sign == "/" and value == 0:
                raise ZeroDivisionError(c)
            a, b = (x, F.lit(value)) if order == "+" else (F.lit(value), x)
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: S.divide(a, b)}[sign]()
        simple = {
            "RECIPROCAL": lambda: S.divide(F.lit(1.0), x), "ROUND": lambda: F.bround(x), "SQRT": lambda: F.sqrt(x), "EXP": lambda: F.exp(x),
            "LOG_ROUND": lambda: F.bround(S.log2(x + float(args[0] if args else 10))), "LENGTH": lambda: F.length(x),
            "LOG": lambda: S.log(x + float(args[1]), None if args[0] == "e" else F.lit(float(args[0]))),
            "SUBSTR": lambda: F.substring(x, int(args[0]) + 1, int(args[1])),
        }
        return simple[op]()

    def expressions(self, df):
        return {c: self._one(c) for c in self.params["columns"]}


class FillNA(Rule):
    """Fill by type: constant, mean, median or most_frequent. Outlier values count as null when fitting and applying."""

    name = "fillna"

    @staticmethod
    def _clean(df: DataFrame, c: str, outliers: list, nan_is_null: bool) -> Column:
        x = known(df, c) if nan_is_null else F.col(c)
        for v in outliers:
            x = F.when((F.abs(x - v) > 1e-7) if is_float(df, c) else (x != v), x)
        return x

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], strategies: dict[str, str] | None = None, constants: dict[str, object] | None = None, outliers: dict[str, list] | None = None, nan_is_null: bool = True) -> FillNA:
        """``strategies``, ``constants`` and ``outliers`` go by class: int, float, str, bool."""
        require(df, *columns)
        strategies, constants, outliers = strategies or {}, constants or {}, outliers or {}
        klass = lambda c: {"string": "str", "boolean": "bool", "float": "float", "double": "float"}.get(dict(df.dtypes)[c], "int")
        wanted = {c: strategies.get(klass(c), "constant") for c in columns}
        clean = {c: cls._clean(df, c, outliers.get(klass(c), []), nan_is_null) for c in columns}
        if unknown := set(wanted.values()) - {"constant", "mean", "median", "most_frequent"}:
            raise KeyError(f"unknown strategies: {sorted(unknown)}")
        means = [c for c in columns if wanted[c] == "mean"]
        row = df.agg(*(F.avg(clean[c]).alias(c) for c in means)).first().asDict() if means else {}
        row |= {c: v[0] for c, v in quantiles(df, {c: clean[c].cast("double") for c in columns if wanted[c] == "median"}, [0.5]).items()}
        for c in columns:
            if wanted[c] == "most_frequent":  # the least on ties
                top = df.select(clean[c].alias("v")).filter("v IS NOT NULL").groupBy("v").count().orderBy(F.desc("count"), "v").first()
                row[c] = top["v"] if top else None
        values = {}
        for c in columns:
            v = row[c] if c in row else constants.get(klass(c), {"str": "", "bool": False}.get(klass(c), 0))
            values[c] = round(v) if klass(c) == "int" and v is not None else v
        return cls(columns=list(columns), values=values, outliers={c: outliers.get(klass(c), []) for c in columns}, nan_is_null=nan_is_null)

    def expressions(self, df):
        p = self.params
        return {c: F.coalesce(self._clean(df, c, p["outliers"][c], p["nan_is_null"]), F.lit(p["values"][c]).cast(dict(df.dtypes)[c])) for c in p["columns"]}


class OneHot(Rule):
    """Columns ``{column}_{i}`` of float for each category; the source column goes.

    Categories come in order of first appearance by ``order``, or by falling count for drop "mode";
    "first" and "mode" leave the first one out; those below round(n * min_frequency) rows share the
    last column. A null gives nulls, an unseen value zeros. 100 categories or more are an error.
    """

    name = "onehot_encode"
    MOST = 100

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], order: str | None = None, drop: str = "no_drop", min_frequency: float = 0.0) -> OneHot:
        if order is None:
            from ..plans.ordered import with_position

            df, order = with_position(df), "_rid"
        least = round(df.count() * min_frequency)
        groups = {}
        for c in columns:
            rows = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("at")).limit(cls.MOST).collect()
            if len(rows) >= cls.MOST:
                raise ValueError(f"{c} has {cls.MOST} categories or more")
            rows.sort(key=lambda r: (-r["n"], r["at"]) if drop == "mode" else (r["at"],))
            often, seldom = [[r[c]] for r in rows if r["n"] >= least], [r[c] for r in rows if r["n"] < least]
            groups[c] = (often[1:] if drop in ("first", "mode") else often) + ([seldom] if seldom else [])
        return cls(columns=list(columns), groups=groups)

    def removed(self):
        return self.params["columns"]

    def expressions(self, df):
        return {f"{c}_{i}": F.when(F.col(c).isNotNull(), F.col(c).isin(group).cast("float")) for c in self.params["columns"] for i, group in enumerate(self.params["groups"][c])}


class Scaler(Rule):
    """Standard (ddof 0, by mean and deviation) or min-max; a constant column gives NaN, or 0 for min-max."""

    name = "scaler"

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str] | None = None, kind: str = "standard", with_mean: bool = True, with_std: bool = True) -> Scaler:
        columns = columns or numeric_columns(df)
        row = df.agg(*(f(known(df, c).cast("double")).alias(f"{c}\x01{k}") for c in columns for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max)))).first()
        get = lambda k: {c: row[f"{c}\x01{k}"] for c in columns}
        if kind == "standard":
            return cls(columns=columns, shift=get("mean") if with_mean else dict.fromkeys(columns, 0.0), by=get("std") if with_std else dict.fromkeys(columns, 1.0), kind=kind)
        return cls(columns=columns, shift=get("min"), by={c: row[f"{c}\x01max"] - row[f"{c}\x01min"] or 1.0 for c in columns}, kind=kind)

    def expressions(self, df):
        return {c: S.divide(F.col(c) - self.params["shift"][c], F.lit(float(self.params["by"][c]))) for c in self.params["columns"]}

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.col(c) * self.params["by"][c] + self.params["shift"][c] for c in self.params["columns"]})


class Ordinal(Rule):
    """Sorted categories to 0.0, 1.0, ...; unseen values raise. ``inverse`` turns back."""

    name = "ordinal"
    MOST = 100_000

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> Ordinal:
        found = {}
        for c in columns:
            rows = df.select(c).filter(F.col(c).isNotNull()).distinct().limit(cls.MOST + 1).collect()
            if len(rows) > cls.MOST:
                raise ValueError(f"{c} has over {cls.MOST} categories")
            found[c] = sorted(r[0] for r in rows)
        return cls(columns=list(columns), categories=found)

    def expressions(self, df):
        def one(c: str) -> Column:
            spot = F.array_position(F.array(*(F.lit(v) for v in self.params["categories"][c])), F.col(c))
            return F.when(spot > 0, (spot - 1).cast("double")).when(F.col(c).isNull(), F.lit(None).cast("double")).otherwise(F.raise_error(F.concat(F.lit("unseen category "), F.col(c).cast("string"))).cast("double"))

        return {c: one(c) for c in self.params["columns"]}

    def inverse(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.element_at(F.array(*(F.lit(v) for v in self.params["categories"][c])), (F.col(c) + 1).cast("int")) for c in self.params["columns"]})


class LogRound(Rule):
    """round(log2(x + bias), decimals), half to even."""

    name = "log_round"

    def expressions(self, df):
        return {c: F.bround(S.log2(F.col(c) + self.params["bias"]), self.params["decimals"]) for c in self.params["columns"]}


class ScoreCard(Rule):
    """Score of a probability: offset -+ factor * ln(odds), within [low, high]; factor = pdo / ln 2."""

    name = "score_card"

    def inputs(self):
        return [self.params["prediction"]]

    def expressions(self, df):
        p, x = self.params, F.col(self.params["prediction"])
        factor = p["pdo"] / math.log(2)
        offset = p["scaled_value"] - factor * math.log(p["odd_base"])
        odds = S.log(S.divide(x, 1 - x))
        score = F.lit(offset) + (factor if p.get("positive", 1) == 1 else -factor) * odds
        return {p.get("new", "score"): F.when(x.isNotNull(), F.least(F.lit(float(p["high"])), F.greatest(F.lit(float(p["low"])), score)))}



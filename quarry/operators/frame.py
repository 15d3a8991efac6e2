"""A thin table facade: vertical tables are one DataFrame whose columns know their party.

Every method returns a new facade over a lazy plan. Only ``fillna`` by neighbours, ``iloc`` and
positional column joins need rows in order and add positions for it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import carry, running, with_position
from ..schema import columns_of, is_float, known, numeric_columns, party_of, require
from . import aggregates


class Table:
    def __init__(self, df: DataFrame):
        self.df = df

    # metadata
    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def dtypes(self) -> dict[str, str]:
        return dict(self.df.dtypes)

    @property
    def shape(self) -> tuple[int, int]:
        return self.df.count(), len(self.df.columns)

    @property
    def partition_columns(self) -> dict[str, list[str]]:
        return {p: columns_of(self.df, party=p) for p in dict.fromkeys(party_of(self.df, c) for c in self.columns)}

    def partition_shape(self) -> dict[str, tuple[int, int]]:
        n = self.df.count()
        return {p: (n, len(c)) for p, c in self.partition_columns.items()}

    # projection
    def __getitem__(self, item: str | list[str]) -> Table:
        names = [item] if isinstance(item, str) else list(item)
        require(self.df, *names)
        return Table(self.df.select(*names))

    def assign(self, **values: Column | object) -> Table:
        return Table(self.df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()}))

    def drop(self, columns: str | list[str], errors: str = "raise") -> Table:
        names = [columns] if isinstance(columns, str) else list(columns)
        if errors == "raise":
            require(self.df, *names)
        return Table(self.df.drop(*names))

    def rename(self, columns: dict[str, str]) -> Table:
        return Table(self.df.withColumnsRenamed(columns))

    def select_dtypes(self, include: str = "number") -> Table:
        if include == "number":
            return self[numeric_columns(self.df)]
        return self[[c for c, t in self.df.dtypes if t == include]]

    def iloc(self, index: int | slice | list[int]) -> Table:
        rows = with_position(self.df)
        if isinstance(index, slice):
            if (index.step or 1) < 1 or (index.start or 0) < 0 or (index.stop or 0) < 0:
                raise ValueError("positions from the end are not taken")
            hit = (F.col("_rid") >= (index.start or 0)) & ((F.col("_rid") - (index.start or 0)) % (index.step or 1) == 0)
            hit = hit & (F.col("_rid") < index.stop) if index.stop is not None else hit
        else:
            hit = F.col("_rid").isin([index] if isinstance(index, int) else list(index))
        return Table(rows.filter(hit).drop("_rid"))

    def astype(self, dtype: str | dict[str, str], errors: str = "raise") -> Table:
        kinds = dtype if isinstance(dtype, dict) else dict.fromkeys(self.columns, dtype)
        require(self.df, *kinds)
        return Table(self.df.withColumns({c: F.col(c).cast(t) if errors == "raise" else F.col(c).try_cast(t) for c, t in kinds.items()}))

    def copy(self) -> Table:
        return Table(self.df)

    def values(self) -> DataFrame:
        """One array column of doubles."""
        return self.df.select(F.array(*(F.col(c).cast("double") for c in self.columns)).alias("values"))

    # elements
    def _each(self, f: Callable[[str], Column], columns: list[str] | None = None) -> Table:
        chosen = self.columns if columns is None else columns
        return Table(self.df.select(*(f(c).alias(c) if c in chosen else F.col(c) for c in self.columns)))

    def isna(self) -> Table:
        return self._each(lambda c: known(self.df, c).isNull())

    def fillna(self, value: object | dict | None = None, method: str | None = None, limit: int | None = None, order: list[str] | None = None) -> Table:
        """By a value for all or some columns, or by the neighbour before (ffill) or after (bfill), up to ``limit`` rows away.

        Neighbours go by ``order``, or by position; rows are dealt by ranges of it.
        """
        if method is None:
            values = value if isinstance(value, dict) else dict.fromkeys(self.columns, value)
            fits = lambda c: isinstance(value, dict) or (self.dtypes[c] == "string") == isinstance(values[c], str)
            return self._each(lambda c: F.coalesce(known(self.df, c), F.lit(values[c]).cast(self.dtypes[c])), [c for c in values if fits(c)])
        rows = self.df if order else with_position(self.df)
        keys = [F.col(c) for c in order or ["_rid"]]
        if limit is None:
            return Table(carry(rows.select(*(known(rows, c).alias(c) for c in rows.columns)), keys, self.columns, method == "ffill")[self.columns])
        # the position of the value that is carried tells how far it came
        placed = running(rows.withColumn("_one", F.lit(1)), keys, {"_place": F.col("_one")})
        spots = {c: f"_at_{i}" for i, c in enumerate(self.columns)}
        placed = placed.select("_place", *(known(self.df, c).alias(c) for c in self.columns)).withColumns({s: F.when(F.col(f"`{c}`").isNotNull(), F.col("_place")) for c, s in spots.items()})
        out = carry(placed, [F.col("_place")], [*spots, *spots.values()], method == "ffill")
        return Table(out.select(*(F.when(F.abs(F.col("_place") - F.col(s)) <= limit, F.col(f"`{c}`")).alias(c) for c, s in spots.items())))

    def replace(self, to_replace: dict) -> Table:
        cases = lambda c: reduce(lambda w, kv: w.when(F.col(c).eqNullSafe(F.lit(kv[0])), F.lit(kv[1])), to_replace.items(), F.when(F.lit(False), F.col(c)))
        text = all(isinstance(k, str) for k in to_replace)
        return self._each(lambda c: cases(c).otherwise(F.col(c)), [c for c in self.columns if (self.dtypes[c] == "string") == text])

    def pow(self, exponent: float) -> Table:
        return self._each(lambda c: F.pow(c, F.lit(exponent)), numeric_columns(self.df))

    def round(self, decimals: int | dict[str, int] = 0) -> Table:
        """Half to even."""
        places = decimals if isinstance(decimals, dict) else dict.fromkeys(numeric_columns(self.df), decimals)
        return self._each(lambda c: F.bround(c, places[c]), list(places))

    def subtract(self, other: float | dict[str, float]) -> Table:
        by = other if isinstance(other, dict) else dict.fromkeys(numeric_columns(self.df), other)
        return self._each(lambda c: F.col(c) - F.lit(by[c]), list(by))

    # rows
    def apply_func(self, func: Callable, schema: str) -> Table:
        """``func`` maps an iterator of pandas frames to another; rows may come and go."""
        return Table(self.df.mapInPandas(func, schema))

    def concat(self, *others: Table, axis: int = 0) -> Table:
        """Below each other (columns by name), or side by side by position; column names must then differ."""
        if axis == 0:
            return Table(reduce(lambda a, b: a.unionByName(b), [o.df for o in others], self.df))
        out = with_position(self.df)
        for o in others:
            if both := set(o.columns) & set(out.columns):
                raise ValueError(f"columns on both sides: {sorted(both)}")
            out = out.join(with_position(o.df), "_rid", "full")
        return Table(out.drop("_rid"))

    def aggregate(self, *functions: str, columns: list[str] | None = None) -> DataFrame:
        return aggregates.column_stats(self.df, list(functions), columns)

    def to_pandas(self):
        return self.df.toPandas()


def horizontal(parts: dict[str, DataFrame]) -> DataFrame:
    """The parts of all parties below each other, with the column party. Names and types must agree."""
    first, *rest = parts.values()
    for other in rest:
        if dict(other.dtypes) != dict(first.dtypes):
            raise TypeError(f"the parts differ: {first.dtypes} and {other.dtypes}")
    return reduce(lambda a, b: a.unionByName(b), (d.withColumn("party", F.lit(p)) for p, d in parts.items()))


def nan_to_null(df: DataFrame) -> DataFrame:
    return df.select(*(known(df, c).alias(c) if is_float(df, c) else F.col(c) for c in df.columns))

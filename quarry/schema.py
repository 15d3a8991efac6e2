"""Column metadata: the party that owns a column and its kind (id, feature or label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("id", "feature", "label")
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FLOATING = (T.FloatType, T.DoubleType)
#: Type names of tables and the Spark types they are read as; there are no unsigned types here.
TYPES = {
    "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "int": "bigint", "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)",
    "float16": "float", "float32": "float", "float64": "double", "float": "double", "bool": "boolean", "str": "string", "binary": "binary",
}


def schema_of(types: dict[str, str]) -> T.StructType:
    """A read schema from column names and type names."""
    unknown = set(types.values()) - set(TYPES)
    if unknown:
        raise TypeError(f"unknown types: {sorted(unknown)}")
    return T._parse_datatype_string(", ".join(f"`{k}` {TYPES[v]}" for k, v in types.items()))


def tag(df: DataFrame, party: str | None = None, kinds: dict[str, str] | None = None, default: str = "feature") -> DataFrame:
    """``df`` with party and kind in the metadata of its columns. Kinds that are given replace the old ones."""
    kinds = kinds or {}
    if bad := set(kinds.values()) - set(KINDS):
        raise ValueError(f"unknown kinds: {sorted(bad)}")
    require(df, *kinds)
    out = []
    for f in df.schema.fields:
        meta = dict(f.metadata or {})
        meta["kind"] = kinds.get(f.name, meta.get("kind", default))
        if party is not None:
            meta["party"] = party
        out.append(F.col(f"`{f.name}`").alias(f.name, metadata=meta))
    return df.select(*out)


def kind_of(df: DataFrame, column: str) -> str | None:
    return df.schema[column].metadata.get("kind")


def party_of(df: DataFrame, column: str) -> str | None:
    return df.schema[column].metadata.get("party")


def columns_of(df: DataFrame, party: str | None = None, kind: str | None = None) -> list[str]:
    return [f.name for f in df.schema.fields if (party is None or f.metadata.get("party") == party) and (kind is None or f.metadata.get("kind") == kind)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def require(df: DataFrame, *columns: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise KeyError(f"no such columns: {missing}")


def is_float(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, FLOATING)


def known(df: DataFrame, column: str) -> Column:
    """The column with NaN as null, so that aggregates skip it."""
    c = F.col(f"`{column}`")
    return F.when(~F.isnan(c), c) if is_float(df, column) else c

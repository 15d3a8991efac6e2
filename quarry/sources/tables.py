"""Readers, writers and connectors of tables."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import joins
from ..plans.ordered import with_position
from ..rules.base import Rule
from ..schema import schema_of, tag


def read_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None, delimiter: str = ",", columns: list[str] | None = None, header: bool = True, prefix: str = "", null_strs: list[str] | None = None, skip_rows: int = 0, nrows: int | None = None, converters: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """A CSV table. ``types`` name the columns of the file in order; ``columns`` keeps some, in the given order.

    Without a header names are ``{prefix}{i}``. ``null_strs`` are read as null. ``skip_rows`` and
    ``nrows`` count from the first data row. ``converters`` are column expressions.
    """
    reader = spark.read.option("sep", delimiter).option("header", header)
    if null_strs and len(null_strs) == 1:
        reader = reader.option("nullValue", null_strs[0])
    df = (reader.schema(schema_of(types)) if types and not (null_strs and len(null_strs) > 1) else reader).csv(path)
    if not header and not types:
        df = df.toDF(*(f"{prefix}{i}" for i in range(len(df.columns))))
    if null_strs and len(null_strs) > 1:
        df = df.select(*(F.when(~F.col(c).isin(null_strs), F.col(c)).alias(c) for c in df.columns))
        if types:
            df = df.select(*(F.col(c).cast(schema_of({c: t})[c].dataType) for c, t in types.items()))
    if skip_rows or nrows is not None:
        rows = with_position(df)
        hit = F.col("_rid") >= skip_rows
        df = rows.filter(hit & (F.col("_rid") < skip_rows + nrows) if nrows is not None else hit).drop("_rid")
    for c, f in (converters or {}).items():
        df = df.withColumn(c, f(F.col(c)))
    return df.select(*columns) if columns else df


def read_vertical(spark: SparkSession, parts: dict[str, DataFrame], keys: list[str] | None = None, drop_keys: bool = False) -> DataFrame:
    """The columns of all parties side by side, matched by ``keys``, or by position if there are none.

    Parties' columns must differ, but for the keys; without keys the parts must have as many rows each.
    """
    tagged = {p: tag(d, p) for p, d in parts.items()}
    names = [c for d in parts.values() for c in d.columns if c not in (keys or [])]
    if len(names) != len(set(names)):
        raise ValueError(f"columns of several parties: {sorted({c for c in names if names.count(c) > 1})}")
    if keys is None:
        sizes = {p: d.count() for p, d in parts.items()}
        if len(set(sizes.values())) > 1:
            raise ValueError(f"the parts have different lengths: {sizes}")
        out = reduce(lambda a, b: a.join(b, "_rid"), (with_position(d) for d in tagged.values()))
        return out.orderBy("_rid").drop("_rid")
    first, *rest = tagged.values()
    out = first
    for d in rest:
        right = d.withColumnsRenamed({k: f"_{k}" for k in keys})
        out = joins.psi(out, right, keys, [f"_{k}" for k in keys], sort=False).drop(*(f"_{k}" for k in keys))
    out = out.orderBy(*keys)
    return out.drop(*keys) if drop_keys else out


def read_horizontal(parts: dict[str, DataFrame]) -> DataFrame:
    from ..operators.frame import horizontal

    return horizontal(parts)


def write_csv(df: DataFrame, path: str, na_rep: str = "", by_party: bool = False) -> None:
    writer = df.write.mode("overwrite").option("header", True).option("nullValue", na_rep).option("emptyValue", "")
    (writer.partitionBy("party") if by_party else writer).csv(path)


def read_orc(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """With ``types`` the columns are taken in that order and cast."""
    df = spark.read.orc(path)
    return df.select(*(F.col(c).cast(schema_of({c: t})[c].dataType) for c, t in types.items())) if types else df


def write_orc(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").orc(path)


def convert(spark: SparkSession, source: str, source_format: str, target: str, target_format: str, types: dict[str, str] | None = None, null_strs: list[str] | None = None, na_rep: str = "") -> None:
    """CSV to ORC or back."""
    df = read_csv(spark, source, types, null_strs=null_strs) if source_format == "csv" else read_orc(spark, source, types)
    write_csv(df, target, na_rep) if target_format == "csv" else write_orc(df, target)


def dump(df: DataFrame, path: str, kind: str = "orc") -> dict:
    """Write a table, and return what ``load`` needs: uri, format, number of rows, schema with parties and kinds. An empty one is an error."""
    (write_orc if kind == "orc" else write_csv)(df, path)
    lines = (df.sparkSession.read.orc(path) if kind == "orc" else df.sparkSession.read.option("header", True).csv(path)).count()
    if not lines:
        raise ValueError("the table is empty")
    return {"uri": path, "format": kind, "line_count": lines, "schema": json.loads(df.schema.json())}


def load(spark: SparkSession, info: dict) -> DataFrame:
    schema = T.StructType.fromJson(info["schema"])
    df = spark.read.orc(info["uri"]) if info["format"] == "orc" else spark.read.schema(schema).option("header", True).csv(info["uri"])
    if df.isEmpty():
        raise ValueError("the table is empty")
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata or {}) for f in schema.fields))


def load_arrays(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The arrays of an .npz file, or the one of an .npy file, a row each for their first axis; read at the driver."""
    held = np.load(path, allow_pickle=False)
    arrays = dict(held) if hasattr(held, "files") else {"data": held}
    out = {}
    for k, a in arrays.items():
        a = a.reshape(len(a), -1).astype(float)
        out[k] = spark.createDataFrame(a.tolist(), ", ".join(f"{n} double" for n in names or [f"c{i}" for i in range(a.shape[1])]))
    return out


# connectors

CONNECTORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_MOCK: dict[str, DataFrame] = {}


def connector(scheme: str) -> Callable:
    """Register a reader of URIs of a scheme."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        CONNECTORS[scheme] = f
        return f

    return register


@connector("mock")
def _mock(spark: SparkSession, uri: str) -> DataFrame:
    return _MOCK[urlparse(uri).netloc]


def mock(name: str, df: DataFrame) -> str:
    """A named table for tests; returns its URI."""
    _MOCK[name] = df
    return f"mock://{name}"


def data_source(spark: SparkSession, uri: str, party: str, columns: str | None = None) -> DataFrame:
    """A table by URI: a registered scheme, or a path by its ending. ``columns`` is JSON that maps columns to kinds."""
    scheme = urlparse(uri).scheme
    if scheme in CONNECTORS:
        df = CONNECTORS[scheme](spark, uri)
    else:
        ending = uri.rstrip("/").rpartition(".")[2]
        df = spark.read.option("header", True).csv(uri) if ending == "csv" else spark.read.format(ending if ending in ("orc", "json") else "parquet").load(uri)
    return tag(df, party, json.loads(columns) if columns else {})


def data_sink(df: DataFrame, party: str, uri: str, kind: str = "parquet") -> None:
    """Write the columns of one party."""
    own = [f.name for f in df.schema.fields if f.metadata.get("party") == party]
    if not own:
        raise ValueError(f"{party} has no column")
    df.select(*own).write.mode("overwrite").format(kind).option("header", True).save(uri)


def read_rule(spark: SparkSession, text: str) -> DataFrame:
    """A stored rule as rows (name, value)."""
    held = json.loads(text)
    return spark.createDataFrame([("rule", held["rule"]), *((k, json.dumps(v)) for k, v in sorted(held["params"].items()))], "name string, value string")


def write_rule(text: str, merges: dict[str, list[int]] | None = None, values: dict[str, object] | None = None) -> str:
    """A stored rule with bins merged or fill values changed."""
    rule = Rule.from_json(text)
    for column, bins in (merges or {}).items():
        rule = rule.merged(column, bins)
    if values:
        if unknown := values.keys() - rule.params["values"].keys():
            raise KeyError(f"no such columns: {sorted(unknown)}")
        rule = type(rule)(**{**rule.params, "values": {**rule.params["values"], **values}})
    return rule.to_json()


# simulated parties

def deal(df: DataFrame, shares: dict[str, float], seed: int = 0, shuffle: bool = True) -> DataFrame:
    """Rows dealt to parties by shares, as the column party: by a seeded draw, or by position."""
    total, upto, out = sum(shares.values()), 0.0, None
    if shuffle:
        rows = df.withColumn("_u", F.rand(seed))
        u = F.col("_u")
    else:
        rows = with_position(df)
        n = df.count()
        rows = rows.withColumn("_u", F.col("_rid") / F.lit(float(max(n, 1)))).drop("_rid")
        u = F.col("_u")
    for p, s in shares.items():
        upto += s / total
        out = F.when(u < upto, F.lit(p)) if out is None else out.when(u < upto, F.lit(p))
    return rows.withColumn("party", out.otherwise(F.lit(list(shares)[-1]))).drop("_u")


def deal_dirichlet(df: DataFrame, parties: list[str], label: str, alpha: float, seed: int = 0) -> DataFrame:
    """Rows dealt with a share of each label's rows that is drawn from a Dirichlet distribution."""
    labels = sorted(r[0] for r in df.select(label).distinct().collect())
    shares = np.random.default_rng(seed).dirichlet([alpha] * len(parties), len(labels)).cumsum(1)
    rows = df.withColumn("_u", F.rand(seed))
    out = F.lit(parties[-1])
    for value, row in zip(labels, shares):
        for p, s in reversed(list(zip(parties, row))):
            out = F.when((F.col(label) == value) & (F.col("_u") < float(s)), F.lit(p)).otherwise(out)
    return rows.withColumn("party", out).drop("_u")


def deal_by_label(df: DataFrame, parties: dict[str, list], label: str) -> DataFrame:
    """Label skew: each party has the rows of its labels; other rows go."""
    out = None
    for p, values in parties.items():
        hit = F.col(label).isin(values)
        out = F.when(hit, F.lit(p)) if out is None else out.when(hit, F.lit(p))
    return df.withColumn("party", out).filter("party IS NOT NULL")

"""Key-matched joins of tables of different parties. Null keys are equal to each other.

Protocol, curve and bucket options of a private matching have no effect on a result and are not
taken. Spark picks the physical join; a small client side may be broadcast after a check of its size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import require, tag

HOW = {"inner": "inner", "left": "left", "right": "right", "full": "full"}
#: Rows of the client side up to which it is broadcast.
BROADCAST_ROWS = 100_000


def match(a: DataFrame, b: DataFrame, keys_a: list[str], keys_b: list[str]) -> Column:
    if len(keys_a) != len(keys_b) or not keys_a:
        raise ValueError("as many keys on each side")
    return reduce(lambda x, y: x & y, (a[x].eqNullSafe(b[y]) for x, y in zip(keys_a, keys_b)))


def check_unique(df: DataFrame, keys: list[str]) -> None:
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"keys {keys} repeat")


def psi(a: DataFrame, b: DataFrame, keys_a: list[str], keys_b: list[str], how: str = "inner", sort: bool = True, duplicated: tuple[bool, bool] = (True, True), allow_empty: bool = True, receiver: str | None = None) -> DataFrame:
    """The matching rows with the columns of both sides, or of the ``receiver`` ("a" or "b") alone.

    ``how``: inner, left, right, full, or difference (rows of either side without a partner). A side
    that is not ``duplicated`` must not repeat a key. Column names must differ between the sides. Key
    columns are ids of the result.
    """
    require(a, *keys_a)
    require(b, *keys_b)
    if both := set(a.columns) & set(b.columns):
        raise ValueError(f"columns on both sides: {sorted(both)}")
    for df, keys, many in ((a, keys_a, duplicated[0]), (b, keys_b, duplicated[1])):
        if not many:
            check_unique(df, keys)
    on = match(a, b, keys_a, keys_b)
    if how == "difference":
        out = a.join(b, on, "left_anti").unionByName(b.join(a, on, "left_anti"), allowMissingColumns=True)
    elif how == "inner" and receiver == "a" and not duplicated[1]:
        out = a.join(b, on, "left_semi")
    else:
        out = a.join(b, on, HOW[how])
    if receiver:
        out = out.select(*(a if receiver == "a" else b).columns)
    if not allow_empty and out.isEmpty():
        raise ValueError("no key matches")
    out = tag(out, kinds={c: "id" for c in (*keys_a, *keys_b) if c in out.columns})
    shown = [F.coalesce(*(F.col(c) for c in pair if c in out.columns)) for pair in zip(keys_a, keys_b) if set(pair) & set(out.columns)]
    return out.orderBy(*shown) if sort and shown else out


def psi_report(a: DataFrame, b: DataFrame, result: DataFrame) -> list[dict]:
    n = result.count()
    return [{"party": p, "original_count": df.count(), "intersection_count": n} for p, df in (("a", a), ("b", b))]


def psi3(a: DataFrame, b: DataFrame, c: DataFrame, keys_a: list[str], keys_b: list[str], keys_c: list[str], sort: bool = True) -> DataFrame:
    """The inner join of three parties."""
    return psi(psi(a, b, keys_a, keys_b, sort=False), c, keys_a, keys_c, sort=sort)


def cache_keys(server: DataFrame, keys: list[str], path: str) -> str:
    """The offline phase of an unbalanced match: the large side, dealt by key, in a table of its own."""
    server.repartition(*keys).write.mode("overwrite").parquet(path)
    return path


def unbalanced_psi(client: DataFrame, server: DataFrame | str, keys_client: list[str], keys_server: list[str], how: str = "inner", sort: bool = True, most: int = BROADCAST_ROWS) -> DataFrame:
    """A small client against a large server, or against the cache of one that ``cache_keys`` wrote.

    The client is broadcast if it has at most ``most`` rows and need not be kept whole, else the join shuffles.
    """
    server = client.sparkSession.read.parquet(server) if isinstance(server, str) else server
    small = how in ("inner", "right") and client.limit(most + 1).count() <= most
    out = psi(F.broadcast(client) if small else client, server, keys_client, keys_server, how, sort=False)
    return out.orderBy(*keys_client) if sort else out


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both; names and types must be the same."""
    if dict(a.dtypes) != dict(b.dtypes):
        raise TypeError(f"the schemas differ: {a.dtypes} and {b.dtypes}")
    return a.unionByName(b)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that both tables have, with null equal to null, once each."""
    return a.intersect(b.select(*a.columns))

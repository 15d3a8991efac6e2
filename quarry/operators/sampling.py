"""Samples and splits of exact size, drawn by a hash of the row key.

A row's rank is its hash, so a draw depends on the key and the seed and not on partitions. Exact
sizes are met by finding the hash at the cut in one aggregate over bins, then sorting one bin only.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import with_position

BINS = 1 << 16


def draw(key: list[str], seed: int) -> Column:
    """A uniform number of [0, 1) for each key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *(F.col(k) for k in key)), 11) / float(1 << 53)


def _cut(df: DataFrame, key: list[str], seed: int, size: int) -> Column:
    """Whether a row is among the ``size`` smallest by hash, then key. Two small jobs find where to cut."""
    u = draw(key, seed)
    counts = {r["b"]: r["count"] for r in df.select(F.floor(u * BINS).alias("b")).groupBy("b").count().collect()}  # at most BINS rows
    left, at = size, -1
    for at in sorted(counts):
        if counts[at] > left:
            break
        left -= counts[at]
    else:
        return F.lit(True)
    if not left:
        return F.floor(u * BINS) < at
    edge = df.filter(F.floor(u * BINS) == at).select(u.alias("u"), *key).orderBy("u", *key).limit(left).orderBy(F.desc("u"), *(F.desc(k) for k in key)).first()
    tie = F.struct(u.alias("u"), *(F.col(k) for k in key)) <= F.struct(F.lit(edge["u"]).alias("u"), *(F.lit(edge[k]).cast(df.schema[k].dataType).alias(k) for k in key))
    return tie


def random_sample(df: DataFrame, key: list[str], frac: float, seed: int = 0, replacement: bool = False) -> DataFrame:
    """round(frac * n) rows. With replacement each draw picks a position, and rows may repeat."""
    n = df.count()
    k = round(frac * n)
    if not replacement:
        if not 0 < frac < 1:
            raise ValueError("a fraction of 1 or more needs replacement")
        return df.filter(_cut(df, key, seed, k))
    spots = df.sparkSession.range(k).select(F.floor(F.rand(seed) * n).cast("long").alias("_rid"))
    return with_position(df).join(spots, "_rid").drop("_rid")


def system_sample(df: DataFrame, frac: float) -> DataFrame:
    """Every round(n / k)-th row from the first, k = round(frac * n)."""
    if not 0 < frac <= 0.5:
        raise ValueError("the fraction must be over 0 and at most 0.5")
    n = df.count()
    step = round(n / max(1, round(frac * n)))
    return with_position(df).filter(F.col("_rid") % step == 0).drop("_rid")


def bucket_of(column: str, quantiles: list[float]) -> Column:
    """0 up to the first quantile (included), and so on."""
    out = F.lit(len(quantiles))
    for i in reversed(range(len(quantiles))):
        out = F.when(F.col(column) <= quantiles[i], F.lit(i)).otherwise(out)
    return out


def stratified_sizes(counts: dict[int, int], total: int, weights: list[float] | None) -> dict[int, int]:
    n = sum(counts.values())
    return {b: round(total * (weights[b] if weights else c / n)) for b, c in counts.items()}


def stratified_sample(df: DataFrame, key: list[str], column: str, quantiles: list[float], frac: float, seed: int = 0, weights: list[float] | None = None, replacement: list[bool] | None = None) -> tuple[DataFrame, list[dict]]:
    """The sample, and per bucket its number of rows before and after."""
    if quantiles != sorted(quantiles) or bisect_left(quantiles, float("inf")) != len(quantiles):
        raise ValueError("quantiles must rise")
    rows = df.withColumn("_bucket", bucket_of(column, quantiles))
    counts = {r["_bucket"]: r["count"] for r in rows.groupBy("_bucket").count().collect()}
    if len(counts) != len(quantiles) + 1:
        raise ValueError("a bucket is empty")
    sizes = stratified_sizes(counts, round(frac * sum(counts.values())), weights)
    parts = []
    for b, size in sorted(sizes.items()):
        part = rows.filter(F.col("_bucket") == b)
        again = replacement[b] if replacement else False
        if size > counts[b] and not again:
            raise ValueError(f"bucket {b} holds under {size} rows")
        if again:
            spots = df.sparkSession.range(size).select(F.floor(F.rand(seed + b) * counts[b]).cast("long").alias("_rid"))
            parts.append(with_position(part).join(spots, "_rid").drop("_rid"))
        else:
            parts.append(part.filter(_cut(part, key, seed, size)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.drop("_bucket"), [{"bucket": b, "before": counts[b], "after": sizes[b]} for b in sorted(counts)]


def train_test_split(df: DataFrame, key: list[str], train_size: float = 0.75, test_size: float | None = None, seed: int = 0, shuffle: bool = True) -> tuple[DataFrame, DataFrame]:
    """The first ceil(n * train) rows and the last ceil(n * test) of a seeded order, or of the table's own; they never overlap."""
    test_size = 1 - train_size if test_size is None else test_size
    if not 0 < train_size < 1 or not 0 < test_size < 1 or train_size + test_size > 1 + 1e-9:
        raise ValueError("shares must be within 0 and 1 and add up to 1 at most")
    n = df.count()
    a = min(n, -int(-n * train_size // 1))
    b = min(n - a, -int(-n * test_size // 1))
    if not shuffle:
        rows = with_position(df)
        return rows.filter(F.col("_rid") < a).drop("_rid"), rows.filter(F.col("_rid") >= n - b).drop("_rid")
    return df.filter(_cut(df, key, seed, a)), df.filter(~_cut(df, key, seed, n - b))


def shuffled(df: DataFrame, seed: int = 0) -> DataFrame:
    return df.orderBy(F.rand(seed))


def ranks_within(df: DataFrame, by: list[str], key: list[str], seed: int = 0) -> Column:
    """The rank of each row of its group in a seeded order."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(draw(key, seed), *key))


def sample(df: DataFrame, key: list[str], algorithm: str = "random", frac: float = 0.1, seed: int = 0, replacement: bool = False, column: str | None = None, quantiles: list[float] | None = None, weights: list[float] | None = None) -> tuple[DataFrame, list[dict]]:
    """A sample by ``algorithm`` (random, system or stratified) and its report: rows before and after, in all and by bucket."""
    if algorithm == "random":
        out, report = random_sample(df, key, frac, seed, replacement), []
    elif algorithm == "system":
        out, report = system_sample(df, frac), []
    elif algorithm == "stratified":
        if column is None or not quantiles:
            raise ValueError("a stratified sample needs a column and quantiles")
        out, report = stratified_sample(df, key, column, quantiles, frac, seed, weights)
    else:
        raise ValueError(f"unknown algorithm {algorithm}")
    return out, [{"bucket": "all", "before": df.count(), "after": out.count()}, *report]

"""Positions and running totals over a whole table, without a window that lands in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut


def with_position(df: DataFrame, name: str = "_rid") -> DataFrame:
    """``df`` with each row's position from 0, gapless, in the order of its partitions.

    A first job counts the rows of each partition; the driver gets one number for each. The order is that
    of the input. A scan is dealt to the same partitions again; a sort or another shuffle is not (its borders
    are drawn from a sample that another run draws anew, and small partitions are joined by their size), so
    it runs once and is written with the numbers of its rows.
    """
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = df.select("*", within.alias("_within"), F.spark_partition_id().alias("_of"))
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        rows = cut(rows, "positions")
    counts = rows.groupBy("_of").count().collect()
    base, total = {}, 0
    for p, n in sorted((r["_of"], r["count"]) for r in counts):
        base[p], total = total, total + n
    offsets = df.sparkSession.createDataFrame(sorted(base.items()), "_part_id int, _offset long")  # a row for each partition
    return rows.join(F.broadcast(offsets), F.col("_of") == F.col("_part_id")).select(*(F.col(f"`{c}`") for c in df.columns), (F.col("_within") + F.col("_offset")).alias(name))


def _ranges(df: DataFrame, order: list[Column], partitions: int | None) -> tuple[DataFrame, list[str]]:
    """``df`` with its order as columns, dealt by ranges of it, and the number of each row's range."""
    names = [f"_k{i}" for i in range(len(order))]
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select("*", *(c.alias(n) for c, n in zip(order, names)))
    ranged = keyed.repartitionByRange(partitions, *(F.col(n) for n in names)).withColumn("_part", F.spark_partition_id())
    return cut(ranged, "ranges"), names  # written, as another run of the plan could draw other borders


def carry(df: DataFrame, order: list[Column], columns: list[str], forward: bool = True, partitions: int | None = None) -> DataFrame:
    """``df`` with nulls of ``columns`` replaced by the last value before (or the first one after) in the given order.

    As with ``running``, each range is a window of its own, and only its last values go to the next ones.
    """
    ranged, names = _ranges(df, order, partitions)
    last = F.last if forward else F.first
    upto = Window.partitionBy("_part").orderBy(*names)
    upto = upto.rowsBetween(Window.unboundedPreceding, 0) if forward else upto.rowsBetween(0, Window.unboundedFollowing)
    pick = F.max_by if forward else F.min_by
    rank = F.struct(*names)
    ends = ranged.groupBy("_part").agg(*(pick(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(f"_e_{c}") for c in columns))
    others = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1) if forward else Window.orderBy("_part").rowsBetween(1, Window.unboundedFollowing)  # a row for each range
    ends = ends.select("_part", *(last(f"_e_{c}", ignorenulls=True).over(others).alias(f"_e_{c}") for c in columns))
    out = ranged.select("*", *(last(c, ignorenulls=True).over(upto).alias(f"_w_{c}") for c in columns)).join(F.broadcast(ends), "_part")
    return out.select(*(F.coalesce(f"_w_{c}", f"_e_{c}").alias(c) if c in columns else F.col(c) for c in df.columns))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], partitions: int | None = None) -> DataFrame:
    """``df`` with running totals (each row included) in the given order.

    Rows are dealt by ranges of the order, each range is summed up by a window of its own, and the
    totals of the ranges before it are added. Only one row for each range is gathered.
    """
    ranged, names = _ranges(df.select("*", *(v.alias(f"_v_{k}") for k, v in sums.items())), order, partitions)
    totals = ranged.groupBy("_part").agg(*(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in sums))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    totals = totals.select("_part", *(F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_t_{k}") for k in sums))
    upto = Window.partitionBy("_part").orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.select("*", *(F.sum(f"_v_{k}").over(upto).alias(f"_w_{k}") for k in sums)).join(F.broadcast(totals), "_part")
    return out.select(*df.columns, *((F.col(f"_w_{k}") + F.col(f"_t_{k}")).alias(k) for k in sums))

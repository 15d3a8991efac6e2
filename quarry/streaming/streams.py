"""Streams: stored rules and filters on unbounded tables, and event-time windows.

Whatever is a plain column expression works on a stream as on a table; fits need a bounded table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.filters import predicate
from ..plans.cut import shared_path
from ..rules.base import Rule


def read(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder (or that match a pattern) as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def apply_rules(stream: DataFrame, *rules: Rule) -> DataFrame:
    for r in rules:
        stream = r.apply(stream)
    return stream


def condition(stream: DataFrame, column: str, comparator: str, bound: str | None = None, other: bool = False) -> DataFrame:
    """The rows that hit, or the ``other`` ones."""
    hit = predicate(stream, column, comparator, bound)
    return stream.filter(~F.coalesce(hit, F.lit(False)) if other else hit)


def tumbling(stream: DataFrame, time: str, width: str, by: list[str], late: str = "10 minutes", slide: str | None = None, **aggregates) -> DataFrame:
    """Sums by event-time window; rows later than ``late`` are left out."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = rows.groupBy(F.window(time, width, slide) if slide else F.window(time, width), *by).agg(*(e.alias(k) for k, e in aggregates.items()))
    return out.select(F.col("window.start").alias("window_start"), *by, *aggregates)


def sessions(stream: DataFrame, time: str, gap: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    out = rows.groupBy(F.session_window(time, gap), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *by, "n")


def deduplicated(stream: DataFrame, keys: list[str], time: str, late: str = "10 minutes") -> DataFrame:
    if not stream.isStreaming:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def split_batches(stream: DataFrame, column: str, comparator: str, bound: str | None, hit_path: str, else_path: str, checkpoint: str) -> StreamingQuery:
    """Both sides of a filter to Parquet folders; what is there already is taken once (trigger available now)."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        p = predicate(batch, column, comparator, bound)
        batch.filter(p).write.mode("overwrite").parquet(f"{hit_path}/epoch={epoch}")
        batch.filter(~F.coalesce(p, F.lit(False))).write.mode("overwrite").parquet(f"{else_path}/epoch={epoch}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream gives until its present input ends: written to Parquet in the shared folder and read from there.

    The mode complete replaces its rows with each batch; as it needs a bounded result anyway, that one is held in memory.
    """
    spark = stream.sparkSession
    if mode != "append":
        query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name)
    path = shared_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def stateful(stream: DataFrame, by: list[str], f: Callable, output: str, state: str, mode: str = "append") -> DataFrame:
    """A function of (key, pandas frames, state) for each key, kept over batches."""
    return stream.groupBy(*by).applyInPandasWithState(f, output, state, mode, "NoTimeout")

"""Tables kept in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``; a lost executor then costs the
reread of a file and nothing else. The setting is read from the session. Only where it is unset
(tests, notebooks) a temporary folder of this machine is used, which is right for local masters only.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OPEN: dict[str, tuple[SparkSession, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this application, below ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/quarry-{spark.sparkContext.applicationId}"
    if path not in _OPEN:
        _OPEN[path] = (spark, path)
    return path


def keep(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, in folders by the column ``by`` if named, and return it as read back, with the same schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    out._kept_path = path
    return out


def drop(kept: DataFrame, *parts: str) -> None:
    """Delete a kept table that no later plan reads, or only its folders ``parts``."""
    spark = kept.sparkSession
    for part in parts or ("",):
        path = spark._jvm.org.apache.hadoop.fs.Path("/".join(filter(None, (kept._kept_path, part))))
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished plans: it does so when the driver's garbage is collected."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark deletes a write's shuffle files as the write ends, and does not wait for its cleaner, which may come late or never."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


@atexit.register
def _clean() -> None:
    for spark, path in _OPEN.values():
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the JVM may be gone by now; the folder then stays with the checkpoints
            return

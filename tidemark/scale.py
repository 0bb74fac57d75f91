"""Decisions that depend on data size: what may be broadcast, which keys are hot, where lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a small dimension is broadcast. Rows of dimensions are a few hundred bytes, so this is tens of MB.
BROADCAST_ROWS = 100_000


def broadcast_if_bounded(df: DataFrame, counted: DataFrame | None = None, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if ``counted`` (by default ``df`` itself) has at most ``max_rows`` rows.

    ``counted`` must have about as many rows as ``df`` or more; a base table is best, as its rows are counted
    from the file footers. Beyond the bound the join is left to a shuffle.
    """
    rows = counted.count() if counted is not None else df.limit(max_rows + 1).count()
    return F.broadcast(df) if rows <= max_rows else df


def hot_keys(df: DataFrame, key: str, rows_per_task: int) -> DataFrame:
    """Keys (NULL is one) with more than ``rows_per_task`` rows and the number of salts each needs: (key, salts).

    Rows of a key are counted by a partial aggregate per task, so a hot key costs no more than any other. The
    result is written once; there is at most a row per ``rows_per_task`` rows of ``df``.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    return cut_lineage(counts.where(F.col("_rows") > rows_per_task).select(key, F.ceil(F.col("_rows") / rows_per_task).cast("int").alias("salts")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir).

    Where it is unset, a local session gets a folder of its machine, removed when the process ends; a cluster
    has no such folder, so there it is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
        spark.sparkContext.setCheckpointDir(at)
    return at


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one for what a query writes and reads again; it is removed when the driver ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder once, so that later reads neither recompute it nor lose it with an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def nan_to_null(value: Column) -> Column:
    """NULL for NaN and infinities; the engine keeps columns free of NaN."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(None)).otherwise(value)


def finite(value: Column) -> Column:
    """True for a value that is neither NULL, NaN nor infinite; never NULL."""
    return F.coalesce(~F.isnan(value) & (F.abs(value) != float("inf")), F.lit(False))


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` for work that costs much more than moving its rows: shuffled by ``key`` if it has fewer partitions than there are cores.

    Rows of one key stay together; a key is expected to be near unique.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(key)

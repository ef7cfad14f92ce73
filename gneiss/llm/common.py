"""What the operators share: the folder for intermediate tables, order ranks, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from gneiss.sources.shared import shared_folder, small_batches  # noqa: F401

ROW_BITS = 33  # monotonically_increasing_id() holds the partition above these bits


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df in the shared folder and read it back: lineage ends there, so a lost executor costs
    no recomputation of what came before, and ids made by the plan stay the same ever after."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def input_partitions(df: DataFrame, target_bytes: int) -> int:
    """Partitions of about target_bytes for the optimizer's size estimate of df, and never fewer than
    spark.sql.shuffle.partitions."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, min(size // target_bytes + 1, 200_000))


def broadcast_if_small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df (stored, of a few longs a row), marked for a broadcast join if it is counted to have so few rows; else Spark
    joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def release_memory() -> None:
    """Give back what Arrow and the C library hold but don't use: a worker process waits for its next task for long."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def partition_bases(counts: DataFrame, key: str, value: str) -> DataFrame:
    """counts has a row for each partition: adds 'base', the sum of value over the partitions before.
    The window sees one row for each partition of the data, never its rows."""
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(key, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long").alias("base"))


def with_position(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df, sorted by range over all partitions, with 'pos' (long, gapless from 0 in that order).

    A hot key only needs further columns in `order` to spread over several partitions: no task holds
    a whole key. Rows that tie in all columns of `order` get an arbitrary but fixed order."""
    spark = df.sparkSession
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(ranged.withColumn("_mid", F.monotonically_increasing_id()), name)
    part = F.shiftright("_mid", ROW_BITS)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    bases = partition_bases(counts, "_part", "_n")  # as many rows as partitions: small enough to broadcast
    return (
        rows.withColumn("_part", part)
        .join(F.broadcast(bases), "_part")
        .withColumn("pos", F.col("base") + F.col("_mid").bitwiseAND((1 << ROW_BITS) - 1))
        .drop("_part", "_mid", "base")
    )

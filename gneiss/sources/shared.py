"""Where loops cut their lineage: tables in the folder that the session names for checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.window import Window

ROW_BITS = 33  # monotonically_increasing_id() holds the partition above these bits


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, a folder of this machine serves if the
    session runs on this machine alone; on a cluster that is an error, as executors wouldn't share it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gneiss-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str = "step") -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2000, size: int = 8 << 20) -> None:
    """Keep Arrow batches of whole texts small, so that a Python worker's memory is bounded. It holds for the
    session: plans that an operator returns run only later."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def written(df: DataFrame, path: str) -> int:
    """Write df and return how many rows that were, counted on the way."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return seen.get["n"]


def listing(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any store that Spark can read, sorted; none if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, in any store that Spark can write."""
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = to.getFileSystem(spark._jsc.hadoopConfiguration()).create(to, True)
    out.write(bytearray(text.encode()))
    out.close()


def positioned(df: DataFrame, order: list[str], name: str = "pos") -> DataFrame:
    """df with its place, gapless from 0, in the order of unique columns: a range sort, and the sums of the
    partitions before. No window sees more than a row for each partition."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(ranged.withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", ROW_BITS)
    counts = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    joined = rows.withColumn("_part", part).join(F.broadcast(bases), "_part")
    return joined.withColumn(name, (F.col("_base") + F.col("_mid").bitwiseAND((1 << ROW_BITS) - 1)).cast("long")).drop("_part", "_mid", "_base")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt out by a key over all cores where it is read in fewer partitions than that: a table of one small
    file would otherwise be worked on by one core. A table in many splits is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df

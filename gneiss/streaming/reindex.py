"""Incremental re-indexing of a growing folder (H14): a file stream with an upsert for each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def document_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def reindex_stream(
    docs: DataFrame, index_of: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, seconds: int | None = None, key: str = "doc"
) -> StreamingQuery:
    """docs (doc, text, and `deleted` if documents go). Each batch's index goes to folder/index/batch=N, and the
    documents that it saw to folder/seen/batch=N, replacing what an earlier try of that batch left: a batch that runs
    twice counts once. A document's latest batch holds (`current`), also where it has no index rows any more."""

    def upsert(batch: DataFrame, n: int) -> None:
        kept = batch.where(~F.coalesce("deleted", F.lit(False))) if "deleted" in batch.columns else batch
        index_of(kept).write.mode("overwrite").parquet(f"{folder}/index/batch={n}")
        batch.select(key).distinct().write.mode("overwrite").parquet(f"{folder}/seen/batch={n}")

    out = docs.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    out = out.trigger(processingTime=f"{seconds} seconds") if seconds else out.trigger(availableNow=True)
    return out.start()


def current(spark: SparkSession, folder: str, key: str = "doc") -> DataFrame:
    """Index rows of each document's latest batch."""
    last = spark.read.parquet(f"{folder}/seen").groupBy(key).agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{folder}/index").join(last, [key, "batch"], "left_semi").drop("batch")


def windowed_counts(events: DataFrame, ts: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of a stream by event-time window; late rows beyond the watermark are dropped by Spark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))

"""Streams: incremental note processing and request queues on Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carrel.functions.hashing import row_hash


def process_stream(spark: SparkSession, folder: str, schema: str, pk: str, key: str, transform: Callable[[DataFrame], DataFrame], dest: str, checkpoint: str):
    """Starts a query that reads new files of a folder, skips rows whose key and hash the destination has, and appends the others.

    The batch number is part of each written folder, so a batch that is run again after a failure overwrites itself.
    """
    rows = spark.readStream.schema(schema).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("_src_hash", row_hash([F.col(c) for c in batch.columns], key)).dropDuplicates([pk, "_src_hash"])
        done = _done(spark, dest, number)
        if done is not None:
            new = new.join(done.select(pk, "_src_hash"), [pk, "_src_hash"], "left_anti")
        out = transform(new)
        out.write.mode("overwrite").parquet(f"{dest}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _done(spark: SparkSession, dest: str, number: int) -> DataFrame | None:
    """What earlier batches have written; None before the first. Anything else that is wrong with the destination is an error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(dest)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path) or not any(s.getPath().getName().startswith("batch=") for s in fs.listStatus(path)):
        return None
    return spark.read.parquet(dest).where(F.col("batch") < number)


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of a stream or table by time window and kind; late rows beyond ``late`` are left out of a stream."""
    d = events.withWatermark(ts, late) if events.isStreaming else events
    return d.groupBy(F.window(ts, length), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")

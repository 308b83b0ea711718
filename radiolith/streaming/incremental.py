"""Incremental audits by Structured Streaming: an extension, since a growing corpus is audited more than once.

A file stream picks up the files that came since the last run and stops (``availableNow``); what it did is in the checkpoint, so a run
that was cut off goes on where it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Rows of Parquet files as they come."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def append_new(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append what is new to a Parquet table, then stop."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def windowed_counts(stream: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and mean value in tumbling windows; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def running_status(stream: DataFrame) -> DataFrame:
    """Files, read and failed, so far: state of one row for each status."""
    return stream.groupBy("status").agg(F.count("*").alias("files"))


def upsert_batches(stream: DataFrame, key: str, order: str, merge, checkpoint: str) -> StreamingQuery:
    """Hand the last row of each key of every micro-batch to ``merge(frame, batch_id)``."""
    from pyspark.sql import Window

    def batch(frame: DataFrame, number: int) -> None:
        last = frame.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
        merge(last, number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

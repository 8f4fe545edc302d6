"""Query-log counters as a stream.

``count_windows`` is the watermarked form for a live dashboard. ``count_deltas`` keeps no state at all: each
micro-batch writes its own counts under its batch number, so a replayed batch overwrites itself and late rows
are never lost; readers add the deltas up.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet", files_per_batch: int = 1000) -> DataFrame:
    """Stream over ``folder/name``, be it a folder of part files, as a cluster writes, or a single file."""
    path = os.path.join(folder, name)
    stored = spark.read.parquet(path)
    reader = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", files_per_batch)
    files = stored.inputFiles()
    if files and all(os.path.basename(f) == name for f in files):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def count_windows(events: DataFrame, keys: list[str], lateness: str = "1 day") -> DataFrame:
    """Daily counts per key with a watermark; in update mode state is dropped once a day is closed."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    counted = stamped.groupBy(F.window("ts", "1 day").alias("w"), *keys).agg(F.count("*").alias("query_count"))
    return counted.select(F.to_date("w.start").alias("date"), *keys, "query_count")


def count_deltas(events: DataFrame, keys: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Write the counts of every micro-batch to ``target/batch=<n>``."""

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy(F.to_date("ts").alias("date"), *keys).agg(F.count("*").alias("query_count"))
        counts.write.mode("overwrite").parquet(os.path.join(target, f"batch={number}"))

    return (
        events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def latest_windows(counted: DataFrame, keys: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Write the windows that each micro-batch changed, in update mode, to ``target/batch=<n>``."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(target, f"batch={number}"))

    return (
        counted.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def read_windows(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The last count written of every window; counts only grow."""
    return spark.read.parquet(target).groupBy("date", *keys).agg(F.max("query_count").alias("query_count"))


def read_counters(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    return spark.read.parquet(target).groupBy("date", *keys).agg(F.sum("query_count").alias("query_count"))

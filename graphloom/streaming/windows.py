"""Windowed counts with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import scratch


def counted_windows(spark: SparkSession, path: str, time: str, width: str, key: str, late: str | None = None) -> DataFrame:
    """(start, ``key``, n): rows of the Parquet files at ``path`` per tumbling window and key.

    ``path`` is a folder or a pattern; a single file has to be given as a pattern. The files are read as a stream until
    all of them are processed. Every call starts from the beginning, in folders of its own; a lost executor only repeats
    tasks. Each micro-batch writes the windows that it changed to the shared folder, under its own number, so that a
    repeated batch replaces its output; the latest row of a window counts. Without ``late`` no row is
    dropped, and the state is one count a window and key; with it (an interval) later rows are dropped and state ends.
    """
    folder = scratch(spark, "stream")
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(path).select(F.col(time).cast("timestamp").alias("_time"), key)
    if late:
        rows = rows.withWatermark("_time", late)
    counts = rows.groupBy(F.window("_time", width).alias("_window"), key).agg(F.count("*").alias("n"))
    changed = counts.select(F.col("_window.start").alias("start"), key, "n")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    changed.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.schema(f"start timestamp, `{key}` {schema[key].dataType.simpleString()}, n long, batch long").parquet(f"{folder}/out")
    return kept.groupBy("start", key).agg(F.max_by("n", "batch").alias("n"))

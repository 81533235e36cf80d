"""Event-time windows over streams: super-observations, time averages and monthly sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.diagnostics import merge_sums


def assim_window(df: DataFrame, seconds: int, time: str = "ts"):
    """Windows (t - dt/2, t + dt/2] as Spark's [start, end): rows are moved back by a microsecond and windows by half a step."""
    moved = F.timestamp_micros(F.unix_micros(time) - 1)
    half = seconds // 2
    return df.withColumn("__moved", moved), F.window("__moved", f"{seconds} seconds", startTime=f"{half} seconds")


def streaming_super_obs(stream: DataFrame, seconds: int, keys: list[str], means: list[str], late: str = "50 minutes", time: str = "ts") -> DataFrame:
    """Means per analysis window and key. In append mode a window is written once the watermark has passed it, and leaves the
    state; rows that come later are left out."""
    moved, window = assim_window(stream, seconds, time)
    grouped = moved.withWatermark("__moved", late).groupBy(window.alias("w"), *keys).agg(*(F.avg(c).alias(c) for c in means), F.count("*").alias("n"))
    centre = F.timestamp_seconds(F.unix_seconds("w.start") + seconds // 2)
    return grouped.select(centre.alias("analysis_time"), *keys, *means, "n")


def watermarks(df: DataFrame, late_seconds: int, batch: str = "batch", time: str = "ts") -> DataFrame:
    """(batch, watermark): the latest time in the batches before, less the delay; null for the first. One row a batch is sorted."""
    latest = df.groupBy(batch).agg(F.max(F.unix_micros(time)).alias("__t"))
    seen = F.max("__t").over(Window.orderBy(batch).rowsBetween(Window.unboundedPreceding, -1))
    return latest.select(batch, F.timestamp_micros(seen - late_seconds * 1_000_000).alias("watermark"))


def late_rows(df: DataFrame, late_seconds: int, batch: str = "batch", time: str = "ts") -> DataFrame:
    """Rows that are older than the watermark of their batch: what a side table takes."""
    return df.join(watermarks(df, late_seconds, batch, time), batch).where(F.col(time) < F.col("watermark")).drop("watermark")


def streaming_time_average(stream: DataFrame, seconds: int, keys: list[str], values: list[str], late: str = "1 hour", time: str = "ts") -> DataFrame:
    """Means per window and key; in append mode as streaming_super_obs()."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, f"{seconds} seconds").alias("w"), *keys).agg(*(F.avg(v).alias(v) for v in values), F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), *keys, *values, "n")


def replay(spark: SparkSession, pattern: str, schema, files: int = 1) -> DataFrame:
    """A stream over the files that match a pattern, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(pattern)


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over what is there now in append mode, and read what it wrote.

    Each micro-batch writes a part of its own number, so one that is run again after a failure replaces its own part.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/batch={number}")

    stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/table/batch=*")


def incremental_sums(stream: DataFrame, path: str, partial: Callable[[DataFrame], DataFrame], keys: list[str]) -> None:
    """Partial sums of each micro-batch, written once by its number; a repeated batch replaces its own part."""

    def put(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{path}/sums/batch={number}")

    stream.writeStream.option("checkpointLocation", f"{path}/log").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()


def merged(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    return merge_sums(spark.read.parquet(f"{path}/sums").drop("batch"), keys)

"""Streaming ingest of points: full-point de-duplication and windowed counts.

Late rows are dropped in silence by a watermark. A bounded task must not lose points, so the
watermark is at least as long as the task's window; with that, a stream in any order gives
what the batch gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_points(stream: DataFrame, time: str, horizon: str) -> DataFrame:
    """Each complete point once, while its copies come within ``horizon``."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, horizon).dropDuplicatesWithinWatermark()


def windowed_counts(stream: DataFrame, time: str, width: str, horizon: str, by: list[str]) -> DataFrame:
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, horizon)
    counted = rows.groupBy(F.window(time, width).alias("_w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.unix_micros("_w.start").alias("bucket_us"), *by, "n")


def run_available(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Runs the stream over what is there, into Parquet files, and waits for its end."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

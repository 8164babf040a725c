"""The catalogue's streaming queries: bounded streams of a table's rows, run to their end."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions.scratch import work_dir
from meridia.streaming.branches import branch_barrier
from meridia.streaming.ingest import run_available


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream, be it a folder or a file."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()
    source = spark.readStream.schema(schema)  # a stream reads folders: one file is picked out of its own
    return source.parquet(path) if folder else source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def ended_stream(rows: DataFrame, tick: dict, at: str) -> DataFrame:
    """Rows as a stream that ends: they are written, and after them one row that moves the time on."""
    spark = rows.sparkSession
    rows.write.parquet(at)
    last = spark.range(1).select(*((F.lit(tick[f.name]) if f.name in tick else F.lit(None)).cast(f.dataType).alias(f.name) for f in rows.schema.fields))
    last.write.mode("append").parquet(at)
    return spark.readStream.schema(rows.schema).parquet(at)


def hourly_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of distinct points. The events are read as a stream; each micro-batch
    appends its distinct points, and the counts over all are taken at the end, so nothing
    that is late is lost and the last hour is not withheld."""
    source = stream_table(spark, sf_dir, "events")
    points = source.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("ts").cast("timestamp").alias("at"), "event_type", "value")
    once = points.withWatermark("at", "60 days").dropDuplicatesWithinWatermark().drop("at")
    at = work_dir(spark)
    run_available(once, f"{at}/points", f"{at}/checkpoint")
    rows = spark.read.schema("user_id bigint, ts_us bigint, event_type string, value double").parquet(f"{at}/points")
    hour = (F.floor(F.col("ts_us") / 3_600_000_000) * 3_600_000_000).alias("bucket_us")
    return rows.groupBy(hour, "event_type").agg(F.count(F.lit(1)).alias("n"))


def barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of two events each as branches: the even one is the log's end, the odd one the signal's.
    Some jobs lack a branch, some branches fail."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    job = F.floor(F.col("event_id") / 2)
    ends = events.select(job.alias("job"), F.col("ts").cast("timestamp").alias("at"), (F.col("value") >= 8).alias("ok"), (F.col("event_id") % 2).alias("side"))
    at = work_dir(spark)
    tick = {"at": datetime(2200, 1, 1, tzinfo=UTC)}
    sides = [ended_stream(ends.filter(f"side = {k} AND job % {m} <> 4").drop("side"), tick, f"{at}/in-{k}") for k, m in ((0, 7), (1, 9))]
    found = branch_barrier(*sides, "job", "at", "ok", "1 hour", "60 days")
    run_available(found, f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema("job bigint, verdict string, log_us bigint, signal_us bigint").parquet(f"{at}/out")


def followups(spark: SparkSession, sf_dir: str, limit: int = 6 * 3_600_000_000) -> DataFrame:
    """Clicks as questions of their user, the first signup as the report; nothing is answered, so each
    question has its turn and expires."""
    from meridia.streaming.followups import settle_stream

    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type IN ('click', 'signup')")
    kind = F.when(F.col("event_type") == "click", "question").otherwise("report")
    turns = events.select(F.col("user_id").cast("string").alias("job"), kind.alias("kind"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    at = work_dir(spark)
    stream = ended_stream(turns, {"job": "tick", "kind": "report", "at_us": 7_258_118_400_000_000}, f"{at}/in")
    run_available(settle_stream(stream, "60 days", limit), f"{at}/out", f"{at}/checkpoint")
    return spark.read.schema("job string, seq bigint, opened_us bigint, closed_us bigint, result string").parquet(f"{at}/out")


def receipted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through the sink with receipts; what is published, by type, with the receipts' total."""
    from meridia.streaming.receipts import published, receipt_sink, receipts

    source, at = stream_table(spark, sf_dir, "events"), work_dir(spark)
    sink = source.writeStream.foreachBatch(receipt_sink(f"{at}/sink")).option("checkpointLocation", f"{at}/checkpoint")
    sink.trigger(availableNow=True).start().awaitTermination()
    told = receipts(spark, f"{at}/sink").agg(F.sum("rows").alias("receipted"))
    rows = published(spark, f"{at}/sink", source.schema).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"))
    return rows.withColumn("receipted", told.scalar())

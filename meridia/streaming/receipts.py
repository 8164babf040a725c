"""A sink that persists first and publishes second, with a receipt for every batch.

Each micro-batch is written below ``data/batch=<id>``; then what was written is read back, counted and
digested by source file, and compared with the batch itself; only then its receipt appears under
``receipts/batch=<id>``, by one rename. Readers see batches with a receipt alone. A batch that comes
again (a restart after its receipt, before the stream's own checkpoint) is recognised by the receipt
and changes nothing; one that died before its receipt is written anew over its leavings.

Receipts are kept: who received what, by file: (batch, source, rows, digest). The digest is the sum
of the rows' 64-bit hashes, so it doesn't depend on their order; repeated rows count as often as they
occur. Null values have hashes of their own. Empty batches leave a receipt without rows' data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.functions.names import row_order, unused

RECEIPT = "batch long, source string, rows long, digest decimal(38,0)"


def _fs(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    fs, place = _fs(spark, path)
    return fs.exists(place)


def tally(rows: DataFrame, source: str) -> DataFrame:
    """(source, rows, digest) of the rows without their column ``source``."""
    own = rows.drop(source)
    value = row_order(own).cast("decimal(38,0)")
    return rows.select(F.col(source).alias("source"), value.alias("h")).groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("h").cast("decimal(38,0)").alias("digest"))


def receipt_sink(path: str, after_data: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``. ``after_data`` is called between data and receipt (tests
    let it fail there)."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = f"{path}/receipts/batch={number}"
        if _exists(spark, done):
            return
        [source] = unused(batch.columns, "_source")
        at = f"{path}/data/batch={number}"
        sourced = batch.withColumn(source, F.input_file_name())
        sourced.write.mode("overwrite").parquet(at)
        written = spark.read.schema(sourced.schema).parquet(at)
        if after_data:
            after_data(number)
        differ = tally(written, source).exceptAll(tally(sourced, source)).unionByName(tally(sourced, source).exceptAll(tally(written, source)))
        if not differ.isEmpty():
            raise ValueError(f"batch {number}: what was written is not what came")
        staged = f"{path}/staged/batch={number}"
        tally(written, source).coalesce(1).write.mode("overwrite").json(staged)
        fs, place = _fs(spark, staged)
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(done)
        fs.mkdirs(target.getParent())
        if not fs.rename(place, target) and not fs.exists(target):
            raise OSError(f"receipt of batch {number} can't be published")

    return write


def receipts(spark: SparkSession, path: str) -> DataFrame:
    """(batch, source, rows, digest) of all published batches."""
    schema = T.StructType.fromDDL(RECEIPT)
    if not _exists(spark, f"{path}/receipts"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{path}/receipts").json(f"{path}/receipts").select(*schema.names)


def published(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of batches that have a receipt, with batch. Its number is a folder's name, so other
    batches' files aren't opened."""
    if not _exists(spark, f"{path}/data"):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch", T.LongType())]))
    fs, place = _fs(spark, f"{path}/receipts")
    done = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(place)] if fs.exists(place) else []  # a number for each batch
    whole = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(whole).option("basePath", f"{path}/data").parquet(f"{path}/data")
    return rows.filter(F.col("batch").isin(done))

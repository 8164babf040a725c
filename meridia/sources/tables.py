"""Parquet tables with declared columns, and files with their digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, path: str, skip: str = r"/(\.git|__pycache__|test-results)/") -> DataFrame:
    """path, bytes and SHA-256 of every file below a folder, but for skipped ones."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(~F.col("path").rlike(skip))
    return rows.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.col("content"))


def decoded(content: Column) -> Column:
    """Text of a file's bytes: strict UTF-8 without a byte order mark; null if it isn't valid."""
    text = content.cast("binary").cast("string")
    return F.when(F.is_valid_utf8(text), F.regexp_replace(text, "^\ufeff", ""))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, bytes) rows of a JSON manifest {"files": {path: {"sha256", "bytes"}}}."""
    schema = "schema string, version string, files map<string, struct<sha256: string, bytes: bigint>>"
    rows = spark.read.schema(schema).json(path, multiLine=True)
    return rows.select(F.explode("files").alias("path", "_f")).select("path", "_f.sha256", "_f.bytes")


def write_manifest(entries: DataFrame, path: str, version: str) -> None:
    """One JSON object; refuses to overwrite. A manifest is small by nature: one row."""
    listed = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("path"), F.struct("sha256", "bytes").alias("f")))))
    entries.agg(listed.alias("files")).select(F.lit("meridia/1").alias("schema"), F.lit(version).alias("version"), "files").coalesce(1).write.mode("errorifexists").json(path)

"""A data source for text logs of signal points, batch and streaming-ready.

A line is ``<vehicle> <signal> <microseconds> <value>``; blank lines and lines that start
with ``#`` are skipped. Lines that can't be read come out with ``ok`` false and the text, so
nothing is lost in silence. Spark reads the lines (any file system, .gz and .zst too, split
by block); parsing is expressions alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = r"^\s*(\S+)\s+(\S+)\s+(-?\d+)\s+(\S+)\s*$"


def parse_points(lines: DataFrame, column: str = "value") -> DataFrame:
    """vehicle, signal, ts_us, value, ok, line."""
    text = F.col(column)
    group = lambda k: F.regexp_extract(text, LINE, k)
    value = F.expr(f"try_cast(regexp_extract({column}, '{LINE.replace(chr(92), chr(92) * 2)}', 4) as double)")
    ts = F.expr(f"try_cast(regexp_extract({column}, '{LINE.replace(chr(92), chr(92) * 2)}', 3) as bigint)")
    ok = text.rlike(LINE) & value.isNotNull() & ts.isNotNull()
    rows = lines.filter(~text.rlike(r"^\s*(#.*)?$"))
    return rows.select(
        F.when(ok, group(1)).alias("vehicle"), F.when(ok, group(2)).alias("signal"), F.when(ok, ts).alias("ts_us"),
        F.when(ok, value).alias("value"), ok.alias("ok"), text.alias("line"),
    )


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return parse_points(spark.read.text(path))


def stream_points(spark: SparkSession, path: str) -> DataFrame:
    return parse_points(spark.readStream.text(path))

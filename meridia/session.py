"""A session with the settings the library counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "meridia", **conf: str) -> SparkSession:
    """UTC, adaptive execution, bounded Arrow batches. Keyword ``a_b`` overrides ``a.b``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4000",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    settings |= {k.replace("_", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()

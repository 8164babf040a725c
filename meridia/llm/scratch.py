"""Intermediate tables in the folder that all executors share.

A written table cuts the lineage and survives lost executors: a later stage that loses
shuffle files restarts from it and never from the raw text. The folder is the session's
``spark.checkpoint.dir``. Only a session on a local master (tests, a laptop) gets a temporary
folder of its own where that is unset; on a cluster that is an error, as every executor
would write to its own disk. The application's folder is deleted when Python ends; tables
that an operator alone reads go as soon as its result is written (``Workspace``).
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_used: dict[str, tuple[SparkSession, str]] = {}
#: Bytes of an Arrow batch: what a Python worker gets at once.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """URI of this application's scratch folder."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="meridia-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        base = f"file://{_own[app]}"
    elif "://" not in base and base.startswith("/"):
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        base = ("file://" if default.startswith("file:") else default.rstrip("/")) + base
    path = f"{base.rstrip('/')}/meridia-{app}"
    if app not in _used:
        _used[app] = (spark, path)
        atexit.register(_at_exit, app)
    return path


def _at_exit(app: str) -> None:
    with suppress(Exception):  # the session may have gone with its files
        _delete(*_used.pop(app))


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and returns a scan of what was written."""
    return _written(df, new_path(df.sparkSession, name))


class Workspace:
    """Tables of one run of an operator, deleted together once its result is written."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, new_path(spark, name)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return _written(df, f"{self.path}/{name}-{uuid.uuid4().hex[:6]}")

    def drop(self) -> None:
        _delete(self.spark, self.path)


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Bounds the session's Arrow batches in bytes, so that a worker's memory doesn't depend
    on how long the texts of a batch are. A smaller bound that is set already stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now > size:
        spark.conf.set(key, str(size))


def clear(spark: SparkSession) -> None:
    """Deletes the application's scratch tables. Call it once no result still reads them."""
    _delete(spark, shared_dir(spark))

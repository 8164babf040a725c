"""Folders of an operator's or a stream's own, where driver and executors see them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import SparkSession


def _delete(spark: SparkSession, path: str) -> None:
    with suppress(Exception):  # the session may have gone
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def work_dir(spark: SparkSession) -> str:
    """A folder that is deleted when Python ends: in the cluster's shared folder where one is set, which
    only a session on a local master can do without."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        path = f"{base.rstrip('/')}/work/{uuid.uuid4().hex[:12]}"
        atexit.register(_delete, spark, path)
        return path
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="meridia-work-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return own

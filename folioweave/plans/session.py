"""The session's shared folder: checkpoints, and tables that queries write and read again."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to ``spark.checkpoint.dir``; a temporary folder only on one machine where it is unset."""
    if spark.sparkContext.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not found and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="folioweave-"))


def folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one at every call; it goes when the Python process ends, as frames may read it until then."""
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def tables(spark: SparkSession, name: str) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a frame as a table of its own and reads it again, which cuts its lineage; the shuffle files of the step go with its job."""
    root, numbers = folder(spark, name), count()

    def table(df: DataFrame) -> DataFrame:
        path, before = f"{root}/{next(numbers)}", spark.conf.get(_CLEANUP)
        spark.conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.set(_CLEANUP, before)
        return spark.read.schema(df.schema).parquet(path)

    return table


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended: nothing is left to ask
        pass

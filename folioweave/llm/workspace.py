"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: While a step runs: shuffle files go when the job that wrote them has ended, so that the jobs of one operator do
#: not add up on disk; and rows with texts go to Python in small batches.
STEP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only on one machine where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="folioweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def step_settings(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in STEP}
    for k, v in STEP.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Workspace:
    """A folder of Parquet tables: ``put`` cuts the lineage, so a lost executor costs one step at most.

    Tables that the caller drops go at once, the rest when the Python process ends; the frame an
    operator returns may still read them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, name: str, df: DataFrame, **options: str) -> DataFrame:
        with step_settings(self.spark):
            df.write.parquet(self.path(name), **options)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Of the tables with these names, or of all."""
        try:
            jvm = self.spark.sparkContext._jvm
            conf = self.spark.sparkContext._jsc.hadoopConfiguration()
            for p in [self.path(n) for n in names] or [self.root]:
                path = jvm.org.apache.hadoop.fs.Path(p)
                path.getFileSystem(conf).delete(path, True)
        except Exception:  # the session has ended: nothing is left to ask
            pass

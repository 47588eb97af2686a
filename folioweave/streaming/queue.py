"""The import queue as a stream of state changes.

Nothing in the citation model streams; this shows its queue as Structured Streaming would keep it: late changes
within the watermark count, and the last state of each item is upserted from micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def state_counts(changes: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, status, n) of changes (id, status, at): how many items entered each state in each window."""
    return (
        changes.withWatermark("at", late)
        .groupBy(F.window("at", every).alias("w"), "status")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), "status", "n")
    )


def last_states(store: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: hands on the last change of each item in the batch; running a batch again gives the same rows."""

    def batch(df: DataFrame, epoch: int) -> None:
        last = df.groupBy("id").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))
        store(last, epoch)

    return batch

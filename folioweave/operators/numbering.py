"""Numbers for rows in an order, and pages of an order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: list[str], group: list[str] | None = None, name: str = "n") -> DataFrame:
    """The rows with their number from 1, in the order of ``order`` within each group (nulls are a group too).

    Rows are numbered within range partitions and lifted by what the group has in the partitions before, so that a group of any size is
    spread. Ties take any order.
    """
    group = group or []
    ranged = df.repartitionByRange(*group, *order).withColumn("_p", F.spark_partition_id())
    local = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_p", *group).orderBy(*order)))
    sizes = local.groupBy("_p", *group).agg(F.max("_n").alias("_c"))
    before = Window.partitionBy(*group) if group else Window.partitionBy()
    lifted = sizes.select(F.col("_p").alias("_q"), *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), (F.sum("_c").over(before.orderBy("_p")) - F.col("_c")).alias("_o"))
    same = F.col("_p") == F.col("_q")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return local.join(lifted, same).select(*df.columns, (F.col("_o") + F.col("_n")).alias(name))


def stored_in_order(df: DataFrame, order: list[str], path: str) -> None:
    """Writes a table for ``page_of``: range partitions of the order, a folder for each."""
    df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(path)


def page_of(stored: DataFrame, order: list[str], offset: int, length: int) -> DataFrame:
    """Rows ``offset`` to ``offset + length`` of a table of ``stored_in_order``, sorted.

    Ranges are counted from their files' footers; only those that hold the page are read, and only their rows are sorted.
    """
    sizes = sorted((r["_range"], r["n"]) for r in stored.groupBy("_range").agg(F.count("*").alias("n")).collect())
    wanted, skip, at = [], 0, 0
    for range_, n in sizes:
        if at + n > offset and at < offset + length:
            skip = skip if wanted else offset - at
            wanted.append(range_)
        at += n
    return stored.where(F.col("_range").isin(wanted)).drop("_range").orderBy(*order).offset(skip).limit(length)

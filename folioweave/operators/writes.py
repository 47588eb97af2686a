"""Writes as frames: what a table holds after a change, and partitioned replacement on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .numbering import numbered


def inserted(df: DataFrame, path: str) -> None:
    """Rows added to a table."""
    df.write.mode("append").parquet(path)


def cleared(spark: SparkSession, path: str) -> None:
    """All rows of a table gone; its columns stay."""
    spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)


def replace_by_key(df: DataFrame, path: str, key: str = "book_id") -> None:
    """Each key that ``df`` has gets its rows, all others stay: dynamic overwrite of the key's partitions."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def upserted(table: DataFrame, rows: DataFrame, keys: list[str], keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """The table with the rows in place of those with the same keys; a null in ``keep_if_null`` leaves the old value."""
    new = rows.select(*(F.col(c).alias(f"_n_{c}") for c in rows.columns), F.lit(True).alias("_new"))
    on = [F.col(k) == F.col(f"_n_{k}") for k in keys]
    out = table.join(new, on, "full")
    pick = []
    for c in table.columns:
        if c not in rows.columns:
            pick.append(F.col(c))
        elif c in keep_if_null or c in keys:
            pick.append(F.coalesce(f"_n_{c}", c).alias(c))
        else:
            pick.append(F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
    return out.select(*pick)


def deleted(parents: DataFrame, key: str, *children: tuple[DataFrame, str]) -> list[DataFrame]:
    """What is left of child tables (frame, foreign key) when the parents (key) are gone; chain it for grandchildren."""
    gone = parents.select(F.col(key).alias("_gone")).distinct()
    return [c.join(gone, c[fk] == gone["_gone"], "left_anti") for c, fk in children]


def appended(table: DataFrame, rows: DataFrame, order: list[str]) -> DataFrame:
    """The table with new rows, their ids following its largest in the given order.

    Rows are numbered within range partitions and lifted by the sizes of those before, so nothing is sorted in one place.
    """
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    new = numbered(rows, order, name="_id").withColumn("id", (top + F.col("_id")).cast("long"))
    return table.unionByName(new.select(*table.columns))


def supplemented(first: DataFrame, other: DataFrame, key: str = "book_id", order: str = "page_number") -> DataFrame:
    """Books that the other edition has come from it, the rest from the first; pages are numbered anew."""
    taken = other.select(F.col(key).alias("_k")).distinct()
    both = first.join(taken, first[key] == taken["_k"], "left_anti").withColumn("_e", F.lit(0)).unionByName(other.withColumn("_e", F.lit(1)))
    n = F.row_number().over(Window.partitionBy(key).orderBy("_e", order)).cast("int")
    return both.withColumn("_m", n).drop("_e", order).withColumnRenamed("_m", order)

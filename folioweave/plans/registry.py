"""Queries with their DuckDB equivalents, registered side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .model import Library, oracle
from .session import checkpoints

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a function of a ``Library``; sql may name its model tables, which become CTEs."""

    def register(make: Callable[[Library], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            checkpoints(spark)
            return make(Library(spark, sf_dir))

        run.__name__, run.__doc__ = name, make.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return make

    return register

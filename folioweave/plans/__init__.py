"""The citation model over a star schema, and the queries that exercise every operator."""

from . import functional, layouts, readings, relational  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""Filters and scopes. A scope is a function from a frame to a frame; ``scoped`` chains them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_ignoring_case
from ..schema import HIDDEN_STATUSES

Scope = Callable[[DataFrame], DataFrame]


def scoped(df: DataFrame, scopes: Sequence[Scope]) -> DataFrame:
    return reduce(lambda d, s: d.transform(s), scopes, df)


def matching(query: str | None, *columns: str, trim: bool = True) -> Scope:
    """Rows with the query, as it is written, in one of the columns; no query, no filter."""
    q = (query or "").strip() if trim else query or ""

    def scope(df: DataFrame) -> DataFrame:
        return df.where(reduce(Column.__or__, [contains_ignoring_case(F.col(c), q) for c in columns])) if q else df

    return scope


def book_search(query: str | None) -> Scope:
    """By title or author; the query is not trimmed."""
    return matching(query, "title", "author", trim=False)


def citation_search(query: str | None) -> Scope:
    return matching(query, "title", "author", "raw")


def queue_search(query: str | None) -> Scope:
    return matching(query, "title", "author")


def author_search(query: str | None, names: DataFrame) -> Scope:
    """Authors one of whose names has the query."""

    def scope(df: DataFrame) -> DataFrame:
        if not (query or "").strip():
            return df
        hits = names.transform(matching(query, "name")).select(F.col("author_id").alias("_author"))
        return df.join(hits, df["id"] == hits["_author"], "left_semi")

    return scope


def equal_if_given(column: str, value: object) -> Scope:
    return lambda df: df if value is None else df.where(F.col(column) == F.lit(value))


def other_than(column: str, value: object) -> Scope:
    return lambda df: df.where(F.col(column) != F.lit(value))


def with_match(kind: str, column: str = "reference_book_id") -> Scope:
    """all, matched or unmatched citations."""
    kinds: dict[str, Scope] = {"all": lambda df: df, "matched": lambda df: df.where(F.col(column).isNotNull()), "unmatched": lambda df: df.where(F.col(column).isNull())}
    if kind not in kinds:
        raise ValueError(f"match must be one of {', '.join(kinds)}: {kind}")
    return kinds[kind]


def regex_ignoring_case(column: str, pattern: str) -> Scope:
    return lambda df: df.where(F.col(column).rlike(f"(?i){pattern}"))


def none_of(column: str, values: Sequence[str]) -> Scope:
    return lambda df: df.where(~F.col(column).isin(*values))


def has_part(parts: Column, type_: str, value: Column | int) -> Column:
    """Whether a place has the part in any position."""
    return F.exists(parts, lambda p: (p["type"] == type_) & (p["value"] == value))


def latest(checks: DataFrame, key: str = "book_id", order: Sequence[str] = ("created_at", "id")) -> DataFrame:
    """The last row of each key, as an aggregate: partial on the map side, no sort."""
    rest = [c for c in checks.columns if c != key]
    return checks.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(key, "_row.*")


def withheld(checks: DataFrame) -> DataFrame:
    """(book_id): books whose latest check hides them."""
    return latest(checks).where(F.col("status").isin(*HIDDEN_STATUSES)).select("book_id")


def shown(df: DataFrame, checks: DataFrame, column: str = "id") -> DataFrame:
    """Rows whose book is not withheld; a book never checked is shown."""
    hidden = withheld(checks).select(F.col("book_id").alias("_hidden"))
    return df.join(hidden, df[column] == hidden["_hidden"], "left_anti")


def by_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows with one of the key tuples (columns of the same names)."""
    return df.join(keys.distinct(), keys.columns, "left_semi")


def status_rank(status: Column, order: Sequence[str]) -> Column:
    """The position of a status in its vocabulary; others and null come after all."""
    at = F.array_position(F.array(*map(F.lit, order)), status)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(order))).cast("int")


def gate(df: DataFrame, checks: DataFrame, column: str = "id") -> DataFrame:
    """The rows with ``gate``: 451 for those of a withheld book, else 200."""
    hidden = withheld(checks).select(F.col("book_id").alias("_hidden"))
    return df.join(hidden, df[column] == hidden["_hidden"], "left").withColumn("gate", F.when(F.col("_hidden").isNotNull(), 451).otherwise(200)).drop("_hidden")


def checked_int(raw: Column, fallback: int, low: int, high: int) -> Column:
    """``int_param`` of a column: null where the value is refused."""
    n = F.when(raw.rlike(r"^-*[0-9]{1,18}\z"), F.regexp_replace(raw, "^-+", "-").try_cast("long"))
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit(fallback).cast("long")).when(n.between(low, high), n)


def checked_enum(raw: Column, fallback: str, allowed: Sequence[str]) -> Column:
    """``enum_param`` of a column: null where the value is refused."""
    return F.when(F.coalesce(raw, F.lit("")) == "", fallback).when(raw.isin(*allowed), raw)


class NotShown(ValueError):
    """The book is withheld."""


def assert_shown(checks: DataFrame, book_id: str) -> None:
    """Raises ``NotShown`` before a plan over a withheld book is made."""
    if withheld(checks.where(F.col("book_id") == book_id)).limit(1).count():
        raise NotShown(book_id)


def int_param(name: str, raw: str | None, fallback: int, low: int, high: int) -> int:
    if raw is None or raw == "":
        return fallback
    if not raw.lstrip("-").isdecimal() or not low <= int(raw) <= high:
        raise ValueError(f"{name} must be a whole number from {low} to {high}")
    return int(raw)


def enum_param(name: str, raw: str | None, fallback: str, allowed: Sequence[str]) -> str:
    if raw is None or raw == "":
        return fallback
    if raw not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")
    return raw


def id_param(name: str, raw: str) -> int:
    if not raw.isdecimal() or int(raw) < 1:
        raise ValueError(f"{name} must be a positive whole number")
    return int(raw)


def paging(offset: str | None = None, length: str | None = None) -> tuple[int, int]:
    return int_param("offset", offset, 0, 0, 10_000), int_param("length", length, 20, 1, 100)

"""Places: arrays of (type, value), outermost part first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MAX_PARTS, PARTS_SQL


def parts_of(df: DataFrame, n: int = MAX_PARTS) -> DataFrame:
    """part1_type .. partN_value folded to ``parts``; null parts are left out."""
    wide = [c for i in range(1, n + 1) for c in (f"part{i}_type", f"part{i}_value")]
    pairs = ", ".join(f"named_struct('type', part{i}_type, 'value', CAST(part{i}_value AS INT))" for i in range(1, n + 1))
    return df.withColumn("parts", F.expr(f"filter(array({pairs}), p -> p.type IS NOT NULL)")).drop(*wide)


def part_columns(parts: Column, n: int = MAX_PARTS) -> list[Column]:
    """The wide form again: null past the last part."""
    return [F.try_element_at(parts, F.lit(i)).getField(f).alias(f"part{i}_{f}") for i in range(1, n + 1) for f in ("type", "value")]


def checked_parts(parts: Column) -> Column:
    """The parts, of which a stored place has one to eight; fails on others."""
    return F.when(F.assert_true(F.size(parts).between(1, MAX_PARTS), F.lit("a place has 1 to 8 parts")).isNull(), parts)


def starts_with(longer: Column, shorter: Column) -> Column:
    """Whether a list begins with a list; the empty one begins nothing."""
    return (F.size(shorter) > 0) & (F.slice(longer, F.lit(1), F.size(shorter)) == shorter)


def has_all(parts: Column, wanted: Column) -> Column:
    """Whether every wanted part is among the parts, in any position."""
    return F.forall(wanted, lambda w: F.array_contains(parts, w))


def distinct_locations(locations: Column) -> Column:
    """Without repeats, the first of each kept."""
    return F.array_distinct(locations)


#: A list of locations (type, rawLabel, values) as places: the types in the order they come, each with its
#: different 32-bit values, at most eight; a place for every combination.
_VALID = "filter(l.values, v -> v = floor(v) AND v BETWEEN -2147483648 AND 2147483647)"
_TYPED = f"transform({{0}}, l -> named_struct('type', l.type, 'raw', l.rawLabel, 'values', transform({_VALID}, v -> CAST(v AS INT))))"


def places(group: str) -> Column:
    """The places of a location group column: array<struct<raw, parts>>; empty where it cites nothing."""
    kept = f"filter({_TYPED.format(group)}, l -> size(l.values) > 0)"
    # each step is a list of one, so that it is made once however often the next one names it
    types = f"transform(array({kept}), k -> named_struct('kept', k, 'types', slice(array_distinct(transform(k, l -> l.type)), 1, {MAX_PARTS}), 'raw', array_join(array_distinct(transform(k, l -> l.raw)), ', ')))"
    values = "transform(s.types, t -> named_struct('type', t, 'values', array_distinct(flatten(transform(filter(s.kept, l -> l.type = t), l -> l.values)))))"
    crossed = f"""aggregate({values}, CAST(array(array()) AS array<{PARTS_SQL}>), (done, t) -> flatten(transform(done, p -> transform(t.values, v -> concat(p, array(named_struct('type', t.type, 'value', v)))))))"""
    return F.expr(f"get(transform({types}, s -> CASE WHEN size(s.types) = 0 THEN CAST(array() AS array<struct<raw: string, parts: {PARTS_SQL}>>) ELSE transform({crossed}, p -> named_struct('raw', s.raw, 'parts', p)) END), 0)")


def skipped_values(group: str) -> Column:
    """How many values of a location group are no 32-bit integers."""
    return F.expr(f"CAST(aggregate({group}, 0, (n, l) -> n + size(l.values) - size({_VALID})) AS BIGINT)")


def division_types(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, types): the part types of each book's most divided row, the first of them in order."""
    ranked = df.withColumn("depth", F.size("parts"))
    return ranked.groupBy(key).agg(F.max_by(F.transform("parts", lambda p: p["type"]), F.struct("depth", -F.col(order))).alias("types"))

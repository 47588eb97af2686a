"""Mixing sources to target weights by pivotal dependent rounding.

Targets are filled like connected vessels: each source gets words by its weight, none more than ``ceiling``
times its size, and the excess is shared again by weight. A document then takes target / size of its source
copies: the whole part for certain, the rest as a probability. Two probabilities at a time settle: words
move between the two documents, by chance and without bias, until one of them is integral. The sum
of expected words stays what it was, so a source ends within one document of its target.

The pairs settle in groups of about ``FAN`` rows of one source, dealt by a hash of key and text (of the row's place in the
table where it has no key); what is left of each group, one document
at most, goes on to the next level of the tree, and the last one is drawn. Large documents settle
first, so that a small one is left. Chance comes from hashes of keys, so reruns agree.

Sources are few beside documents: their table, a row each, is sorted in one task, which holds for some millions.

Defined results: null and empty texts have size 0 and take nothing; very long texts only count their words, and a source of one
such text takes all or nothing of its fraction; a null source comes last and is a source
of its own; repeated rows, and rows without a key, are documents of their own, equal ones in any order; a source without words
has target 0; columns other than the three are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import blank_words, map_batches
from .workspace import Workspace

WEIGHTS, SHARE, CEILING = (3, 1, 2), 1.5, 2.0
FAN = 1_000
SEED = 5


def sizes(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None) -> DataFrame:
    """(k, source, size, salt[, row]): the number of words ``[^\\x20\\x09-\\x0D]+`` of each row; salt deals rows that share a key."""
    rows = df.select(F.col(key).alias("k"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"), F.when(F.col(key).isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64(text)).alias("salt"), *([F.col(row).alias("row")] if row else []))
    kind = rows.schema[0].dataType.simpleString()
    schema = pa.schema([("k", rows.select("k").limit(0).toArrow().schema[0].type), ("source", pa.string()), ("size", pa.int64()), ("salt", pa.int64()), *([("row", pa.int64())] if row else [])])
    return map_batches(rows, lambda c: c | {"size": [len(blank_words(t)) for t in c["text"]]}, schema, f"k {kind}, source string, size long, salt long" + ", row long" * bool(row))


def targets(by_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(source, source_size, target) from (source, source_size): windows over one row for each source, which spill.

    A source is full when the level (words for each unit of weight) reaches ceiling * size / weight. With the
    sources in the order of those levels, the full ones come first; the level of the others is what
    is left to share over their weights.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = by_source.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(ceiling))).withColumn("level", F.col("cap") / F.col("weight"))
    by_level = Window.orderBy("level", F.asc_nulls_last("source"))
    so_far = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_ = Window.partitionBy()
    shared = weighed.withColumn("all", F.sum("source_size").over(all_) * F.lit(float(share))).withColumn(
        "others", (F.col("all") - F.coalesce(F.sum("cap").over(so_far), F.lit(0.0))) / F.sum("weight").over(rest)
    )
    # the level at which the first source that is not full stands; later ones would give less
    level = F.max(F.when(F.col("others") <= F.col("level"), F.col("others"))).over(all_)
    return shared.withColumn("at", level).select(
        "source", "source_size", F.when(F.col("at").isNull() | (F.col("level") < F.col("at")), F.col("cap")).otherwise(F.col("at") * F.col("weight")).alias("target")
    )


def _chance(*seed: object) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.blake2b(repr(seed).encode(), digest_size=8).digest(), "big"))


def pivot(size: np.ndarray, p: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """p after settling pairs in order: all but at most one are 0 or 1, the sum of size * p is unchanged.

    chance: numbers in [0, 1), one for each step.
    """
    p, held = p.copy(), -1
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        if held < 0:
            held = i
            continue
        j, s, t = held, float(size[held]), float(size[i])
        # j may gain up to a words from i, or lose up to b to it
        a, b = min((1 - p[j]) * s, p[i] * t), min(p[j] * s, (1 - p[i]) * t)
        if chance[i] * (a + b) < b:
            full = (1 - p[j]) * s <= p[i] * t
            p[j], p[i] = (1.0, p[i] - a / t) if full else (p[j] + a / s, 0.0)
        else:
            gone = p[j] * s <= (1 - p[i]) * t
            p[j], p[i] = (0.0, p[i] + b / t) if gone else (p[j] - b / s, 1.0)
        for x in (i, j):
            if p[x] < 1e-12 or p[x] > 1 - 1e-12:
                p[x] = round(p[x])
        held = j if 0 < p[j] < 1 else i if 0 < p[i] < 1 else -1
    return p


_ROW = "k {kind}, source string, size long, salt long, p double, n long, groups long, open boolean"


def _level(rows: DataFrame, level: int, seed: int, kind: str, fan: int) -> DataFrame:
    """Every group of each source settled; ``open`` marks the one row of a group that still has a fraction.

    groups: into how many groups the row's source is dealt; with one, the last fraction is drawn.
    """

    def settle(table: pa.Table) -> pa.Table:
        source, g, last = table["source"][0].as_py(), table["g"][0].as_py(), table["groups"][0].as_py() == 1
        size, tie = table["size"].to_numpy(), table["tie"].to_numpy()
        order = np.lexsort((tie, -size))
        table = table.take(pa.array(order))
        p = pivot(size[order], table["p"].to_numpy(), _chance(seed, level, source, g).random(len(order)))
        still = (p > 0) & (p < 1)
        if last:
            p = np.where(still, _chance(seed, "last", source, g).random(len(p)) < p, p).astype(float)
            still = np.zeros(len(p), bool)
        later = pa.array([-(-x // fan) for x in table["groups"].to_pylist()], pa.int64())
        rest = [table["row"]] if "row" in table.column_names else []
        return pa.table([table["k"], table["source"], table["size"], table["salt"], pa.array(p), table["n"], later, pa.array(still), *rest], names=["k", "source", "size", "salt", "p", "n", "groups", "open", *["row"] * len(rest)])

    spread = rows.withColumn("tie", F.xxhash64("k", "salt", F.lit(seed))).withColumn("g", F.pmod(F.xxhash64("k", "salt", F.lit(seed + 1 + level)), F.col("groups")))
    return spread.groupBy("source", "g").applyInArrow(settle, _ROW.format(kind=kind) + ", row long" * ("row" in rows.columns))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING, seed: int = SEED, fan: int = FAN, row: str | None = None) -> DataFrame:
    """(key, source, size, source_size, target, copies, taken[, row]) of each row; row: a column of longs that tells rows apart."""
    spark = df.sparkSession
    work = Workspace(spark, "mixing")
    rows = work.put("sizes", sizes(df, key, text, source, row))
    kind = rows.schema[0].dataType.simpleString()
    counted = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.count("*") / fan).alias("groups"))
    counted = work.put("sources", counted)
    goal = targets(counted.select("source", "source_size"), weights, share, ceiling)
    groups = counted.select(F.col("source").alias("_s"), "groups")
    named = work.put("targets", goal.join(groups, F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_source"), "source_size", "target", "groups"))
    each = rows.join(named, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    )
    # a document without words is settled as it is
    fraction = F.when(F.col("size") > 0, F.col("rate") - F.floor("rate")).otherwise(F.lit(0.0))
    now = each.select("k", "source", "size", "salt", fraction.alias("p"), F.floor("rate").cast("long").alias("n"), "groups", *(["row"] if row else []))
    settled, level = [now.filter("p = 0")], 0  # nothing to draw: these rows do not travel
    now = now.filter("p > 0")
    while True:
        done = work.put(f"level={level}", _level(now, level, seed, kind, fan))
        settled.append(done.filter("not open").drop("open"))
        now, level = done.filter("open").drop("open"), level + 1
        if not now.limit(1).count():
            break
    out = reduce(DataFrame.unionByName, settled).withColumn("copies", F.col("n") + F.col("p").cast("long")).drop("groups")
    return out.join(named, F.col("source").eqNullSafe(F.col("_source"))).select(F.col("k").alias(key), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *([F.col("row").alias(row)] if row else []))

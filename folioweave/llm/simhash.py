"""Near-duplicates by SimHash, found by meet-in-the-middle ball hashing.

Two fingerprints within ``2 * half`` bits have a word between them that is within ``half`` bits of each. So
every distinct fingerprint emits all words within ``half`` bits of it (2081 for half = 2), and the fingerprints
that meet at a word are linked, each of them, since the distance to the word bounds theirs: a meeting needs no
list of pairs, only a star to its smallest member. A word is met by at most 2081 distinct fingerprints,
so no key of this shuffle can be hot, however many copies a text has.

The words travel as packed arrays, a row for each batch and range of words, in ``ROUNDS`` rounds over equal
parts of the 64-bit space, each ending with its links on disk; the shuffle of one round is gone before the next.

Defined results: texts without words (null, empty) have fingerprint zero and link like any other; repeated
rows give repeated rows; rows with a null key have a null component unless a keyed row shares it; other
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .text import map_batches, mix
from .workspace import Workspace

SHINGLE, SEED, RADIUS = 4, 42, 4
ROUNDS = 4
#: Words in a group of the meeting shuffle, about; 10 bytes each.
GROUP_WORDS = 2_000_000
_BATCH = 1000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Of a whole text: bit i is one if it is set in more than half of the shingles' hashes, repeats counted."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), seed)
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=False)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp): the fingerprint as a signed long."""
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("text"))
    schema = pa.schema([("k", rows.select("k").limit(0).toArrow().schema[0].type), ("fp", pa.int64())])

    def work(cols: dict[str, list]) -> dict[str, list]:
        return {"k": cols["k"], "fp": np.array([fingerprint(t, shingle) for t in cols["text"]], np.uint64).view(np.int64)}

    return map_batches(rows, work, schema, f"k {rows.schema[0].dataType.simpleString()}, fp long").withColumnRenamed("k", key)


def masks(half: int) -> np.ndarray:
    """All words of at most ``half`` one bits."""
    return np.array([sum(1 << b for b in c) for n in range(half + 1) for c in combinations(range(64), n)], np.uint64)


def _emit(fps: DataFrame, half: int, round_: int, rounds: int, groups: int) -> DataFrame:
    """(g, words, flips): the words of a batch that fall into this round and group."""
    schema = pa.schema([("g", pa.int32()), ("words", pa.binary()), ("flips", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = masks(half)
        for batch in batches:
            all_fps = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(all_fps), _BATCH):
                words = mix(all_fps[i : i + _BATCH, None] ^ flips[None, :]).ravel()
                # top bits choose the round, those below them the group: both even, as mix is a bijection
                share = (words >> np.uint64(32)) * np.uint64(rounds)
                here = np.flatnonzero((share >> np.uint64(32)) == np.uint64(round_))
                words, share = words[here], share[here]
                g = (((share & np.uint64(0xFFFFFFFF)) * np.uint64(groups)) >> np.uint64(32)).astype(np.uint16 if groups <= 1 << 16 else np.uint32)
                order = np.argsort(g, kind="stable")
                flip = (here[order] % len(flips)).astype(np.uint16 if len(flips) <= 1 << 16 else np.uint32)
                words, g = words[order], g[order]
                firsts = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.empty(0, int)
                ends = np.append(firsts[1:], len(g))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[firsts].astype(np.int32)), pa.array([words[a:b].tobytes() for a, b in zip(firsts, ends, strict=True)], pa.binary()), pa.array([flip[a:b].tobytes() for a, b in zip(firsts, ends, strict=True)], pa.binary())],
                    schema=schema,
                )

    return fps.mapInArrow(run, "g int, words binary, flips binary")


def _unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mix``."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    x = x ^ (x >> np.uint64(29)) ^ (x >> np.uint64(58))
    x = x * np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    return x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))


def _meet(sent: DataFrame, half: int) -> DataFrame:
    """(a, b): of each word that several fingerprints sent, its smallest one beside each other one."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    wide = np.uint16 if len(masks(half)) <= 1 << 16 else np.uint32

    def run(table: pa.Table) -> pa.Table:
        words = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("words")])
        flips = np.concatenate([np.frombuffer(x.as_py(), wide) for x in table.column("flips")])
        ordered = np.sort(words)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if not len(again):
            return schema.empty_table()
        at = np.minimum(np.searchsorted(again, words), len(again) - 1)
        hit = np.flatnonzero(again[at] == words)
        at, fp = at[hit], (_unmix(words[hit]) ^ masks(half)[flips[hit]]).view(np.int64)
        order = np.lexsort((fp, at))
        at, fp = at[order], fp[order]
        first = np.append(True, at[1:] != at[:-1])
        least = fp[first][np.cumsum(first) - 1]
        links = np.unique(np.stack([least, fp], 1)[fp != least], axis=0)
        return pa.table([links[:, 0], links[:, 1]], schema=schema)

    return sent.groupBy("g").applyInArrow(run, "a long, b long")


def links(fps: DataFrame, work: Workspace, radius: int = RADIUS, rounds: int = ROUNDS, group_words: int = GROUP_WORDS) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints (column ``fp``, no repeats) within an even radius."""
    half = radius // 2
    total = fps.count() * len(masks(half))
    groups = max(1, -(-total // (rounds * group_words)))
    fps = fps.select("fp").repartition(max(1, -(-total // (4 * group_words))), "fp")
    for i in range(rounds):
        work.put(f"links/round={i}", _meet(_emit(fps, half, i, rounds, groups), half))
    return fps.sparkSession.read.schema("a long, b long").parquet(*[work.path(f"links/round={i}") for i in range(rounds)]).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(key, fp, component_id): the component is the smallest key that is reachable over links."""
    spark = df.sparkSession
    work = Workspace(spark, "simhash")
    prints = work.put("fingerprints", fingerprints(df, key, text, shingle))
    distinct = work.put("distinct", prints.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(links(distinct, work, radius), work)
    rooted = work.put("rooted", distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = work.put("least", rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = work.put("named", rooted.join(least, "root").select("fp", "component_id"))
    return prints.join(named, "fp").select(key, "fp", "component_id")


def keep(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df``, with their own columns, that come first in their component; the key must be unique and not null."""
    later = near_duplicates(df, key, text, **options).filter(F.col(key) != F.col("component_id")).select(F.col(key).alias("_later"))
    return df.join(later, df[key] == later["_later"], "left_anti")

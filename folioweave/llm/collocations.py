"""Phrases whose words keep company: level-wise counts, scored at their weakest cut.

Level k holds the phrases of k words that occur at least ``LEAST`` times in their language. A phrase can be one only if both phrases of k - 1 words
that overlap in it are, so a task emits those whose two parts the level below may hold. The level below reaches the tasks as a
filter of bits over hashes of its phrases, at most ``FILTER_BYTES`` whatever the corpus: its table would grow with the corpus, and
a broadcast of it could not be bounded. A filter lets a few phrases more through, never one less, and each level is counted by Spark over the phrases themselves and cut at
``LEAST`` afterwards, so that results do not depend on it. Tasks sum a slice of texts before anything travels. Scores come from joins with the level tables.

Defined results: null and empty texts have no words; a null language is ``und``; repeated rows count each; pieces end at marks, so
no phrase goes over one; very long texts are read in slices that end at marks; ties go to the smallest cut and, between phrases, to byte order; other columns are
ignored, whatever their names; an empty table gives an empty one. Sums and products are exact (decimals where 64 bits may not do).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .decontaminate import passing, print_filter
from .text import mix
from .workspace import Workspace

LEAST, LONGEST, TOP = 30, 4, 2000
#: A phrase inside a longer one goes if that has this share (in hundredths) of its occurrences.
INSIDE = 80
FILTER_BYTES = 32 << 20
#: Texts are counted together in slices of about this many bytes; a longer text is cut at marks.
SLICE_BYTES = 24 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: A-Z to lower case, a tab to a space, all that ends a piece to a full stop.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x2E if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b for b in range(256))


class _Numbers(dict):
    """Words in the order in which they were met; the end of a piece is number 0."""

    def __init__(self) -> None:
        super().__init__({b".": 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found


def _cuts(raw: bytes, most: int = 4 << 20) -> Iterator[bytes]:
    """The text in parts that end where a piece does."""
    at = 0
    while len(raw) - at > most:
        end = raw.find(b".", at + most)
        if end < 0:
            break
        yield raw[at : end + 1]
        at = end + 1
    yield raw[at:]


def _prints(hashes: np.ndarray, k: int, salt: np.uint64) -> np.ndarray:
    """A hash of each k consecutive words of a language."""
    n = len(hashes) - k + 1
    h = np.full(max(n, 0), salt, np.uint64)
    for i in range(k if n > 0 else 0):
        h = h * _ODD + hashes[i : i + n]
    return mix(h)


def _salt(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


class _Slice:
    """Words of some texts of one language, as numbers."""

    def __init__(self, lang: str):
        self.lang, self.size, self.numbers, self.parts = lang, 0, _Numbers(), []

    def add(self, text: str) -> None:
        raw = text.encode().translate(_FOLD)
        self.size += len(raw)
        for part in _cuts(raw):
            words = part.replace(b".", b" . ").split(b" ")
            found = np.fromiter(map(self.numbers.__getitem__, filter(None, words)), np.int32)
            self.parts += [found, np.zeros(1, np.int32)]

    def phrases(self, k: int, known: tuple[np.ndarray, int] | None) -> tuple[pa.Array, np.ndarray]:
        """The different phrases of k words of which both parts may be frequent, and how often each occurs."""
        ids = np.concatenate(self.parts) if self.parts else np.empty(0, np.int32)
        words = list(self.numbers)
        names = pa.array(words, pa.binary())
        if k == 1:
            times = np.bincount(ids, minlength=len(words))
            times[0] = 0
            some = np.flatnonzero(times)
            return names.take(pa.array(some)), times[some]
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        n = len(ids) - k + 1
        if n <= 0:
            return names[:0], np.empty(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(ids == 0)])
        within = np.flatnonzero(ends[k:] == ends[:-k])
        if k == 2:  # a word passes or not wherever it stands
            may = passing(_prints(hashes, 1, _salt(self.lang)), *known)[ids]
        else:
            may = np.zeros(n + 1, bool)
            may[within] = may[within + 1] = True
            may[may] = passing(_prints(hashes[ids], k - 1, _salt(self.lang))[may], *known)
        at = within[may[within] & may[within + 1]]
        codes = ids[at].astype(np.int64)
        for j in range(1, k):
            codes = codes * len(words) + ids[at + j]
            if j < k - 1:
                codes = np.unique(codes, return_inverse=True)[1]
        _, first, times = np.unique(codes, return_index=True, return_counts=True)
        return pc.binary_join_element_wise(*(names.take(pa.array(ids[at[first] + j])) for j in range(k)), b" "), times


def _emitted(df: DataFrame, k: int, known: Broadcast | None, lang: str, text: str) -> DataFrame:
    """(lang, phrase, n) of slices of texts."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def out(part: _Slice) -> Iterator[pa.RecordBatch]:
        found, times = part.phrases(k, known.value if known else None)
        for i in range(0, len(found), 20_000):
            some = found.slice(i, 20_000).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(part.lang, pa.string()), len(some)), some, pa.array(times[i : i + 20_000], pa.int64())], schema=schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, _Slice] = {}
        size = 0
        for batch in batches:
            for l, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):  # noqa: E741
                part = open_.setdefault(l, _Slice(l))
                part.add(t)
                size += len(t)
                if size >= SLICE_BYTES:
                    for p in open_.values():
                        yield from out(p)
                    open_, size = {}, 0
        for p in open_.values():
            yield from out(p)

    rows = df.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.col(text).alias("text")).where("text is not null and text <> ''")
    return rows.mapInArrow(run, "lang string, phrase string, n long")


def _filter(level: DataFrame, k: int) -> tuple[np.ndarray, int]:
    """The bits of a level's phrases."""
    schema = pa.schema([("fingerprint", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = np.array([xxhash.xxh3_64_intdigest(w) for w in phrase.encode().split(b" ")], np.uint64)
                found.append(_prints(words, k, _salt(lang)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], schema=schema)

    return print_filter(level.select("lang", "phrase").mapInArrow(run, "fingerprint long"), FILTER_BYTES)


def levels(df: DataFrame, work: Workspace, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of the frequent phrases of up to ``longest`` words, and (lang, n) with all words."""
    spark, known, found, totals = df.sparkSession, None, None, None
    for k in range(1, longest + 1):
        counted = _emitted(df, k, known, lang, text).groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if k == 1:
            counted = work.put("words", counted)
            totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
        level = work.put(f"level{k}", counted.where(F.col("f") >= least).select("lang", F.lit(k).alias("words"), "phrase", "f"))
        found = level if found is None else found.unionByName(level)
        if known is not None:
            known.destroy()
        known = spark.sparkContext.broadcast(_filter(level, k)) if k < longest else None
    return found, totals


def collocations(df: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best ``top`` phrases."""
    work = Workspace(df.sparkSession, "collocations")
    level, totals = levels(df, work, lang, text, least, longest)
    candidates = level.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cut = candidates.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("rest"))
    sides = cut
    for side, f in (("first", "l"), ("rest", "r")):
        known = level.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("f").alias(f))
        sides = sides.join(known, (F.col("lang") == F.col("_lang")) & (F.col(side) == F.col("_phrase"))).drop("_lang", "_phrase")
    score = F.expr("cast((cast(a as decimal(38,0)) * 2000000) div (cast(l as decimal(38,0)) + r) as long)")
    weakest = sides.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # what a longer candidate has of the occurrences of each phrase inside it
    inner = candidates.where("size(w) > 2").select("lang", "a", "w", F.explode(F.sequence(F.lit(2), F.size("w") - 1)).alias("s"))
    inner = inner.select("lang", "a", "w", "s", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("s") + 1)).alias("i")).select(F.col("lang").alias("_lang"), part(F.col("i"), F.col("s")).alias("_phrase"), "a")
    longer = inner.groupBy("_lang", "_phrase").agg(F.max("a").alias("longer"))
    met = weakest.join(longer, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left")
    hundred = F.expr("cast(longer as decimal(38,0)) * 100"), F.expr(f"cast(a as decimal(38,0)) * {INSIDE}")
    kept = met.where(F.col("longer").isNull() | (hundred[0] < hundred[1])).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    best = (F.desc("score"), F.desc("a"), "phrase")
    # no task gets a whole language: the best of its parts first
    dealt = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = dealt.withColumn("_n", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*best))).where(F.col("_n") <= top).drop("_n", "_part")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals.withColumnRenamed("lang", "_l"), F.col("lang") == F.col("_l")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

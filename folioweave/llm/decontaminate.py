"""Benchmark decontamination by winnowed fingerprints.

Of every ``WINDOW`` consecutive k-gram hashes the smallest is kept; K + WINDOW - 1 = SPAN, so that each window of SPAN words
has one kept fingerprint, the same on both sides. Three tables are made of the benchmark: its fingerprints, its different windows (a
row for each window of words, however many items open with it), and which items have a window. A document's windows whose fingerprint
the benchmark has are joined to the benchmark's windows by the digest of all their words, so a meeting is confirmed by the join
itself and a document's window meets one row at most; hits that overlap grow into runs. Items of fewer than SPAN words
are one window of their own length.

The fingerprints reach the documents as a filter of bits: at most ``FILTER_BYTES``, whatever the benchmark's size, and built by
aggregation. A full filter lets more windows through to the join, and drops none. Texts do not travel, and windows travel only if they pass the filter.

Defined results: null and empty texts have no words, no hits and are not contaminated; repeated rows get the
same result each; items without words or without an id hit nothing; an item id counts once however many
rows it has; very long texts are read whole, and only their hits are kept; empty tables on either side are allowed;
only the key and text columns are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import map_batches, mix, plain_words
from .workspace import Workspace

SPAN, K = 13, 8
WINDOW = SPAN - K + 1
#: The largest filter, and its bits for each fingerprint while it may still grow.
FILTER_BYTES, FILTER_BITS = 32 << 20, 32
#: Words whose hashes a task remembers.
WORDS = 500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Words to 64-bit hashes; starts again when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


def _grams(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * _ODD + ids[i : i + n]
    return mix(h + np.uint64(k))


def _winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Of each window the place of its smallest hash, of equal ones the last."""
    n = len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at = h[:n].copy(), np.arange(n)
    for i in range(1, window):
        later = h[i : i + n] <= best
        best[later] = h[i : i + n][later]
        at[later] = np.flatnonzero(later) + i
    return at


def fingerprints(ids: np.ndarray, span: int) -> np.ndarray:
    """The fingerprint of each window of ``span`` words: its least k-gram, or a short window as a whole."""
    if span < SPAN:
        return _grams(ids, span)
    h = _grams(ids, K)
    return h[_winnow(h, WINDOW)]


def digests(words: list[bytes], places: list[int], span: int) -> list[bytes]:
    """128-bit digests of the windows of ``span`` words that start at ``places``."""
    return [xxhash.xxh3_128_digest(b" ".join(words[p : p + span])) for p in places]


def item_windows(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, span, fingerprint, digest): each different window of each item."""
    rows = benchmark.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text")).filter("item is not null and text is not null")
    schema = pa.schema([("item", pa.string()), ("span", pa.int32()), ("fingerprint", pa.int64()), ("digest", pa.binary())])

    def work(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in schema.names}
        hashes = _Hashes()
        for item, t in zip(cols["item"], cols["text"], strict=True):
            if words := plain_words(t):
                span = min(SPAN, len(words))
                prints = fingerprints(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), span)
                out["item"] += [item] * len(prints)
                out["span"] += [span] * len(prints)
                out["fingerprint"] += prints.view(np.int64).tolist()
                out["digest"] += digests(words, range(len(prints)), span)
        return out

    return map_batches(rows, work, schema, "item string, span int, fingerprint long, digest binary").distinct()


def print_filter(windows: DataFrame, most: int = FILTER_BYTES) -> tuple[np.ndarray, int]:
    """(words of bits, log2 of the number of bits) of the fingerprints, two bits each; summed by Spark, at most ``most`` bytes."""
    prints = windows.select("fingerprint").distinct()
    n = prints.count()
    size = max(6, min((n * FILTER_BITS - 1).bit_length(), most.bit_length() + 2))
    places = prints.select(F.explode(F.array(F.shiftrightunsigned("fingerprint", 64 - size), F.col("fingerprint").bitwiseAND((1 << size) - 1))).alias("p"))
    held = places.groupBy(F.shiftrightunsigned("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (size - 6), np.int64)
    out[held["w"].to_numpy()] = held["bits"].to_numpy()
    return out.view(np.uint64), size


def passing(prints: np.ndarray, bits: np.ndarray, size: int) -> np.ndarray:
    """Which fingerprints the filter has, and perhaps a few others."""
    ok = np.ones(len(prints), bool)
    for p in (prints >> np.uint64(64 - size), prints & np.uint64((1 << size) - 1)):
        ok &= (bits[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return ok


def _scan(rows: DataFrame, known: Broadcast, spans: list[int]) -> DataFrame:
    """(k, row, n_words, found): the windows of each document that the filter lets through. rows: (k, row, text)."""
    hit = pa.list_(pa.struct([("at", pa.int32()), ("span", pa.int32()), ("digest", pa.binary())]))
    schema = pa.schema([("k", rows.select("k").limit(0).toArrow().schema[0].type), ("row", pa.int64()), ("n_words", pa.int64()), ("found", hit)])
    hashes = _Hashes()

    def found(words: list[bytes]) -> Iterator[dict[str, object]]:
        ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        for span in spans:
            places = np.flatnonzero(passing(fingerprints(ids, span), *known.value)).tolist()
            for p, d in zip(places, digests(words, places, span), strict=True):
                yield {"at": p, "span": span, "digest": d}

    def work(cols: dict[str, list]) -> dict[str, list]:
        words = [plain_words(t) for t in cols["text"]]
        return {"k": cols["k"], "row": cols["row"], "n_words": list(map(len, words)), "found": [list(found(w)) for w in words]}

    kind = rows.schema[0].dataType.simpleString()
    return map_batches(rows, work, schema, f"k {kind}, row long, n_words long, found array<struct<at: int, span: int, digest: binary>>")


#: Words that lie in any of the hits, which are sorted by their start.
_HIT = "aggregate(array_sort(hits), named_struct('n', 0L, 'to', 0L), (s, h) -> named_struct('n', s.n + greatest(0L, h.at + h.span - greatest(h.at, s.to)), 'to', greatest(s.to, cast(h.at + h.span AS bigint))), s -> s.n)"


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(key, n_words, n_hit, n_items, item_ids, items_sha256, contaminated) of each document row."""
    spark = docs.sparkSession
    work = Workspace(spark, "winnow")
    windows = work.put("windows", item_windows(benchmark, item_key, item_text))
    spans = sorted(r.span for r in windows.select("span").distinct().collect())
    known = spark.sparkContext.broadcast(print_filter(windows, filter_bytes))
    rows = docs.select(F.col(key).alias("k"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    scanned = work.put("scanned", _scan(rows, known, spans))
    met = scanned.filter("size(found) > 0").select("row", F.explode("found").alias("f")).select("row", "f.at", "f.span", "f.digest")
    # which windows are the benchmark's, a row each, and by which items: equal sets of items are one set
    asked = met.select(F.col("digest").alias("d")).distinct()
    of = windows.join(asked, F.col("digest") == F.col("d"), "left_semi").groupBy("digest").agg(F.array_sort(F.collect_set("item")).alias("items"))
    named = work.put("named", of.select(F.col("digest").alias("d"), F.xxhash64("items").alias("set"), "items"))
    hits = met.join(named.select("d", "set"), F.col("digest") == F.col("d"))
    by_row = work.put("hits", hits.groupBy("row").agg(F.collect_set(F.struct("at", "span")).alias("hits"), F.collect_set("set").alias("sets")))
    sets = named.groupBy("set").agg(F.first("items").alias("items")).withColumnRenamed("set", "_set")
    items = by_row.select("row", F.explode("sets").alias("set")).join(sets, F.col("set") == F.col("_set")).select("row", F.explode("items").alias("item")).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    judged = work.put("judged", by_row.select("row", F.expr(_HIT).alias("n_hit")).join(items, "row").withColumnRenamed("row", "_row"))
    work.drop("windows", "named", "hits")
    out = scanned.select("k", "row", "n_words").join(judged, F.col("row") == F.col("_row"), "left")
    none = F.array().cast("array<string>")
    return out.select(F.col("k").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids")).select(
        key,
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        "item_ids",
    )


def keep(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with their own columns, that are not contaminated; a row is judged by its text, whatever its key, and rows without a key are kept or go like others."""
    # the verdict is the text's; the key is in the name so that copies under many keys are spread
    name = F.concat(F.sha2(F.coalesce(F.col(text), F.lit("")), 256), F.coalesce(F.col(key).cast("string"), F.lit("")))
    bad = contamination(docs.select(name.alias("_name"), F.col(text).alias("_read")), benchmark, "_name", "_read", **options).filter("contaminated").select(F.col("_name").alias("_bad")).distinct()
    # written first: how large it is decides how it meets the documents
    bad = Workspace(docs.sparkSession, "winnow").put("bad", bad)
    return docs.join(bad, name == F.col("_bad"), "left_anti")

"""Substring deduplication by hashed units of a line.

A line is cut into units, after each run of ``.!?,;:`` or line feeds; a unit is normalised (the marks dropped, A-Z lower-cased,
runs of white space made one space, trimmed) and digested. Of equal digests the occurrence that ranks first, by key and then by
place in the text, stays. The others are repeats, and a run of repeats goes, from its first unit to its last, if it has
``LEAST`` words or more: short phrases recur in any prose, and cutting them would leave holes in documents of their own. Units
are parts of lines because a passage that is set inside other text shares no whole line with it.

Only digests that occur again are joined back to their units, so that what is unique never travels twice; a digest
that a third of all units have is counted before it travels and its join is split by Spark.

Defined results: a null text has no units and stays null; pieces without a word (empty lines) go with the run that they stand in
or next to, and stay otherwise; texts under a null key take no part and stay; exact repeats of a row are one document, different
texts under one key are told apart by their hash, the smaller first; very long texts are read whole, a row of (digest, place)
for each unit; extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import pieces
from .workspace import Workspace

#: Words that a run of repeats has at least.
LEAST = 15
MARKS = ".!?,;:\n"
_PIECE = re.compile(rf"[^{MARKS}]*[{MARKS}]+|[^{MARKS}]+")


def units(text: str | None) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first, end, words) of the pieces of a text, which they cover; offsets in code points."""
    for m in _PIECE.finditer(text or ""):
        yield m.start(), m.end(), m[0].rstrip(MARKS).encode().lower().split()


def runs(text: str | None, again: set[int], least: int = LEAST) -> tuple[int, int, list[tuple[int, int]]]:
    """(units, units removed, removed spans) of a text whose units that start at ``again`` are repeats."""
    n, gone, spans = 0, 0, []
    first, last, size, held = 0, 0, 0, 0

    def close() -> int:
        if size >= least:
            spans.append((first, last))
            return held
        return 0

    for a, b, words in units(text):
        n += bool(words)
        if words and a not in again:
            gone += close()
            first, size, held = b, 0, 0
        else:
            size, held = size + len(words), held + bool(words)
        last = b
    return n, gone + close(), spans


def without(text: str, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return "".join([*out, text[at:]])


def repeated_units(df: DataFrame, work: Workspace, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, tag, again): where units of a document start that an earlier one has too. tag: a hash of the text."""
    rows = df.select(F.col(key).alias("doc"), F.col(text).alias("text")).filter("doc is not null and text is not null")
    kind = rows.schema[0].dataType.simpleString()
    schema = pa.schema([("doc", rows.select("doc").limit(0).toArrow().schema[0].type), ("tag", pa.int64()), ("first", pa.int32()), ("digest", pa.binary())])
    digest = xxhash.xxh3_128_digest

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                found = [[(a, digest(b" ".join(words))) for a, _, words in units(t) if words] for t in part.column(1).to_pylist()]
                of = pa.array([i for i, f in enumerate(found) for _ in f], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(of), part.column(2).take(of), pa.array([a for f in found for a, _ in f], pa.int32()), pa.array([d for f in found for _, d in f], pa.binary())], schema=schema)

    every = work.put("units", rows.withColumn("tag", F.xxhash64("text")).mapInArrow(run, f"doc {kind}, tag long, first int, digest binary"))
    rank = F.struct("doc", "tag", "first")
    leads = work.put("leads", every.groupBy("digest").agg(F.min(rank).alias("lead"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("d"), "lead"))
    later = every.join(leads, F.col("digest") == F.col("d")).filter(F.struct("doc", "tag", "first") != F.col("lead"))
    return work.put("again", later.groupBy("doc", "tag").agg(F.collect_set("first").alias("again")))


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, n_units, n_removed, spans, kept) of each row: spans are removed [first, end) in code points of the text."""
    work = Workspace(df.sparkSession, "lines")
    known = repeated_units(df, work, key, text).withColumnsRenamed({"doc": "_doc", "tag": "_tag"})
    work.drop("units", "leads")
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("text"), F.xxhash64(text).alias("tag"))
    joined = rows.join(known, (F.col("k") == F.col("_doc")) & (F.col("tag") == F.col("_tag")), "left").select("k", "text", "again")
    kind = rows.schema[0].dataType.simpleString()
    span = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("k", rows.select("k").limit(0).toArrow().schema[0].type), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("kept", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                texts = part.column(1).to_pylist()
                found = [runs(t, set(again or ()), least) for t, again in zip(texts, part.column(2).to_pylist(), strict=True)]
                kept = [t if not spans else without(t, spans) for t, (_, _, spans) in zip(texts, found, strict=True)]
                spans = [[{"first": a, "end": b} for a, b in s] for *_, s in found]
                columns = ([n for n, *_ in found], [g for _, g, _ in found], spans, kept)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(schema[0].type), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return joined.mapInArrow(run, f"k {kind}, n_units long, n_removed long, spans array<struct<first: int, end: int>>, kept string").withColumnRenamed("k", key)

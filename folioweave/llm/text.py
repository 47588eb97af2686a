"""Byte-level text helpers shared by the operators; all of them see whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_KEEP = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Upper-case ASCII to lower case; ASCII that is no letter or digit to a space; other bytes stay.
_FOLD = bytes(b if b in _KEEP else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

#: Texts are handed on in pieces of about this size, so that a batch of long texts stays in bounds.
BATCH_BYTES = 8 << 20


def blank_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; null has none."""
    return text.encode().split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, as UTF-8; null has none."""
    return text.encode().translate(_FOLD).split() if text else []


def map_batches(df: DataFrame, work: Callable[[dict[str, list]], dict[str, list]], schema: pa.Schema, spark_schema) -> DataFrame:
    """``mapInArrow`` over column lists: work gets and returns a dict of equally long lists."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                out = work({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, spark_schema)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``BATCH_BYTES``."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, int(n * BATCH_BYTES / max(batch.nbytes, BATCH_BYTES)))
    for i in range(0, n, step):
        yield batch.slice(i, step)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))

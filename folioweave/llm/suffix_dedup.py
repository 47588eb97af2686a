"""Exact substring deduplication over the corpus, by prefix-free parsing.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller key.

1. *Parse.* A rolling hash of the last bytes triggers phrase borders. A phrase is taken with the LENGTH - 1 bytes
   that follow it, which fixes every string of LENGTH bytes that starts in it.
2. *Dictionary.* Equal phrases are grouped; the occurrence with the smallest key leads. All strings that start in
   other occurrences are repeats, so that repetitive text is settled here, a row for each phrase.
3. *Finer phrases.* Only leading phrases can still share strings with each other, and only around K-grams that
   several documents have in theirs: any string of LENGTH bytes holds the least K-gram hash of the grams in it.
   The strings around such grams are cut at grams into short phrases, which are settled like the long ones.
4. *Order of the dictionary's suffixes.* What still leads are short phrases at the borders of repeats. Their
   suffixes are sorted by the first LENGTH bytes (as hashes of 96 bits) and meet their equals; no deeper order is
   asked for.
5. *Cut.* Phrases of both kinds without the lead and strings with a smaller equal give the spans of each document.

Sorting is spread by ranges of hash values. Every sorter gets at most one key's entries from each sender,
which keep the rest, so that a passage in every third document is no hot key. Texts are read in slices of
``SLICE`` bytes with the bytes around them.

Defined results: null and empty texts have no bytes; a text without a key is left as it is and removes
nothing; exact repeats of a row share its result; different texts under one key are judged each, and cut by smaller keys only, never
by each other (texts are then numbered in the order of their keys, which costs two more passes); very long texts are read whole, in slices; columns
other than key and text are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import mix, pieces
from .workspace import Workspace

LENGTH, K = 50, 24
TRIGGER, PHRASE, SHORTEST = 16, 256, 64
SLICE = 4 << 20
#: Entries that a sorter holds, about, and that a sender gathers before it settles what it can.
GROUP = 500_000
_RNG = np.random.default_rng(50)
_TABLES = _RNG.integers(1, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = [int(x) | 1 for x in _RNG.integers(1 << 62, 1 << 63, 2)]


def _windows(raw: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A polynomial hash of each window of ``length`` bytes, by doubling."""
    n = len(raw) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    odd, power, out, done = _ODD[which], _TABLES[which][raw], None, 0
    width = 1
    while True:  # power[i]: hash of raw[i : i + width]
        if length & width:
            part = power[done : done + n]
            out = part.copy() if out is None else out * np.uint64(pow(odd, width, 1 << 64)) + part
            done += width
        if done == length:
            return out
        power = power[:-width] * np.uint64(pow(odd, width, 1 << 64)) + power[width:]
        width *= 2


def _sliding(x: np.ndarray, width: int, least: Callable) -> np.ndarray:
    """The least (or greatest) of each ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = least(x[: len(x) - step], x[step:])
        have += step
    return x


def _sampled(grams: np.ndarray, width: int) -> np.ndarray:
    """Whether a gram is the least of some ``width`` neighbours; equal ones all are."""
    if len(grams) < width:
        return np.zeros(len(grams), bool)
    low = _sliding(grams, width, np.minimum)
    top = np.uint64(0)
    padded = np.concatenate([np.full(width - 1, top), low, np.full(width - 1, top)])
    return _sliding(padded, width, np.maximum) == grams


def anchors(raw: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of sampled grams; every ``length`` bytes hold one that they alone determine."""
    width, at, found = length - k + 1, [], []
    for i in range(0, max(1, len(raw)), SLICE):
        low = max(0, i - width)
        part = raw[low : i + SLICE + width + k]
        grams = mix(_windows(part, k))
        p = np.flatnonzero(_sampled(grams, width))
        p = p[(p + low >= i) & (p + low < i + SLICE)]
        at.append(p + low)
        found.append(grams[p])
    return np.concatenate(at), np.concatenate(found)


def phrases(raw: np.ndarray) -> np.ndarray:
    """Borders 0, ..., len(raw): after triggers, and at least ``SHORTEST`` bytes apart."""
    hits = []
    for i in range(0, len(raw), SLICE):
        h = mix(_windows(raw[i : i + SLICE + TRIGGER - 1], TRIGGER))
        hits.append(np.flatnonzero(h & np.uint64(PHRASE - 1) == 0) + i + TRIGGER)
    borders, last = [0], 0
    for p in np.concatenate(hits).tolist() if hits else []:
        if p - last >= SHORTEST and p < len(raw):
            borders.append(p)
            last = p
    return np.array([*borders, len(raw)], np.int64)


def _keyed_phrases(raw: bytes, view: np.ndarray, length: int) -> Iterator[tuple[int, int, bytes]]:
    """(border, next border, key) of the phrases in which a string of ``length`` bytes starts."""
    borders, digest = phrases(view).tolist(), xxhash.xxh3_128_digest
    for first, end in zip(borders, borders[1:], strict=False):
        if first + length <= len(raw):
            yield first, end, digest(raw[first : end + length - 1])


def _parse(rows: DataFrame, length: int) -> DataFrame:
    """(key, doc, first, grams, of): each different phrase of each document once, with the grams in it; of: how many the document has."""
    schema = pa.schema([("key", pa.binary()), ("doc", pa.int64()), ("first", pa.int32()), ("grams", pa.binary()), ("of", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                out: list[list] = [[], [], [], [], []]
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = text.encode()
                    view, seen = np.frombuffer(raw, np.uint8), set()
                    at, grams = anchors(view, length)
                    found = list(_keyed_phrases(raw, view, length))
                    lows = np.searchsorted(at, [f for f, _, _ in found]).tolist()
                    highs = np.searchsorted(at, [e + length - 1 - K for _, e, _ in found], "right").tolist()
                    for (first, _, key), low, high in zip(found, lows, highs, strict=True):
                        if key not in seen:
                            seen.add(key)
                            for column, value in zip(out, (key, doc, first, grams[low:high].tobytes()), strict=False):
                                column.append(value)
                    out[4] += [len(seen)] * len(seen)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, "key binary, doc long, first int, grams binary, of int")


def _packed(x: np.ndarray | None) -> bytes:
    """Byte planes: what is alike in all numbers compresses away."""
    if x is None:
        return b""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unpacked(found: pa.ChunkedArray, kind=np.uint64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    parts = [np.ascontiguousarray(np.frombuffer(x.as_py(), np.uint8).reshape(size, -1).T).view(kind).ravel() for x in found]
    return np.concatenate(parts) if parts else np.empty(0, kind)


_SENT = pa.schema([("g", pa.int32()), ("known", pa.bool_()), ("h", pa.binary()), ("h2", pa.binary()), ("doc", pa.binary()), ("at", pa.binary())])
_SENT_SQL = "g int, known boolean, h binary, h2 binary, doc binary, at binary"


def _send(h: np.ndarray, h2: np.ndarray | None, doc: np.ndarray, at: np.ndarray, known: np.ndarray, groups: int) -> Iterator[pa.RecordBatch]:
    """Entries by group: open ones by ranges of h, so that equals meet; known ones by document, only to be passed on."""
    for flag in (False, True):
        here = np.flatnonzero(known == flag)
        if not len(here):
            continue
        by = mix(doc[here].view(np.uint64) if flag else h[here])  # sampled hashes are small: mixed anew
        g = (((by >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(g, kind="stable")
        here, g = here[order], g[order]
        firsts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        cuts = list(zip(firsts, np.append(firsts[1:], len(g)), strict=True))
        columns = [pa.array([_packed(None if x is None else x[here[a:b]]) for a, b in cuts], pa.binary()) for x in (h, h2, doc, at)]
        yield pa.RecordBatch.from_arrays([pa.array(g[firsts].astype(np.int32)), pa.array([flag] * len(cuts)), *columns], schema=_SENT)


def _groups(h: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order by (h, h2), the first of each group in it, and the groups' smallest and largest documents."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.append(True, s[1:] != s[:-1])
    t = h2[order]
    if np.any(~new[1:] & (t[1:] != t[:-1])):
        order = np.lexsort((h2, h))
        s, t = h[order], h2[order]
        new = np.append(True, (s[1:] != s[:-1]) | (t[1:] != t[:-1]))
    firsts, d = np.flatnonzero(new), doc[order]
    return order, new, np.minimum.reduceat(d, firsts), np.maximum.reduceat(d, firsts)


def _shared_grams(book: DataFrame, groups: int, shift: int) -> DataFrame:
    """(doc, gram): grams of leading phrases that several documents have, for each of the documents. ``doc >> shift`` tells documents apart."""

    def flush(grams: list[np.ndarray], docs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        h, doc = np.concatenate(grams), np.concatenate(docs)
        if not len(h):
            return
        order, new, low, high = _groups(h, h, doc >> shift)
        h, doc, group = h[order], doc[order], np.cumsum(new) - 1
        several = (low < high)[group]
        # what is settled here goes on as known; the groups' sorter hears of it from two entries
        two = np.flatnonzero(low < high)
        firsts = np.flatnonzero(new)[two]
        tell = np.concatenate([h[firsts]] * 2)
        h, doc = np.concatenate([h, tell]), np.concatenate([doc, low[two] << shift, high[two] << shift])
        known = np.append(several, np.zeros(len(tell), bool))
        told = np.append(np.zeros(len(several), np.uint8), np.ones(len(tell), np.uint8))
        yield from _send(h, None, doc, told, known, groups)

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, docs, size = [], [], 0
        for batch in batches:
            sizes = np.array([len(x) // 8 for x in batch.column(1).to_pylist()], np.int64)
            if not sizes.sum():
                continue
            grams.append(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64))
            docs.append(np.repeat(batch.column(0).to_numpy(), sizes))
            size += int(sizes.sum())
            if size >= GROUP:
                yield from flush(grams, docs)
                grams, docs, size = [], [], 0
        if size:
            yield from flush(grams, docs)

    def meet(table: pa.Table) -> pa.Table:
        known, rest = table.filter(table["known"]), table.filter(pc.invert(table["known"]))
        h, doc, told = _unpacked(rest["h"]), _unpacked(rest["doc"], np.int64), _unpacked(rest["at"], np.uint8)
        out_doc, out_h = [_unpacked(known["doc"], np.int64)], [_unpacked(known["h"])]
        if len(h):
            order, new, low, high = _groups(h, h, doc >> shift)
            pick = order[(low < high)[np.cumsum(new) - 1]]
            pick = pick[told[pick] == 0]
            out_doc.append(doc[pick])
            out_h.append(h[pick])
        return pa.table([np.concatenate(out_doc), np.concatenate(out_h).view(np.int64)], names=["doc", "gram"])

    return book.select("doc", "grams").mapInArrow(send, _SENT_SQL).groupBy("g").applyInArrow(meet, "doc long, gram long")


def _units(rows: DataFrame, length: int) -> DataFrame:
    """(key, doc, first, n, context): short phrases of the n strings from ``first`` on. rows: (doc, text, whole, leading, grams)."""
    schema = pa.schema([("key", pa.binary()), ("doc", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("context", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for part in pieces(batch):
                out: list[list] = [[], [], [], [], []]
                for doc, text, whole, leading, wanted in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                    raw = text.encode()
                    view, strings = np.frombuffer(raw, np.uint8), len(raw) - length + 1
                    if strings <= 0:
                        continue
                    at, grams = anchors(view, length)
                    near = at[np.isin(grams, np.array(wanted, np.int64).view(np.uint64))]
                    edge = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(edge, np.maximum(0, near - (length - K)), 1)
                    np.add.at(edge, near + 1, -1)
                    open_ = np.cumsum(edge)[:strings] > 0
                    if not whole:
                        led, firsts = set(leading), {}
                        for first, end, key in _keyed_phrases(raw, view, length):
                            if firsts.setdefault(key, first) not in led:
                                open_[first:end] = False
                    where = np.flatnonzero(open_)
                    if not len(where):
                        continue
                    border = np.zeros(len(raw), bool)
                    border[at[grams & np.uint64(1) == 0]] = True
                    begins = np.flatnonzero(np.append(True, (np.diff(where) != 1) | border[where[1:]]))
                    sizes = np.diff(np.append(begins, len(where)))
                    firsts, ends = where[begins], where[begins] + sizes + length - 1
                    contexts = [raw[a:b] for a, b in zip(firsts.tolist(), ends.tolist(), strict=True)]
                    for column, values in zip(out, (map(digest, contexts), [doc] * len(contexts), firsts.tolist(), sizes.tolist(), contexts), strict=True):
                        column += values
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, "key binary, doc long, first int, n int, context binary")


def _repeats(units: DataFrame, length: int, groups: int, shift: int) -> DataFrame:
    """(doc, at): starts of strings that a smaller document (``doc >> shift``) has too. units: (doc, first, context)."""

    def flush(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h, h2, doc, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, new, low, _ = _groups(h, h2, doc >> shift)
        h, h2, doc, at = h[order], h2[order], doc[order], at[order]
        yield from _send(h, h2, doc, at, (doc >> shift) > low[np.cumsum(new) - 1], groups)

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for piece in pieces(batch):
                contexts = piece.column(2).to_pylist()
                sizes = np.array([len(c) for c in contexts], np.int64)
                ends = np.cumsum(sizes)
                view = np.frombuffer(b"".join(contexts), np.uint8)
                # strings of the joined contexts that lie in one of them
                inside = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
                begin = np.repeat(ends - sizes, np.maximum(sizes - length + 1, 0))
                step = np.arange(len(inside)) - np.repeat(np.cumsum(np.maximum(sizes - length + 1, 0)) - np.maximum(sizes - length + 1, 0), np.maximum(sizes - length + 1, 0))
                spots = begin + step
                if not len(spots):
                    continue
                doc, first = piece.column(0).to_numpy(), piece.column(1).to_numpy()
                parts.append((mix(_windows(view, length)[spots]), (mix(_windows(view, length, 1)[spots]) >> np.uint64(32)).astype(np.uint32), doc[inside], (first[inside] + step).astype(np.uint32)))
                size += len(spots)
                if size >= GROUP:
                    yield from flush(parts)
                    parts, size = [], 0
        if size:
            yield from flush(parts)

    def meet(table: pa.Table) -> pa.Table:
        known, rest = table.filter(table["known"]), table.filter(pc.invert(table["known"]))
        out_doc, out_at = [_unpacked(known["doc"], np.int64)], [_unpacked(known["at"], np.uint32)]
        h, h2, doc, at = _unpacked(rest["h"]), _unpacked(rest["h2"], np.uint32), _unpacked(rest["doc"], np.int64), _unpacked(rest["at"], np.uint32)
        if len(h):
            order, new, low, _ = _groups(h, h2, doc >> shift)
            pick = order[(doc[order] >> shift) > low[np.cumsum(new) - 1]]
            out_doc.append(doc[pick])
            out_at.append(at[pick])
        return pa.table([np.concatenate(out_doc), np.concatenate(out_at).astype(np.int32)], names=["doc", "at"])

    return units.mapInArrow(send, _SENT_SQL).groupBy("g").applyInArrow(meet, "doc long, at int")


def spans_of(raw: bytes, leading: set[int] | None, repeats: np.ndarray, units: np.ndarray, length: int) -> np.ndarray:
    """Maximal removed runs, a row [first, end) for each.

    leading: first borders of phrases with the lead, None if all have it; repeats: starts of strings; units: rows (first, n) of strings in a row.
    """
    view, firsts = np.frombuffer(raw, np.uint8), {}
    edge = np.zeros(len(raw) + 2, np.int32)
    for first, end, key in _keyed_phrases(raw, view, length) if leading is not None else ():
        if firsts.setdefault(key, first) not in leading:
            edge[first] += 1
            edge[min(end + length - 1, len(raw))] -= 1
    for first, n in ((repeats, 1), (units[:, 0], units[:, 1])):
        np.add.at(edge, first, 1)
        np.add.at(edge, first + n - 1 + length, -1)
    gone = np.diff(np.concatenate([[0], np.cumsum(edge)[: len(raw)] > 0, [0]]).astype(np.int8))
    return np.stack([np.flatnonzero(gone == 1), np.flatnonzero(gone == -1)], 1)


def _cut(raw: bytes, whole: bool | None, leading: list | None, repeats: list | None, units: list | None, length: int) -> np.ndarray:
    """``spans_of`` from columns, in which null is none."""
    if whole and not repeats and not units:
        return np.empty((0, 2), np.int64)
    return spans_of(raw, None if whole else set(leading or ()), np.array(repeats or (), np.int64), np.array(units or (), np.int64).reshape(-1, 2), length)


def without(raw: bytes, spans: np.ndarray) -> bytes:
    out, at = [], 0
    for first, end in spans.tolist():
        out.append(raw[at:first])
        at = end
    return b"".join([*out, raw[at:]])


def whole_characters(raw: bytes, spans: np.ndarray) -> np.ndarray:
    """The spans drawn in to borders of UTF-8 characters, so that what is left is text."""
    inside = [(a, b) for a, b in spans.tolist()]
    out = []
    for a, b in inside:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)


def _numbered(keyed: DataFrame, work: Workspace) -> tuple[DataFrame, int]:
    """The rows with a number for ``doc``, another one for each text under a key, and by how many bits it is shifted for the key's own.

    Different (key, text) pairs are numbered in their order, by ranges, so a key that many texts share is spread; a key's
    own number is its first. Rows without a key or a text have none.
    """
    tag = F.sha2("_text", 256)
    pairs = keyed.filter("doc is not null and _text is not null").select("doc", tag.alias("tag")).distinct()
    placed = work.put("placed", pairs.repartitionByRange("doc", "tag").sortWithinPartitions("doc", "tag").withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg((F.max(place) + 1).alias("size"))
    before = sizes.select("_part", (F.sum("size").over(Window.orderBy("_part")) - F.col("size")).alias("before"))  # a row for each range
    numbers = placed.join(before, part == F.col("_part")).select("doc", "tag", (F.col("before") + place).alias("n"))
    own = numbers.groupBy(F.col("doc").alias("_of")).agg(F.min("n").alias("first"))
    named = work.put("numbers", numbers.join(own, F.col("doc") == F.col("_of")).select(F.col("doc").alias("_doc"), F.col("tag").alias("_tag"), "first", (F.col("n") - F.col("first")).alias("nth")))
    first, nth = named.agg(F.max("first"), F.max("nth")).first()
    shift = max(1, nth.bit_length())
    if first.bit_length() + shift > 62:
        raise ValueError(f"{nth + 1} texts under one key are too many to be numbered")
    ids = named.select("_doc", "_tag", (F.shiftleft("first", shift) + F.col("nth")).alias("_id"))
    joined = keyed.join(ids, (F.col("doc") == F.col("_doc")) & (tag == F.col("_tag")), "left")
    return joined.withColumn("doc", F.col("_id")).drop("_doc", "_tag", "_id"), shift


def duplicate_spans(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, carry: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``df`` as (_key, _text, judged, whole, leading, repeats, units, _0, ...): what ``spans_of`` needs beside the text; and the columns ``carry``."""
    others = [f"_{i}" for i in range(len(carry))]
    work = Workspace(df.sparkSession, "suffix")
    keyed = df.select(F.col(key).alias("_key"), F.col(key).cast("long").alias("doc"), F.col(text).alias("_text"), *(F.col(c).alias(o) for c, o in zip(carry, others, strict=True)))
    rows = keyed.filter("doc is not null and _text is not null").select("doc", F.col("_text").alias("text"))
    shift, led = 0, F.min_by(F.struct("doc", "first", "grams", "of"), "doc")
    if rows.groupBy("doc").count().filter("count > 1").limit(1).count():
        keyed, shift = _numbered(keyed, work)
        rows = keyed.filter("doc is not null").select("doc", F.col("_text").alias("text")).dropDuplicates(["doc"])
    order = F.shiftright("doc", shift)
    judged = F.col("doc").isNotNull()
    if shift:
        # every text of the smallest document that has a phrase leads it
        parsed = work.put("parsed", _parse(rows, length))
        least = parsed.groupBy(F.col("key").alias("_phrase")).agg(F.min(order).alias("_least"))
        book = parsed.join(least, F.col("key") == F.col("_phrase")).filter(order == F.col("_least")).select("doc", "first", "grams", "of")
    else:
        book = _parse(rows, length).groupBy("key").agg(led.alias("p")).select("p.*")
    book = work.put("dictionary", book)
    work.drop("parsed")
    total = book.agg(F.coalesce(F.sum(F.octet_length("grams")), F.lit(0))).first()[0] // 8
    shared = work.put("grams", _shared_grams(book, max(1, -(-total // GROUP)), shift))
    # a document all of whose phrases lead need not name them
    named = book.groupBy("doc").agg((F.count("*") == F.max("of")).alias("whole"), F.collect_list("first").alias("leading"))
    leading = work.put("leading", named.select("doc", "whole", F.when(~F.col("whole"), F.col("leading")).alias("leading")))
    work.drop("dictionary")
    wanted = shared.groupBy("doc").agg(F.collect_set("gram").alias("grams"))
    units = work.put("units", _units(rows.join(wanted, "doc").join(leading, "doc").select("doc", "text", "whole", "leading", "grams"), length))
    leads = work.put("leads", units.groupBy("key").agg(F.min(order).alias("lead"), F.max(order).alias("last")).filter("lead < last").select(F.col("key").alias("k"), "lead"))
    known = units.join(leads, F.col("key") == F.col("k"), "left").withColumn("gone", F.coalesce(order > F.col("lead"), F.lit(False)))
    settled = work.put("settled", known.select("doc", "first", "n", F.when(~F.col("gone"), F.col("context")).alias("context")))
    work.drop("grams", "units", "leads")
    left = settled.filter("context is not null")
    strings = left.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    repeats = work.put("repeats", _repeats(left.select("doc", "first", "context"), length, max(1, -(-strings // GROUP)), shift))
    short = settled.filter("context is null").groupBy("doc").agg(F.collect_list(F.struct("first", "n")).alias("units"))
    found = repeats.groupBy("doc").agg(F.collect_list("at").alias("repeats"))
    spans = work.put("spans", leading.join(found, "doc", "full").join(short, "doc", "full"))
    work.drop("leading", "settled", "repeats")
    return keyed.join(spans, "doc", "left").select(
        "_key", "_text", judged.alias("judged"), "whole", "leading", "repeats", F.expr("flatten(transform(units, u -> array(u.first, u.n)))").alias("units"), *others
    )


_RESULT = "n_bytes long, n_removed long, spans array<struct<first: long, end: long>>, kept_sha256 string"


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, with_bytes: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, spans, kept_sha256[, kept]) of each row; kept: the remaining bytes, binary."""
    kind = df.select(key).schema[0].dataType.simpleString()
    rows = duplicate_spans(df, key, text, length)
    schema = pa.schema(
        [
            ("k", rows.select("_key").limit(0).toArrow().schema[0].type),
            ("n_bytes", pa.int64()),
            ("n_removed", pa.int64()),
            ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
            ("kept_sha256", pa.string()),
            *([("kept", pa.binary())] if with_bytes else []),
        ]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                out: list[tuple] = []
                for k, t, judged, *found in zip(*(part.column(i).to_pylist() for i in range(7)), strict=True):
                    raw = (t or "").encode()
                    cut = _cut(raw, *found, length) if judged else np.empty((0, 2), np.int64)
                    kept = without(raw, cut)
                    out.append((k, len(raw), len(raw) - len(kept), [{"first": a, "end": b} for a, b in cut.tolist()], hashlib.sha256(kept).hexdigest(), *([kept] if with_bytes else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    out = Workspace(df.sparkSession, "suffix").put("result", rows.mapInArrow(run, f"k {kind}, {_RESULT}" + ", kept binary" * with_bytes))
    return out.withColumnRenamed("k", key)


def rewrite(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, kept_text, columns of carry) of each row: its text without its repeated runs, drawn in to whole characters.

    Rows without a key, repeated ones and different texts under one key have a row each, with their own columns.
    """
    kind = df.select(key).schema[0].dataType.simpleString()
    rows = duplicate_spans(df, key, text, length, carry)
    others = rows.select("_key", *rows.columns[7:]).limit(0).toArrow().schema
    schema = pa.schema([("k", others[0].type), ("kept_text", pa.string()), *(others.field(i) for i in range(1, len(others)))])
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema[7:])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                out = []
                for t, judged, *found in zip(*(part.column(i).to_pylist() for i in range(1, 7)), strict=True):
                    raw = (t or "").encode()
                    if judged:
                        cut = _cut(raw, *found, length)
                        t = without(raw, whole_characters(raw, cut)).decode() if t is not None else None
                    out.append(t)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(schema[0].type), pa.array(out, pa.string()), *(part.column(i).cast(schema[i - 5].type) for i in range(7, part.num_columns))], schema=schema)

    return rows.mapInArrow(run, f"k {kind}, kept_text string{kinds}").toDF(key, "kept_text", *carry)

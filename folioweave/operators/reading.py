"""Places read from printed citations, in Arrow batches; "Ibid." in the order of each source book."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bible, readers, thml, volumes
from ..functions.aliases import PREFIXES, TYPES
from ..functions.text import is_summa
from ..schema import PARTS_SQL
from .linkage import first_rule

_PLACES = pa.list_(pa.list_(pa.struct([("type", pa.string()), ("value", pa.int32())])))
_PLACES_SQL = f"array<{PARTS_SQL}>"


def _arrow(places: list[readers.Place]) -> list[list[dict[str, object]]]:
    """Values past 32 bits are no places."""
    return [[{"type": t, "value": v} for t, v in p] for p in places if all(v <= 2147483647 for _, v in p)]


def _numbered(asked: Iterable[tuple]) -> tuple[list[tuple], pa.Array]:
    """The different ones of a batch, in the order in which they come, and the number of each; what comes again is read once."""
    known: dict[tuple, int] = {}
    at = [known.setdefault(x, len(known)) for x in asked]
    return list(known), pa.array(at, pa.int64())


def father_places(df: DataFrame) -> DataFrame:
    """(id, places) of (id, location, raw, title, types): the places that citations of a divided work give.

    Columns that may be there: ``pattern`` finds the title in a raw text that spells it otherwise, ``prefix`` goes before
    the places that are read, ``work`` is returned with them.
    """

    def read_place(loc: str | None, raw: str | None, title: str | None, types: tuple[str, ...], pattern: str | None, before: tuple[tuple[str, int], ...]) -> list:
        found = readers.father_places(readers.location_text(loc or "", raw or "", title or "", pattern), list(types[len(before) :]))
        return _arrow([[*before, *place] for place in found])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            loc, raw, title, types, pattern, prefix = (b.column(i).to_pylist() for i in range(2, 8))
            asked = zip(loc, raw, title, (tuple(t or ()) for t in types), pattern, (tuple((p["type"], p["value"]) for p in x or ()) for x in prefix), strict=True)
            known, at = _numbered(asked)
            found = pa.array([read_place(*x) for x in known], _PLACES).take(at)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), found], names=["id", "work", "places"])

    with_work = "work" in df.columns
    for name, kind in (("pattern", "string"), ("prefix", PARTS_SQL), ("work", "string")):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    read = df.select(F.col("id").cast("long").alias("id"), "work", "location", "raw", "title", "types", "pattern", "prefix").mapInArrow(run, f"id long, work string, places {_PLACES_SQL}")
    return read if with_work else read.drop("work")


def works_cited(citations: DataFrame, rules: list[tuple[str, dict[str, str]]], divided: DataFrame) -> DataFrame:
    """(id, work, places) of citations (id, author, title, location, raw) of the works that ordered rules name.

    divided: (work, types), the part types of each work's pages (``places.division_types``); a work read otherwise has its own in
    ``aliases.TYPES``, one that is part of another its first parts in ``aliases.PREFIXES``. Works that are not there have no places.
    Citations of no work go last, as a filter before would have the rules evaluated twice.
    """
    parts = lambda title: F.array(*[F.struct(F.lit(t).alias("type"), F.lit(v).alias("value")) for t, v in PREFIXES[title]]).cast(PARTS_SQL) if title in PREFIXES else F.lit(None).cast(PARTS_SQL)
    types = lambda work: F.array(*map(F.lit, TYPES[work])) if work in TYPES else F.lit(None).cast("array<string>")
    about = F.array(*[F.struct(F.lit(work).alias("work"), F.lit(p["title"]).alias("pattern"), parts(p["title"]).alias("prefix"), types(work).alias("own")) for work, p in rules])
    ruled = first_rule(citations, [(str(i), patterns) for i, (_, patterns) in enumerate(rules)], "_rule")
    named = ruled.select("id", "title", "location", "raw", F.get(about, F.col("_rule").cast("int")).alias("_about")).select("id", "title", "location", "raw", "_about.*")
    known = named.join(divided.select("work", F.col("types").alias("_types")), "work", "left").withColumn("types", F.coalesce("own", "_types"))
    return father_places(known).where("work is not null")


def summa_places(citations: DataFrame, order: tuple[str, ...] = ("source_page", "id")) -> DataFrame:
    """(id, places): places of the Summa in each source book; an "Ibid." goes on from the last place read before it.

    What comes before decides, step by step, so a book's citations are read in order by one task. A book is the
    bound of that: its citations are sorted by the shuffle and streamed through in batches.
    """
    rows = citations.where(is_summa(F.col("title"), F.col("author"))).select("source_book_id", *order, F.col("id").cast("long").alias("_id"), "raw")
    sorted_ = rows.repartition("source_book_id").sortWithinPartitions("source_book_id", *order).select("source_book_id", "_id", "raw")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, before = None, None
        for b in batches:
            # a text, with what came before it if that counts, is read once a batch
            known: dict[tuple, int] = {}
            read, lasts, out = [], [], []
            for of, raw in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if of != book:
                    book, before = of, None
                asked = (raw or "", before if readers.is_ibid(raw or "") else None)
                at = known.setdefault(asked, len(known))
                if at == len(read):
                    found = readers.summa_places(*asked)
                    read.append(_arrow(found))
                    lasts.append(readers.last_place(found))
                before = lasts[at] or before
                out.append(at)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(read, _PLACES).take(pa.array(out, pa.int64()))], names=["id", "places"])

    return sorted_.mapInArrow(run, f"id long, places {_PLACES_SQL}")


def read_texts(df: DataFrame, read: Callable[[str], object], kind: pa.DataType, sql: str) -> DataFrame:
    """(id, found) of (id, text): what a reader of one text finds, in Arrow batches; a text that comes again in a batch is read once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = b.column(1).dictionary_encode()
            found = pa.array([read(t or "") for t in known.dictionary.to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), found.take(known.indices)], names=["id", "found"])

    return df.select(F.col("id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"id long, found {sql}")


def divisions(df: DataFrame) -> DataFrame:
    """(id, found) of (id, text): label, type and value of the numbered division that a title names, or null."""

    def read(title: str) -> dict | None:
        found = thml.division(title, "")
        return dict(zip(("label", "type", "value"), found, strict=True)) if found else None

    return read_texts(df, read, pa.struct([("label", pa.string()), ("type", pa.string()), ("value", pa.int32())]), "struct<label: string, type: string, value: int>")


def work_references(df: DataFrame) -> DataFrame:
    """(id, found) of (id, text): author, title and location of each work that a reference names."""
    names = ("author", "title", "location")
    return read_texts(df, lambda t: [dict(zip(names, r, strict=True)) for r in thml.work_references(t)], pa.list_(pa.struct([(n, pa.string()) for n in names])), "array<struct<author: string, title: string, location: string>>")


def passages(df: DataFrame) -> DataFrame:
    """(id, found) of (id, text): book, chapter and verses of the passages that a scripture mark names."""
    kind = pa.list_(pa.struct([("book", pa.int32()), ("chapter", pa.int32()), ("verses", pa.list_(pa.int32()))]))
    return read_texts(df, lambda t: [{"book": b, "chapter": c, "verses": v} for b, c, v in bible.marked_passages(t)], kind, "array<struct<book: int, chapter: int, verses: array<int>>>")


def bible_books(df: DataFrame) -> DataFrame:
    """(id, found) of (id, text): the number of the book of the Bible that a printed name means, or null."""
    return read_texts(df, bible.printed_book, pa.int32(), "int")


def chapter_gaps(titles: DataFrame) -> DataFrame:
    """(book_id, position, chapters) of (book_id, position, title): the chapters each title names; one that names none takes the one that its neighbours leave out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([volumes.chapter_numbers(t or "") for t in b.column(2).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), found], names=["book_id", "position", "chapters"])

    named = titles.select("book_id", F.col("position").cast("int").alias("position"), "title").mapInArrow(run, "book_id string, position int, chapters array<int>")
    order = Window.partitionBy("book_id").orderBy("position")
    before = F.coalesce(F.last(F.array_max("chapters"), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.first(F.array_min("chapters"), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    gap = (F.size("chapters") == 0) & (after - before == 2)
    return named.select("book_id", "position", F.when(gap, F.array(before + 1)).otherwise(F.col("chapters")).alias("chapters"))

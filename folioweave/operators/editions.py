"""Works in HTML documents to pages: blocks are cut where a book or a chapter is marked.

A small parser gives the blocks of each document (``functions.editions``); everything after it is windows and joins over
(path, document, block) for all works at once. A work's blocks are sorted within its path only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import editions, readers
from ..functions.text import roman_to_int, to_roman
from ..schema import PARTS_SQL

#: Number words, how books and chapters are marked, and the largest number that is one.
WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
BOOK = rf"(?i)^book\s+([ivxlc]+|\d+|{'|'.join(WORDS)}|{'|'.join(readers.ORDINALS[:10])})\.?(?:\s+chapter\s+([ivxlc]+|\d+)\.?)?$"
CHAPTER = r"""(?i)^(?:part|chapter|chap\.?)\s*([ivxlc]+|\d+)\b\.?(?:\s*[:.—–-].*|\s*["'“”‘’]+)?$"""
BARE = r"(?i)^([ivx]+|\d{1,3})\.?$"
NUMBERED = r"^(\d{1,3})\.\s+\S"
NAMED_BOOK = r"_Book_([A-Za-z]+|\d+)(?=[._]|$)"
MOST = 200
#: Words of a heading at most, of a segment that stands alone at least, of an unmarked first chapter at least; letters of a title.
HEADING_WORDS, TINY, OPENING, CHAPTER_LETTERS, TITLE_LETTERS = 15, 30, 100, 200, 60

_LEAF = "path string, document int, name string, leaf int, html string, text string, heading boolean, refs array<string>, bold string, anchor string"
_NOTE = "path string, document int, name string, nth int, id string, number string, note string"
_AT = ("path", "document")
Table = Callable[[DataFrame], DataFrame]


def as_it_is(df: DataFrame) -> DataFrame:
    return df


def _each(documents: DataFrame, read: Callable[[str], Iterator[dict]], schema: str) -> DataFrame:
    """What ``read`` finds in each document, numbered in its order."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([(*at, i, *x.values()) for *at, xhtml in f.itertuples(index=False) for i, x in enumerate(read(xhtml or ""))], columns=names)

    return documents.select("path", "document", "name", "xhtml").mapInPandas(run, schema)


def number_of(raw: Column) -> Column:
    """A number from 1 to ``MOST`` in figures, as a well-formed numeral or as a word; else null."""
    low = F.lower(raw)
    word = lambda known: F.nullif(F.array_position(F.array(*map(F.lit, known)), low), F.lit(0)).cast("int")
    n = F.coalesce(F.when(low.rlike(r"^\d{1,9}$"), low.try_cast("int")), F.when(low.rlike(rf"^{readers.ROMAN_NUMERAL}$"), roman_to_int(low)), word(WORDS), word(readers.ORDINALS))
    return F.when(n.between(1, MOST), n)


def marked(leaves: DataFrame) -> DataFrame:
    """Leaves with the book or the chapter that each starts: a book by its line; a chapter by anchor, line or bold opening, in this order."""
    first = lambda c, p, g=1: number_of(F.regexp_extract(c, p, g))
    book = first("text", BOOK)
    signs = [number_of(F.col("anchor")), F.when(F.length("text") < CHAPTER_LETTERS, first("text", CHAPTER)), first("text", BARE), F.when(F.col("heading"), first("text", NUMBERED)), first("bold", BARE), first("bold", CHAPTER)]
    words = F.size(F.split("text", " "))
    named = leaves.withColumn("book", book).withColumn("chapter", F.when(F.col("book").isNotNull(), first("text", BOOK, 2)).otherwise(F.coalesce(*signs))).withColumn("words", words)
    mark = F.col("book").isNotNull() | F.col("chapter").isNotNull()
    return named.withColumn("mark", mark).withColumn("heading", F.col("heading") | (mark & (words <= HEADING_WORDS)))


def segments(leaves: DataFrame, starts_at: str | None = None, first_book: int | None = None) -> DataFrame:
    """Marked leaves with ``seg``, the segment of the work each lies in, and what that segment starts with: in_book, in_chapter, counts.

    starts_at: a pattern of the block where the text starts; marks before it do not count.
    """
    so_far = Window.partitionBy("path").orderBy("document", "leaf").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = F.lit(True) if starts_at is None else F.max(F.col("text").rlike(starts_at)).over(so_far)
    there = leaves.withColumn("begun", begun).withColumn("nth", F.sum(F.col("begun").cast("int")).over(so_far)).withColumn("counts", F.col("begun") & F.col("mark"))
    opens = F.when(F.col("leaf") == 0, number_of(F.regexp_extract("name", NAMED_BOOK, 1)))
    told = F.coalesce(F.when(F.col("counts"), F.col("book")), F.when(F.col("nth") == 1, F.lit(first_book if starts_at else None).cast("int")), opens)
    cut = F.col("counts") | (F.col("leaf") == 0)
    known = there.withColumn("now", F.last(told, ignorenulls=True).over(so_far)).withColumn("seg", F.sum(cut.cast("int")).over(so_far))
    of = Window.partitionBy(*_AT, "seg").orderBy("leaf").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return known.withColumn("in_book", F.first("now").over(of)).withColumn("in_chapter", F.first(F.when(F.col("counts"), F.col("chapter"))).over(of)).withColumn("counts", F.first("counts").over(of))


def without_contents(cut: DataFrame) -> DataFrame:
    """(path, document, unit, book, chapter, words, first, last) of segments: a run of marks before the numbering goes back is a table of contents, one unnumbered unit."""
    each = cut.groupBy(*_AT, "seg").agg(F.first("in_book").alias("book"), F.first("in_chapter").alias("chapter"), F.first("counts").alias("counts"), F.sum("words").alias("words"))
    by_seg = Window.partitionBy(*_AT).orderBy("seg")
    place = F.when(F.col("counts"), F.struct(F.coalesce("book", F.lit(0)).alias("b"), F.coalesce("chapter", F.lit(0)).alias("c")))
    before = F.last("place", ignorenulls=True).over(by_seg.rowsBetween(Window.unboundedPreceding, -1))
    # marks rise between two steps back, so the last mark is the furthest
    run = F.sum(F.coalesce((F.col("place") <= F.col("before")).cast("int"), F.lit(0))).over(by_seg)
    runs = each.withColumn("place", place).withColumn("before", before).withColumn("run", run).withColumn("table", F.col("run") < F.max("run").over(Window.partitionBy(*_AT)))
    unit = F.when(F.col("table"), F.min("seg").over(Window.partitionBy(*_AT, "run"))).otherwise(F.col("seg"))
    return (
        runs.withColumn("unit", unit)
        .groupBy(*_AT, "unit")
        .agg(F.min_by("book", "seg").alias("book"), F.when(~F.bool_or("table"), F.first("chapter")).alias("chapter"), F.sum("words").alias("words"), F.min("seg").alias("first"), F.max("seg").alias("last"))
    )


#: Who takes a unit: itself, the unit before it or the one after it; words held back count for the next.
_FOLD = f"""aggregate(units, named_struct('held', 0L, 'any', false, 'out', cast(array() AS array<string>)),
  (s, u) -> CASE WHEN s.held + u.words >= {TINY} OR (u.chapter IS NOT NULL AND NOT s.any) OR (u.chapter IS NULL AND u.unit = units[size(units) - 1].unit)
      THEN named_struct('held', 0L, 'any', true, 'out', concat(s.out, array('own')))
    WHEN u.chapter IS NULL THEN named_struct('held', s.held + u.words, 'any', s.any, 'out', concat(s.out, array('after')))
    ELSE named_struct('held', 0L, 'any', true, 'out', concat(s.out, array('before'))) END,
  s -> s.out)"""


def joined(units: DataFrame) -> DataFrame:
    """Units as (path, document, page, book, chapter, first, last): marks with hardly any text join a neighbour of their document; a long opening before chapter 2 is chapter 1."""
    listed = units.groupBy(*_AT).agg(F.array_sort(F.collect_list(F.struct("unit", "words", "book", "chapter", "first", "last"))).alias("units"))
    told = listed.select(*_AT, F.explode(F.arrays_zip("units", F.expr(_FOLD).alias("to"))).alias("x")).select(*_AT, "x.units.*", F.col("x.to").alias("to"))
    by_unit = Window.partitionBy(*_AT).orderBy("unit")
    own = F.sum((F.col("to") == "own").cast("int")).over(by_unit)
    page = F.first(F.when(F.col("to") != "after", F.col("n")), ignorenulls=True).over(by_unit.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    chief = lambda c: F.first(F.when(F.col("to") == "own", F.col(c)), ignorenulls=True)
    grouped = told.withColumn("n", own).withColumn("page", page).groupBy(*_AT, "page")
    found = grouped.agg(F.coalesce(chief("book"), F.min_by("book", "unit")).alias("book"), chief("chapter").alias("chapter"), F.sum("words").alias("words"), F.min("first").alias("first"), F.max("last").alias("last"))
    then = Window.partitionBy("path").orderBy(*_AT[1:], "page")
    opening = F.col("chapter").isNull() & (F.lead("book").over(then) == F.col("book")) & (F.lead("chapter").over(then) == 2) & (F.col("words") >= OPENING)
    return found.withColumn("chapter", F.when(opening, F.lit(1)).otherwise(F.col("chapter")))


def _escaped(s: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), s)


_CITATIONS = "array<struct<author: string, title: string, location: string, raw: string, reference_book_id: string>>"


def _block(label: Column, html: Column) -> Column:
    return F.struct(label.alias("label"), html.alias("html"), F.array().cast(_CITATIONS).alias("citations"))


def pages(documents: DataFrame, title: Column, table: Table = as_it_is, **reading) -> DataFrame:
    """(path, page_number, printed, parts, also, blocks) of documents (path, document, name, xhtml), a work a path; title: of a path.

    table: makes a table of what several steps read, so that documents are parsed once.
    """
    cut = segments(marked(table(_each(documents, editions.leaves, _LEAF))), **reading)
    of_work = Window.partitionBy("path")
    made = joined(without_contents(cut)).withColumn("has_books", F.bool_or(F.col("book").isNotNull()).over(of_work))
    made = made.withColumn("page_number", F.row_number().over(of_work.orderBy("document", "page"))).drop("page", "words")
    here = cut.drop("book", "chapter").join(made, [*_AT]).where("seg BETWEEN first AND last")
    # a note stands where its document first refers to it
    asked = here.select(*_AT, "page_number", "leaf", F.posexplode("refs").alias("nth", "id")).groupBy(*_AT, "id").agg(F.min(F.struct("leaf", "nth")).alias("at"), F.min_by("page_number", F.struct("leaf", "nth")).alias("page_number"))
    known = _each(documents, editions.notes, _NOTE).drop("name", "nth").dropDuplicates([*_AT, "id"])
    foot = F.concat(F.lit("<p><sup>"), _escaped(F.col("number")), F.lit("</sup> "), F.col("note"), F.lit("</p>"))
    feet = asked.join(known, [*_AT, "id"]).groupBy("path", "page_number").agg(F.array_sort(F.collect_list(F.struct("document", "at", foot.alias("html")))).alias("feet"))
    tag = lambda name: F.concat(F.lit(f"<{name}>"), "html", F.lit(f"</{name}>"))
    head = F.col("heading")
    block = F.struct("leaf", F.when(head, "SectionHeader").otherwise("Text").alias("label"), F.when(head, tag("h3")).otherwise(tag("p")).alias("html"), F.when(head, F.substring("text", 1, TITLE_LETTERS)).alias("title"))
    body = here.groupBy("path", "page_number", "book", "chapter", "has_books").agg(F.array_sort(F.collect_list(block)).alias("body")).join(feet, ["path", "page_number"], "left")
    label = F.concat_ws(", ", F.concat(F.lit("Book "), to_roman(F.col("book"))), F.concat(F.lit("Chapter "), F.col("chapter").cast("string")))
    titled = F.get(F.filter(F.transform("body", lambda b: b["title"]), lambda t: t.isNotNull()), F.lit(0))
    part = lambda kind, c: F.array(F.struct(F.lit(kind).alias("type"), F.col(c).cast("int").alias("value")))
    none = F.array().cast(PARTS_SQL)
    parts = F.concat(F.when(F.col("book").isNotNull(), part("book", "book")).otherwise(none), F.when(F.col("chapter").isNotNull() & (F.col("book").isNotNull() | ~F.col("has_books")), part("chapter", "chapter")).otherwise(none))
    top = F.array(_block(F.lit("PageHeader"), F.concat(F.lit("<p>"), _escaped(title), F.lit("</p>"))))
    text = F.transform("body", lambda b: _block(b["label"], b["html"]))
    last = F.transform(F.coalesce("feet", F.array().cast(feet.schema["feet"].dataType)), lambda n: _block(F.lit("Footnote"), n["html"]))
    return body.select("path", "page_number", F.coalesce(F.nullif(label, F.lit("")), titled, F.lit("Introduction")).alias("printed"), parts.alias("parts"), F.array().cast(f"array<{PARTS_SQL}>").alias("also"), F.concat(top, text, last).alias("blocks"))


# a book of songs and prose

_EVENT = "path string, i int, kind string, n int, name string, html string, refs array<string>"
_QUOTED = r"(?:Bk\.\s*([IVX]+)\.,\s*)?ch\.\s*([ivx]+)\.,\s*p\.\s*\d+\s*,\s*l\.\s*\d+:\s*(.*?)(?=\s*(?:Bk\.\s*[IVX]+\.,\s*)?ch\.\s*[ivx]+\.,\s*p\.|$)"


def song_events(files: DataFrame) -> DataFrame:
    """(path, i, kind, n, name, html, refs) of HTML editions (path, html): ``functions.editions.song_events``, numbered."""
    names = [c.split()[0] for c in _EVENT.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(path, i, x["kind"], x["n"], x["name"], x["html"], x["refs"]) for path, html in zip(f["path"], f["html"], strict=True) for i, x in enumerate(editions.song_events(html or ""))]
            made = pd.DataFrame(rows, columns=names)
            yield made.assign(n=made["n"].astype("Int32"))

    return files.select("path", "html").mapInPandas(run, _EVENT)


def quotations(texts: DataFrame) -> DataFrame:
    """(path, book, prose, nth, source) of lists (path, text) of the sources of quotations; a book goes on until the next is named."""
    plain = F.trim(F.regexp_replace("text", r"\s+", " "))
    group = lambda i: F.regexp_extract_all(plain, F.lit(_QUOTED), i)
    each = texts.select("path", F.posexplode(F.arrays_zip(group(1).alias("book"), group(2).alias("prose"), group(3).alias("source"))).alias("nth", "q"))
    so_far = Window.partitionBy("path").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = F.when(F.col("q.book") != "", roman_to_int(F.lower("q.book")))
    return each.select("path", F.coalesce(F.last(named, ignorenulls=True).over(so_far), F.lit(0)).alias("book"), roman_to_int(F.lower("q.prose")).alias("prose"), "nth", F.trim("q.source").alias("source"))


def song_pages(files: DataFrame, title: str, table: Table = as_it_is) -> DataFrame:
    """(path, page_number, printed, parts, also, blocks) of HTML editions (path, html): a page for each song (metre) and prose section.

    Events are cut where a section starts; what stands before the first book, after an epilogue and among the references is in none. A
    page has the notes it refers to, as it does, and a prose section the sources of its quotations. table: as for ``pages``.
    """
    so_far = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.col("kind") == "book"
    told = table(song_events(files)).withColumn("book", F.last(F.when(head, F.col("n")), ignorenulls=True).over(so_far))
    told = told.withColumn("over", F.max(head & F.col("name").rlike(r"^EPILOGUE\.?$")).over(so_far)).withColumn("listed", F.last(F.when(head, F.upper("name").startswith("REFERENCES TO QUOTATIONS")), ignorenulls=True).over(so_far))
    inside = told.where("book is not null and not over and not listed and kind in ('song', 'prose', 'text')").withColumn("page_number", F.count(F.when(F.col("kind") != "text", 1)).over(so_far).cast("int")).where("page_number > 0")
    sections = inside.where("kind <> 'text'").select("path", "page_number", "kind", "n", "name", "book")
    texts = inside.where("kind = 'text' and html <> ''").groupBy("path", "page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "html"))), lambda x: x["html"]).alias("texts"))
    notes = told.where("kind = 'note'").groupBy("path", F.col("name").alias("ref")).agg(F.max_by("html", "i").alias("note"))
    asked = inside.select("path", "page_number", "i", F.posexplode("refs").alias("nth", "ref")).join(notes, ["path", "ref"])
    feet = asked.groupBy("path", "page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "nth", "note"))), lambda x: x["note"]).alias("notes"))
    lists = told.where("kind = 'sources'").groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "html"))), lambda x: x["html"]), " ").alias("text"))
    quoted = quotations(lists).groupBy("path", "book", F.col("prose").alias("n")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "source"))), lambda x: x["source"]).alias("quoted")).withColumn("kind", F.lit("prose"))
    made = sections.join(texts, ["path", "page_number"], "left").join(feet, ["path", "page_number"], "left").join(quoted, ["path", "book", "n", "kind"], "left")
    none = F.array().cast("array<string>")
    block = lambda label, tag, lead="": lambda x: _block(F.lit(label), F.concat(F.lit(f"<{tag}>{lead}"), x, F.lit(f"</{tag}>")))
    book, kind = F.concat(F.lit("Book "), to_roman(F.col("book"))), F.concat(F.initcap("kind"), F.lit(" "), to_roman(F.col("n")))
    named = F.concat(kind, F.when(F.col("name") != "", F.concat(F.lit(". "), _escaped(F.col("name")))).otherwise(""))
    blocks = F.concat(
        F.array(block("PageHeader", "p")(_escaped(F.lit(title))), block("PageHeader", "p")(book), block("SectionHeader", "h3")(named)),
        F.transform(F.coalesce("texts", none), block("Text", "p")),
        F.transform(F.coalesce("notes", none), block("Footnote", "p")),
        F.transform(F.coalesce("quoted", none), lambda x: block("Footnote", "p", "Quoted: ")(_escaped(x))),
    )
    part = F.when(F.col("kind") == "song", "metre").otherwise("prose")
    parts = F.array(F.struct(F.lit("book").alias("type"), F.col("book").cast("int").alias("value")), F.struct(part.alias("type"), F.col("n").cast("int").alias("value")))
    return made.select("path", "page_number", F.concat(book, F.lit(", "), kind).alias("printed"), parts.alias("parts"), F.array().cast(f"array<{PARTS_SQL}>").alias("also"), blocks.alias("blocks"))

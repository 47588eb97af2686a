"""Scanned books: blocks, printed page numbers, footnotes and the citations in them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..schema import BLOCK_LABELS

#: Labels of blocks that are pictures.
IMAGES = ("Picture", "Figure", "Diagram")
#: Pairs of digits that scanning takes for each other.
CONFUSED = frozenset(("38", "83", "56", "65", "17", "71", "08", "80", "09", "90", "68", "86"))
#: Scores and costs of the numbering. A page that reads the number, nearly reads it, reads others; a
#: small and a large change of the offset, and what is small (twice that where a scan shows two pages).
READS, NEARLY, OTHERS, NEAR_COST, FAR_COST, NEAR = 2, 1, -1, 4, 30, 12
#: Pages and their share with two numbers from which scans show two pages; pages beyond the outermost sure one.
TWIN_PAGES, TWIN_SHARE, EDGE = 10, 0.4, 2
#: So many pairs of a page and an offset are looked at together, about.
CELLS = 100_000

_ROMAN_PAGE = re.compile(r"(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")


def blocks(pages: DataFrame) -> DataFrame:
    """(book_id, page_number, position, label, html, bbox) of (book_id, page, blocks): pictures and empty blocks go, unknown labels are Text."""
    each = pages.select("book_id", F.col("page").alias("page_number"), F.explode("blocks").alias("b")).select("book_id", "page_number", "b.*")
    kept = each.where(~F.col("label").isin(*IMAGES) & (X.squashed(X.stripped(F.coalesce("html", F.lit("")))) != ""))
    n = F.row_number().over(Window.partitionBy("book_id", "page_number").orderBy("reading_order")) - 1
    return kept.select("book_id", "page_number", n.cast("int").alias("position"), F.when(F.col("label").isin(*BLOCK_LABELS), F.col("label")).otherwise("Text").alias("label"), "html", "bbox")


def candidates(pages: DataFrame) -> DataFrame:
    """(book_id, page, numbers, roman): numbers that a page's running heads and feet may print."""
    heads = F.filter("blocks", lambda b: b["label"].isin("PageHeader", "PageFooter"))
    texts = F.transform(heads, lambda b: X.squashed(F.regexp_replace(X.stripped(b["html"]), r"[\[\](){}—–]|^\s*-+|-+\s*\z", " ")))
    digits = lambda t: F.filter(
        F.when(t.rlike(r"^\d{1,4}\z"), F.array(t)).otherwise(F.array(F.regexp_extract(t, r"^(\d{1,4})\s+\D", 1), F.regexp_extract(t, r"\D\s+(\d{1,4})\z", 1))), lambda x: x != ""
    )
    roman = lambda t: F.coalesce(*(F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (r"^([ivxlcIVXLC]{1,7})\.?\z", r"^([ivxlc]{1,7})\s+\D", r"\D\s+([ivxlc]{1,7})\z")))
    return pages.select("book_id", "page", F.transform(F.flatten(F.transform(texts, digits)), lambda x: x.cast("int")).alias("numbers"), F.transform(texts, roman).alias("romans")).select(
        "book_id", "page", "numbers", F.get(F.filter("romans", lambda r: F.lower(r).rlike(rf"^{_ROMAN_PAGE.pattern}\z")), F.lit(0)).alias("roman")
    )


_ALIKE = np.zeros((10, 10), bool)
_ALIKE[[int(x[0]) for x in CONFUSED], [int(x[1]) for x in CONFUSED]] = True


def nearly(read: int | np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of the wanted numbers differ from the one read, or from those read (of a shape that goes with theirs), in one digit that scanning confuses."""
    read, wanted = np.broadcast_arrays(np.asarray(read, np.int64), np.atleast_1d(wanted))
    places = 10 ** np.arange(len(str(read.max(initial=0))))
    top = places[np.maximum(np.searchsorted(places, read, side="right") - 1, 0)]
    a, b = read[..., None] // places % 10, wanted[..., None] // places % 10
    as_long = (wanted >= np.where(read > 9, top, 0)) & (wanted < 10 * top)
    return as_long & ((a != b).sum(-1) == 1) & ((a == b) | _ALIKE[a, b]).all(-1)


def near_numbers(read: Column, wanted: Column) -> Column:
    """``nearly`` of two columns."""
    a, b = F.split(read.cast("string"), ""), F.split(wanted.cast("string"), "")
    wrong = F.filter(F.zip_with(a, b, lambda x, y: F.concat(x, y)), lambda x: F.substring(x, 1, 1) != F.substring(x, 2, 1))
    return (F.size(a) == F.size(b)) & (F.size(wrong) == 1) & F.coalesce(F.get(wrong, F.lit(0)).isin(*sorted(CONFUSED)), F.lit(False))


def _gains(at: np.ndarray, numbers: list[list[int]], offsets: np.ndarray) -> np.ndarray:
    """What each page (row) says for each offset (column); many pages at a time."""
    out = np.zeros((len(at), len(offsets)), np.int64)
    some = np.array([i for i, read in enumerate(numbers) if read], np.int64)
    step = max(CELLS // len(offsets), 1)
    for pages in (some[i : i + step] for i in range(0, len(some), step)):
        sizes = [len(numbers[i]) for i in pages]
        read = np.array([c for i in pages for c in numbers[i]], np.int64)[:, None]
        want = np.repeat(at[pages], sizes)[:, None] + offsets
        each = np.select([want == read, nearly(read, want)], [READS, NEARLY], OTHERS)
        out[pages] = np.maximum.reduceat(each, np.cumsum([0, *sizes[:-1]]), axis=0)
    return out


def _likeliest(gains: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """The path of columns with the greatest gains less the costs of its changes; of equal ones that which stays."""
    here = np.arange(gains.shape[1])
    total, came = gains[0], []
    for gain in gains[1:]:
        reached = total[None, :] - costs
        best = reached.argmax(1)
        best = np.where(reached[here, here] >= reached[here, best], here, best)
        came.append(best)
        total = reached[here, best] + gain
    path = [int(total.argmax())]
    for best in reversed(came):
        path.append(int(best[path[-1]]))
    return np.array(path[::-1])


def _filled(value: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Pages whose number holds: sure ones, ones that fit between their sure neighbours, and up to two beside the first or the last."""
    n, here = len(value), np.arange(len(value))
    last = np.maximum.accumulate(np.where(sure, here, -1))
    coming = np.minimum.accumulate(np.where(sure, here, n)[::-1])[::-1]
    before, after = np.append(-1, last[:-1]), np.append(coming[1:], n)
    led, followed = before >= 0, after < n
    fits = (~led | (value > value[before])) & (~followed | (value < value[np.minimum(after, n - 1)]))
    beside = np.where(led, ~followed & (here - before <= EDGE), followed & (after - here <= EDGE) & (value >= 1))
    return sure | (fits & ((led & followed) | beside))


def numbering(page: list[int], numbers: list[list[int]], roman: list[str]) -> list[str]:
    """The printed number of each page of a book, '' where there is none.

    A printed number is the scan's plus an offset that changes seldom, so the offsets are those of the likeliest path through
    all pages: pages gain by what they read, changes of the offset cost. Pages that read their number are sure; others
    get theirs if it fits between sure neighbours, or next to the first or last one, and no other page has it.
    """
    blank = [r or "" for r in roman]
    read = [set(x) for x in numbers if x]
    twin = len(read) >= TWIN_PAGES and sum(any(c + 1 in x for c in x) for x in read) >= TWIN_SHARE * len(read)
    at = np.array(page, np.int64) * (2 if twin else 1)
    if twin:  # both numbers of a scan stand for its left page
        numbers = [sorted({c - (c - 1 in x) for c in x}) for x in numbers]
    offsets = np.unique([c - int(a) for x, a in zip(numbers, at, strict=True) for c in x]).astype(np.int64)
    if not len(offsets):
        return blank
    apart = np.abs(offsets[:, None] - offsets)
    gains = _gains(at, numbers, offsets)
    path = _likeliest(gains, np.select([apart == 0, apart <= NEAR * (1 + twin)], [0, NEAR_COST], FAR_COST))
    value = at + offsets[path]
    sure = (gains[np.arange(len(at)), path] > 0) & (value >= 1)
    shown = [(f"{v}-{v + 1}" if twin else str(v)) if ok else b for v, ok, b in zip(value.tolist(), _filled(value, sure), blank, strict=True)]
    times = Counter(shown)
    return [x if times[x] == 1 or ok else b for x, ok, b in zip(shown, sure, blank, strict=True)]


def printed_numbers(pages: DataFrame) -> DataFrame:
    """(book_id, page, printed): a book's pages are numbered together, as what a page prints depends on all others.

    Books are streamed through their partition in order, many to a batch, so that small books cost little.
    """
    rows = candidates(pages).select("book_id", F.col("page").cast("int").alias("page"), "numbers", "roman")
    ordered = rows.repartition("book_id").sortWithinPartitions("book_id", "page")

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = ((r["book_id"], r["page"], r["numbers"] or [], r["roman"] or "") for b in batches for r in b.to_pylist())
        out: list[tuple] = []
        for book, group in groupby(every, key=lambda r: r[0]):
            found = list(group)
            printed = numbering([r[1] for r in found], [r[2] for r in found], [r[3] for r in found])
            out += [(book, r[1], p) for r, p in zip(found, printed, strict=True)]
            if len(out) >= 10_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return ordered.mapInArrow(number, "book_id string, page int, printed string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    book, page, printed = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(book, pa.string()), pa.array(page, pa.int32()), pa.array(printed, pa.string())], names=["book_id", "page", "printed"])


_MARK = r"[.*+?^${}()|\[\]\\]"


def placed_citations(citations: DataFrame, page_blocks: DataFrame) -> DataFrame:
    """(citation columns, position): each citation in the first footnote block of its page that has its marker.

    Without a marker in the first one; null where no block has it. Both sides have the columns book_id and
    page_number.
    """
    notes = page_blocks.where("label = 'Footnote'").select("book_id", "page_number", "position", "html")
    plain = X.stripped(F.regexp_replace("html", r"(?i)</p>|<br\s*/?>", "\n"))
    marker = F.regexp_replace("footnote", f"({_MARK})", r"\\$1")
    hit = F.when(F.col("footnote") == "", F.lit(True)).otherwise(
        F.rlike(F.col("html"), F.concat(F.lit(r"<sup>\s*"), marker, F.lit(r"\s*</sup>"))) | F.rlike(plain, F.concat(F.lit(r"(^|\n)\s*"), marker, F.lit(r"[\s.)]")))
    )
    met = citations.select("id", "book_id", "page_number", "footnote").join(notes, ["book_id", "page_number"]).where(hit)
    first = met.groupBy("id").agg(F.min("position").alias("position"))
    return citations.join(first, "id", "left")


_PARAGRAPH_MARK = r"(?i)^\s*<p>\s*(?:<sup>\s*([^<]+?)\s*</sup>|(\d{1,3}\)?|[*†‡])\s)"
_NOT_SHOWN = ("PageHeader", "PageFooter", "Footnote")


def note_paragraphs(page_blocks: DataFrame) -> DataFrame:
    """(book_id, page_number, block, at, mark, note): the paragraphs of a page's footnotes in order; ``note`` counts the marked ones so far."""
    each = F.filter(F.split("html", r"(?i)(?=<p[\s>])"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")
    notes = page_blocks.where("label = 'Footnote'").select("book_id", "page_number", "position", F.col("id").alias("block"), F.posexplode(each).alias("nth", "paragraph"))
    written = F.coalesce(F.nullif(F.regexp_extract("paragraph", _PARAGRAPH_MARK, 1), F.lit("")), F.regexp_extract("paragraph", _PARAGRAPH_MARK, 2))
    marked = notes.withColumn("mark", F.when(F.col("paragraph").rlike(_PARAGRAPH_MARK), _bare_mark(written))).withColumn("at", F.struct("position", "nth"))
    return marked.withColumn("note", F.count("mark").over(Window.partitionBy("book_id", "page_number").orderBy("at")))


def _bare_mark(mark: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(mark, F.lit(""))), r"[).]+$", "")


def source_pages(citations: DataFrame, page_blocks: DataFrame) -> DataFrame:
    """(id, html) of citations (id, block_id, book_id, page_number, footnote): the page of each, with no footnote but its own.

    The paragraphs of a page's footnotes fall into runs, each a marked one and the unmarked ones after it, over blocks too. A citation
    shows the run that its mark opens in its block; without a mark, the rest of the run that goes on into the block; where there is neither,
    the block as it is. Heads and feet are left out; a page of which nothing is shown is empty, and one without blocks gives no row.
    """
    page = ["book_id", "page_number"]
    paragraphs = note_paragraphs(page_blocks)
    asked = citations.select("id", "block_id", *page, _bare_mark(F.col("footnote")).alias("wanted"))
    opens = F.when(F.col("wanted") == "", (F.col("nth") == 0) & F.col("mark").isNull()).otherwise(F.col("mark") == F.col("wanted"))
    begun = asked.join(paragraphs, page).where(F.col("block") == F.col("block_id")).where(opens).groupBy("id", *page).agg(F.min(F.struct("at", "note")).alias("start"))
    run = begun.join(paragraphs, page).where((F.col("note") == F.col("start.note")) & (F.col("at") >= F.col("start.at")))
    own = run.groupBy("id", "position").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "paragraph"))), lambda x: x["paragraph"]), "").alias("html"))
    blocks = page_blocks.select(*page, "position", F.col("id").alias("block"), "label", "html")
    whole = asked.join(begun.select("id"), "id", "left_anti").join(blocks.where("label = 'Footnote'"), page).where(F.col("block") == F.col("block_id"))
    body = asked.join(blocks.where(~F.col("label").isin(*_NOT_SHOWN)), page).select("id", "position", "html")
    notes = own.unionByName(whole.select("id", "position", "html")).withColumn("html", F.regexp_replace("html", r"^\s+|\s+$", ""))
    shown = body.unionByName(notes).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "html"))), lambda x: x["html"]), "\n").alias("html"))
    known = asked.join(page_blocks.select(*page).distinct(), page).select("id")
    return known.join(shown, "id", "left").select("id", F.coalesce("html", F.lit("")).alias("html"))


#: The answer of a footnote reader, a page each.
ANSWER = """struct<footnotes: array<struct<identifier: string, citations: array<struct<author: string, title: string, location: string, raw: string,
  locationsCited: array<array<struct<rawLabel: string, type: string, values: array<double>>>>>>>>, additionalInsights: array<struct<insight: string, score: int, keywords: array<string>>>>"""


def answered_citations(answers: DataFrame) -> DataFrame:
    """(book_id, page, footnote, n, author, title, location, raw, locations) of (book_id, page, answer): JSON to rows."""
    read = answers.select("book_id", "page", F.from_json("answer", ANSWER.replace("\n", " ")).alias("a"))
    notes = read.select("book_id", "page", F.posexplode("a.footnotes").alias("f", "note"))
    cited = notes.select("book_id", "page", F.col("note.identifier").alias("footnote"), "f", F.posexplode("note.citations").alias("c", "cit"))
    return cited.select("book_id", "page", "footnote", (F.shiftleft(F.col("f").cast("long"), 31) + F.col("c")).alias("n"), "cit.author", "cit.title", "cit.location", "cit.raw", F.col("cit.locationsCited").alias("locations"))

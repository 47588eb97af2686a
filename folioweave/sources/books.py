"""Books as they come: scans as JSON, plain-text editions, ThML files. Files are read by Spark, from any store."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import thml, volumes
from ..functions.volume_authors import VOLUME_AUTHORS
from ..operators.editions import pages as pages_of_editions
from ..operators.editions import song_pages as pages_of_songs
from .archives import register

#: Pages of one frame from Python, at least where more are to come.
FRAME = 5_000

SCAN = "map<string, array<struct<page: int, blocks: array<struct<label: string, html: string, reading_order: int, bbox: array<double>>>>>>"


def scans(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(book_id, page, blocks) of recognised scans, a JSON file (or line) for each book: its first entry is the book."""
    whole = spark.read.text(path, wholetext=not lines)
    first = whole.select(F.get(F.map_entries(F.from_json("value", SCAN)), F.lit(0)).alias("e"))
    return first.select(F.col("e.key").alias("book_id"), F.explode("e.value").alias("p")).select("book_id", "p.page", "p.blocks")


def text_edition(spark: SparkSession, path: str) -> DataFrame:
    """``edition_texts`` of plain-text files."""
    return edition_texts(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def edition_texts(files: DataFrame) -> DataFrame:
    """(path, book, position, paragraph) of editions (path, text): from the first "BOOK n" line to "THE END", paragraphs by blank lines."""
    whole = files.select("path", F.regexp_replace("text", "\r\n?", "\n").alias("t"))
    body = F.regexp_extract("t", r"(?ms)^(BOOK [IVXLC\d]+\b.*?)(?:^\s*THE END\b.*)?\z", 1)
    each = whole.select("path", F.posexplode(F.split(body, r"\n[ \t]*\n+")).alias("position", "raw"))
    kept = each.withColumn("paragraph", F.trim(F.regexp_replace("raw", r"\s+", " "))).where("paragraph <> ''")
    head = F.when(F.col("paragraph").rlike(r"^BOOK [IVXLC\d]+\.?$"), F.regexp_extract("paragraph", r"^BOOK ([IVXLC\d]+)", 1))
    so_far = Window.partitionBy("path").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = kept.withColumn("head", head).withColumn("book", F.last("head", ignorenulls=True).over(so_far))
    return marked.where("head is null").select("path", "book", "position", "paragraph")


def _spread(files: DataFrame, *by: str) -> DataFrame:
    """Files dealt to all tasks by path, or by the columns given: a table of them may come as a partition or two, which is little to read and long to parse."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(by or ("path",)))


def thml_divs(files: DataFrame) -> DataFrame:
    """(path, div, parent, level, id, title, short_title, kind, own) of (path, xml): the divs of each file in reading order.

    A file is parsed as a whole in one task; div and parent are positions in it, parent -1 at the top.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(path, *d) for path, xml in zip(f.path, f.xml, strict=True) for d in thml.divs(xml or "")]
            yield pd.DataFrame(rows, columns=["path", "div", "parent", "level", "id", "title", "short_title", "kind", "own"])

    return _spread(files.select("path", "xml")).mapInPandas(run, "path string, div int, parent int, level int, id string, title string, short_title string, kind string, own string")


_SO_FAR = "path string, block long, seq long, text string, tag string, opened long, s long, low long, divs long, run long"


def _so_far(rows: DataFrame) -> DataFrame:
    """Rows with sums over the rows of their block up to them: ``s`` of steps and ``low``, its least, ``divs`` of those opened, ``run`` of tags. Rows of a block are those of one task, in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, s, low, divs, tags = None, 0, 0, 0, 0
        for batch in batches:
            blocks, paths = batch.column("block").to_numpy(), batch.column("path").dictionary_encode()
            ids = paths.indices.to_numpy()
            starts = np.flatnonzero((np.diff(blocks, prepend=blocks[:1]) != 0) | (np.diff(ids, prepend=ids[:1]) != 0)) if len(ids) else []
            sums: list[list[np.ndarray]] = [[], [], [], []]
            for a, b in zip([0, *starts], [*starts, len(ids)], strict=True):
                if a == b:
                    continue
                here = (paths.dictionary[int(ids[a])].as_py(), int(blocks[a]))
                if here != last:
                    last, s, low, divs, tags = here, 0, None, 0, 0
                each = [batch.column(c).slice(a, b - a).to_numpy(zero_copy_only=False) for c in ("step", "opened", "tagged")]
                total = np.cumsum(each[0]) + s
                least = np.minimum.accumulate(total if low is None else np.minimum(total, low))
                for kept, x in zip(sums, (total, least, np.cumsum(each[1]) + divs, np.cumsum(each[2]) + tags), strict=True):
                    kept.append(x.astype(np.int64))
                s, low, divs, tags = (int(kept[-1][-1]) for kept in sums)
            found = [np.concatenate(x) if x else np.empty(0, np.int64) for x in sums]
            names = ["path", "block", "seq", "text", "tag", "opened"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(x, pa.int64()) for x in found)], names=[*names, "s", "low", "divs", "run"])

    return rows.mapInArrow(run, _SO_FAR)


def _run_texts(rows: DataFrame) -> DataFrame:
    """(path, block, seq, run, text, whole): what stands between two tags, joined within a batch; ``whole`` if both tags are there, else the rest is in a row before or after it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            block, number = batch.column("block").to_numpy(), batch.column("run").to_numpy()
            path, text = batch.column("path").dictionary_encode().indices.to_numpy(), batch.column("text").to_pylist()
            apart = (np.diff(block) != 0) | (np.diff(path) != 0)
            starts = np.concatenate([[0], np.flatnonzero(apart | (np.diff(number) != 0)) + 1])
            ends = np.append(starts[1:], len(text))
            same = ~apart[starts[1:] - 1]  # whether a run and the one before it are of one block
            whole = np.append(False, same) & np.append(same, False)
            first = batch.take(pa.array(starts))
            joined = pa.array(["".join(text[a:b]) for a, b in zip(starts, ends, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*(first.column(c) for c in ("path", "block", "seq", "run")), joined, pa.array(whole)], names=["path", "block", "seq", "run", "text", "whole"])

    return rows.mapInArrow(run, "path string, block long, seq long, run long, text string, whole boolean")


def thml_file_divs(spark: SparkSession, path: str, table: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``thml_divs`` of files at a path, a large file by all tasks.

    Files are read as rows that end with a tag (at ``>``), which Spark splits by bytes; a row starts with the text before its tag.
    Depths and numbers of divs are sums over the rows before: within a block of a file, which a task reads in order and adds up as it goes (``_so_far``), and of the
    blocks before it. No task sorts or holds the rows of a block. ``table`` keeps what is read again: a row a block, and a row a div tag. A run is what
    stands between two div tags; the div it belongs to is the last one opened at the depth there, looked up among the runs, which carry no text. A
    closing tag without a div to close is passed over.
    """
    rows = spark.read.option("lineSep", ">").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")
    tag = F.regexp_extract("value", r"(?s)<(/?div\d\b[^<>]*)\z", 1)
    read = rows.withColumn("tag", tag).withColumn("text", F.when(F.col("tag") == "", F.concat("value", F.lit(">"))).otherwise(F.expr("left(value, length(value) - length(tag) - 1)")))
    closes, alone = F.col("tag").startswith("/"), F.rtrim("tag").endswith("/")
    step = F.when(F.col("tag") == "", 0).when(closes, -1).when(alone, 0).otherwise(1)
    opened = ((F.col("tag") != "") & ~closes).cast("long")
    local = _so_far(read.select("path", "block", "seq", "text", "tag", step.alias("step"), opened.alias("opened"), (F.col("tag") != "").cast("long").alias("tagged")))
    # what the blocks before have: a row a block
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = local.groupBy("path", "block").agg(F.max_by("s", "seq").alias("all_s"), F.min("s").alias("all_low"), F.sum("opened").alias("all_divs"), F.max("run").alias("all_runs"))
    blocks = blocks.withColumn("s0", F.coalesce(F.sum("all_s").over(before), F.lit(0)))
    blocks = blocks.select("path", "block", "s0", F.coalesce(F.min(F.col("s0") + F.col("all_low")).over(before), F.lit(0)).alias("low0"), *(F.coalesce(F.sum(f"all_{c}").over(before), F.lit(0)).alias(f"{c}0") for c in ("divs", "runs")), F.sum("all_runs").over(Window.partitionBy("path")).alias("tags"))
    blocks = table(blocks)
    met = local.join(blocks, ["path", "block"])
    total, low = F.col("s") + F.col("s0"), F.least(F.col("low0"), F.col("low") + F.col("s0"), F.lit(0))
    met = met.select("path", "block", "seq", "text", "tag", "opened", (total - low).alias("depth"), (F.col("divs") + F.col("divs0") - 1).alias("div"), (F.col("run") + F.col("runs0")).alias("run"), "tags", closes.alias("closes"), alone.alias("alone"))
    # a row's text belongs to the run before its tag; what comes behind the last tag is in no div that ends
    ahead = F.col("run") - (F.col("tag") != "").cast("long")
    joined = _run_texts(local.select("path", "block", "seq", ahead.alias("run"), "text")).where("text <> ''").join(blocks.select("path", "block", "runs0", "tags"), ["path", "block"])
    joined = joined.withColumn("run", F.col("run") + F.col("runs0")).where(F.col("run") < F.col("tags"))
    # only runs that batches or blocks cut are put together by a shuffle
    cut = joined.where("not whole").groupBy("path", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "seq", "text"))), lambda x: x["text"]), "").alias("text"))
    texts = joined.where("whole").select("path", "run", "text").unionByName(cut)
    tags = met.where("tag <> ''").select("path", "run", "tag", "opened", "alone", "div", F.when(F.col("alone"), F.col("depth") + 1).otherwise(F.col("depth")).alias("depth"), F.col("depth").alias("inside"))
    tags = table(tags)
    own_run = F.when(F.col("alone") & (F.col("opened") == 1), F.col("inside")).otherwise(F.col("depth"))
    # asks look for the last div opened at a depth, at most at their run
    opens = tags.where("opened = 1 and not alone").select("path", F.col("depth").alias("at"), "run", F.lit(0).alias("asks"), "div")
    parents = tags.where("opened = 1").select("path", (F.col("depth") - 1).alias("at"), (F.col("run") - 1).alias("run"), F.lit(1).alias("asks"), "div")
    owners = tags.select("path", own_run.alias("at"), "run", F.lit(2).alias("asks"), F.lit(None).cast("long").alias("div"))
    so_far = Window.partitionBy("path", "at").orderBy("run", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = opens.unionByName(parents).unionByName(owners).withColumn("last", F.last(F.when(F.col("asks") == 0, F.col("div")), ignorenulls=True).over(so_far))
    parent = found.where("asks = 1").select("path", "div", F.coalesce("last", F.lit(-1)).alias("parent"))
    owner = found.where("asks = 2 and at > 0 and last is not null").select("path", "run", F.col("last").alias("div"))
    # a table of tags is far smaller than its rows, so that Spark would take these sides for small ones and broadcast them
    own = texts.join(owner.hint("merge"), ["path", "run"]).groupBy("path", "div").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "text"))), lambda x: x["text"]), "").alias("own"))
    value = lambda name: F.regexp_extract("tag", rf'\b{name}="([^"]*)"', 1)
    named = tags.where("opened = 1").select("path", "div", F.regexp_extract("tag", r"div(\d)", 1).cast("int").alias("level"), value("id").alias("id"), value("title").alias("title"), value("shorttitle").alias("short_title"), value("type").alias("kind"))
    out = named.join(parent.hint("merge"), ["path", "div"]).join(own.hint("merge"), ["path", "div"], "left")
    return out.select("path", F.col("div").cast("int").alias("div"), F.col("parent").cast("int").alias("parent"), "level", "id", "title", "short_title", "kind", F.coalesce("own", F.lit("")).alias("own"))


def thml_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))


_CITATION = "struct<author: string, title: string, location: string, raw: string, reference_book_id: string>"
PAGES = f"""path string, book_id string, title string, author string, page_number int, printed string, parts array<struct<type: string, value: int>>, also array<array<struct<type: string, value: int>>>,
  blocks array<struct<label: string, html: string, citations: array<{_CITATION}>>>""".replace("\n", " ")


def _place(place: list[tuple[str, int]]) -> list[dict]:
    return [{"type": t, "value": v} for t, v in place]


def _rows(path: str, book: dict) -> Iterator[tuple]:
    """The pages of a book, numbered from 1."""
    for n, p in enumerate(book["pages"], 1):
        blocks = [{"label": label, "html": html, "citations": [{k: v for k, v in c.items() if k != "passages"} for c in cites]} for label, html, cites in p["blocks"]]
        yield path, book["book_id"], book["title"], book["author"], n, p["printed"], _place(p["parts"]), [_place(x) for x in p["also"]], blocks


def _books(files: DataFrame, column: str, read) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in "path, book_id, title, author, page_number, printed, parts, also, blocks".split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for f in frames:
            for path, content in zip(f["path"], f[column], strict=True):
                rows += (row for book in read(path, content) for row in _rows(path, book))
                if len(rows) >= FRAME:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        yield pd.DataFrame(rows, columns=names)

    return _spread(files.select("path", column)).mapInPandas(run, PAGES)


def volume_pages(files: DataFrame, authors: dict[str, dict] = VOLUME_AUTHORS) -> DataFrame:
    """Pages of all works in volumes (path, xml); the file's name is the volume's. authors: rules by volume (``volumes.author``)."""
    return _books(files, "xml", lambda path, xml: volumes.volume_books(file_stem(path), xml, authors.get(file_stem(path))))


def single_work_pages(files: DataFrame, book_id: str, title: str, author: str) -> DataFrame:
    """Pages of files (path, xml) that are one work each."""
    return _books(files, "xml", lambda path, xml: [{"book_id": book_id, "title": title, "author": author, "pages": volumes.single_book(xml, title)}])


def summa_pages(files: DataFrame, book_id: str = "summa-theologiae") -> DataFrame:
    return _books(files, "xml", lambda path, xml: [{"book_id": book_id, "title": "Summa Theologiae", "author": "Thomas Aquinas", "pages": volumes.summa_pages(xml)}])


def bible_pages(files: DataFrame, book_id: str = "douay-rheims") -> DataFrame:
    return _books(files, "xml", lambda path, xml: [{"book_id": book_id, "title": "The Holy Bible", "author": "Bible", "pages": volumes.bible_pages(xml)}])


def epub_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, document, name, xhtml) of the EPUB archives at a path; filters on path and name reach the listing."""
    register(spark)
    return spark.read.format("epub").load(path)


def write_epubs(documents: DataFrame, path: str) -> None:
    """An archive for each path of (path, document, name, xhtml)."""
    register(documents.sparkSession)
    documents.select("path", "document", "name", "xhtml").repartition("path").sortWithinPartitions("path", "document").write.format("epub").mode("append").save(path)


def edition_pages(documents: DataFrame, author: str, **reading) -> DataFrame:
    """Pages of works in documents (path, document, name, xhtml); the path's name gives id and title."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)\z", 1), r"\.[^.]*\z", "")
    title = F.replace(stem, F.lit("_"), F.lit(" "))
    found = pages_of_editions(_spread(documents, "path", "document"), title, **reading)
    book_id = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return found.select("path", book_id.alias("book_id"), title.alias("title"), F.lit(author).alias("author"), "page_number", "printed", "parts", "also", "blocks")


def epub_pages(spark: SparkSession, path: str, author: str, **reading) -> DataFrame:
    """Pages of the EPUB archives at a path, a work each."""
    return edition_pages(epub_documents(spark, path), author, **reading)


def song_pages(files: DataFrame, book_id: str, title: str, author: str, **reading) -> DataFrame:
    """Pages of HTML editions (path, html) of songs and prose."""
    found = pages_of_songs(_spread(files), title, **reading)
    return found.select("path", F.lit(book_id).alias("book_id"), F.lit(title).alias("title"), F.lit(author).alias("author"), "page_number", "printed", "parts", "also", "blocks")


def marked_blocks(blocks: DataFrame) -> DataFrame:
    """(key, html, footnotes) of (key, thml): citations in the text numbered, each with its footnote. A text that comes again in a batch is read once."""
    cited = pa.struct([(c, pa.string()) for c in ("author", "title", "location", "raw", "reference_book_id")])
    kind = pa.list_(pa.struct([("identifier", pa.string()), ("kind", pa.string()), ("raw", pa.string()), ("citations", pa.list_(cited))]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).dictionary_encode()
            found = [thml.marked(x) for x in texts.dictionary.to_pylist()]
            columns = (pa.array([h for h, _ in found], pa.string()), pa.array([n for _, n in found], kind))
            yield pa.RecordBatch.from_arrays([b.column(0), *(c.take(texts.indices) for c in columns)], names=["key", "html", "footnotes"])

    rows = blocks.select(F.col("key").cast("string").alias("key"), F.coalesce("thml", F.lit("")).alias("thml"))
    return rows.mapInArrow(run, f"key string, html string, footnotes array<struct<identifier: string, kind: string, raw: string, citations: array<{_CITATION}>>>")


def file_stem(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])

"""Summaries of what others say about a page: what is asked, what an answer says, and the stored ones that a change makes stale.

The service that answers is not part of the library: ``questions`` gives a text for each page, ``summaries`` reads the answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import page_text
from .citing import invalidated
from .writes import upserted

#: The form of an answer.
ANSWER = "struct<overview: string, sources: array<struct<sourceId: string, summary: string>>>"


def _heading(number: Column, printed: Column) -> Column:
    return F.concat(F.lit("[scan page "), number.cast("string"), F.when(printed != "", F.concat(F.lit(", printed page "), printed)).otherwise(""), F.lit("]"))


def questions(sources: DataFrame, books: DataFrame, pages: DataFrame, blocks: DataFrame, most: int = 400_000) -> DataFrame:
    """(book_id, page_number, question, n_sources): a page that is cited, then each source with the pages around it, in order.

    sources: ``citing.insight_sources``. A source whose context would take all contexts so far beyond ``most`` characters is named without it; those after it
    are judged by what has been taken. A page without blocks or a book without a row is named as far as it is known.
    """
    of = books.select(F.col("id").alias("_id"), F.concat(F.lit('"'), "title", F.lit('" by '), F.when(F.col("author") == "", "an unknown author").otherwise(F.col("author"))).alias("name"))
    so_far = Window.partitionBy("book_id", "page_number").orderBy("rank")
    sized = sources.withColumn("size", F.length("context")).withColumn("all", F.sum("size").over(so_far)).withColumn("given", F.when(F.col("all") <= most, F.col("context")).otherwise(""))
    named = sized.join(of, F.col("source_book_id") == F.col("_id"), "left")
    notes = F.coalesce(F.nullif(F.array_join("footnotes", ", "), F.lit("")), F.lit("(unnumbered)"))
    told = F.concat(F.lit("SOURCE S"), F.col("rank").cast("string"), F.lit(": "), F.coalesce("name", F.col("source_book_id")), F.lit(". Footnote "), notes, F.lit(" on scan page "), F.col("source_page").cast("string"), F.lit("."))
    each = named.select("book_id", "page_number", "rank", F.concat_ws("\n\n", told, F.nullif("given", F.lit(""))).alias("text"))
    listed = each.groupBy("book_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("texts"), F.count("*").alias("n_sources"))
    text = blocks.groupBy("book_id", "page_number").agg(page_text(F.array_sort(F.collect_list(F.struct("position", "label", "html")))).alias("page"))
    asked = listed.join(pages.select("book_id", "page_number", "printed"), ["book_id", "page_number"], "left").join(text, ["book_id", "page_number"], "left").join(of, F.col("book_id") == F.col("_id"), "left")
    head = F.concat(F.lit("PAGE: "), F.coalesce("name", F.col("book_id")), F.lit(", "), _heading(F.col("page_number"), F.coalesce("printed", F.lit(""))))
    return asked.select("book_id", "page_number", F.concat_ws("\n\n", head, F.nullif("page", F.lit("")), "texts").alias("question"), "n_sources")


def summaries(sources: DataFrame, answers: DataFrame) -> DataFrame:
    """(book_id, page_number, overview, rank, source_book_id, source_page, summary): every source of an answered page, in order.

    answers: (book_id, page_number, answer), JSON. Sources that an answer leaves out have an empty summary, those that it made up are ignored; of several for
    one source the last counts. An answer that is no JSON gives no rows.
    """
    read = answers.select("book_id", "page_number", F.from_json("answer", ANSWER).alias("a")).where("a.overview is not null")
    said = read.select("book_id", "page_number", F.posexplode("a.sources").alias("n", "s")).groupBy("book_id", "page_number", F.col("s.sourceId").alias("name")).agg(F.max_by("s.summary", "n").alias("summary"))
    known = sources.join(read.select("book_id", "page_number", F.col("a.overview").alias("overview")), ["book_id", "page_number"]).withColumn("name", F.concat(F.lit("S"), F.col("rank").cast("string")))
    out = known.join(said, ["book_id", "page_number", "name"], "left")
    return out.select("book_id", "page_number", "overview", "rank", "source_book_id", "source_page", F.coalesce("summary", F.lit("")).alias("summary"))


def stored(cache: DataFrame, new: DataFrame, pages: DataFrame, groups: DataFrame, changed: DataFrame) -> DataFrame:
    """The stored summaries (book_id, page_number, ...) after new ones come and citations ``changed`` (book_id, citation_id): a page has its latest one, and none once a change cites it by number."""
    return invalidated(upserted(cache, new, ["book_id", "page_number"]), pages, groups, changed)

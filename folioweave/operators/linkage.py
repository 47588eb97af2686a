"""Linking citations to books by author and title, and what is queued for want of a match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .numbering import numbered


def same_books(pairs: DataFrame) -> DataFrame:
    """The pairs (author, title, w_author, w_title, ...) with ``same``: whether a citation's author and title mean the work. Pairs that are the same are compared once."""
    by = ("author", "title", "w_author", "w_title")
    asked = F.when(X.cited_title(F.col("title")) != "", X.cited_title(F.col("title"))).otherwise(F.col("title"))
    read = pairs.select(*by).distinct().select(*by, X.title_forms(asked).alias("_c"), X.title_forms(F.col("w_title")).alias("_o"))
    told = read.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), (X.same_author(F.col("author"), F.col("w_author")) & X.same_title(F.col("_c"), F.col("_o"))).alias("same"))
    met = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(by)))
    return pairs.join(told, met).select(*pairs.columns, "same")


def matching_titles(cited: DataFrame, works: DataFrame) -> DataFrame:
    """(author, title, w_author, w_title): the different authors and titles of works that different (author, title) pairs may mean.

    A work's author has one of the key names of the cited one, and titles that are the same share a key (``title_keys``): pairs
    meet on both, so that a name with many works is as many keys. Works of the same author and title (editions, copies) are
    compared once, and the similarity of titles is computed only where their letters allow it.
    """
    asked = F.when(X.cited_title(F.col("title")) != "", X.cited_title(F.col("title"))).otherwise(F.col("title"))
    pairs = cited.select("author", "title").distinct().select("author", "title", X.key_names(F.col("author")).alias("names"), X.title_forms(asked).alias("forms"))
    known = works.select(F.col("author").alias("w_author"), F.col("title").alias("w_title")).distinct()
    known = known.select("w_author", "w_title", X.surnames(F.col("w_author")).alias("names"), X.title_forms(F.col("w_title")).alias("w_forms"))
    met = candidate_titles(pairs, known)
    return met.where(X.same_title(F.col("forms"), F.col("w_forms"))).select("author", "title", "w_author", "w_title")


def matching_works(cited: DataFrame, works: DataFrame) -> DataFrame:
    """(author, title, id): works that different (author, title) pairs may mean, every copy of each."""
    ids = works.select("id", F.col("author").alias("w_author"), F.col("title").alias("w_title"))
    return matching_titles(cited, works).join(ids, ["w_author", "w_title"]).select("author", "title", "id")


def candidate_titles(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """(author, title, forms, w_author, w_title, w_forms): all pairs that share a name and may be the same title, once each.

    pairs: (author, title, names, forms); known: (w_author, w_title, names, w_forms).
    """
    asked = pairs.where("size(forms.words) > 0").select("author", "title", "forms", F.array_join("forms.words", " ").alias("text"), F.explode(F.array_distinct("names")).alias("token"))
    works = known.where("size(w_forms.words) > 0").select("w_author", "w_title", "w_forms", F.array_join("w_forms.words", " ").alias("text"), F.explode(F.array_distinct("names")).alias("token"))
    ruled = asked.withColumn("key", F.explode(X.title_keys(F.col("forms"), True))).join(works.withColumn("key", F.explode(X.title_keys(F.col("w_forms"), False))).drop("text"), ["token", "key"])
    near = asked.where(F.length("text") >= 12).withColumn("a", X.likeness("text")).withColumn("key", F.explode("a.keys")).withColumn("a", F.struct("a.n", "a.bits", "a.more"))
    others = works.withColumn("b", X.likeness("text")).withColumn("key", F.explode("b.keys")).withColumn("b", F.struct("b.n", "b.bits", "b.more"))
    short = lambda df, *kept: df.select("token", F.col("key"), *kept)
    left, right = short(near, "author", "title", "a"), short(others, "w_author", "w_title", "b")
    met = left.join(right.withColumnsRenamed({"token": "_token", "key": "_key"}), (F.col("token") == F.col("_token")) & (F.col("key") == F.col("_key")) & X.may_be_similar(F.col("key"), F.col("a"), F.col("b")))
    alike = met.select("author", "title", "w_author", "w_title").distinct()
    alike = alike.join(pairs.select("author", "title", "forms"), ["author", "title"]).join(known.select("w_author", "w_title", "w_forms"), ["w_author", "w_title"])
    columns = ("author", "title", "forms", "w_author", "w_title", "w_forms")
    return ruled.select(*columns).unionByName(alike.select(*columns)).dropDuplicates(["author", "title", "w_author", "w_title"])


def match_cited_books(citations: DataFrame, books: DataFrame, queued: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(citation_id, book_id) of citations that cite a book, and the citations to look for.

    Of several matches the volume that the citation names counts, if any match is a volume; the first by id wins.
    Citations without much to go by are to be looked for; those that match something queued are neither.

    Of books with the same author and title only the first can win, so those alone meet the titles; a citation meets the
    winner of its author, title and volume, a row however many copies there are.
    """
    open_ = citations.where("reference_book_id is null").withColumn("skip", X.should_be_skipped(F.col("author"), F.col("title")))
    asked = open_.where(~F.col("skip")).withColumn("wanted", F.coalesce(X.volume_of(F.col("title")), X.volume_of(F.col("location"))))
    firsts = books.groupBy(F.col("author").alias("w_author"), F.col("title").alias("w_title")).agg(F.min("id").alias("book_id")).withColumn("volume", X.volume_of(F.col("w_title")))
    hits = matching_titles(asked, books).join(firsts, ["w_author", "w_title"])
    # a pair's first book of each volume, of none as null
    won = hits.groupBy("author", "title", "volume").agg(F.min("book_id").alias("book_id"))
    won = won.groupBy("author", "title").agg(F.min("book_id").alias("first"), F.map_from_entries(F.collect_list(F.when(F.col("volume").isNotNull(), F.struct("volume", "book_id")))).alias("of"))
    met = asked.select(F.col("id").alias("citation_id"), "author", "title", "wanted").join(won, ["author", "title"])
    book = F.when(F.col("wanted").isNull() | (F.size("of") == 0), F.col("first")).otherwise(F.try_element_at("of", F.col("wanted")))
    links = met.select("citation_id", book.alias("book_id")).where("book_id is not null").groupBy("citation_id").agg(F.min("book_id").alias("book_id"))
    waiting = matching_titles(asked, queued).select("author", "title").distinct()
    rest = asked.drop("wanted").join(links, asked["id"] == links["citation_id"], "left_anti").join(waiting, ["author", "title"], "left_anti")
    return links, rest.select(*open_.columns).unionByName(open_.where("skip")).drop("skip")


def linked(citations: DataFrame, links: DataFrame) -> DataFrame:
    """The citations with ``reference_book_id`` from the links where there is one."""
    l = links.select(F.col("citation_id").alias("_id"), F.col("book_id").alias("_to"))  # noqa: E741
    return citations.join(l, citations["id"] == l["_id"], "left").withColumn("reference_book_id", F.coalesce("_to", "reference_book_id")).select(*citations.columns)


def relinked(groups: DataFrame, replaced: DataFrame) -> DataFrame:
    """Group rows of the replaced citations go, the given ones (same columns) come."""
    ids = replaced.select(F.col("citation_id").alias("_id")).distinct()
    return groups.join(ids, groups["citation_id"] == ids["_id"], "left_anti").unionByName(replaced.select(*groups.columns))


def first_rule(df: DataFrame, rules: list[tuple[str, dict[str, str]]], name: str = "work") -> DataFrame:
    """``name``: of ordered rules (value, {column: pattern}) the first whose patterns all match, ignoring case.

    The rules are code, not data, so they become one flat expression over the row; nothing is joined. Spaces are drawn
    together, and patterns of several rules are matched, once a row.
    """
    tests = [(c, p) for _, patterns in rules for c, p in patterns.items()]
    columns = list(dict.fromkeys(c for c, _ in tests))
    shared = {t: f"_m{i}" for i, t in enumerate(dict.fromkeys(t for t in tests if tests.count(t) > 1))}
    hit = lambda c, p: F.coalesce(F.rlike(F.col(f"_s_{c}"), F.lit(f"(?i){p}")), F.lit(False))
    read = df.withColumns({f"_s_{c}": X.squashed(F.col(c)) for c in columns}).withColumns({m: hit(*t) for t, m in shared.items()})
    pick = F
    for value, patterns in rules:
        met = F.lit(True)
        for t in patterns.items():
            met = met & (F.col(shared[t]) if t in shared else hit(*t))
        pick = pick.when(met, F.lit(value))
    chosen = F.lit(None).cast("string") if pick is F else pick
    return read.withColumn(name, chosen).drop(*[f"_s_{c}" for c in columns], *shared.values())


def archive_plan(copies: DataFrame, queued_urls: DataFrame, book_ids: DataFrame) -> DataFrame:
    """(archive_url, pdf_url, file_name, citations, decision) of each item that was found.

    copies: (ord, archive_url, pdf_url, ...); an item that is queued or a book already is skipped, one whose PDF has
    no .pdf name fails; of items that share a PDF the first queues it.
    """
    items = copies.groupBy("archive_url").agg(F.min_by("pdf_url", "ord").alias("pdf_url"), F.min("ord").alias("ord"), F.count("*").alias("citations"))
    items = items.withColumn("file_name", X.file_name(F.col("pdf_url"))).withColumn("identifier", F.url_decode(F.coalesce(F.get(F.split("archive_url", "/details/"), F.lit(1)), F.lit(""))))
    q = queued_urls.select(F.col("url").alias("_url")).distinct()
    ids = book_ids.select(F.col("id").alias("_id")).distinct()
    marked = items
    for c, t, k, flag in (("archive_url", q, "_url", "q1"), ("pdf_url", q, "_url", "q2"), ("identifier", ids, "_id", "b1"), ("stem", ids, "_id", "b2")):
        marked = marked.withColumn("stem", F.regexp_replace("file_name", r"(?i)\.pdf\z", ""))
        hit = t.withColumnRenamed(k, f"_{flag}")
        marked = marked.join(hit, F.col(c) == F.col(f"_{flag}"), "left").withColumn(flag, F.col(f"_{flag}").isNotNull()).drop(f"_{flag}")
    named = F.lower("file_name").endswith(".pdf")
    free = ~(F.col("q1") | F.col("q2") | F.col("b1") | F.col("b2")) & named
    nth = F.sum(free.cast("int")).over(Window.partitionBy("pdf_url").orderBy("ord"))
    decision = (
        F.when(F.col("q1") | F.col("q2"), "already queued")
        .when(F.col("b1") | F.col("b2"), F.when(nth > 0, "already queued").otherwise("already a book"))
        .when(~named, "no .pdf file name")
        .when(nth > 1, "already queued")
        .otherwise("queue")
    )
    return marked.withColumn("decision", decision).select("archive_url", "pdf_url", "file_name", "citations", "decision")


def find_or_create_authors(wanted: DataFrame, names: DataFrame, authors: DataFrame) -> DataFrame:
    """(name, author_id, created) of each different name (case and outer space aside): known ones are found, others get new ids.

    New ids follow the largest known one in the order of the keys. Numbering is by range partition and offsets.
    """
    key = lambda c: F.lower(X.trimmed(F.col(c)))
    asked = wanted.where(X.names_an_author(F.col("name"))).groupBy(key("name").alias("k")).agg(F.min(X.trimmed(F.col("name"))).alias("name"))
    known = names.groupBy(key("name").alias("k")).agg(F.min("author_id").alias("author_id"))
    met = asked.join(known, "k", "left")
    top = authors.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).scalar()
    fresh = met.where("author_id is null").select("k", "name")
    made = numbered(fresh, ["k"], name="_id").select("name", (top + F.col("_id")).cast("long").alias("author_id"), F.lit(True).alias("created"))
    return met.where("author_id is not null").select("name", "author_id", F.lit(False).alias("created")).unionByName(made)

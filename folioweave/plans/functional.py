"""Scalar functions, as registered queries over the model's own texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import places as P
from ..functions import text as X
from .model import Library
from .registry import query


@query("x02_cited_title", "SELECT id, trim(regexp_replace(title || ', vol. II', ',\\s*vol.*$', '')) AS t FROM m_citations")
def _(lib: Library) -> DataFrame:
    return lib.citations.select("id", X.cited_title(F.concat("title", F.lit(", vol. II"))).alias("t"))


@query("x03_volume_of", "SELECT id, CAST(regexp_extract('Works, vol. ' || CAST(source_page AS VARCHAR), '(\\d+)$', 1) AS INT) AS volume FROM m_citations")
def _(lib: Library) -> DataFrame:
    return lib.citations.select("id", X.volume_of(F.concat(F.lit("Works, vol. "), X.to_roman(F.col("source_page")))).alias("volume"))


@query("x04_tokens", "SELECT id, array_to_string(list_filter(regexp_split_to_array(lower(title || ' and ' || author), '[^a-z0-9]+'), lambda t: t <> ''), ' ') AS t FROM m_books")
def _(lib: Library) -> DataFrame:
    return lib.books.select("id", F.array_join(X.tokens(F.concat("title", F.lit(" & "), "author")), " ").alias("t"))


@query("x05_main_title", "SELECT id, lower(title) AS t FROM m_books")
def _(lib: Library) -> DataFrame:
    return lib.books.select("id", F.array_join(X.drop_article(X.main_title(F.concat(F.lit("The "), "title", F.lit(": being a tale of "), "author"))), " ").alias("t"))


_LIKENESSES = {
    "longer": "title || ' ' || author",
    "shorter": "substr(title, 2)",
    "swapped": "substr(title, 2, 1) || substr(title, 1, 1) || substr(title, 3)",
    "same": "title",
}


@query(
    "x06_jaro_winkler",
    " UNION ALL ".join(f"SELECT id, '{shape}' AS shape, round(jaro_winkler_similarity(title, {other}), 9) AS s FROM m_books" for shape, other in _LIKENESSES.items()),
)
def _(lib: Library) -> DataFrame:
    """Titles against likenesses that score over 0.7 before the boost: it counts at any score here, over 0.7 only in DuckDB."""
    other = F.explode(F.array(*(F.struct(F.lit(shape).alias("shape"), F.expr(made).alias("title")) for shape, made in _LIKENESSES.items())))
    pairs = lib.books.select("id", "title", other.alias("other"))
    return pairs.select("id", "other.shape", F.round(X.jaro_winkler(F.col("title"), F.col("other.title")), 9).alias("s"))


@query("x07_list_prefix", "SELECT id, part1_type = 'book' AND part1_value = 1 AS starts FROM m_groups")
def _(lib: Library) -> DataFrame:
    first = F.expr("array(named_struct('type', 'book', 'value', 1))")
    return lib.groups.select("id", P.starts_with(F.col("parts"), first).alias("starts"))


@query("x08_surnames", "SELECT id, lower(regexp_replace(author, '#', ' ')) LIKE 'brand%' AS named FROM m_books")
def _(lib: Library) -> DataFrame:
    return lib.books.select("id", F.array_contains(X.surnames(F.col("author")), "brand").alias("named"))


@query("x10_skipped", "SELECT id, author = '' AS skipped FROM m_citations")
def _(lib: Library) -> DataFrame:
    return lib.citations.select("id", X.should_be_skipped(F.col("author"), F.col("title")).alias("skipped"))


@query("x12_places", "SELECT id, CAST(2 * (CASE WHEN source_page = 3 THEN 1 ELSE 2 END) AS BIGINT) AS n, CAST(1 AS BIGINT) AS skipped FROM m_citations")
def _(lib: Library) -> DataFrame:
    loc = lambda t, vs: F.struct(F.lit(t).alias("type"), F.lit(t).alias("rawLabel"), F.array(*vs).cast("array<double>").alias("values"))
    group = lib.citations.withColumn("group", F.array(loc("book", [F.col("source_page"), F.lit(3)]), loc("chapter", [F.lit(1), F.lit(2), F.lit(1), F.lit(1.5)])))
    return group.select("id", F.size(P.places("group")).cast("long").alias("n"), P.skipped_values("group").alias("skipped"))


@query("x14_stripped", r"""SELECT id, trim(regexp_replace(replace(replace(regexp_replace(regexp_replace(html, '<br\s*/?>', ' ', 'gi'), '<[^>]+>', '', 'g'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM m_blocks""")
def _(lib: Library) -> DataFrame:
    return lib.blocks.select("id", X.squashed(X.stripped(F.col("html"))).alias("t"))


_LINE = r"""trim(regexp_replace({}, '\s+', ' ', 'g'))"""
_HTML = r"""replace(replace(regexp_replace(html, '<(p|b|/p|/b)>', '', 'g'), '&quot;', '"'), '&amp;', '&')"""


@query("x15_page_text", rf"""WITH t AS (SELECT book_id, page_number, position, {_LINE.format(f"string_split({_HTML}, '<br/>')[1]")} || chr(10) || {_LINE.format(f"string_split({_HTML}, '<br/>')[2]")} AS t FROM m_blocks WHERE label NOT IN ('PageHeader', 'PageFooter'))
SELECT book_id, page_number, string_agg(t, chr(10) || chr(10) ORDER BY position) AS t FROM t GROUP BY 1, 2""")
def _(lib: Library) -> DataFrame:
    ordered = lib.blocks.groupBy("book_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("position", "label", "html"))).alias("blocks"))
    return ordered.select("book_id", "page_number", X.page_text(F.col("blocks")).alias("t"))


@query("x18_to_roman", "SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS back FROM part")
def _(lib: Library) -> DataFrame:
    return lib.table("part").select(F.col("p_partkey").alias("id"), X.roman_to_int(X.to_roman(F.col("p_size"))).cast("long").alias("back"))


@query("x24_summa", "SELECT id, id % 5 IN (0, 3) AS summa, id % 3 = 0 AS ibid FROM m_citations")
def _(lib: Library) -> DataFrame:
    """Titles of the Summa, one broken over a line, and of other Summae and another author; citations that go back to the one before and not."""
    title = F.element_at(F.array(*map(F.lit, ("Summa Theologica", "Summa Theologica", "Summa Contra Gentiles", "summa theo- logiae", "Summa Theol. Mor."))), (F.col("id") % 5 + 1).cast("int"))
    author = F.when(F.col("id") % 5 == 1, F.col("author")).otherwise("St. Thomas Aquinas")
    raw = F.when(F.col("id") % 3 == 0, F.concat(F.lit("(Ibid., "), "raw")).otherwise(F.concat("raw", F.lit(" ibid.")))
    return lib.citations.select("id", X.is_summa(title, author).alias("summa"), X.is_ibid(raw).alias("ibid"))


@query("x27_summa_parts", "SELECT id, 'book 2/question ' || CAST(source_page AS VARCHAR) || '/article 4' AS place FROM m_citations")
def _(lib: Library) -> DataFrame:
    found = X.summa_parts(F.concat(F.lit("I-II q. "), F.col("source_page").cast("string"), F.lit(" a. 4")))
    return lib.citations.select("id", F.array_join(F.transform(found, lambda p: F.concat(p["type"], F.lit(" "), p["value"].cast("string"))), "/").alias("place"))


@query("x33_has_keyword", r"SELECT doc_id, regexp_matches(lower(text), '(^|[^\p{L}\p{N}])mit\s+license($|[^\p{L}\p{N}])') AS hit FROM documents")
def _(lib: Library) -> DataFrame:
    return lib.table("documents").select("doc_id", X.has_keyword(F.col("text"), F.lit("MIT  License")).alias("hit"))


@query("x34_insights_for_pages", """SELECT b.id AS page_id, i.id AS insight_id, i.score FROM (SELECT id, regexp_split_to_array(lower(html), '[^a-z0-9]+') AS w FROM m_blocks) b JOIN (SELECT id, score, keyword1 AS k FROM m_insights WHERE score > 2 AND keyword1 NOT LIKE 'kw%') i ON list_contains(b.w, i.k)""")
def _(lib: Library) -> DataFrame:
    from ..operators.insights import for_pages

    words = lib.insights.select("id", F.upper("keyword1").alias("keyword")).union(lib.insights.select("id", "keyword2"))
    return for_pages(lib.blocks.select(F.col("id").alias("page_id"), F.col("html").alias("text")), lib.insights, words)


@query("x35_insight_keys", "SELECT id, lower(insight) AS k FROM m_insights")
def _(lib: Library) -> DataFrame:
    return lib.insights.select("id", X.insight_key(F.concat(F.lit("  "), F.upper("insight"), F.lit(" ;. "))).alias("k"))


@query("x41_names_an_author", "SELECT id, trim(author) <> '' AS named FROM m_citations")
def _(lib: Library) -> DataFrame:
    return lib.citations.select("id", X.names_an_author(F.col("author")).alias("named"))


@query("x42_file_names", r"SELECT page_id, regexp_extract(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1) AS f FROM pages")
def _(lib: Library) -> DataFrame:
    return lib.table("pages").select("page_id", X.file_name(F.col("url")).alias("f"))


@query("x43_cutoff_year", "SELECT id, CAST(year(created_at) - 96 AS INT) AS y FROM m_checks")
def _(lib: Library) -> DataFrame:
    return lib.checks.select("id", X.cutoff_year(F.col("created_at")).alias("y"))


@query("x47_part_columns", "SELECT id, part1_type, part1_value, part2_type, part2_value, part3_type, part3_value FROM m_groups")
def _(lib: Library) -> DataFrame:
    return lib.groups.select("id", *P.part_columns(F.col("parts"), 3))


@query("x01_fold", "SELECT id, lower(strip_accents('ÉLAN vïtal ' || title)) AS t FROM m_books")
def _(lib: Library) -> DataFrame:
    return lib.books.select("id", X.fold(F.concat(F.lit("ÉLAN vï- tal "), "title")).alias("t"))


@query("x09_same_author", "SELECT id, author_id % 6 IN (0, 1, 2) AS same FROM m_books")
def _(lib: Library) -> DataFrame:
    """One name with a title before it, with the surname first, and by its surname alone; another surname, a first name only, and nobody."""
    kind, name = F.col("author_id") % 6, lambda form: F.replace(F.lit(form), F.lit("@"), F.concat(F.lit("Scribe"), F.substring("id", 2, 9)))
    cited = F.element_at(F.array(*map(name, ("Rev. John @", "@, John", "@", "John Other", "John", "Anonymous"))), (kind + 1).cast("int"))
    return lib.books.select("id", X.same_author(cited, name("J. @")).alias("same"))


@query("x11_same_title", "SELECT id, author_id % 7 < 5 AS same FROM m_books")
def _(lib: Library) -> DataFrame:
    """A volume, a title before its subtitle, the main title alone, a run of words inside, a slip of the pen; another title, and one of which too little is left."""
    kind = F.col("author_id") % 7
    pair = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"))
    shapes = (
        pair("The Book of @, vol. 3", "Book of @"), pair("Letters on @", "Letters on @: a study in two parts"), pair("Of @ and faith: with notes", "Of @ and faith"), pair("life of @", "The whole life of @ explained"),
        pair("Discourses upon @ of old", "Discuorses upon @ of old"), pair("A treatise on @", "Outlines of dogma"), pair("Of @", "The history of the church of @ in the days of old"),
    )
    one = F.element_at(F.array(*shapes), (kind + 1).cast("int"))
    named = lambda c: X.title_forms(F.replace(c, F.lit("@"), F.split("title", " ")[0]))
    forms = lib.books.select("id", "title", one.alias("p")).select("id", named(F.col("p.a")).alias("a"), named(F.col("p.b")).alias("b"))
    return forms.select("id", X.same_title(F.col("a"), F.col("b")).alias("same"))


@query("x16_citable_numbers", "SELECT book_id, page_number, CAST(printed AS BIGINT) AS number FROM m_pages WHERE regexp_matches(printed, '^[0-9]+$')")
def _(lib: Library) -> DataFrame:
    return lib.pages.select("book_id", "page_number", X.guarded_number(F.col("printed")).cast("long").alias("number")).where("number is not null")


@query("x37_distinct_locations", """SELECT citation_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT citation_id, part1_type AS t, part1_value AS v FROM m_groups UNION SELECT citation_id, part2_type, part2_value FROM m_groups WHERE part2_type IS NOT NULL
UNION SELECT citation_id, part3_type, part3_value FROM m_groups WHERE part3_type IS NOT NULL) AS x GROUP BY citation_id""")
def _(lib: Library) -> DataFrame:
    from ..operators.citing import locations_of

    return locations_of(lib.groups).select("citation_id", F.size(P.distinct_locations(F.col("locations"))).cast("long").alias("n"))


@query("s18_json_rows", "SELECT json_object('id', id, 'title', title, 'author', author) AS row FROM m_books")
def _(lib: Library) -> DataFrame:
    return lib.books.select(F.to_json(F.struct("id", "title", "author")).alias("row"))

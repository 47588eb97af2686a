"""Readers, scans and sources, as registered queries over texts made of the model's own numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import aliases
from ..operators import reading, scans
from ..sources import books
from .model import Library
from .registry import query
from .session import folder, tables


def _text(parts) -> F.Column:
    return F.array_join(F.transform(parts, lambda p: F.concat(p["type"], F.lit(" "), p["value"].cast("string"))), "/")


def _all(places) -> F.Column:
    return F.array_join(F.transform(places, _text), "; ")


@query("x17_numbers", "SELECT id, CAST(source_page AS BIGINT) AS back FROM m_citations")
def _(lib: Library) -> DataFrame:
    from ..functions import text as X

    return lib.citations.select("id", X.roman_to_int(X.to_roman(F.col("source_page"))).cast("long").alias("back"))


@query("x20_marked_passages", "SELECT id, CAST(50 AS INT) AS book, CAST(source_page AS INT) AS chapter, CAST(source_page + 3 AS INT) AS last_verse FROM m_citations")
def _(lib: Library) -> DataFrame:
    page = F.col("source_page").cast("string")
    marks = F.concat(F.lit("vul|John|"), page, F.lit("|"), page, F.lit("|0|"), (F.col("source_page") + 3).cast("string"))
    one = F.get(F.col("found"), F.lit(0))
    return reading.passages(lib.citations.select("id", marks.alias("text"))).select("id", one["book"].alias("book"), one["chapter"].alias("chapter"), F.element_at(one["verses"], -1).alias("last_verse"))


@query("x19_bible_names", "SELECT id, CASE WHEN source_page % 6 < 4 THEN CAST(9 + source_page % 6 AS INT) WHEN source_page % 6 = 4 THEN CAST(26 AS INT) END AS book FROM m_citations")
def _(lib: Library) -> DataFrame:
    """Four books of Kings, a short name and one that is no book of the Bible."""
    kind = F.col("source_page") % 6
    name = F.when(kind < 4, F.concat((kind + 1).cast("string"), F.lit(" Kings"))).when(kind == 4, "Ecclus.").otherwise("Ep")
    return reading.bible_books(lib.citations.select("id", name.alias("text"))).select("id", F.col("found").alias("book"))


def _shaped(shapes: list, key: F.Column) -> F.Column:
    """One of the shapes, by a number from 0."""
    return F.element_at(F.array(*(F.lit(x) if isinstance(x, str) else x for x in shapes)), (key + 1).cast("int"))


def _with_page(text: str) -> F.Column:
    return F.replace(F.lit(text), F.lit("@"), F.col("source_page").cast("string"))


@query(
    "x21_work_references",
    """SELECT m.id, CAST(x.n AS INT) AS n, x.a AS author, x.t AS title, replace(x.l, '@', CAST(m.source_page AS VARCHAR)) AS location FROM m_citations m LEFT JOIN (VALUES (0, 0, '', 'De Trin.', 'Lib. @, 3'), (1, 0, 'Dionysius', 'De Div. Nom.', 'iv, @'),
  (2, 0, '', 'Metaph.', 'xii, text. @'), (2, 1, '', 'De Anima', 'iii, @'), (3, 0, 'Neale', '', 'i. @'), (4, 0, '', 'Gen. ad lit.', 'p. @'), (4, 1, '', 'Gen. ad lit.', 'x, 2')) AS x(k, n, a, t, l) ON x.k = m.id % 7""",
)
def _(lib: Library) -> DataFrame:
    """A label, an author before the title, two works, an author alone, a place in the work before; a chapter of the book itself and a town with a year are no works."""
    shapes = ["De Trin. Lib. @, 3", "cf. Dionysius, De Div. Nom. iv, @", "Metaph. xii, text. @; De Anima iii, @.", "Neale, i. @", "Gen. ad lit. p. @; x, 2", "Chapter @", "Rome, 1742"]
    texts = lib.citations.select("id", _shaped([_with_page(x) for x in shapes], F.col("id") % 7).alias("text"))
    return reading.work_references(texts).select("id", F.posexplode_outer("found").alias("n", "w")).select("id", "n", "w.author", "w.title", "w.location")


@query(
    "x22_marked_text",
    """SELECT CAST(m.id AS VARCHAR) AS key, replace(x.h, '@', CAST(m.source_page AS VARCHAR)) AS html, x.k AS kinds FROM m_citations m JOIN (VALUES
  (0, 'As Damascene says (De Fide Orth. @, 2)<sup>1</sup> and (Ps. 118)<sup>2</sup>', 'work scripture'), (1, 'text<sup>1</sup> more', 'note'), (2, '(i.e., the prophets) (1) none', ''),
  (3, '(<scripRef passage="Rom. 1:@">Rom. 1:@</scripRef>)<sup>1</sup> so', 'scripture')) AS x(n, h, k) ON x.n = m.id % 4""",
)
def _(lib: Library) -> DataFrame:
    """A work and a psalm in parentheses, a note, no citation at all, and marked scripture."""
    shapes = ["As Damascene says (De Fide Orth. @, 2) and (Ps. 118)", "text<note n='1'><p>De Trin. i, @.</p></note> more", "(i.e., the prophets) (1) none", '(<scripRef passage="Rom. 1:@">Rom. 1:@</scripRef>) so']
    found = books.marked_blocks(lib.citations.select(F.col("id").alias("key"), _shaped([_with_page(x) for x in shapes], F.col("id") % 4).alias("thml")))
    return found.select("key", "html", F.array_join(F.transform("footnotes", lambda n: n["kind"]), " ").alias("kinds"))


_SUMMA_SHAPES = (
    ("S. Theol., 1a 2ae, qu. @, art. 4.", "book 2/question @/article 4"),
    ("Summa Theologica, 1a: XLIX: 2. L: @.", "book 1/question 49/article 2; book 1/question 50/article @"),
    ("Sum. theol., ii-ii, @, 3, ad 2; Suppl., qu. 95", "book 3/question @/article 3/ad 2; book 5/question 95"),
    ("Summa Theol., 1-11, q. 3, a. @ and 3a, qu. 5", "book 2/question 3/article @; book 4/question 5"),
    ("Summa Theol., of that @", ""),
)


@query("x23_summa_places", f"SELECT m.id, replace(x.p, '@', CAST(m.source_page AS VARCHAR)) AS places FROM m_citations m JOIN (VALUES {', '.join(f"({i}, '{p}')" for i, (_, p) in enumerate(_SUMMA_SHAPES))}) AS x(n, p) ON x.n = m.id % 5")
def _(lib: Library) -> DataFrame:
    """Labels, numbers with colons over two questions, another part behind a reply, a misread part, and no place."""
    raw = _shaped([_with_page(x) for x, _ in _SUMMA_SHAPES], F.col("id") % 5)
    df = lib.citations.withColumn("title", F.lit("Summa Theologica")).withColumn("author", F.lit("Aquinas")).withColumn("raw", raw)
    return reading.summa_places(df).select("id", _all(F.col("places")).alias("places"))


@query(
    "w07_ibid",
    """WITH c AS (SELECT id, source_book_id, source_page, id % 5 AS k, CASE WHEN id % 5 < 2 THEN source_page WHEN id % 5 = 3 THEN 7 END AS q, CASE id % 5 WHEN 0 THEN 3 WHEN 1 THEN 1 END AS b FROM m_citations),
p AS (SELECT *, last_value(b IGNORE NULLS) OVER w AS book, last_value(q IGNORE NULLS) OVER w AS known, count(b) OVER w AS named FROM c WINDOW w AS (PARTITION BY source_book_id ORDER BY source_page, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
r AS (SELECT *, last_value(CASE WHEN k < 2 THEN q WHEN k = 3 AND named > 0 THEN 7 END IGNORE NULLS) OVER (PARTITION BY source_book_id ORDER BY source_page, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS question FROM p)
SELECT id, CASE WHEN k = 0 THEN 'book 3/question ' || CAST(q AS VARCHAR) WHEN k = 1 THEN 'book 1/question ' || CAST(q AS VARCHAR) || '/article 2' WHEN named = 0 OR k = 4 THEN ''
  WHEN k = 2 THEN 'book ' || CAST(book AS VARCHAR) || '/question ' || CAST(question AS VARCHAR) || '/article 6' ELSE 'book ' || CAST(book AS VARCHAR) || '/question 7' END AS places FROM r""",
)
def _(lib: Library) -> DataFrame:
    """Two whole places, "Ibid." with an article, with another question, and with nothing: places go on from the last one in the book."""
    shapes = [_with_page("Summa Theol., 2a 2ae, q. @"), _with_page("S. Theol., 1a, qu. @, a. 2"), "Ibid., a. 6", "Ibid., q. 7.", "Ibid."]
    df = lib.citations.withColumn("title", F.lit("Summa Theologica")).withColumn("author", F.lit("Aquinas")).withColumn("raw", _shaped(shapes, F.col("id") % 5))
    return reading.summa_places(df).select("id", _all(F.col("places")).alias("places"))


@query("x25_father_places", "SELECT id, CASE WHEN source_page = 50 THEN '' ELSE 'book ' || CAST(source_page AS VARCHAR) || '/chapter 4; book ' || CAST(source_page AS VARCHAR) || '/chapter 5' END AS places FROM m_citations")
def _(lib: Library) -> DataFrame:
    """Book "l" (50) is a label before what looks like a numeral, so that place is none."""
    from ..functions.text import to_roman

    where = F.concat(F.lit("lib. "), F.lower(to_roman(F.col("source_page"))), F.lit(", c. 4,5 (Migne)"))
    df = lib.citations.withColumn("location", where).withColumn("types", F.array(F.lit("book"), F.lit("chapter")))
    return reading.father_places(df).select("id", _all(F.col("places")).alias("places"))


@query("x26_location_text", "SELECT id, 'chapter ' || CAST(source_page AS VARCHAR) AS places FROM m_citations")
def _(lib: Library) -> DataFrame:
    """The location is empty: the place is read from the raw text after the title."""
    raw = F.concat("title", F.lit(", c. "), F.col("source_page").cast("string"))
    df = lib.citations.withColumn("raw", raw).withColumn("location", F.lit("")).withColumn("types", F.array(F.lit("chapter")))
    return reading.father_places(df).select("id", _all(F.col("places")).alias("places"))


#: Citations as printed: author, title, the title as extracted, the work and its first parts, types after those.
_PRINTED = (
    ("Aristotle", "Eth. Eudem.", "Eth. Eudem.", "aristotle-eudemian-ethics", "", "book/chapter"),
    ("The Philosopher", "Ethic.", "Ethic.", "aristotle-nicomachean-ethics", "", "book/chapter"),
    ("Aristot.", "De Gener. Animal.", "De Gener. Animal.", "aristotle-on-the-generation-of-animals", "", "book/chapter"),
    ("Aristotle", "De Gener.", "De Gener.", "aristotle-on-generation-and-corruption", "", "book/chapter"),
    ("Boethius", "De Consol.", "De Consolatione", "boethius-consolation-of-philosophy", "", "book/prose"),
    ("St. Thomas", "Contra Gent.", "Summa Contra Gentiles", "summa-contra-gentiles", "", "book/chapter"),
    ("St. Augustine", "De Dono Persev.", "De Dono Persev.", "npnf105-a-treatise-on-the-predestination-of-the-saints", "book 2", "chapter"),
    ("Athanasius", "Contra Gentes", "Contra Gentes", None, "", "book/chapter"),
)
_AS_VALUES = ", ".join(f"({i}, '{work}', '{first}', '{types}')" for i, (*_, work, first, types) in enumerate(_PRINTED) if work)


@query(
    "j20_works_cited",
    f"""SELECT c.id, x.w AS work, CASE WHEN x.f <> '' THEN x.f || '/' || x.t || ' ' || CAST(c.source_page AS VARCHAR)
  ELSE split_part(x.t, '/', 1) || ' ' || CAST(c.source_page AS VARCHAR) || '/' || split_part(x.t, '/', 2) || ' 4' END AS places
FROM m_citations c JOIN (VALUES {_AS_VALUES}) AS x(i, w, f, t) ON x.i = c.id % {len(_PRINTED)}""",
)
def _(lib: Library) -> DataFrame:
    """Every citation under a Latin name; a third have their place in the raw text only."""
    row = F.get(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("author", "short", "title"), p[:3], strict=True)]) for p in _PRINTED]), (F.col("id") % len(_PRINTED)).cast("int"))
    place = F.concat(F.col("source_page").cast("string"), F.lit(", 4"))
    printed = lib.citations.select("id", row.alias("p"), F.when(F.col("id") % 3 == 0, "").otherwise(place).alias("location"), place.alias("place"))
    printed = printed.select("id", "p.author", "p.title", "location", F.concat("p.short", F.lit(" "), "place").alias("raw"))
    rules = aliases.FATHERS + aliases.PHILOSOPHER + aliases.MEDIEVALS
    works = sorted({w for w, _ in rules} - set(aliases.TYPES))
    divided = lib.spark.createDataFrame([(w, ["book", "chapter"]) for w in works], "work string, types array<string>")
    return reading.works_cited(printed, rules, divided).select("id", "work", _all(F.col("places")).alias("places"))


def _scan(lib: Library) -> DataFrame:
    """Each book's pages with a running head that prints page + 6, every fifth one unread."""
    head = F.when(F.col("page_number") % 5 == 0, F.lit("<p>no number here</p>")).otherwise(F.concat(F.lit("<p>[ "), (F.col("page_number") + 6).cast("string"), F.lit(" ]</p>")))
    block = lambda label, html, n: F.struct(F.lit(label).alias("label"), html.alias("html"), F.lit(n).alias("reading_order"), F.array(*[F.lit(0.0)] * 4).alias("bbox"))
    wide = lib.pages.select("book_id", F.explode(F.sequence(F.col("page_number") * 3 - 2, F.col("page_number") * 3)).alias("page_number"))
    return wide.select("book_id", F.col("page_number").alias("page"), F.array(block("PageHeader", head, 0), block("Caption", F.lit("<p>words</p>"), 2), block("Text", F.lit("<p> </p>"), 1)).alias("blocks"))


@query("w08_printed_numbers", "SELECT book_id, CAST(n AS INT) AS page, CAST(n + 6 AS VARCHAR) AS printed FROM (SELECT book_id, unnest(range(page_number * 3 - 2, page_number * 3 + 1)) AS n FROM m_pages) AS x")
def _(lib: Library) -> DataFrame:
    return scans.printed_numbers(_scan(lib))


@query("x39_page_candidates", "SELECT book_id, CAST(n AS INT) AS page, CASE WHEN n % 5 = 0 THEN '' ELSE CAST(n + 6 AS VARCHAR) END AS numbers FROM (SELECT book_id, unnest(range(page_number * 3 - 2, page_number * 3 + 1)) AS n FROM m_pages) AS x")
def _(lib: Library) -> DataFrame:
    return scans.candidates(_scan(lib)).select("book_id", "page", F.array_join(F.transform("numbers", lambda n: n.cast("string")), ",").alias("numbers"))


@query("x38_confused_digits", "SELECT id, id % 3 = 0 AS near FROM m_citations")
def _(lib: Library) -> DataFrame:
    """A last digit 3 read as 8, which scans do, as 4, which they do not, and with a digit too many."""
    n = F.col("source_page") * 10 + 3
    other = F.when(F.col("id") % 3 == 0, n + 5).when(F.col("id") % 3 == 1, n + 1).otherwise(n * 10 + 8)
    return lib.citations.select("id", scans.near_numbers(n, other).alias("near"))


@query("x40_blocks", "SELECT book_id, CAST(n AS INT) AS page_number, CAST(v.p AS INT) AS position, v.l AS label FROM (SELECT book_id, unnest(range(page_number * 3 - 2, page_number * 3 + 1)) AS n FROM m_pages) AS x CROSS JOIN (VALUES (0, 'PageHeader'), (1, 'Text')) AS v(p, l)")
def _(lib: Library) -> DataFrame:
    return scans.blocks(_scan(lib)).select("book_id", "page_number", "position", "label")


@query("s02_scan_json", "SELECT book_id, CAST(page_number AS INT) AS page, printed AS html FROM m_pages")
def _(lib: Library) -> DataFrame:
    """All books are written as the JSON of scans, a line each, and read again."""
    path = folder(lib.spark, "scan")
    page = F.struct(F.col("page_number").alias("page"), F.array(F.struct(F.lit("Text").alias("label"), F.col("printed").alias("html"), F.lit(0).alias("reading_order"), F.array(F.lit(0.0)).alias("bbox"))).alias("blocks"))
    book = lib.pages.groupBy("book_id").agg(F.collect_list(page).alias("pages"))
    book.select(F.to_json(F.create_map("book_id", "pages")).alias("value")).write.mode("overwrite").text(path)
    return books.scans(lib.spark, path, lines=True).select("book_id", "page", F.get("blocks", F.lit(0))["html"].alias("html"))


def _files(lib: Library, suffix: str, column: str, *pieces: str) -> DataFrame:
    """A file for each book, named after it: the given pieces with the book's title between them."""
    return lib.books.select(F.concat("id", F.lit(suffix)).alias("path"), F.concat_ws("", *[x for p in pieces for x in (F.lit(p), F.col("title"))][:-1]).alias(column))


@query("s03_thml_divs", "SELECT m.id || '.xml' AS path, CAST(x.n AS INT) AS div, CAST(x.p AS INT) AS parent, replace(x.t, '@', m.title) AS title FROM m_books m CROSS JOIN (VALUES (0, -1, '@'), (1, 0, 'Book I of @'), (2, 1, 'Chapter 1'), (3, 0, 'Book II')) AS x(n, p, t)")
def _(lib: Library) -> DataFrame:
    files = _files(lib, ".xml", "xml", '<ThML.body><div1 title="', '"><div2 title="Book I of ', '"><p>a</p><div3 title="Chapter 1"><p>b</p></div3></div2><div2 title="Book II"/></div1></ThML.body>')
    return books.thml_divs(files).select("path", "div", "parent", "title")


@query("s05_text_edition", "SELECT m.id || '.txt' AS path, x.b AS book, CASE x.p WHEN 'First' THEN 'First paragraph of ' || m.title || '.' ELSE x.p END AS paragraph FROM m_books m CROSS JOIN (VALUES ('I', 'First'), ('I', 'Second.'), ('II', 'Third.')) AS x(b, p)")
def _(lib: Library) -> DataFrame:
    """An edition for each book, as read from files."""
    files = _files(lib, ".txt", "text", "front\n\nBOOK I\n\nFirst\nparagraph of ", ".\n\nSecond.\n\nBOOK II\n\nThird.\n\nTHE END\n\nlicense")
    return books.edition_texts(files).select("path", "book", "paragraph")


@query("j24_placed_footnotes", "SELECT c.id, CASE WHEN c.source_page % 2 = 0 THEN 3 END AS position FROM m_citations c")
def _(lib: Library) -> DataFrame:
    """A footnote block for each page that is cited from, with the markers of every citation on even pages."""
    cited = lib.citations.select("id", F.col("source_book_id").alias("book_id"), F.col("source_page").alias("page_number"), "footnote")
    marks = F.array_join(F.transform(F.array_sort(F.collect_set("footnote")), lambda m: F.concat(F.lit("<p><sup> "), m, F.lit("</sup> text</p>"))), "")
    notes = cited.groupBy("book_id", "page_number").agg(F.when(F.col("page_number") % 2 == 0, marks).otherwise("<p>no marks</p>").alias("html"))
    blocks = notes.select("book_id", "page_number", F.lit(3).alias("position"), F.lit("Footnote").alias("label"), "html")
    return scans.placed_citations(cited, blocks).select("id", "position")


@query("x36_source_pages", "SELECT id, 'body' || chr(10) || '<p><sup>' || footnote || '</sup> note ' || footnote || '</p>' AS html FROM m_citations")
def _(lib: Library) -> DataFrame:
    cited = lib.citations.select("id", F.xxhash64("source_book_id", "source_page").alias("block_id"), F.col("source_book_id").alias("book_id"), F.col("source_page").alias("page_number"), "footnote")
    note = F.concat(F.lit("<p><sup>"), "footnote", F.lit("</sup> note "), "footnote", F.lit("</p>"))
    notes = cited.groupBy("book_id", "page_number", "block_id").agg(F.array_join(F.array_sort(F.collect_set(note)), "").alias("html"))
    foot = notes.select("book_id", "page_number", F.col("block_id").alias("id"), F.lit(3).alias("position"), F.lit("Footnote").alias("label"), "html")
    body = notes.select("book_id", "page_number", (F.col("block_id") + 1).alias("id"), F.lit(2).alias("position"), F.lit("Text").alias("label"), F.lit("body").alias("html"))
    return scans.source_pages(cited, foot.unionByName(body))


@query("x44_answers", "SELECT source_book_id AS book_id, source_page AS page, title, CAST(1 AS INT) AS n FROM m_citations")
def _(lib: Library) -> DataFrame:
    where = F.array(F.array(F.struct(F.lit("p").alias("rawLabel"), F.lit("page").alias("type"), F.array(F.col("source_page").cast("double")).alias("values"))))
    cite = F.struct("author", "title", "location", "raw", where.alias("locationsCited"))
    answer = F.to_json(F.struct(F.array(F.struct(F.col("footnote").alias("identifier"), F.array(cite).alias("citations"))).alias("footnotes")))
    found = scans.answered_citations(lib.citations.select(F.col("source_book_id").alias("book_id"), F.col("source_page").alias("page"), answer.alias("answer")))
    return found.select("book_id", "page", "title", F.size("locations").alias("n"))


@query(
    "x28_divisions",
    """SELECT id, CASE WHEN source_page % 5 < 2 THEN 'chapter' WHEN source_page % 5 = 2 THEN 'book' END AS type, CASE WHEN source_page % 5 < 4 THEN CAST(source_page AS INT) END AS value FROM m_citations""",
)
def _(lib: Library) -> DataFrame:
    """Divisions of other kinds are cited by chapter; a bare number has no type; the fifth title names none."""
    from ..functions.text import to_roman

    page, kind = F.col("source_page"), F.col("source_page") % 5
    title = F.when(kind == 0, F.concat(F.lit("Homily "), to_roman(page), F.lit(". On"))).when(kind == 1, F.concat(F.lit("Chapter "), page.cast("string"))).when(kind == 2, F.concat(F.lit("BOOK "), to_roman(page)))
    title = title.when(kind == 3, F.concat(to_roman(page), F.lit("."))).otherwise("Of the soul")
    found = reading.divisions(lib.citations.select("id", title.alias("text")))
    return found.select("id", "found.type", "found.value")


@query(
    "x30_tidy_titles",
    """SELECT id, CASE WHEN length(title) % 3 = 0 THEN title ELSE n || ' of the ' || n END AS title
FROM (SELECT id, title, array_to_string(list_transform(string_split(title, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS n FROM m_books) AS x""",
)
def _(lib: Library) -> DataFrame:
    """Every title: some as they are, the others in capitals, half of those with a count of articles."""
    from ..functions.text import tidy_title

    size = F.length("title")
    loud = F.concat(F.upper("title"), F.lit(" OF THE "), F.upper("title"), F.when(size % 2 == 0, " (EIGHT ARTICLES)").otherwise(""))
    return lib.books.select("id", tidy_title(F.when(size % 3 == 0, F.col("title")).otherwise(loud)).alias("title"))


def _div(level: int, title: str, body: str, id_: str = "", short: str = "") -> str:
    return f'<div{level} id="{id_}" title="{title}" shorttitle="{short}">{body}</div{level}>'


_VOLUME = (
    "<ThML.body>"
    + _div(1, "CLEMENT OF ROME", _div(2, "Introductory Note", "<p>by the editor</p>") + _div(2, "Epistle on @", _div(3, "The salutation.", "<p>The church (Ps. 118).</p>", short="Chapter I") + _div(3, "Praise.", "<p>Two.</p>", short="Chapter II")))
    + _div(1, "IRENAEUS", _div(2, "Against Heresies: Book I", _div(3, "Chapter I", "<p>One.</p>")) + _div(2, "Against Heresies: Book II", _div(3, "Chapter I", "<p>Two.</p>")))
    + "</ThML.body>"
)


def _pages(found: DataFrame) -> DataFrame:
    return found.select("book_id", "page_number", "printed", _text(F.col("parts")).alias("place"))


def _volumes(lib: Library) -> DataFrame:
    """A volume for each book, its first work with the book's title."""
    return _files(lib, ".xml", "xml", *_VOLUME.split("@"))


_VOLUME_PAGES = """SELECT m.id || '-' || replace(x.b, '@', regexp_replace(lower(m.title), '[^a-z0-9]+', '-', 'g')) AS book_id, CAST(x.n AS INT) AS page_number, x.l AS printed, x.p AS place
FROM m_books m CROSS JOIN (VALUES ('epistle-on-@', 1, 'Chapter I', 'chapter 1'), ('epistle-on-@', 2, 'Chapter II', 'chapter 2'),
  ('against-heresies', 1, 'Book I, Chapter I', 'book 1/chapter 1'), ('against-heresies', 2, 'Book II, Chapter I', 'book 2/chapter 1')) AS x(b, n, l, p)"""


@query("x29_works_of_a_volume", _VOLUME_PAGES)
def _(lib: Library) -> DataFrame:
    return _pages(books.volume_pages(_volumes(lib)))


@query("w13_merged_books", "SELECT id || '-against-heresies' AS book_id, CAST(2 AS BIGINT) AS pages, CASE WHEN id = 'b1' THEN 'Irenaeus' ELSE 'Unknown' END AS author FROM m_books")
def _(lib: Library) -> DataFrame:
    """Two books of one work in each volume are merged; the rules of one volume name its authors."""
    found = books.volume_pages(_volumes(lib), {"b1": {"within": [("irenaeus", "Irenaeus")]}})
    return found.where("book_id like '%-against-heresies'").groupBy("book_id").agg(F.count("*").alias("pages"), F.first("author").alias("author"))


@query("x31_summa_pages", "SELECT m.id || '.xml' AS path, CAST(x.n AS INT) AS page_number, x.l AS printed FROM m_books m CROSS JOIN (VALUES (1, 'I-II q. 1'), (2, 'I-II q. 1 a. 1'), (3, 'I-II q. 1 a. 2')) AS x(n, l)")
def _(lib: Library) -> DataFrame:
    """An edition of the Summa for each book."""
    articles = "".join(_div(4, "", f"<h4>Whether {n}</h4><p>Objection.</p>", f"FS_Q1_A{n}") for n in (1, 2))
    xml = "<ThML.body>" + _div(1, "I-II", _div(2, "Treatise", _div(3, "Of @", "<p>Prologue.</p>" + articles, "FS_Q1")), "FS") + "</ThML.body>"
    return books.summa_pages(_files(lib, ".xml", "xml", *xml.split("@"))).select("path", "page_number", "printed")


@query("x32_bible_pages", "SELECT m.id || '.xml' AS path, CAST(x.n AS INT) AS page_number, x.l AS printed, x.p AS place FROM m_books m CROSS JOIN (VALUES (1, 'Genesis 1', 'book 1/chapter 1'), (2, 'Tobias 1', 'book 17/chapter 1'), (3, '1 Machabees 1', 'book 45/chapter 1')) AS x(n, l, p)")
def _(lib: Library) -> DataFrame:
    """An edition of the Bible for each book."""
    chapter = lambda id_: _div(3, "", '<scripture passage="1:1" /><sup>1</sup>text @', f"{id_}.1")
    xml = "<ThML.body>" + _div(1, "Old Testament", _div(2, "Genesis", chapter("Gen"), "Gen") + _div(2, "1 Machabees", chapter("iMac"), "iMac") + _div(2, "Tobias", chapter("Tob"), "Tob")) + "</ThML.body>"
    found = books.bible_pages(_files(lib, ".xml", "xml", *xml.split("@")))
    return found.select("path", "page_number", "printed", _text(F.col("parts")).alias("place"))


def _prose(n: int) -> str:
    return "<p>" + " ".join(f"word{i}" for i in range(n)) + "</p>"


_EPUB_PAGES = """SELECT b.id AS book_id, CAST(x.n AS INT) AS page_number, replace(x.l, '@', b.title) AS printed, x.p AS place FROM (SELECT id, title, CAST(id[2:] AS BIGINT) % 4 AS k FROM m_books) AS b
JOIN (VALUES (0, 1, 'Book I, Chapter 1', 'book 1/chapter 1'), (0, 2, 'Book I, Chapter 2', 'book 1/chapter 2'), (0, 3, 'Book II, Chapter 1', 'book 2/chapter 1'),
  (1, 1, 'Chapter 1', 'chapter 1'), (1, 2, 'Chapter 2', 'chapter 2'), (2, 1, 'Book I, Chapter 1', 'book 1/chapter 1'), (2, 2, 'Book II, Chapter 1', 'book 2/chapter 1'), (2, 3, 'Book II, Chapter 2', 'book 2/chapter 2'),
  (3, 1, 'Of @', '')) AS x(k, n, l, p) ON x.k = b.k"""


def _epubs(lib: Library) -> DataFrame:
    """The documents of an archive for each book, in four shapes: parts of documents named after books, headed chapters, books as lines with bare numbers, and no marks at all."""
    body = lambda *x: F.concat(F.lit("<html><body>"), *(F.lit(y) if isinstance(y, str) else y for y in x), F.lit("</body></html>"))
    prose, shape = _prose(40), F.expr("cast(substring(id, 2) as bigint) % 4")
    document = lambda name, xhtml: F.struct(F.lit(name).alias("name"), xhtml.alias("xhtml"))
    shapes = [
        [document("c1_Work_Book_I.xhtml", body(f"<p>Part 1</p>{prose}<p>Part 2</p>{prose}")), document("c2_Work_Book_II.xhtml", body(f"<p>Part 1</p>{prose}"))],
        [document("c1_Work.xhtml", body(f"<h2>Chapter I. On beginnings</h2>{prose}<h2>CHAPTER II.</h2>{prose}"))],
        [document("c1_Work.xhtml", body(f"<p>BOOK I</p><p>i.</p>{prose}<p>Book Two</p><p>1</p>{prose}<p>2</p>{prose}"))],
        [document("c1_Work.xhtml", body("<h1>Of ", F.col("title"), f"</h1>{prose}"))],
    ]
    chosen = F.when(shape == 0, F.array(*shapes[0])).when(shape == 1, F.array(*shapes[1])).when(shape == 2, F.array(*shapes[2])).otherwise(F.array(*shapes[3]))
    return lib.books.select(F.concat("id", F.lit(".epub")).alias("path"), F.posexplode(chosen).alias("document", "d")).select("path", "document", "d.name", "d.xhtml")


@query("s04_epub", _EPUB_PAGES)
def _(lib: Library) -> DataFrame:
    """An archive is written for each book, and all are read again by the data source."""
    path = folder(lib.spark, "epub")
    books.write_epubs(_epubs(lib), path)
    return _pages(books.epub_pages(lib.spark, path, "", table=tables(lib.spark, "epub-leaves")))


@query("s03_thml_ranges", """SELECT m.title AS file_title, CAST(x.p AS INT) AS depth, replace(x.t, '@', m.title) AS title, replace(x.o, '@', m.title) AS own FROM m_books m
CROSS JOIN (VALUES (0, '@', ''), (1, 'Book I of @', '<p>a</p>'), (2, 'Chapter 1', '<p>b &lt; @</p>'), (1, 'Book II', '')) AS x(p, t, o)""")
def _(lib: Library) -> DataFrame:
    """All volumes in a few large files, read in blocks: each div under its ancestors, with its own markup."""
    pieces = ('<div1 title="', '"><div2 title="Book I of ', '"><p>a</p><div3 title="Chapter 1"><p>b &lt; ', '</p></div3></div2><div2 title="Book II"/></div1>')
    path = folder(lib.spark, "volumes")
    _files(lib, ".xml", "xml", *pieces).select("xml").write.text(path, lineSep=" ")
    found = books.thml_file_divs(lib.spark, path, tables(lib.spark, "divs"))
    up = found.select(F.col("path").alias("_path"), F.col("div").alias("_div"), F.col("title").alias("_title"), F.col("parent").alias("_parent"))
    one = found.join(up, (F.col("path") == F.col("_path")) & (F.col("parent") == F.col("_div")), "left").select("path", "title", F.trim("own").alias("own"), "_title", "_parent")
    two = up.select(F.col("_path").alias("p2"), F.col("_div").alias("d2"), F.col("_title").alias("t2"))
    top = one.join(two, (F.col("path") == F.col("p2")) & (F.col("_parent") == F.col("d2")), "left")
    depth = F.when(F.col("_title").isNull(), 0).when(F.col("t2").isNull(), 1).otherwise(2)
    return top.select(F.coalesce("t2", "_title", "title").alias("file_title"), depth.cast("int").alias("depth"), "title", "own")


@query(
    "w12_segments",
    """SELECT id AS book_id, CAST(i AS INT) AS page_number, CASE WHEN i = 1 THEN 'Contents' ELSE 'Chapter ' || CAST(i - 1 AS VARCHAR) END AS printed
FROM (SELECT id, unnest(range(1, length(title) % 4 + 3)) AS i FROM m_books) AS x""",
)
def _(lib: Library) -> DataFrame:
    """A document for each book: a table of contents with summaries, then the chapters it lists."""
    chapters = lambda mark, words: F.array_join(F.transform(F.sequence(F.lit(1), F.length("title") % 4 + 1), lambda n: F.concat(F.lit(f"<p>{mark} "), n.cast("string"), F.lit(f".</p>{_prose(words)}"))), "")
    html = F.concat(F.lit("<body><h2>Contents</h2>"), chapters("Chap.", 40), chapters("Chapter", 200), F.lit("</body>"))
    documents = lib.books.select(F.col("id").alias("path"), F.lit(0).alias("document"), F.lit("W.xhtml").alias("name"), html.alias("xhtml"))
    return books.edition_pages(documents, "", table=tables(lib.spark, "segments")).select("book_id", "page_number", "printed")


_SONG_SHAPES = (
    '<h2>BOOK I.</h2><h3>SONG I.<br> A Complaint.</h3><div class="poem"><span>line</span></div><h3>I.</h3><p>While I was pondering @.</p><h2>EPILOGUE.</h2><p>x</p>',
    '<h2>PREFACE.</h2><h3>I.</h3><p>@</p><h2>BOOK II.</h2><div><h3>IV.</h3><p>@<a class="fnanchor" href="#Footnote_1">[1]</a></p></div><div class="footnote"><p><a id="Footnote_1"></a><span class="label">[1]</span> Of @.</p></div>',
    '<h2>BOOK V.</h2><h3>VI.</h3><p>a</p><h3>Unnumbered</h3><p>@</p><h2>REFERENCES TO QUOTATIONS IN THE TEXT.</h2><ul class="Quot"><li>Bk. V., ch. vi., p. 7, l. 6: @. ch. ii., p. 8, l. 1: none.</li></ul>',
    "<h2>Contents</h2><p>@</p>",
)


@query(
    "s06_songs_and_prose",
    """SELECT m.id || '.html' AS path, CAST(x.n AS INT) AS page_number, x.l AS printed, x.p AS place, replace(x.h, '@', m.title) AS last FROM m_books m JOIN (VALUES (0, 1, 'Book I, Song I', 'book 1/metre 1', '<p>line</p>'), (0, 2, 'Book I, Prose I', 'book 1/prose 1', '<p>While I was pondering @.</p>'),
  (1, 1, 'Book II, Prose IV', 'book 2/prose 4', '<p><sup>1</sup> Of @.</p>'), (2, 1, 'Book V, Prose VI', 'book 5/prose 6', '<p>Quoted: @.</p>')) AS x(k, n, l, p, h) ON x.k = CAST(m.id[2:] AS BIGINT) % 4""",
)
def _(lib: Library) -> DataFrame:
    """An edition of songs and prose for each book, in four shapes: a song and a section; a note, after a preface; quotations' sources; and no book at all."""
    shape = F.expr("cast(substring(id, 2) as bigint) % 4")
    html = F.element_at(F.array(*(F.lit(f"<body>{x}</body>") for x in _SONG_SHAPES)), (shape + 1).cast("int"))
    files = lib.books.select(F.concat("id", F.lit(".html")).alias("path"), F.replace(html, F.lit("@"), F.col("title")).alias("html"))
    found = books.song_pages(files, "consolation", "The Consolation", "Boethius", table=tables(lib.spark, "songs"))
    return found.select("path", "page_number", "printed", _text(F.col("parts")).alias("place"), F.element_at("blocks", -1)["html"].alias("last"))


@query(
    "w09_chapter_gaps",
    """SELECT id AS book_id, CAST(v.p AS INT) AS position, CASE v.p WHEN 0 THEN CAST(n AS VARCHAR) WHEN 1 THEN CAST(n + 1 AS VARCHAR) WHEN 2 THEN CAST(n + 2 AS VARCHAR) WHEN 3 THEN '' ELSE CAST(n + 12 AS VARCHAR) || ',' || CAST(n + 13 AS VARCHAR) END AS chapters
FROM (SELECT id, length(title) AS n FROM m_books) AS x CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS v(p)""",
)
def _(lib: Library) -> DataFrame:
    """Five titles of each book: the second names no chapter and takes the one left out, the fourth has too wide a gap."""
    from ..functions.text import to_roman

    n = F.length("title")
    titles = F.array(
        F.concat(F.lit("Chapter "), to_roman(n), F.lit(".")), F.lit("Without a number"), F.concat(F.lit("Chapter "), to_roman(n + 2), F.lit(".")), F.lit("Without"), F.concat(F.lit("Chapters "), to_roman(n + 12), F.lit(", "), to_roman(n + 13), F.lit("."))
    )
    found = reading.chapter_gaps(lib.books.select(F.col("id").alias("book_id"), F.posexplode(titles).alias("position", "title")))
    return found.select("book_id", "position", F.array_join(F.transform("chapters", lambda c: c.cast("string")), ",").alias("chapters"))

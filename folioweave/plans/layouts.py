"""Volumes, contents, page orders, linkage and writes, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import citing, insights, layout, linkage, writes
from ..schema import PARTS_SQL
from .model import Library
from .registry import query
from .relational import _CITES, _COUNTED, _HIDDEN, aliases
from .session import folder, tables

_VOLUMES = """f AS (SELECT book_id, page_number, id, part1_type AS t, part1_value AS v FROM m_places),
num AS (SELECT book_id, t, v, row_number() OVER (PARTITION BY book_id ORDER BY pg, i) AS volume FROM (SELECT book_id, t, v, page_number AS pg, id AS i, row_number() OVER (PARTITION BY book_id, t, v ORDER BY page_number, id) AS k FROM f) AS x WHERE k = 1),
pg AS (SELECT p.book_id, p.page_number, max_by(f.t || ':' || CAST(f.v AS VARCHAR), f.id) AS part FROM m_pages p LEFT JOIN f ON f.book_id = p.book_id AND f.page_number = p.page_number GROUP BY 1, 2),
car AS (SELECT book_id, page_number, part, last_value(part IGNORE NULLS) OVER (PARTITION BY book_id ORDER BY page_number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM pg),
pl AS (SELECT book_id, page_number, t || ':' || CAST(v AS VARCHAR) AS part FROM f UNION SELECT book_id, page_number, carried FROM car WHERE part IS NULL),
vols AS (SELECT DISTINCT n.book_id, CAST(n.volume AS INT) AS volume, n.t AS part_type, n.v AS part_value, pl.page_number FROM pl JOIN num n ON n.book_id = pl.book_id AND coalesce(n.t || ':' || CAST(n.v AS VARCHAR) = pl.part, n.volume = 1))"""


def volumes(lib: Library) -> DataFrame:
    return layout.volumes(lib.pages, lib.places)


@query("w01_min_over_label", "SELECT id, citation_id, raw, min(id) OVER (PARTITION BY citation_id, raw) AS first_id FROM m_groups")
def _(lib: Library) -> DataFrame:
    return lib.groups.select("id", "citation_id", "raw", F.min("id").over(Window.partitionBy("citation_id", "raw")).alias("first_id"))


@query("w02_volumes", f"WITH {_VOLUMES} SELECT * FROM vols")
def _(lib: Library) -> DataFrame:
    return volumes(lib)


_ENTRIES = """e AS (SELECT book_id, page_number, id, 1 AS depth, part1_type || ' ' || CAST(part1_value AS VARCHAR) AS path, part2_type IS NULL AS exact FROM m_places
  UNION ALL SELECT book_id, page_number, id, 2, part1_type || ' ' || CAST(part1_value AS VARCHAR) || '/' || part2_type || ' ' || CAST(part2_value AS VARCHAR), part3_type IS NULL FROM m_places WHERE part2_type IS NOT NULL
  UNION ALL SELECT book_id, page_number, id, 3, part1_type || ' ' || CAST(part1_value AS VARCHAR) || '/' || part2_type || ' ' || CAST(part2_value AS VARCHAR) || '/' || part3_type || ' ' || CAST(part3_value AS VARCHAR), true FROM m_places WHERE part3_type IS NOT NULL),
toc AS (SELECT book_id, depth, path, coalesce(min_by(page_number, page_number * 10000000 + id) FILTER (WHERE exact), min_by(page_number, page_number * 10000000 + id)) AS page_number FROM e GROUP BY 1, 2, 3)"""
_PATH = "array_join(transform(path, p -> p.type || ' ' || CAST(p.value AS STRING)), '/')"


@query("w03_contents", f"WITH {_ENTRIES} SELECT t.book_id, CAST(t.depth AS INT) AS depth, t.path, t.page_number, coalesce(m.printed, '') AS printed FROM toc t LEFT JOIN m_pages m ON m.book_id = t.book_id AND m.page_number = t.page_number")
def _(lib: Library) -> DataFrame:
    return layout.contents(lib.places, lib.pages).select("book_id", "depth", F.expr(_PATH).alias("path"), "page_number", "printed")


_LAYOUT = """lay AS (SELECT p.book_id, p.n AS page_count, CAST(coalesce(v.n, 0) AS BIGINT) AS volume_count, CASE WHEN v.n IS NULL THEN 'volume' WHEN p.n < 8 * v.n THEN 'all' WHEN p.n < 200 THEN 'marked' ELSE 'volume' END AS layout
FROM (SELECT book_id, CAST(count(*) AS BIGINT) AS n FROM m_pages GROUP BY 1) p LEFT JOIN (SELECT book_id, count(DISTINCT volume) AS n FROM vols GROUP BY 1) v ON v.book_id = p.book_id)"""


@query("w05_layout", f"WITH {_VOLUMES}, {_LAYOUT} SELECT * FROM lay")
def _(lib: Library) -> DataFrame:
    return layout.page_layout(lib.pages, volumes(lib))


@query(
    "w04_page_order",
    f"""WITH {_VOLUMES}, {_LAYOUT}, {_COUNTED}, {_CITES}, cnt AS (SELECT book_id, page_number, CAST(count(DISTINCT citation_id) AS BIGINT) AS n FROM cites GROUP BY 1, 2),
opn AS (SELECT DISTINCT book_id, page_number FROM vols WHERE volume = 1), has AS (SELECT DISTINCT book_id FROM opn)
SELECT m.book_id, m.page_number, CAST(1 AS INT) AS kind, CAST(0 AS INT) AS volume, m.printed, coalesce(cnt.n, 0) AS cited_by FROM m_pages m JOIN lay ON lay.book_id = m.book_id LEFT JOIN cnt ON cnt.book_id = m.book_id AND cnt.page_number = m.page_number
LEFT JOIN opn ON opn.book_id = m.book_id AND opn.page_number = m.page_number LEFT JOIN has ON has.book_id = m.book_id WHERE lay.layout <> 'volume' OR has.book_id IS NULL OR opn.book_id IS NOT NULL""",
)
def _(lib: Library) -> DataFrame:
    """Page orders with volume marks and counts of all books; books of fewer pages per volume list pages only."""
    counts = citing.cited_counts(lib.pages, lib.places, lib.groups, citing.counting(lib.citations, aliases(lib), lib.checks), aliases(lib))
    return layout.page_order(lib.pages, volumes(lib), counts)


@query("w06_selected_volume", f"WITH {_VOLUMES} SELECT m.book_id, m.page_number AS page, CAST(coalesce(min(v.volume), 1) AS INT) AS selected FROM m_pages m LEFT JOIN vols v ON v.book_id = m.book_id AND v.page_number = m.page_number GROUP BY 1, 2")
def _(lib: Library) -> DataFrame:
    asked = lib.pages.select("book_id", F.lit(None).cast("int").alias("volume"), F.col("page_number").alias("page"))
    return layout.selected_volume(asked, volumes(lib)).drop("volume")


@query("w09_gap_fill", "SELECT id, created_at, CASE WHEN score IS NULL AND lead(score) OVER w - lag(score) OVER w = 2 THEN lag(score) OVER w + 1 ELSE score END AS filled FROM (SELECT i.id, i.score, i.kind, c.created_at FROM m_insights i JOIN m_checks c ON c.id = i.id) AS x WINDOW w AS (PARTITION BY kind ORDER BY id)")
def _(lib: Library) -> DataFrame:
    at = lib.checks.select("id", "created_at")
    return layout.gap_filled(lib.insights.join(at, "id"), "score", "id", "kind").select("id", "created_at", "filled")


@query("w10_positional_numbers", "SELECT book_id, position, label, CAST(row_number() OVER (PARTITION BY book_id, page_number, label ORDER BY position) AS INT) AS n FROM m_blocks")
def _(lib: Library) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("book_id", "page_number", "label").orderBy("position"))
    return lib.blocks.select("book_id", "position", "label", n.cast("int").alias("n"))


@query("w11_runs", """WITH d AS (SELECT DISTINCT source_book_id, source_page AS v FROM m_citations), i AS (SELECT *, v - row_number() OVER (PARTITION BY source_book_id ORDER BY v) AS k FROM d),
r AS (SELECT source_book_id, min(v) AS a, max(v) AS b FROM i GROUP BY source_book_id, k)
SELECT source_book_id, string_agg(CASE WHEN a < b THEN CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR) ELSE CAST(a AS VARCHAR) END, ', ' ORDER BY a) AS pages FROM r GROUP BY 1""")
def _(lib: Library) -> DataFrame:
    from ..functions.text import runs

    pages = lib.citations.groupBy("source_book_id").agg(F.array_sort(F.collect_set("source_page")).alias("p"))
    return pages.select("source_book_id", runs(F.col("p")).alias("pages"))


@query("w13_numbered_runs", "SELECT book_id, min(page_number) AS first, max(page_number) AS last FROM (SELECT book_id, page_number, page_number - row_number() OVER (PARTITION BY book_id ORDER BY page_number) AS k FROM m_pages WHERE printed <> 'x') AS x GROUP BY book_id, k HAVING count(*) > 1")
def _(lib: Library) -> DataFrame:
    k = F.col("page_number") - F.row_number().over(Window.partitionBy("book_id").orderBy("page_number"))
    runs = lib.pages.where("printed <> 'x'").withColumn("k", k).groupBy("book_id", "k").agg(F.min("page_number").alias("first"), F.max("page_number").alias("last"), F.count("*").alias("n"))
    return runs.where("n > 1").select("book_id", "first", "last")


@query("w14_carried_number", "SELECT id, last_value(score IGNORE NULLS) OVER (PARTITION BY kind ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM m_insights")
def _(lib: Library) -> DataFrame:
    w = Window.partitionBy("kind").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lib.insights.select("id", F.last("score", ignorenulls=True).over(w).alias("carried"))


@query("w15_suffixed_ids", "SELECT id AS book_id, CASE WHEN n = 1 THEN title ELSE title || '-' || CAST(n AS VARCHAR) END AS slug FROM (SELECT id, title, row_number() OVER (PARTITION BY author_id, title ORDER BY id) AS n FROM m_books) AS x")
def _(lib: Library) -> DataFrame:
    named = layout.suffixed(lib.books.withColumnRenamed("id", "book_id"), "title", "book_id", "author_id")
    return named.select("book_id", F.col("id").alias("slug"))


_AS_TEXT = "concat_ws('/', {t}.part1_type || ' ' || CAST({t}.part1_value AS VARCHAR), {t}.part2_type || ' ' || CAST({t}.part2_value AS VARCHAR), {t}.part3_type || ' ' || CAST({t}.part3_value AS VARCHAR))"


@query(
    "w16_path_to_page",
    """WITH one AS (SELECT book_id, page_number * 10000000 + id AS pos, page_number, part1_type || ' ' || CAST(part1_value AS VARCHAR) AS a, part2_type || ' ' || CAST(part2_value AS VARCHAR) AS b, part3_type || ' ' || CAST(part3_value AS VARCHAR) AS c FROM m_places),
e AS (SELECT book_id, page_number, pos, 1 AS depth, '' AS up, a AS path, b IS NULL AS exact FROM one UNION ALL SELECT book_id, page_number, pos, 2, a, a || '/' || b, c IS NULL FROM one WHERE b IS NOT NULL
  UNION ALL SELECT book_id, page_number, pos, 3, a || '/' || b, a || '/' || b || '/' || c, true FROM one WHERE c IS NOT NULL),
toc AS (SELECT book_id, depth, up, path, coalesce(min_by(page_number, pos) FILTER (WHERE exact), min_by(page_number, pos)) AS page_number, min(pos) AS reached FROM e GROUP BY 1, 2, 3, 4),
l1 AS (SELECT m.book_id, m.page_number AS page, max_by(t.path, t.reached) AS p FROM m_pages m LEFT JOIN toc t ON t.book_id = m.book_id AND t.depth = 1 AND t.page_number <= m.page_number GROUP BY 1, 2),
l2 AS (SELECT l1.book_id, l1.page, l1.p, max_by(t.path, t.reached) AS q FROM l1 LEFT JOIN toc t ON t.book_id = l1.book_id AND t.depth = 2 AND t.up = l1.p AND t.page_number <= l1.page GROUP BY 1, 2, 3),
l3 AS (SELECT l2.book_id, l2.page, l2.p, l2.q, max_by(t.path, t.reached) AS r FROM l2 LEFT JOIN toc t ON t.book_id = l2.book_id AND t.depth = 3 AND t.up = l2.q AND t.page_number <= l2.page GROUP BY 1, 2, 3, 4)
SELECT book_id, page, coalesce(r, q, p, '') AS path FROM l3""",
)
def _(lib: Library) -> DataFrame:
    entries = layout.contents(lib.places, lib.pages)
    found = layout.path_to_page(entries, lib.pages.select("book_id", F.col("page_number").alias("page")))
    return found.select("book_id", "page", F.expr(_PATH).alias("path"))


@query("w17_page_volumes", f"WITH {_VOLUMES}, s AS (SELECT book_id, volume, min(page_number) AS a, max(page_number) AS b FROM vols GROUP BY 1, 2) SELECT m.book_id, m.page_number, max(s.volume) AS volume FROM m_pages m JOIN s ON s.book_id = m.book_id AND m.page_number BETWEEN s.a AND s.b GROUP BY 1, 2")
def _(lib: Library) -> DataFrame:
    return layout.page_volumes(lib.pages, volumes(lib))


@query("w18_verses_cited", "SELECT DISTINCT citation_id, part1_value AS book, part2_value AS chapter, part3_value AS verse FROM m_groups WHERE part3_type = 'verse'")
def _(lib: Library) -> DataFrame:
    """Locations group by group, so that book and chapter carry as they do along one citation's list."""
    one = lib.groups.select(F.col("id").alias("citation_id"), F.col("parts").alias("locations"))
    named = lib.groups.select(F.col("id").alias("_g"), F.col("citation_id").alias("of"))
    found = layout.verses_cited(one).join(named, F.col("citation_id") == F.col("_g"))
    return found.select(F.col("of").alias("citation_id"), "book", "chapter", "verse").distinct()


@query(
    "j21_place_on_page",
    f"""WITH g AS (SELECT g.id, c.reference_book_id AS book_id, {_AS_TEXT.format(t="g")} AS place FROM m_groups g JOIN m_citations c ON c.id = g.citation_id WHERE c.reference_book_id IS NOT NULL),
p AS (SELECT p.book_id, p.page_number * 10000000 + p.id AS pos, {_AS_TEXT.format(t="p")} AS parts FROM m_places p), d AS (SELECT DISTINCT book_id, place FROM g),
m AS (SELECT d.book_id, d.place, bool_or(starts_with(d.place || '/', p.parts || '/')) AS there, min_by(p.parts, p.pos) FILTER (WHERE starts_with(p.parts || '/', d.place || '/')) AS under FROM d JOIN p ON p.book_id = d.book_id GROUP BY 1, 2)
SELECT g.id, g.book_id, g.place, CASE WHEN m.there THEN g.place ELSE m.under END AS snapped FROM g LEFT JOIN m ON m.book_id = g.book_id AND m.place = g.place""",
)
def _(lib: Library) -> DataFrame:
    of = lib.citations.where("reference_book_id is not null").select(F.col("id").alias("citation_id"), F.col("reference_book_id").alias("book_id"))
    asked = lib.groups.join(of, "citation_id").select("id", "book_id", F.col("parts").alias("place"))
    found = layout.place_on_page(asked, lib.places)
    as_text = lambda c: F.array_join(F.transform(c, lambda p: F.concat(p["type"], F.lit(" "), p["value"].cast("string"))), "/")
    return found.select("id", "book_id", as_text(F.col("place")).alias("place"), as_text(F.col("snapped")).alias("snapped"))


@query("j22_exact_path", "SELECT p.id, n.name FROM m_places p LEFT JOIN (SELECT part1_type, part1_value, 'The ' || CAST(part1_value AS VARCHAR) || 'th book' AS name FROM (SELECT DISTINCT part1_type, part1_value FROM m_groups) AS x) n ON n.part1_type = p.part1_type AND n.part1_value = p.part1_value AND p.part2_type IS NULL")
def _(lib: Library) -> DataFrame:
    heads = lib.groups.select(F.slice("parts", 1, 1).alias("path")).distinct()
    names = heads.select("path", F.concat(F.lit("The "), F.get("path", F.lit(0))["value"].cast("string"), F.lit("th book")).alias("name"))
    return lib.places.join(names, lib.places["parts"] == names["path"], "left").select("id", "name")


@query("j20_rule_join", "SELECT id, CASE WHEN author ILIKE 'writer 1%' AND title ILIKE 'work 1%' THEN 'one' WHEN title ILIKE 'work 1%' THEN 'first hundred' WHEN regexp_matches(author, '^writer [2-4]$', 'i') THEN 'two to four' END AS work FROM m_citations")
def _(lib: Library) -> DataFrame:
    rules = [("one", {"author": "^writer 1", "title": "^work 1"}), ("first hundred", {"title": "^work 1"}), ("two to four", {"author": "^writer [2-4]$"})]
    return linkage.first_rule(lib.citations, rules).select("id", "work")


def _linkable(lib: Library) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Citations that name their source's own work in another form, or one that nobody has, books of the same writers, and what is queued."""
    writer = F.concat(F.lit("scribe"), (F.col("author_id") % 9).cast("string"))
    of = lib.books.select(F.col("id").alias("_s"), F.col("title").alias("_t"), writer.alias("_w"))
    named = lib.citations.join(of, F.col("source_book_id") == F.col("_s"))
    cited = named.select("id", F.concat(F.lit("J. "), "_w").alias("author"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("A Lost Treatise on the "), "_t")).otherwise(F.concat(F.lit("The "), "_t", F.lit(" of old, vol. 2"))).alias("title"), "location", "reference_book_id", "source_book_id")
    books = lib.books.select("id", F.concat(F.initcap(writer), F.lit(", A.")).alias("author"), F.concat("title", F.lit(" of old: a study")).alias("title"))
    queued = lib.queue.select("id", "author", "title")
    return cited, books, queued


#: The rows of ``_linkable``, and which works of one writer have the same title or one as near as 0.93.
_LINKED = """c AS (SELECT m.id, b.title AS t, b.author_id % 9 AS w, m.id % 4 = 0 AS lost FROM m_citations m JOIN m_books b ON b.id = m.source_book_id WHERE m.reference_book_id IS NULL),
k AS (SELECT id AS book_id, title AS t, author_id % 9 AS w FROM m_books), u AS (SELECT DISTINCT t, w FROM k),
same AS (SELECT a.t, a.w, b.t AS other FROM u a JOIN u b ON b.w = a.w WHERE a.t = b.t OR length(a.t) + 7 >= 12 AND jaro_winkler_similarity(a.t || ' of old', b.t || ' of old a study') >= 0.93),
links AS (SELECT c.id AS citation_id, min(k.book_id) AS book_id FROM c JOIN same s ON s.t = c.t AND s.w = c.w JOIN k ON k.t = s.other AND k.w = s.w WHERE NOT c.lost GROUP BY 1)"""


@query("j18_fuzzy_links", f"WITH {_LINKED} SELECT citation_id, book_id FROM links")
def _(lib: Library) -> DataFrame:
    return linkage.match_cited_books(*_linkable(lib))[0]


@query("j19_to_look_for", f"WITH {_LINKED} SELECT id, 'J. scribe' || CAST(w AS VARCHAR) AS author, CASE WHEN lost THEN 'A Lost Treatise on the ' || t ELSE 'The ' || t || ' of old, vol. 2' END AS title FROM c WHERE id NOT IN (SELECT citation_id FROM links)")
def _(lib: Library) -> DataFrame:
    return linkage.match_cited_books(*_linkable(lib))[1].select("id", "author", "title")


@query("x13_same_book", "SELECT m.id, m.id % 4 <> 0 AS same FROM m_citations m JOIN m_books b ON b.id = m.source_book_id")
def _(lib: Library) -> DataFrame:
    """Whether each citation means its own source: a lost treatise is not that book."""
    cited, books, _ = _linkable(lib)
    pairs = cited.join(books.select(F.col("id").alias("_k"), F.col("author").alias("w_author"), F.col("title").alias("w_title")), F.col("source_book_id") == F.col("_k"))
    return linkage.same_books(pairs.select("id", "author", "title", "w_author", "w_title")).select("id", "same")


@query(
    "j23_archive_plan",
    """WITH c AS (SELECT id AS ord, 'https://archive.example/details/item' || CAST(id % 500 AS VARCHAR) AS archive_url, 'f' || CAST(id % 250 AS VARCHAR) AS stem, CASE WHEN id % 9 = 0 THEN '.txt' ELSE '.pdf' END AS kind FROM m_citations),
i AS (SELECT archive_url, min_by(stem, ord) AS stem, min_by(kind, ord) AS kind, min(ord) AS ord, count(*) AS citations FROM c GROUP BY 1),
m AS (SELECT *, archive_url IN (SELECT 'https://archive.example/details/item' || CAST(id AS VARCHAR) FROM m_queue) AS queued, stem IN (SELECT 'f' || id[2:] FROM m_books) AS book FROM i),
n AS (SELECT *, sum(CASE WHEN NOT queued AND NOT book AND kind = '.pdf' THEN 1 ELSE 0 END) OVER (PARTITION BY stem, kind ORDER BY ord) AS nth FROM m)
SELECT archive_url, 'https://archive.example/download/' || stem || kind AS pdf_url, stem || kind AS file_name, citations,
  CASE WHEN queued THEN 'already queued' WHEN book AND nth = 0 THEN 'already a book' WHEN book THEN 'already queued' WHEN kind <> '.pdf' THEN 'no .pdf file name' WHEN nth > 1 THEN 'already queued' ELSE 'queue' END AS decision FROM n""",
)
def _(lib: Library) -> DataFrame:
    copies = lib.citations.select(
        F.col("id").alias("ord"), F.concat(F.lit("https://archive.example/details/item"), (F.col("id") % 500).cast("string")).alias("archive_url"), F.concat(F.lit("https://archive.example/download/f"), (F.col("id") % 250).cast("string"), F.when(F.col("id") % 9 == 0, ".txt").otherwise(".pdf")).alias("pdf_url")
    )
    queued = lib.queue.select(F.concat(F.lit("https://archive.example/details/item"), F.col("id").cast("string")).alias("url"))
    ids = lib.books.select(F.regexp_replace("id", "b", "f").alias("id"))
    return linkage.archive_plan(copies, queued, ids)


@query("j25_find_or_create_authors", """WITH w AS (SELECT DISTINCT lower(trim(author)) AS k, trim(author) AS name FROM m_citations WHERE trim(author) <> ''), n AS (SELECT lower(trim(name)) AS k, min(author_id) AS author_id FROM m_author_names GROUP BY 1)
SELECT w.name, CASE WHEN n.author_id IS NOT NULL THEN n.author_id ELSE (SELECT max(id) FROM m_authors) + row_number() OVER (PARTITION BY n.author_id IS NULL ORDER BY w.k) END AS author_id, n.author_id IS NULL AS created FROM w LEFT JOIN n ON n.k = w.k""")
def _(lib: Library) -> DataFrame:
    return linkage.find_or_create_authors(lib.citations.select(F.col("author").alias("name")), lib.author_names, lib.authors)


@query(
    "a14_insight_groups",
    """WITH RECURSIVE w AS (SELECT id, keyword1 AS k FROM m_insights UNION SELECT id, keyword2 FROM m_insights),
few AS (SELECT k FROM w GROUP BY k HAVING count(*) <= 30), near AS (SELECT DISTINCT a.id AS a, b.id AS b FROM w a JOIN w b ON b.k = a.k WHERE a.k IN (SELECT k FROM few)),
far(id, other) AS (SELECT a, b FROM near UNION SELECT f.id, n.b FROM far f JOIN near n ON n.a = f.other),
roots AS (SELECT i.id, coalesce(min(f.other), i.id) AS root FROM m_insights i LEFT JOIN far f ON f.id = i.id GROUP BY 1)
SELECT id, root, CAST((row_number() OVER (PARTITION BY root ORDER BY id) - 1) // 30 AS INT) AS chunk FROM roots""",
)
def _(lib: Library) -> DataFrame:
    words = lib.insights.select("id", F.col("keyword1").alias("keyword")).union(lib.insights.select("id", "keyword2"))
    return insights.consolidation_groups(lib.insights, words, tables(lib.spark, "insight-groups"))


@query("a16_consolidation_check", "SELECT id FROM m_insights WHERE id % 3 <> 0")
def _(lib: Library) -> DataFrame:
    merged = lib.insights.where("id % 3 = 0").select((F.col("id") % 10).alias("n"), "id").groupBy("n").agg(F.array_append(F.collect_list("id"), F.lit(-1).cast("long")).alias("source_ids"))
    return insights.checked_consolidation(lib.insights, merged)[1]


@query("s11_bulk_insert", "SELECT book_id, page_number, printed FROM m_pages")
def _(lib: Library) -> DataFrame:
    """Two inserts into one table; Spark writes in parallel parts, which stand for chunks."""
    path = folder(lib.spark, "inserted")
    for rest in (0, 1):
        writes.inserted(lib.pages.where(F.pmod(F.xxhash64("book_id"), F.lit(2)) == rest), path)
    return lib.spark.read.parquet(path).select("book_id", "page_number", "printed")


@query("s17_clear_counts", "SELECT book_id, CAST(count(*) AS BIGINT) AS n FROM m_pages WHERE page_number > 1 GROUP BY 1")
def _(lib: Library) -> DataFrame:
    """A cache of counts is cleared whole, so that only what is counted after it is there."""
    path = folder(lib.spark, "counts")
    counts = lambda df: df.groupBy("book_id").agg(F.count("*").alias("n"))
    writes.inserted(counts(lib.pages), path)
    writes.cleared(lib.spark, path)
    writes.inserted(counts(lib.pages.where("page_number > 1")), path)
    return lib.spark.read.parquet(path)


@query("s12_replace_by_key", "SELECT book_id, page_number, printed FROM m_pages WHERE page_number < 4 OR book_id = 'b1'")
def _(lib: Library) -> DataFrame:
    """Some books' pages are written again over all of them; their partitions alone are replaced."""
    path = folder(lib.spark, "pages")
    keyed = lambda df: df.withColumn("part", F.pmod(F.xxhash64("book_id"), F.lit(16)))
    keyed(lib.pages).write.mode("overwrite").partitionBy("part").parquet(path)
    again = keyed(lib.pages.where("page_number < 4 or book_id = 'b1'"))
    writes.replace_by_key(again, path, "part")
    return lib.spark.read.parquet(path).select("book_id", "page_number", "printed")


@query("s13_upsert", "SELECT id, title || ' (new)' AS title, coalesce(CASE WHEN author_id % 2 = 0 THEN 'new tr.' END, translator) AS translator FROM m_books WHERE author_id < 10 UNION ALL SELECT id, title, translator FROM m_books WHERE author_id >= 10")
def _(lib: Library) -> DataFrame:
    table = lib.books.select("id", "title", "translator")
    rows = lib.books.where("author_id < 10").select("id", F.concat("title", F.lit(" (new)")).alias("title"), F.when(F.col("author_id") % 2 == 0, "new tr.").alias("translator"))
    return writes.upserted(table, rows, ["id"], ("translator",))


@query("s14_bulk_link", "SELECT id, CASE WHEN reference_book_id IS NULL AND source_page < 20 THEN 'b' || CAST(source_page AS VARCHAR) ELSE reference_book_id END AS reference_book_id FROM m_citations")
def _(lib: Library) -> DataFrame:
    links = lib.citations.where("reference_book_id is null and source_page < 20").select(F.col("id").alias("citation_id"), F.concat(F.lit("b"), F.col("source_page").cast("string")).alias("book_id"))
    return linkage.linked(lib.citations, links).select("id", "reference_book_id")


@query("s15_relink", "SELECT id, citation_id, 'page 1' AS place FROM m_groups WHERE citation_id % 7 = 0 UNION ALL SELECT id, citation_id, part1_type || ' ' || CAST(part1_value AS VARCHAR) AS place FROM m_groups WHERE citation_id % 7 <> 0")
def _(lib: Library) -> DataFrame:
    new = lib.groups.where("citation_id % 7 = 0").withColumn("parts", F.expr(f"cast(array(struct('page', 1)) as {PARTS_SQL})"))
    return linkage.relinked(lib.groups, new).select("id", "citation_id", F.expr("parts[0].type || ' ' || cast(parts[0].value as string)").alias("place"))


@query("s16_invalidate", f"""WITH q AS (SELECT a.book_id, c.id AS citation_id FROM m_citations c JOIN (SELECT id AS book_id, id AS cited_id FROM m_books UNION SELECT book_id, alternate_id FROM m_alternate_ids) a ON a.cited_id = c.reference_book_id WHERE c.id % 2 = 0)
SELECT book_id, page_number FROM m_pages p WHERE NOT EXISTS (SELECT 1 FROM q JOIN m_groups g ON g.citation_id = q.citation_id AND g.part1_type = 'page' WHERE q.book_id = p.book_id AND CASE WHEN regexp_matches(p.printed, '^[0-9]+$') THEN CAST(p.printed AS BIGINT) END = g.part1_value)""")
def _(lib: Library) -> DataFrame:
    changed = citing.pointing(lib.citations.where("id % 2 = 0"))
    return citing.invalidated(lib.pages, lib.pages, lib.groups, changed, aliases(lib)).select("book_id", "page_number")


@query("s19_append", "SELECT id, name FROM m_authors UNION ALL SELECT (SELECT max(id) FROM m_authors) + row_number() OVER (ORDER BY title), title FROM (SELECT DISTINCT title FROM m_books) AS t")
def _(lib: Library) -> DataFrame:
    return writes.appended(lib.authors, lib.books.select(F.col("title").alias("name")).distinct(), ["name"])


@query("s20_cascade", "SELECT g.id FROM m_groups g JOIN m_citations c ON c.id = g.citation_id WHERE c.source_book_id NOT IN (SELECT id FROM m_books WHERE author = '')")
def _(lib: Library) -> DataFrame:
    gone = lib.books.where("author = ''")
    (left,) = writes.deleted(gone, "id", (lib.citations, "source_book_id"))
    dead = lib.citations.join(left.select(F.col("id").alias("_l")), F.col("id") == F.col("_l"), "left_anti")
    return writes.deleted(dead, "id", (lib.groups, "citation_id"))[0].select("id")


@query("s21_checked_parts", "SELECT id, CAST(1 + CASE WHEN part2_type IS NULL THEN 0 ELSE 1 END + CASE WHEN part3_type IS NULL THEN 0 ELSE 1 END AS INT) AS n FROM m_places")
def _(lib: Library) -> DataFrame:
    from ..functions.places import checked_parts

    return lib.places.select("id", F.size(checked_parts(F.col("parts"))).alias("n"))

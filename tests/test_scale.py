"""Plans that have to hold at size: the same rows as the plain form, and no step that is quadratic or one task."""

import random
import re

import pytest
from pyspark.sql import functions as F

from folioweave.functions import text as X
from folioweave.functions import thml
from folioweave.operators import citing, layout, linkage, numbering
from folioweave.plans import QUERIES
from folioweave.plans.session import checkpoints, tables
from folioweave.sources import books

SF = "/root/testdata/sf0.001"
PART = "array<struct<type: string, value: int>>"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["s11_bulk_insert", "s12_replace_by_key", "s17_clear_counts", "s02_scan_json"])
def test_again_in_one_session(spark, name):
    assert len({QUERIES[name](spark, SF).count() for _ in range(4)}) == 1


def _place(*parts):
    return [{"type": t, "value": v} for t, v in parts]


def test_places_meet_by_whole_paths(spark):
    rows = [("b", 1, 1, _place(("book", 1))), ("b", 2, 2, _place(("book", 2), ("chapter", 3))), ("b", 3, 3, _place(("book", 2), ("chapter", 4))), ("c", 1, 4, _place(("book", 9)))]
    places = spark.createDataFrame(rows, f"book_id string, page_number int, id long, parts {PART}")
    asked = [("b", _place(("book", 1), ("chapter", 7))), ("b", _place(("book", 2))), ("b", _place(("book", 3))), ("c", _place(("book", 1))), ("b", []), ("b", _place(("book", 2))), (None, _place(("book", 2)))]
    found = layout.place_on_page(spark.createDataFrame(asked, f"book_id string, place {PART}"), places)
    got = sorted((str(r.book_id), str(r.place), [tuple(p) for p in r.snapped] if r.snapped else None) for r in found.collect())
    text = lambda *p: str([__import__("pyspark").sql.Row(type=t, value=v) for t, v in p])
    want = [("b", text(("book", 1), ("chapter", 7)), [("book", 1), ("chapter", 7)]), ("b", text(("book", 2)), [("book", 2), ("chapter", 3)]), ("b", text(("book", 2)), [("book", 2), ("chapter", 3)]), ("b", text(("book", 3)), None), ("c", text(("book", 1)), None), ("b", "[]", None), ("None", text(("book", 2)), None)]
    assert got == sorted(want, key=lambda r: (r[0], r[1]))


def test_volumes_of_pages_by_blocks(spark):
    r = random.Random(3)
    spans = [("b", v, *sorted((r.randint(1, 70), r.randint(1, 70)))) for v in range(1, 25)] + [("c", 1, 1, 1), ("d", 1, 0, 64)]
    vols = spark.createDataFrame([(b, v, p) for b, v, *ends in spans for p in ends], "book_id string, volume int, page_number int")
    pages = spark.createDataFrame([(b, p) for b in "bcde" for p in range(0, 75)], "book_id string, page_number int")
    want = {(b, p): max(v for x, v, lo, hi in spans if x == b and lo <= p <= hi) for b in "bcde" for p in range(75) if any(x == b and lo <= p <= hi for x, v, lo, hi in spans)}
    found = layout.page_volumes(pages, vols)
    assert {(r.book_id, r.page_number): r.volume for r in found.collect()} == want
    assert not re.search(r"page_number#\d+ (<=|>=)", plan(found))


def test_pages_take_the_last_entry(spark):
    checkpoints(spark)
    entry = lambda page, id_, *parts: ("b", _place(*parts), len(parts), page, (page, id_))
    rows = [entry(1, 1, ("book", 1)), entry(3, 2, ("book", 2)), entry(3, 3, ("book", 2), ("chapter", 1)), entry(5, 4, ("book", 2), ("chapter", 2)), entry(2, 5, ("book", 1), ("chapter", 9))]
    entries = spark.createDataFrame(rows, f"book_id string, path {PART}, depth int, page_number int, reached struct<page_number: int, id: long>")
    asked = spark.createDataFrame([("b", p) for p in range(7)] + [("x", 1)], "book_id string, page int")
    found = layout.path_to_page(entries, asked)
    got = {(r.book_id, r.page): "/".join(f"{p.type} {p.value}" for p in r.path) for r in found.collect()}
    assert got == {("b", 0): "", ("b", 1): "book 1", ("b", 2): "book 1/chapter 9", ("b", 3): "book 2/chapter 1", ("b", 4): "book 2/chapter 1", ("b", 5): "book 2/chapter 2", ("b", 6): "book 2/chapter 2", ("x", 1): ""}
    assert "Join" not in plan(found)


def test_titles_meet_by_keys_and_lose_none(spark):
    r = random.Random(5)
    words = "history of the church letters homilies on genesis treatise faith soul nature grace city god war peace romans psalms against heresies first book".split()
    known = [" ".join(r.choice(words) for _ in range(r.randint(1, 6))) + r.choice(["", ": a study", ", vol. 2", " é"]) for _ in range(150)]

    def typo(s):
        s = list(s)
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(s))
            s[i : i + 1] = r.choice([[], [r.choice("abcz")], [s[i], r.choice("xyz")], s[i : i + 2][::-1]])
        return "".join(s)

    cited = spark.createDataFrame([("J. Scribe", typo(r.choice(known))) for _ in range(150)] + [("J. Scribe", ""), ("", known[0]), (None, None)], "author string, title string").distinct()
    works = spark.createDataFrame([(i, "Scribe, J.", t) for i, t in enumerate(known)], "id long, author string, title string")
    got = {tuple(x) for x in linkage.matching_works(cited, works).collect()}
    asked = F.when(X.cited_title(F.col("title")) != "", X.cited_title(F.col("title"))).otherwise(F.col("title"))
    left, right = cited.where("author = 'J. Scribe'").select("author", "title", X.title_forms(asked).alias("c")), works.select("id", X.title_forms(F.col("title")).alias("o"))
    want = {tuple(x) for x in left.crossJoin(right).where(X.same_title(F.col("c"), F.col("o"))).select("author", "title", "id").collect()}
    assert got == want and len(want) > 100


def test_numbers_over_ranges(spark):
    rows = [(None if i % 3 == 0 else i % 4, i) for i in range(200)]
    found = numbering.numbered(spark.createDataFrame(rows, "root int, id long"), ["id"], ["root"]).collect()
    by = {}
    for root, i in sorted(rows, key=lambda r: r[1]):
        by.setdefault(root, []).append(i)
    assert {(r.root, r.id): r.n for r in found} == {(root, i): n for root, ids in by.items() for n, i in enumerate(ids, 1)}


def test_deep_pages(spark, tmp_path):
    df = spark.createDataFrame([(f"t{i % 37:02}", i) for i in range(500)], "title string, id long")
    numbering.stored_in_order(df, ["title", "id"], str(tmp_path / "o"))
    stored, want = spark.read.parquet(str(tmp_path / "o")), sorted((r.title, r.id) for r in df.collect())
    for offset, n in ((0, 5), (120, 150), (490, 20), (500, 10), (7, 0)):
        assert [(r.title, r.id) for r in numbering.page_of(stored, ["title", "id"], offset, n).collect()] == want[offset : offset + n]


def test_counts_follow_changes(spark):
    schema = "book_id string, page_number int, citation_id long, n long"
    stored = spark.createDataFrame([("b", 1, 1, 2), ("b", 1, 2, 1), ("b", 2, 1, 1)], schema)
    gone, new = spark.createDataFrame([("b", 1, 1, 1), ("b", 2, 1, 1)], schema), spark.createDataFrame([("b", 3, 4, 1), ("b", 1, 5, 1)], schema)
    counts = stored.groupBy("book_id", "page_number").agg(F.count("*").alias("n"))
    kept, after = citing.changed(stored, counts, gone, new)
    assert sorted(tuple(r) for r in kept.collect()) == [("b", 1, 1, 1), ("b", 1, 2, 1), ("b", 1, 5, 1), ("b", 3, 4, 1)]
    assert sorted(tuple(r) for r in after.collect()) == [("b", 1, 3), ("b", 3, 1)]


def test_components_by_contraction(spark):
    from folioweave.operators.insights import contracted

    checkpoints(spark)
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {x: x for e in edges for x in e}

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((up(a), up(b)))
        root[b] = a
    df = spark.createDataFrame([e for e in edges if e[0] != e[1]], "id long, hub long")
    got = {x.id: x.root for x in contracted(df, tables(spark, "c")).collect()}
    assert got == {x: up(x) for x in root if up(x) != x}
    assert contracted(df.limit(0), tables(spark, "c")).count() == 0


VOLUME = """<ThML.body>front &amp; <p>x</p><div1 id="a" title="One" shorttitle="1" type="work">a<p>b > c</p>
<div2 title="Two"><p>d</p><div3 title="Self"/>e</div2>f<div2 title="Three">g</div2></div1></div1>between<div1 title="Four">h<div2>i"""


def test_volumes_in_blocks(spark, tmp_path):
    r = random.Random(2)
    more, depth = [], 0
    for i in range(400):
        k = r.random()
        if depth < 6 and k < 0.5:
            depth += 1
            more.append(f'<div{depth} title="t{i}" id="i{i}">')
        elif depth and k < 0.9:
            more.append(f"</div{depth}>")
            depth -= 1
        else:
            more.append(f'<div{depth + 1} title="s{i}" />')
        more.append(f"text {i} <p>{'é' * r.randint(0, 30)}</p>\n")
    texts = {"one.xml": VOLUME, "two.xml": "".join(more), "three.xml": "no divs", "four.xml": ""}
    for name, xml in texts.items():
        (tmp_path / name).write_text(xml)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "1000")
        rows = books.thml_file_divs(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = sorted((r.path.rsplit("/", 1)[-1], *tuple(r)[1:]) for r in rows)
    assert got == sorted((name, *d) for name, xml in texts.items() for d in thml.divs(xml))


def test_a_block_is_added_up_as_it_is_read(spark, tmp_path):
    """No task sorts or collects the rows of a block: only runs that a batch or block cuts, and the runs of a div, are put together."""
    (tmp_path / "one.xml").write_text("".join(f'<div1 title="t{i}"><p>{i}</p><p>b</p></div1>' for i in range(2000)))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = books.thml_file_divs(spark, str(tmp_path))
        assert "Window [sum(step" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert [r.own for r in found.orderBy("div").collect()] == [f"<p>{i}</p><p>b</p>" for i in range(2000)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_copies_of_a_book_do_not_meet_every_citation(spark):
    copies = [(f"b{i:03}", "Migne, J.", "History of the Church") for i in range(200)]
    volumes = [(f"v{i}{c}", "Newman, J.", f"Sermons on Faith, vol. {i}") for i in (1, 2) for c in "ab"]
    books = spark.createDataFrame([*copies, *volumes], "id string, author string, title string")
    named = [("J. Migne", "History of the Church"), ("J. Newman", "Sermons on Faith, vol. 2"), ("J. Newman", "Sermons on Faith, vol. 7"), ("J. Newman", "Sermons on Faith"), ("J. Migne", "Another Thing Altogether")]
    rows = [(i, *named[i % 5], None, None) for i in range(500)]
    citations = spark.createDataFrame(rows, "id long, author string, title string, location string, reference_book_id string")
    links, rest = linkage.match_cited_books(citations, books, books.limit(0))
    want = ["b000", "v2a", None, "v1a", None]
    assert {r.citation_id: r.book_id for r in links.collect()} == {i: want[i % 5] for i in range(500) if want[i % 5]}
    assert sorted(r.id for r in rest.collect()) == [i for i in range(500) if not want[i % 5]]
    assert "Window" not in plan(links)  # citations times copies went through one


def test_epub_source(spark, tmp_path):
    rows = [("a.epub", i, f"d{i:02}.xhtml", f"<p>{i}</p>" * 50) for i in range(12)] + [("b.epub", 0, "x.html", None), ("c.epub", 0, "notes.txt", "no document")]
    books.write_epubs(spark.createDataFrame(rows, "path string, document int, name string, xhtml string"), str(tmp_path))
    read = books.epub_documents(spark, str(tmp_path))
    want = sorted((p, i, n, x or "") for p, i, n, x in rows if not n.endswith(".txt"))
    assert sorted(tuple(r) for r in read.collect()) == want
    assert [r.document for r in read.where("path = 'a.epub' and name = 'd03.xhtml'").collect()] == [3]
    small = spark.read.format("epub").option("partitionBytes", "500").load(str(tmp_path))
    assert sorted(tuple(r) for r in small.collect()) == want and small.rdd.getNumPartitions() > 5
    (tmp_path / "bad.epub").write_text("none")
    with pytest.raises(Exception, match="no archive"):
        books.epub_documents(spark, str(tmp_path)).count()


def test_epub_archives_are_opened_by_tasks(spark, tmp_path):
    import pickle

    from folioweave.sources import archives

    n = 3000
    rows = spark.range(n).select(F.format_string("b%d.epub", "id").alias("path"), F.lit(0).alias("document"), F.lit("d.xhtml").alias("name"), F.col("id").cast("string").alias("xhtml"))
    books.write_epubs(rows, str(tmp_path))
    assert max(sum(f.is_file() for f in d.iterdir()) for d in [tmp_path, *(d for d in tmp_path.iterdir() if d.is_dir())]) < n // 50
    books.write_epubs(rows.where("id < 2").withColumn("xhtml", F.lit("again")), str(tmp_path))
    (tmp_path / "bad.epub").write_text("none")  # is opened by a task, not for the listing
    parts = archives.EpubReader({"path": str(tmp_path)}).partitions()
    assert len(pickle.dumps(parts)) < 40 * n and sum(len(p.names) for p in parts) == n + 1
    (tmp_path / "bad.epub").unlink()
    got = {r.path: r.xhtml for r in books.epub_documents(spark, str(tmp_path)).collect()}
    assert len(got) == n and got["b1.epub"] == "again" and got["b2.epub"] == "2" and books.epub_documents(spark, str(tmp_path)).count() == n


def test_questions_summaries_and_what_is_stored(spark):
    from folioweave.operators import summaries

    found = [("b", 1, 1, "x", 4, ["1", "*"], "four"), ("b", 1, 2, "y", 2, [], "two and more"), ("b", 1, 3, "z", 9, [], "six"), ("c", 1, 1, "x", 4, [], "")]
    sources = spark.createDataFrame(found, "book_id string, page_number int, rank int, source_book_id string, source_page int, footnotes array<string>, context string")
    named = spark.createDataFrame([("b", "Title", "Author"), ("x", "Other", "")], "id string, title string, author string")
    pages = spark.createDataFrame([("b", 1, "i"), ("b", 2, "7")], "book_id string, page_number int, printed string")
    blocks = spark.createDataFrame([("b", 1, 1, "Text", "<p>Said.</p>")], "book_id string, page_number int, position int, label string, html string")
    asked = {(r.book_id, r.page_number): (r.question, r.n_sources) for r in summaries.questions(sources, named, pages, blocks, most=10).collect()}
    want = 'PAGE: "Title" by Author, [scan page 1, printed page i]\n\nSaid.\n\nSOURCE S1: "Other" by an unknown author. Footnote 1, * on scan page 4.\n\nfour\n\nSOURCE S2: y. Footnote (unnumbered) on scan page 2.\n\nSOURCE S3: z. Footnote (unnumbered) on scan page 9.'
    assert asked[("b", 1)] == (want, 3) and asked[("c", 1)][0].startswith("PAGE: c, [scan page 1]\n\nSOURCE S1")
    answers = spark.createDataFrame([("b", 1, '{"overview": "o", "sources": [{"sourceId": "S2", "summary": "two"}, {"sourceId": "S8", "summary": "none"}]}'), ("c", 1, "no")], "book_id string, page_number int, answer string")
    assert sorted((r.rank, r.overview, r.summary) for r in summaries.summaries(sources, answers).collect()) == [(1, "o", ""), (2, "o", "two"), (3, "o", "")]
    schema = "book_id string, page_number int, text string"
    groups = spark.createDataFrame([(5, [{"type": "page", "value": 7}])], f"citation_id long, parts {PART}")
    changed = spark.createDataFrame([("b", 5)], "book_id string, citation_id long")
    left = summaries.stored(spark.createDataFrame([("b", 1, "old"), ("b", 2, "stale")], schema), spark.createDataFrame([("b", 1, "new"), ("c", 1, "first")], schema), pages, groups, changed)
    assert sorted(tuple(r) for r in left.collect()) == [("b", 1, "new"), ("c", 1, "first")]

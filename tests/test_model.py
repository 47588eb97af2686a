"""Every registered query against its SQL on the smallest tables, and operators against fixtures of their own."""

import os

import pytest
from pyspark.sql import functions as F

from folioweave.functions import places as P
from folioweave.functions import text as X
from folioweave.operators import filters, insights, layout, linkage, writes
from folioweave.plans import ORACLES, QUERIES
from folioweave.plans.session import checkpoints, tables

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, float) and v.is_integer():
        return str(int(v))
    return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    mine = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    if name not in ORACLES:
        assert mine
        return
    cur = duck.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    theirs = [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(mine) == sorted(theirs)


def test_titles_and_authors(spark):
    same = [
        ("The Sacraments", "The Sacraments, Vol. II: The Holy Eucharist", True),
        ("Epistemology", "Epistemology, or the Theory of Knowledge", True),
        ("De Deo Creante et Elevante", "Tractatus de Deo creante et elevante", True),
        ("Christian Philosophy: God, 2nd ed", "Christian philosophy, God; being a contribution", True),
        ("Knowabil- ity of God", "The Knowability of God", True),
        ("Summa Theologica", "Summa Contra Gentiles", False),
        ("Logic", "Logic and Mental Philosophy Today", False),
        ("Theological Outlines", "Theologicall Outlines", True),
        ("", "Anything", False),
    ]
    df = spark.createDataFrame(same, "a string, b string, want boolean")
    df = df.select("a", "want", X.title_forms(F.col("a")).alias("c"), X.title_forms(F.col("b")).alias("o"))
    assert [r.a for r in df.where(X.same_title(F.col("c"), F.col("o")) != F.col("want")).collect()] == []
    who = [("Pohle-Preuss", "Pohle, Joseph", True), ("Driscoll, John T. (John Thomas), 1866-", "J. T. Driscoll", True), ("J. T. Driscoll", "Thomas Aquinas", False), ("St. Thomas", "Thomas Aquinas", True), ("", "Thomas", False)]
    df = spark.createDataFrame(who, "a string, b string, want boolean")
    assert [r.a for r in df.where(X.same_author(F.col("a"), F.col("b")) != F.col("want")).collect()] == []


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    t = lambda s: F.lit(s)
    assert one(X.cited_title(t("Christian Philosophy: God, 2nd ed"))) == "Christian Philosophy: God"
    assert one(X.cited_title(t("God, Chapter XV"))) == "God" and one(X.cited_title(t("God, partly"))) == "God, partly"
    assert [one(X.volume_of(t(s))) for s in ("Works, vol. XIV", "Tom 3", "volume iv.", "Volta", None)] == [14, 3, 4, None, None]
    assert [one(X.roman_to_int(t(s))) for s in ("xlix", "IV", "MCMXCIV")] == [49, 4, 1994]
    assert [one(X.to_roman(t(n))) for n in (1, 4, 49, 1994, 0)] == ["I", "IV", "XLIX", "MCMXCIV", None]
    assert one(X.key_names(t("Pohle-Preuss"))) == ["pohle", "preuss"] and one(X.key_names(t("Rev. Fr."))) == []
    assert one(X.stripped(t("a&amp;lt;<br/>b &#39;c&#x27;&nbsp;"))) == "a&lt; b 'c' "
    assert one(X.runs(F.array(*map(F.lit, [3, 4, 5, 8, 10, 11])))) == "3-5, 8, 10-11"
    assert X.similarity("martha", "marhta") == pytest.approx(0.9611, abs=1e-4) and X.similarity("", "a") == 0 and X.similarity("a", "a") == 1
    assert X.similarity("dwayne", "duane") == pytest.approx(0.84, abs=1e-2) and X.similarity("abc", "xyz") == 0
    assert one(X.file_name(t("https://x.org/a/2015.932.Types.pdf?x=1#y"))) == "2015.932.Types.pdf"
    assert one(X.folder_name(t("https://x.org/a/2015.932.Types.PDF"))) == "2015_932_Types"
    words = [("Sent. I, d. 3", "Sent.", True), ("Sentences", "Sent.", False), ("P.L. 34", "P. L.", True), ("August", "Aug", False), ("ab", "ab", False), ("(Migne)", "migne", True), ("É. Gilson", "é. gilson", True)]
    df = spark.createDataFrame(words, "t string, k string, want boolean")
    assert [r.k for r in df.where(X.has_keyword(F.col("t"), F.col("k")) != F.col("want")).collect()] == []
    labels = {"I-II q. 3 a. 2": 3, "I q. 2": 2, "III prol.": 1, "Suppl. App. 1 q. 1": 3, "xii": None}
    for label, n in labels.items():
        got = one(X.summa_parts(t(label)))
        assert (None if got is None else len(got)) == n
    assert one(X.is_summa(t("Summa Theo- logica"), t("St. Thomas"))) and not one(X.is_summa(t("Summa Contra Gentiles"), t("Aquinas")))


def test_places(spark):
    kind = "g array<struct<type: string, rawLabel: string, values: array<double>>>"
    rows = [
        ([("chapter", "ch. 1", [1.0]), ("verse", "vv. 2-4", [2.0, 3.0, 4.0])],),
        ([("book", "a", [1.0]), ("book", "b", [1.0, 2.0])],),
        ([("page", "p", [1.5, 3e10])],),
        ([],),
        ([("page", "p", [1.5, 7.0])],),
    ]
    got = spark.createDataFrame(rows, kind).select(P.places("g").alias("p"), P.skipped_values("g").alias("s")).collect()
    parts = [[[(x.type, x.value) for x in p.parts] for p in r.p] for r in got]
    assert parts == [[[("chapter", 1), ("verse", v)] for v in (2, 3, 4)], [[("book", 1)], [("book", 2)]], [], [], [[("page", 7)]]]
    assert [r.s for r in got] == [0, 0, 2, 0, 1] and got[0].p[0].raw == "ch. 1, vv. 2-4" and got[1].p[0].raw == "a, b"


def _pages(spark, numbers, book="b"):
    return spark.createDataFrame([(book, n, str(n)) for n in numbers], "book_id string, page_number int, printed string")


def _places(spark, rows, book="b"):
    parts = "parts array<struct<type: string, value: int>>"
    return spark.createDataFrame([(i, book, n, p) for i, (n, p) in enumerate(rows)], f"id long, book_id string, page_number int, {parts}")


def test_volumes_and_orders(spark):
    pages = _pages(spark, range(1, 8))
    places = _places(spark, [(2, [("book", 2)]), (4, [("book", 2)]), (4, [("book", 1)]), (6, [("book", 2)])])
    vols = layout.volumes(pages, places)
    got = {}
    for r in vols.collect():
        got.setdefault((r.volume, r.part_value), set()).add(r.page_number)
    assert got == {(1, 2): {1, 2, 3, 4, 6, 7}, (2, 1): {4, 5}}
    assert layout.volumes(pages, places.limit(0)).count() == 0
    lay = layout.page_layout(pages, vols).first()
    assert (lay.page_count, lay.volume_count, lay.layout) == (7, 2, "all")
    many = _pages(spark, range(1, 41))
    two = layout.volumes(many, _places(spark, [(1, [("book", 1)]), (20, [("book", 2)])]))
    counts = spark.createDataFrame([("b", 3, 5)], "book_id string, page_number int, n long")
    order = layout.page_order(many, two, counts).orderBy("page_number", "kind", "volume").collect()
    assert len(order) == 42 and (order[0].printed, order[0].kind) == ("Book 1", 0) and [r.cited_by for r in order if r.page_number == 3] == [5]
    asked = spark.createDataFrame([("b", None, 25), ("b", 3, None), ("b", 2, None), ("b", None, None), ("z", None, 4)], "book_id string, volume int, page int")
    assert [r.selected for r in layout.selected_volume(asked, two).orderBy("book_id", F.asc_nulls_first("volume"), F.asc_nulls_first("page")).collect()] == [1, 2, 2, None, 1]


def test_contents_and_paths(spark):
    places = _places(spark, [(1, [("book", 1), ("question", 1)]), (2, [("book", 1)]), (3, [("book", 1), ("question", 2)]), (5, [("book", 2), ("question", 1)])])
    pages = _pages(spark, range(1, 7))
    toc = layout.contents(places, pages)
    got = {tuple((p.type, p.value) for p in r.path): r.page_number for r in toc.collect()}
    assert got == {(("book", 1),): 2, (("book", 1), ("question", 1)): 1, (("book", 1), ("question", 2)): 3, (("book", 2),): 5, (("book", 2), ("question", 1)): 5}
    asked = spark.createDataFrame([("b", 1), ("b", 4), ("b", 6)], "book_id string, page int")
    paths = {r.page: [p.value for p in r.path] for r in layout.path_to_page(toc, asked).collect()}
    assert paths == {1: [], 4: [1, 2], 6: [2, 1]}
    kind = "book_id string, place array<struct<type: string, value: int>>"
    snap = layout.place_on_page(spark.createDataFrame([("b", [("book", 2)]), ("b", [("book", 1), ("question", 2), ("article", 3)]), ("b", [("book", 9)])], kind), places)
    assert {r.place[0].value: None if r.snapped is None else [p.value for p in r.snapped] for r in snap.collect()} == {2: [2, 1], 1: [1, 2, 3], 9: None}


def test_linking(spark):
    books = spark.createDataFrame([("b1", "J. Pohle", "Dogmatics, vol. 1"), ("b2", "J. Pohle", "Dogmatics, vol. 2"), ("b3", "T. Aquinas", "On Being and Essence")], "id string, author string, title string")
    queued = spark.createDataFrame([(1, "John Ryan", "Some Queued Work")], "id long, author string, title string")
    cited = [(1, "Pohle", "Dogmatics", "vol. II, p. 3", None), (2, "Aquinas", "On Being and Essence", "", None), (3, "Ryan", "Some Queued Work", "", None), (4, "Nobody", "Lost Book of Things", "", None), (5, "", "Dogmatics", "", None), (6, "Pohle", "Dogmatics", "", "b9")]
    df = spark.createDataFrame(cited, "id long, author string, title string, location string, reference_book_id string")
    links, rest = linkage.match_cited_books(df, books, queued)
    assert {r.citation_id: r.book_id for r in links.collect()} == {1: "b2", 2: "b3"} and sorted(r.id for r in rest.collect()) == [4, 5]
    assert {r.id: r.reference_book_id for r in linkage.linked(df, links).collect()} == {1: "b2", 2: "b3", 3: None, 4: None, 5: None, 6: "b9"}


def test_archive_plan(spark):
    rows = [(1, "https://a.org/details/one", "https://a.org/d/one.pdf"), (2, "https://a.org/details/one", "https://a.org/d/one.pdf"), (3, "https://a.org/details/two", "https://a.org/d/one.pdf"), (4, "https://a.org/details/book%201", "https://a.org/d/x.pdf"), (5, "https://a.org/details/five", "https://a.org/d/five.txt"), (6, "https://a.org/details/six", "https://a.org/d/six.pdf")]
    plan = linkage.archive_plan(spark.createDataFrame(rows, "ord long, archive_url string, pdf_url string"), spark.createDataFrame([("https://a.org/d/six.pdf",)], "url string"), spark.createDataFrame([("book 1",)], "id string"))
    got = {r.archive_url.rsplit("/", 1)[1]: (r.decision, r.citations) for r in plan.collect()}
    assert got == {"one": ("queue", 2), "two": ("already queued", 1), "book%201": ("already a book", 1), "five": ("no .pdf file name", 1), "six": ("already queued", 1)}


def test_insight_groups(spark):
    checkpoints(spark)
    rows = [(1, ["a", "b"]), (2, ["B "]), (3, ["c"]), (4, []), (5, ["d", "c"]), (6, [])]
    df = spark.createDataFrame(rows, "id long, keywords array<string>")
    words = df.select("id", F.explode("keywords").alias("keyword"))
    got = {r.id: r.root for r in insights.consolidation_groups(df.select("id"), words, tables(spark, "t")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 5: 3, 4: None, 6: None}
    common = spark.createDataFrame([(i, "x") for i in range(40)], "id long, keyword string")
    alone = insights.consolidation_groups(common.select("id"), common, tables(spark, "t")).collect()
    assert {r.id: r.root for r in alone} == {i: i for i in range(40)}
    chain = spark.createDataFrame([(i, f"k{j}") for i in range(1, 65) for j in (i, i + 1)], "id long, keyword string")
    out = insights.consolidation_groups(chain.select("id").distinct(), chain, tables(spark, "t")).collect()
    assert {r.root for r in out} == {1} and max(r.chunk for r in out) == 2
    cleaned = insights.clean_keywords(spark.createDataFrame([(1, [" Sent. ", "sent.", "ab", "P.  L."]), (2, [])], "id long, keywords array<string>"))
    assert {r.id: r.keywords for r in cleaned.collect()} == {1: ["Sent.", "P. L."], 2: []}
    twice = spark.createDataFrame([(1, "Use “it”."), (2, 'use "IT"'), (3, " .")], "id long, insight string")
    assert [r.id for r in insights.without_repeats(twice).collect()] == [1]


def test_parameters_and_gate(spark):
    assert filters.paging() == (0, 20) and filters.paging("5", "100") == (5, 100)
    for bad in (lambda: filters.paging("x"), lambda: filters.paging("0", "101"), lambda: filters.enum_param("sort", "z", "title", ("title",)), lambda: filters.id_param("id", "0"), lambda: filters.with_match("some")):
        with pytest.raises(ValueError):
            bad()
    checks = spark.createDataFrame([(1, "a", "likely_copyrighted", "2024-01-01"), (2, "b", "likely_copyrighted", "2024-01-01"), (3, "b", "likely_public_domain", "2024-01-02")], "id long, book_id string, status string, created_at string")
    filters.assert_shown(checks, "b")
    with pytest.raises(filters.NotShown):
        filters.assert_shown(checks, "a")


def test_appends_and_deletes(spark):
    table = spark.createDataFrame([(7, "x")], "id long, name string")
    new = writes.appended(table, spark.createDataFrame([("b",), ("a",)], "name string"), ["name"])
    assert {r.name: r.id for r in new.collect()} == {"x": 7, "a": 8, "b": 9}
    up = writes.upserted(table, spark.createDataFrame([(7, None), (8, "n")], "id long, name string"), ["id"], ("name",))
    assert {r.id: r.name for r in up.collect()} == {7: "x", 8: "n"}


def test_works_of_the_fathers(spark):
    from folioweave.functions.aliases import FATHERS

    john, epistle = "npnf107-lectures-or-tractates-on-the-gospel-according-to-st-john", "npnf107-ten-homilies-on-the-first-epistle-of-john"
    rows = [
        ("Augustine", "De Civit. Dei", "", "npnf102-city-of-god"),
        ("St. Augustine", "De  Trin.", "", "npnf103-on-the-holy-trinity"),
        ("John Damascene", "De Fide Orth", "", "npnf209-an-exact-exposition-of-the-orthodox-faith"),
        ("Augustine", "De Fide et Symbolo", "", "npnf103-a-treatise-on-faith-and-the-creed"),
        ("Augustine", "Tract.", "cv in Joan", john),
        ("Augustine", "Tract.", "ix in Ep. i Joan", epistle),
        ("Augustine", "Tract.", "li", None),
        ("Augustine", "In prim. canon. Joan. Tract.", "iv", epistle),
        ("Pseudo-Augustine", "De Trin.", "", None),
        ("Hilary", "De Trin.", "", None),
    ]
    df = spark.createDataFrame(rows, "author string, title string, location string, want string")
    assert [(r.author, r.title) for r in linkage.first_rule(df, FATHERS).collect() if r.work != r.want] == []


def test_insights_by_the_rarest_word(spark):
    pages = [(1, "The nature of the soul; see S. Th. I."), (2, "The soul of the world"), (3, "the THE the"), (4, ""), (5, None), (6, "natural soul")]
    keywords = [(1, "the nature"), (2, "The  Soul"), (3, "s.th."), (4, "soul"), (5, "of the"), (6, "???"), (7, "ab"), (8, None), (9, "the nature"), (10, "soul")]
    df = spark.createDataFrame(pages, "page_id long, text string")
    learned = spark.createDataFrame([(i, 1 if i == 10 else 4) for i, _ in keywords], "id long, score int")
    words = spark.createDataFrame(keywords + [(4, "nature")], "id long, keyword string")
    got = sorted((r.page_id, r.insight_id) for r in insights.for_pages(df, learned, words).collect())
    kept = [(p, i) for p, t in pages for i, k in keywords + [(4, "nature")] if t and k and i != 10]
    has = spark.createDataFrame([(p, i, dict(pages)[p], k) for p, i, k in {(p, i, k) for p, i in kept for j, k in keywords + [(4, "nature")] if j == i}], "p long, i long, t string, k string")
    want = sorted({(r.p, r.i) for r in has.where(X.has_keyword(F.col("t"), F.col("k"))).collect()})
    assert got == want and (1, 1) in got and (2, 2) in got and (1, 3) in got and (3, 1) not in got


def test_works_and_places_cited(spark):
    from folioweave.functions.aliases import FATHERS, MEDIEVALS, PHILOSOPHER
    from folioweave.operators import reading

    rows = [
        (1, "Aristotle", "Eth. Eudem.", "ii, 3", "", "aristotle-eudemian-ethics", ["book 2/chapter 3"]),
        (2, "the Philosopher", "Metaph.", "", "Metaph. xii, 7", "aristotle-metaphysics", ["book 12/chapter 7"]),
        (3, "Aristotle", "De  Cœl.", "i", "", "aristotle-on-the-heavens", ["book 1"]),
        (4, "Boethius", "De Consol. Phil.", "iii, 11", "", "boethius-consolation-of-philosophy", ["book 3/prose 11"]),
        (5, "S. Thom.", "Summa Contra Gentiles", "", "Contra Gent. Lib. III. c. lxix.", "summa-contra-gentiles", ["book 3/chapter 69"]),
        (6, "Athanasius", "Contra Gentes", "1", "", None, None),
        (7, "Augustine", "De Dono Persev.", "c. 4", "", "npnf105-a-treatise-on-the-predestination-of-the-saints", ["book 2/chapter 4"]),
        (8, None, None, None, None, None, None),
        (9, "Aristotle", "Analytics", "i", "", None, None),
        (10, "Aristotle", "Poet.", "4", "", "aristotle-poetics", []),
    ]
    df = spark.createDataFrame(rows, "id long, author string, title string, location string, raw string, want string, places array<string>")
    divided = spark.createDataFrame([(w, ["book", "chapter"]) for w in {r[5] for r in rows if r[5]} if w not in ("boethius-consolation-of-philosophy", "aristotle-poetics")], "work string, types array<string>")
    got = {r.id: (r.work, ["/".join(f"{p.type} {p.value}" for p in place) for place in r.places]) for r in reading.works_cited(df.drop("want", "places"), FATHERS + PHILOSOPHER + MEDIEVALS, divided).collect()}
    assert got == {r[0]: (r[5], r[6]) for r in rows if r[5]}

"""Whole files to pages: volumes of works, the Summa, the Bible, EPUB documents, songs and prose."""

import io
import zipfile

import pytest

from folioweave.functions import editions, volumes
from folioweave.operators import editions as operators
from folioweave.sources import books


def div(level, id_, title, body, short="", kind=""):
    return f'<div{level} id="{id_}" title="{title}" shorttitle="{short}" type="{kind}">{body}</div{level}>'


ROMANS = '<scripRef passage="Rom. 1:20" parsed="vul|Rom|1|20|0|0">Rom. 1:20</scripRef>'
VOLUME = (
    "<ThML><ThML.head/><ThML.body>"
    + div(1, "a", "Title Page", "<p>x</p>")
    + div(
        1,
        "b",
        "CLEMENT OF ROME",
        div(2, "b.1", "Introductory Note", "<p>by the editor</p>")
        + div(
            2,
            "b.2",
            "First Epistle",
            div(3, "b.2.1", "Chapter I.—The salutation.", f"<h3>Chapter I.—The salutation.</h3><p>The church<note n='1'><p>Or, “sojourning.”</p></note> of God ({ROMANS}).</p><index/>", "Chapter I")
            + div(3, "b.2.2", "Chapter II.—Praise.", "<p>Two.</p>")
            + div(3, "b.2.3", "Elucidations", "<p>An editor's.</p>"),
        ),
    )
    + div(
        1,
        "c",
        "IRENÆUS",
        div(2, "c.1", "Against Heresies: Book I", div(3, "c.1.1", "Chapter I", "<p>One.</p>"))
        + div(2, "c.2", "Against Heresies: Book II", "<p>Preface to it.</p>" + div(3, "c.2.1", "Absurdity of it", "<p>Two.</p>", "Chapter I"))
        + div(2, "c.3", "Fragments", "<verse><l>A line,</l><l>another.</l></verse>")
        + div(2, "c.4", "Alone: Book I", div(3, "c.4.1", "Chapter I", "<p>One.</p>")),
    )
    + div(1, "d", "Indexes", div(2, "d.1", "Index of Scripture", "<p>Genesis</p>"))
    + "</ThML.body></ThML>"
)
RULES = {"works": [(r"fragments", "Anonymous")], "within": [(r"clement of rome", "Clement of Rome"), (r"irenaeus", "Irenaeus")]}


def test_works_of_a_volume(spark):
    made = {b["book_id"]: b for b in volumes.volume_books("v1", VOLUME, RULES)}
    assert [(k, b["author"]) for k, b in made.items()] == [("v1-first-epistle", "Clement of Rome"), ("v1-against-heresies", "Irenaeus"), ("v1-fragments", "Anonymous"), ("v1-alone-book-i", "Irenaeus")]
    first = made["v1-first-epistle"]["pages"]
    assert [(p["printed"], p["parts"]) for p in first] == [("Chapter I", [("chapter", 1)]), ("Chapter II", [("chapter", 2)])]
    assert [b[:2] for b in first[0]["blocks"]] == [
        ("PageHeader", "<p>First Epistle</p>"),
        ("PageHeader", "<p>Chapter I</p>"),
        ("SectionHeader", "<h3>Chapter I.—The salutation.</h3>"),
        ("Text", "<p>The church<sup>1</sup> of God (Rom. 1:20)<sup>2</sup>.</p>"),
        ("Footnote", "<p><sup>1</sup> Or, “sojourning.”</p>"),
        ("Footnote", "<p><sup>2</sup> Rom. 1:20</p>"),
    ]
    assert [(p["printed"], p["parts"]) for p in made["v1-against-heresies"]["pages"]] == [("Book I, Chapter I", [("book", 1), ("chapter", 1)]), ("Book II", [("book", 2)]), ("Book II, Chapter I", [("book", 2), ("chapter", 1)])]
    assert made["v1-fragments"]["pages"][0]["parts"] == [] and "A line,<br />another." in made["v1-fragments"]["pages"][0]["blocks"][-1][1]
    rows = books.volume_pages(spark.createDataFrame([("/x/v1.xml", VOLUME)], "path string, xml string"), {"v1": RULES}).collect()
    assert len(rows) == 7 and rows[0].blocks[5].citations[0].title == "Romans" and rows[0].author == "Clement of Rome"


def test_numbering_by_kind():
    node = lambda kind, title="": volumes.Node(kind=kind, title=title)
    values = lambda nodes: [d and d[2] for d in volumes.numbered(nodes)]
    assert values([node("Chapter", "Chapter 1"), node("Chapter", "Proof"), node("Chapter", "More")]) == [1, 2, 3]
    assert values([node("Note", "Some note"), node("Chapter", "Chapter 1"), node("Chapter", "Yet more")]) == [None, 1, 2]
    assert values([node("Note", "Some note"), node("", "Some more")]) == [None, None] and values([node("Chapter", "Chapter 5"), node("Chapter", "Last")]) == [5, None]


def test_single_work_and_its_chapters():
    assert volumes.chapter_numbers("Chapters XXXIII, XXXVI.") == [33, 36] and volumes.chapter_numbers("Chapters XLI–XLV. On") == [41, 42, 43, 44, 45]
    assert volumes.chapter_numbers("Chapter LXIV. That God governs") == [64] and volumes.chapter_numbers("Of the soul") == []
    assert volumes.book_chapters(["Chapter 1", "No name", "Chapter 3", "Unnamed", "Chapter 9"]) == [[1], [2], [3], [], [9]]
    xml = "<ThML.body>" + div(1, "p", "Preface", "<p>x</p>") + div(1, "i", "Book II", div(2, "i.1", "Chapters III, IV.", "<p>a</p>") + div(2, "i.2", "Chapter V.", "<p>b</p>")) + "</ThML.body>"
    pages = volumes.single_book(xml, "Contra")
    assert [(p["printed"], p["parts"], p["also"]) for p in pages] == [("Book II, Chapter III", [("book", 2), ("chapter", 3)], [[("book", 2), ("chapter", 4)]]), ("Book II, Chapter V", [("book", 2), ("chapter", 5)], [])]


def test_summa_pages():
    xml = (
        "<ThML.body>"
        + div(1, "FS", "I-II", div(2, "FS.1", "Treatise", "<h2>LAST END</h2><p>note</p>" + div(3, "FS_Q1", "OF MAN'S END", "<h3>OF THE END (TWO ARTICLES)</h3><p>Prologue.</p>" + div(4, "FS_Q1_A1", "", "<h4>Whether it acts</h4><p>Objection (Phys. ii, 9).</p>") + div(4, "FS_Q1_A2", "", "<h4>Two</h4><p/><p>x</p>"))))
        + "</ThML.body>"
    )
    pages = volumes.summa_pages(xml)
    assert [p["printed"] for p in pages] == ["I-II prol.", "I-II q. 1", "I-II q. 1 a. 1", "I-II q. 1 a. 2"]
    assert pages[0]["blocks"][2][1] == "<h3>Last End</h3>" and pages[1]["blocks"][2][1] == "<h3>Question 1: Of the End</h3>" and pages[2]["blocks"][-1][2][0]["title"] == "Phys."
    assert "<li><b>Article 2.</b> Two</li>" in pages[1]["blocks"][4][1]


def chapter(book, n, found, start=1):
    marks = "".join(f'<scripture passage="{book} {n}:{i}" />\n<sup>{i}</sup>{t}\n' for i, t in enumerate(found, start))
    return div(3, f"{book}.{n}", f"{book} {n}", f"<h3>Chapter {n}</h3><p>{marks}</p>")


BIBLE = (
    "<ThML.body>"
    + div(
        1,
        "OT",
        "Old Testament",
        div(2, "Gen", "Genesis", "<h2>The Book of Genesis</h2><h4>So called.</h4>" + chapter("Gen", 1, ["In the beginning.", "Void."]))
        + div(2, "iSam", "1 Kings, alias 1 Samuel", chapter("iSam", 1, ["A man"]))
        + div(2, "Esth", "Esther", chapter("Esth", 10, "abc"))
        + div(2, "Sir", "Ecclesiasticus", chapter("Sir", "i", ["Many"], 1) + chapter("Sir", 1, ["Wisdom"]))
        + div(2, "Tob", "Tobias", chapter("Tob", 1, ["Tribe"]))
        + div(2, "Dan", "Daniel", chapter("Dan", 3, [f"v{i}" for i in range(1, 31)]) + chapter("Dan", 4, [f"w{i}" for i in range(1, 38)]))
        + div(2, "PrAzar", "Prayer", chapter("PrAzar", 1, [f"p{i}" for i in range(67)]))
        + div(2, "AddEsth", "Additions", chapter("AddEsth", 10, "de", 4) + chapter("AddEsth", 11, ["Dream"])),
    )
    + "</ThML.body>"
)


def test_bible_pages():
    pages = {p["printed"]: p for p in volumes.bible_pages(BIBLE)}
    assert list(pages) == ["Genesis 1", "1 Kings 1", "Tobias 1", "Esther 10", "Esther 11", "Ecclesiasticus, Prologue", "Ecclesiasticus 1", "Daniel 3", "Daniel 4"]
    assert pages["Ecclesiasticus, Prologue"]["parts"] == [("book", 26), ("chapter", 0)] and pages["1 Kings 1"]["parts"] == [("book", 9), ("chapter", 1)]
    assert [b[1] for b in pages["Genesis 1"]["blocks"][3:]] == ["<p><i>So called.</i></p>", "<p><sup>1</sup> In the beginning.</p>", "<p><sup>2</sup> Void.</p>"]
    third = [b[1] for b in pages["Daniel 3"]["blocks"][3:]]
    assert len(third) == 100 and third[23] == "<p><sup>24</sup> p0</p>" and third[90] == "<p><sup>91</sup> v24</p>" and third[99] == "<p><sup>100</sup> w3</p>"
    assert pages["Daniel 4"]["blocks"][3][1] == "<p><sup>1</sup> w4</p>"
    assert "".join(b[1][-5] for b in pages["Esther 10"]["blocks"][3:]) == "abcde"
    with pytest.raises(ValueError, match="Tob"):
        volumes.bible_pages(BIBLE.replace('"Tobias"', '"Enoch"'))


def words(n, stem="text"):
    return "<p>" + " ".join(f"{stem}{i}" for i in range(n)) + "</p>"


def cited(spark, works, **reading):
    """(printed, parts) of each work's pages, all works read by one job."""
    rows = [(f"w{i}", d, name, html) for i, documents in enumerate(works) for d, (name, html) in enumerate(documents)]
    found = books.edition_pages(spark.createDataFrame(rows, "path string, document int, name string, xhtml string"), "A", **reading).collect()
    by = [sorted((r for r in found if r.path == f"w{i}"), key=lambda r: r.page_number) for i in range(len(works))]
    assert all([r.page_number for r in x] == list(range(1, len(x) + 1)) for x in by)
    return [[(r.printed, [(p.type, p.value) for p in r.parts]) for r in x] for x in by]


def test_leaves(spark):
    page = (
        '<body><p>Part 2 </p><h3>Chapter 3</h3><p><b>4</b> If then there is some end of the things that we do and wish for, and so on and on it goes.</p><p><span id="Chapter_5"><b>5</b></span> Forms</p><p> <br/> 6</p><p>BOOK SECOND. CHAPTER I.</p><p>1882</p><p>C.</p>'
        '<p><span class="pagenum">[1]</span><i>Good</i> aims<sup class="mw-ref"><a href="#n1">[1]</a></sup>.</p><ol class="references"><li id="n1" data-mw-footnote-number="1"><span class="reference-text">By Eudoxus.</span></li></ol><h2>External links</h2><p>gone</p></body>'
    )
    found = list(editions.leaves(page))
    rows = [(i, f["text"], f["heading"], f["bold"], f["anchor"]) for i, f in enumerate(found)]
    marks = operators.marked(spark.createDataFrame(rows, "leaf int, text string, heading boolean, bold string, anchor string")).orderBy("leaf").collect()
    assert [(r.book, r.chapter) for r in marks] == [(None, 2), (None, 3), (None, 4), (None, 5), (None, 6), (2, 1), (None, None), (None, None), (None, None)]
    assert [r.heading for r in marks[:3]] == [True, True, False] and found[-1]["html"] == "<i>Good</i> aims<sup>1</sup>." and found[-1]["refs"] == ["n1"]
    assert list(editions.notes(page)) == [{"id": "n1", "number": "1", "html": "By Eudoxus."}]


def test_edition_pages(spark):
    table = "".join(f"<p>Chap. {n}. Of things.</p>{words(40, 'summary')}" for n in (1, 2, 3))
    text = "".join(f"<p>Chapter {n}</p>{words(200)}" for n in (1, 2, 3))
    held = f"<p>Dedication</p>{words(20)}<p>Book IV.</p>{words(5)}<p>Chapter I.</p>{words(40)}<p>Chapter II.</p>{words(3)}<p>Chapter III.</p>{words(40)}"
    works = [
        [("W_Book_I.xhtml", f"<p>Part 1</p>{words(40)}<p>Part 2</p>{words(40)}"), ("W_Book_II.xhtml", f"<p>Part 1</p>{words(40)}")],
        [("W.xhtml", f"<h2>Preface</h2>{words(40)}<p>1</p>{words(40)}<p>2</p>{words(40)}")],
        [("W.xhtml", f"<h2>Contents</h2>{table}{text}")],
        [("W_Book_I.xhtml", f"{words(150)}<p><b>2</b> More.</p>{words(40)}")],
        [("W.xhtml", held)],
        [("W.xhtml", f"<p>Few</p>{words(3)}"), ("V.xhtml", ""), ("X.xhtml", f"<p>5.</p>{words(4)}")],
    ]
    got = cited(spark, works)
    assert got[0] == [("Book I, Chapter 1", [("book", 1), ("chapter", 1)]), ("Book I, Chapter 2", [("book", 1), ("chapter", 2)]), ("Book II, Chapter 1", [("book", 2), ("chapter", 1)])]
    assert got[1] == [("Preface", []), ("Chapter 1", [("chapter", 1)]), ("Chapter 2", [("chapter", 2)])]
    assert [p for p, _ in got[2]] == ["Contents", "Chapter 1", "Chapter 2", "Chapter 3"]
    assert [p for p, _ in got[3]] == ["Book I, Chapter 1", "Book I, Chapter 2"]
    # the dedication and the book's line join chapter 1, the three words of chapter 2 too
    assert [p for p, _ in got[4]] == ["Book IV, Chapter 1", "Book IV, Chapter 3"]
    assert [p for p, _ in got[5]] == ["Introduction", "Chapter 5"]
    marked = f"<p>Book I.</p><p>Book II.</p>{words(40, 'contents')}<p>CHAPTER I.</p>{words(40)}<p>BOOK SECOND. CHAPTER I.</p>{words(40)}"
    assert [p for p, _ in cited(spark, [[("W.xhtml", marked)]], starts_at=r"^CHAPTER I\.$", first_book=1)[0]] == ["Book I.", "Book I, Chapter 1", "Book II, Chapter 1"]


def test_notes_of_editions(spark):
    note = lambda i: f'<li id="n{i}"><span class="reference-text">Note {i} &amp; more.</span></li>'
    ref = lambda i: f'<sup class="mw-ref"><a href="#n{i}">[{i}]</a></sup>'
    html = f"<p>Chapter 1</p><p>{'word ' * 40}{ref(2)}</p><p>Chapter 2</p><p>{'word ' * 40}{ref(1)}{ref(2)}{ref(9)}</p><ol class='references'>{note(1)}{note(2)}</ol>"
    rows = books.edition_pages(spark.createDataFrame([("x/A_&_B.epub", 0, "d.xhtml", html)], "path string, document int, name string, xhtml string"), "A").orderBy("page_number").collect()
    assert [[(b.label, b.html) for b in r.blocks if b.label != "Text"] for r in rows] == [
        [("PageHeader", "<p>A &amp; B</p>"), ("SectionHeader", "<h3>Chapter 1</h3>"), ("Footnote", "<p><sup>2</sup> Note 2 &amp; more.</p>")],
        [("PageHeader", "<p>A &amp; B</p>"), ("SectionHeader", "<h3>Chapter 2</h3>"), ("Footnote", "<p><sup>1</sup> Note 1 &amp; more.</p>")],
    ]
    assert [(r.book_id, r.title) for r in rows] == [("a-b", "A & B")] * 2


def test_epub_files(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("c1_Ethics_Book_I.xhtml", f"<html><body><p>Part 1</p>{words(40)}</body></html>")
    (tmp_path / "My_Ethics.epub").write_bytes(data.getvalue())
    rows = books.epub_pages(spark, str(tmp_path), "Aristotle").collect()
    assert [(r.book_id, r.page_number, r.printed, [(p.type, p.value) for p in r.parts]) for r in rows] == [("my-ethics", 1, "Book I, Chapter 1", [("book", 1), ("chapter", 1)])]


SONGS = """<html><body><ul class="TOC"><li>BOOK I.</li></ul><h2>PREFACE.</h2><p>Before.</p><h2>BOOK I.</h2><h3>SONG I.<br> A Complaint.</h3>
<div class="poem"><div class="stanza"><span>First line<br></span> <span class="i2">second line,<br></span></div></div><h3>I.</h3>
<p>While I was pondering,<a class="fnanchor" href="#Footnote_A_1">[A]</a> and more.</p><h2>BOOK II.</h2><h3>SONG I.<a class="fnanchor" href="#Footnote_B_2">[B]</a><br> Malice.</h3><div class="poem"><span>Mad Fortune</span></div>
<p>FOOTNOTES:</p><div class="footnote"><p><a id="Footnote_A_1"></a><span class="label">[A]</span> A note.</p></div><div class="footnote"><p><a id="Footnote_B_2"></a><span class="label">[B]</span> On Fortune.</p></div>
<h2>EPILOGUE.</h2><p>Died.</p><h2>REFERENCES TO QUOTATIONS IN THE TEXT.</h2><ul class="Quot"><li>Bk. I., ch. i., p. 17, l. 6: 'Iliad,' I. 363.</li></ul></body></html>"""


def test_songs_and_prose(spark):
    quoted = "Bk. I., ch. iv., p. 17 , l. 6: 'Iliad,' I. ch. v., p. 30 , l. 19: 'Iliad,' II. Bk. V., ch. i., p. 227 , l. 16: Physics."
    found = operators.quotations(spark.createDataFrame([("f", quoted), ("g", "")], "path string, text string")).orderBy("nth").collect()
    assert [(r.path, r.book, r.prose, r.source) for r in found] == [("f", 1, 4, "'Iliad,' I."), ("f", 1, 5, "'Iliad,' II."), ("f", 5, 1, "Physics.")]
    files = spark.createDataFrame([("f", SONGS), ("none", "<p>x</p>"), ("null", None), ("twice", SONGS)], "path string, html string")
    rows = books.song_pages(files, "consolation", "The Consolation", "Boethius").orderBy("path", "page_number").collect()
    assert [r.path for r in rows] == ["f"] * 3 + ["twice"] * 3
    pages = rows[:3]
    parts = [[(p.type, p.value) for p in r.parts] for r in pages]
    assert [r.page_number for r in pages] == [1, 2, 3] and [r.printed for r in pages] == ["Book I, Song I", "Book I, Prose I", "Book II, Song I"] and parts == [[("book", 1), ("metre", 1)], [("book", 1), ("prose", 1)], [("book", 2), ("metre", 1)]]
    blocks = [[(b.label, b.html) for b in r.blocks] for r in pages]
    assert blocks[0] == [("PageHeader", "<p>The Consolation</p>"), ("PageHeader", "<p>Book I</p>"), ("SectionHeader", "<h3>Song I. A Complaint.</h3>"), ("Text", "<p>First line<br/>second line,</p>")]
    assert blocks[1][2:] == [("SectionHeader", "<h3>Prose I</h3>"), ("Text", "<p>While I was pondering,<sup>A</sup> and more.</p>"), ("Footnote", "<p><sup>A</sup> A note.</p>"), ("Footnote", "<p>Quoted: 'Iliad,' I. 363.</p>")]
    assert blocks[2][2:] == [("SectionHeader", "<h3>Song I. Malice.</h3>"), ("Text", "<p>Mad Fortune</p>"), ("Footnote", "<p><sup>B</sup> On Fortune.</p>")]


def test_authors_of_the_volumes():
    from folioweave.functions.volume_authors import VOLUME_AUTHORS

    who = lambda volume, title, *within: volumes.author(VOLUME_AUTHORS.get(volume, {}), title, within)
    assert who("anf01", "Epistle to Polycarp", "IGNATIUS") == "Ignatius of Antioch"
    assert who("anf01", "The Martyrdom of Polycarp", "POLYCARP") == "Church of Smyrna"
    assert who("anf08", "Pantænus, the Alexandrian Philosopher.", "Remains") == "Pantaenus"
    assert [who(v, "A Treatise") for v in ("npnf108", "npnf109", "npnf114", "npnf202", "x")] == ["Augustine of Hippo", "John Chrysostom", "John Chrysostom", None, None]
    assert who("npnf211", "Institutes", "THE WORKS OF JOHN CASSIAN") == "John Cassian" and who("npnf209", "On the Trinity", "x") == "Hilary of Poitiers"

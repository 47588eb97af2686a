"""Sources: scans, text editions, ThML; and the marks set in its text."""

import json

from folioweave.functions import thml
from folioweave.sources import books


def ref(text, parsed=None):
    return f'<scripRef passage="{text}"' + (f' parsed="{parsed}"' if parsed else "") + f">{text}</scripRef>"


def note(text):
    return f'<note place="end" n="6"><p class="endnote">{text}</p></note>'


def bare(html):
    import re

    return re.sub(r"</?scripRef[^>]*>", "", html)


def cites(footnotes):
    return [[(c["author"], c["title"], c["location"]) for c in f["citations"]] for f in footnotes]


def test_scripture():
    html, notes = thml.marked(f'<p>"the way" ({ref("Jn. 14:6", "vul|John|14|6|0|0")}) Therefore</p>')
    assert bare(html) == '<p>"the way" (Jn. 14:6)<sup>1</sup> Therefore</p>' and cites(notes) == [[("Bible", "John", "14:6")]]
    assert notes[0]["kind"] == "scripture" and notes[0]["citations"][0]["passages"] == [(50, 14, [6])]
    html, _ = thml.marked(f"({ref('Jn. 14:6', 'vul|John|14|6|0|0')}; {ref('Rom. 1:20', 'vul|Rom|1|20|0|0')})")
    assert bare(html) == "(Jn. 14:6<sup>1</sup>; Rom. 1:20<sup>2</sup>)"
    _, notes = thml.marked(ref("2 Cor. 10:4,5", "vul|2Cor|10|4|10|5") + ref("Lev. 4:3,23", "vul|Lev|4|3|0|0;vul|Lev|4|23|0|0") + ref("3 Kings 10:4,5") + ref("Ep. 137"))
    assert cites(notes) == [[("Bible", "2 Corinthians", "10:4-5")], [("Bible", "Leviticus", "4:3; 4:23")], [("Bible", "3 Kings", "10:4-5")]]
    _, notes = thml.marked("<p>as it is written (Ps. 118)</p>")
    assert [(n["kind"], *c) for n, c in zip(notes, cites(notes), strict=True)] == [("scripture", ("Bible", "Psalms", "118"))]


def test_works():
    html, notes = thml.marked("<p>Dionysius says (Coel. Hier. xii) that ... and Tertullian (Apol. XVI.) says</p>")
    assert html == "<p>Dionysius says (Coel. Hier. xii)<sup>1</sup> that ... and Tertullian (Apol. XVI.)<sup>2</sup> says</p>"
    assert cites(notes) == [[("Dionysius", "Coel. Hier.", "xii")], [("Tertullian", "Apol.", "XVI")]]
    _, notes = thml.marked("the Philosopher (Metaph. xii, text. 51; De Anima iii)", 5)
    assert notes[0]["identifier"] == "5" and cites(notes) == [[("Philosopher", "Metaph.", "xii, text. 51"), ("Philosopher", "De Anima", "iii")]]
    text = "<p>As Augustine says (De Civ. Dei x, 3), and (1) (i.e., the prophets) (Q[70], A[1]).</p>"
    html, notes = thml.marked(text)
    assert html.replace("<sup>1</sup>", "") == text and cites(notes) == [[("Augustine", "De Civ. Dei", "x, 3")]]
    assert thml.work_references("De Fide Orth. i, 1,3") == [("", "De Fide Orth.", "i, 1,3")] and thml.work_references("Gen. ad lit. xii, 6,7") == [("", "Gen. ad lit.", "xii, 6,7")]
    for other in ("FOUR ARTICLES", "Orthodox", "Rome, 1742", "Chapter 4", "the end"):
        assert thml.work_references(other) == [], other


def test_notes():
    html, notes = thml.marked(f"<p>career,{note(' Ep. LXXXI.')} and of the latter{note(' Relig. Hist. 1214.')}.</p>")
    assert html == "<p>career,<sup>1</sup> and of the latter<sup>2</sup>.</p>" and [n["raw"] for n in notes] == ["Ep. LXXXI.", "Relig. Hist. 1214."]
    _, notes = thml.marked("text" + note(f" See {ref('Rom. 1:20', 'vul|Rom|1|20|0|0')} and (De Trin. i, 1).") + " more" + note(" cf. Ecc. Hist. v. 19. p. 146.") + note(" The best account."))
    assert cites(notes) == [[("Bible", "Romans", "1:20"), ("", "De Trin.", "i, 1")], [("", "Ecc. Hist.", "v. 19. p. 146")], []]
    html, notes = thml.marked(f"Augustine (De Trin. i, 1){note(' ' + ref('Ps. 118', 'vul|Ps|118|0|0|0'))} and ({ref('Jn. 14:6', 'vul|John|14|6|0|0')}).")
    assert [n["kind"] for n in notes] == ["work", "note", "scripture"]
    assert bare(html) == "Augustine (De Trin. i, 1)<sup>1</sup><sup>2</sup> and (Jn. 14:6)<sup>3</sup>."


def test_titles_and_divisions():
    assert thml.tidy_title("OF THE SIMPLICITY OF GOD (EIGHT ARTICLES)") == "Of the Simplicity of God" and thml.tidy_title("Of God") == "Of God"
    assert thml.division("Chapter V.—The martyrdom", "") == ("Chapter V", "chapter", 5) and thml.division("x", "Book I") == ("Book I", "book", 1)
    assert thml.division("", "II") == ("II", None, 2) and thml.division("Homily the First", "") == ("Homily First", "chapter", 1) and thml.division("Preface", "") is None
    assert thml.cleaned('a <a id="x"/><a href="y">b</a>\n ' + ref("Jn. 1")) == "a b Jn. 1"


def test_files(spark, tmp_path):
    xml = '<ThML.body><div1 id="i" title="T"><p>one</p><div2 id="i.1" shorttitle="Book I" type="Book"><p>two</p></div2><p>three</p><div2 id="i.2"/></div1></ThML.body>'
    (tmp_path / "a.xml").write_text(xml)
    rows = books.thml_divs(books.thml_files(spark, str(tmp_path / "a.xml"))).orderBy("div").collect()
    assert [(r.div, r.parent, r.level, r.id, r.short_title, r.kind, r.own) for r in rows] == [(0, -1, 1, "i", "", "", "<p>one</p><p>three</p>"), (1, 0, 2, "i.1", "Book I", "Book", "<p>two</p>"), (2, 0, 2, "i.2", "", "", "")]
    scan = {"b1": [{"page": 1, "blocks": [{"label": "Text", "html": "<p>x</p>", "reading_order": 0, "bbox": [0, 0, 1, 1]}]}], "b2": []}
    (tmp_path / "scan.json").write_text(json.dumps(scan))
    got = books.scans(spark, str(tmp_path / "scan.json")).collect()
    assert [(r.book_id, r.page, r.blocks[0].html) for r in got] == [("b1", 1, "<p>x</p>")]
    (tmp_path / "e.txt").write_text("front\n\nBOOK I\n\nFirst\nparagraph.\n\nSecond.\n\nBOOK II\n\nThird.\n\nTHE END\n\nlicense")
    got = books.text_edition(spark, str(tmp_path / "e.txt")).orderBy("position").collect()
    assert [(r.book, r.paragraph) for r in got] == [("I", "First paragraph."), ("I", "Second."), ("II", "Third.")]
    marked = books.marked_blocks(spark.createDataFrame([(1, "Dionysius says (Coel. Hier. xii)"), (2, None)], "key long, thml string")).collect()
    assert {r.key: len(r.footnotes) for r in marked} == {"1": 1, "2": 0}


def test_files_of_one_partition_are_parsed_by_all_tasks(spark):
    files = spark.createDataFrame([(f"v{i}.xml", "<ThML.body></ThML.body>") for i in range(40)], "path string, xml string").coalesce(1)
    parsed = [books.thml_divs(files), books.volume_pages(files), books.summa_pages(files), books.bible_pages(files)]
    assert files.rdd.getNumPartitions() == 1 and min(p.rdd.getNumPartitions() for p in parsed) > 1

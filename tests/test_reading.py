"""Readers of places, page numbers, footnotes and scripture, on literal cases."""

import json

import pytest

from folioweave.functions import bible, readers
from folioweave.operators import reading, scans


def show(places):
    return [", ".join(f"{t} {v}" for t, v in p) for p in places]


@pytest.mark.parametrize(
    ("raw", "before", "want"),
    [
        ("St. Thomas, Summa Theol., 2a 2ae, qu. 186, art. 7.", None, ["book 3, question 186, article 7"]),
        ("S. Theol., 1a, qu. 3, art. 7.", None, ["book 1, question 3, article 7"]),
        ("Summa Theol., Supplement., qu. 95, art. 2.", None, ["book 5, question 95, article 2"]),
        ("Summa Theologica, 12–2ae: C: 7, ad 1.", None, ["book 2, question 100, article 7, ad 1"]),
        ("Sum. theol., ii-ii, 184, 3.", None, ["book 3, question 184, article 3"]),
        ("Summa Theologica, 3a: III: 5.", None, ["book 4, question 3, article 5"]),
        ("Summa Theologica, ia zae, q. 5, a. 1", None, ["book 2, question 5, article 1"]),
        ("Summa Theologica, 12: VII: 1. I Contra Gentes 69", None, ["book 1, question 7, article 1"]),
        ("Sum theol., 1, 13, 12. Cp. Sum. theol., 111, 16, 1, et ad. 1", None, ["book 1, question 13, article 12", "book 4, question 16, article 1"]),
        ("Sum. theol., ii-ii, 179-80.", None, ["book 3, question 179"]),
        ("Summa Theol., 1a, qu. 2, art. 3; 2a 2ae, qu. 23, art. 1.", None, ["book 1, question 2, article 3", "book 3, question 23, article 1"]),
        ("Ibid., 1a–2a: LXXII: 1, 3. LXXV: 3.", None, ["book 2, question 72, article 1", "book 2, question 75, article 3"]),
        ("Ibid., q. 90, a. 1.", (2, 3), ["book 2, question 90, article 1"]),
        ("Ibid. a. 6", (2, 3), ["book 2, question 3, article 6"]),
        ("Ibid., q. 90, a. 1.", None, []),
        ("Summa Theologica, 1a", None, []),
        ("S. Theol., 38, qu. 12, art. 2, ad 1.", None, ["book 4, question 12, article 2, ad 1"]),
        ("Sum. theol., ii-ii, 26, 3 ad. 3: 'How", None, ["book 3, question 26, article 3, ad 3"]),
        ("—Summa Theol., iii., q. 76, art. 1, ad. 3.", None, ["book 4, question 76, article 1, ad 3"]),
        ("Summa, Ila Ilae, q. 17, a. 4, 5.", None, ["book 3, question 17, article 4"]),
        ("Cfr. S. Theol., 2-2ae, qu. 81, art. 8", None, ["book 3, question 81, article 8"]),
        ("Summa Theologica, 1a: XIII: 12. 2a-2ae: 1: 2.", None, ["book 1, question 13, article 12", "book 3, question 1, article 2"]),
    ],
)
def test_summa(raw, before, want):
    assert show(readers.summa_places(raw, before)) == want


@pytest.mark.parametrize(
    ("location", "types", "want"),
    [
        ("xiv, 9", "book chapter", ["book 14, chapter 9"]),
        ("xxi", "book chapter", ["book 21"]),
        ("XI, c. 9", "book chapter", ["book 11, chapter 9"]),
        ("lib. xv. cap. 16", "book chapter", ["book 15, chapter 16"]),
        ("i, 3,4", "book chapter", ["book 1, chapter 3", "book 1, chapter 4"]),
        ("ii, 4-6", "book chapter", ["book 2, chapter 4", "book 2, chapter 5", "book 2, chapter 6"]),
        ("cv in Joan", "chapter", ["chapter 105"]),
        ("50, n. 3", "chapter part", ["chapter 50"]),
        ("i, 10", "book", ["book 1"]),
        ("I, c. 12, n. 35 (Migne, P. L., XXXIV, 1247", "book chapter", ["book 1, chapter 12"]),
        ("", "book chapter", []),
        ("Prolog.", "book chapter", []),
        ("c. 9", "book chapter", []),
    ],
)
def test_fathers(location, types, want):
    assert show(readers.father_places(location, types.split())) == want


def test_location_text():
    assert readers.location_text("iii, 4", "x", "y") == "iii, 4"
    assert readers.location_text("", "Contra Gent. Lib. III. c. lxix.", "Contra Gent.") == " Lib. III. c. lxix."
    assert readers.location_text(" ", "Contra Gent. Lib. III.", "Summa Contra Gentiles", "^contra gent") == ". Lib. III."
    assert readers.location_text("", "raw", "") == "raw"


def test_ibid_is_carried_within_a_book(spark):
    rows = [
        (1, "a", 1, "Summa Theologica", "Aquinas", "Summa Theol., 1a 2ae, q. 3"),
        (2, "a", 2, "Summa Theologica", "Aquinas", "Ibid., a. 6"),
        (3, "a", 3, "Summa Theologica", "Aquinas", "Ibid."),
        (4, "a", 4, "Summa Theologica", "Aquinas", "Ibid., q. 9, a. 2"),
        (5, "b", 1, "Summa Theologica", "Aquinas", "Ibid., q. 9"),
        (6, "b", 2, "Summa Contra Gentiles", "Aquinas", "Summa, 1a, q. 1"),
    ]
    df = spark.createDataFrame(rows, "id long, source_book_id string, source_page int, title string, author string, raw string")
    got = {r.id: show([[(p.type, p.value) for p in x] for x in r.places]) for r in reading.summa_places(df).collect()}
    assert got == {1: ["book 2, question 3"], 2: ["book 2, question 3, article 6"], 3: [], 4: ["book 2, question 9, article 2"], 5: []}


def test_bible():
    assert len(bible.CANON) == 73 and bible.book_name(9) == "1 Kings" and bible.book_name(0) == ""
    assert [bible.printed_book(x) for x in ("3 Kings", "Ecclus.", "1 Cor", "Ep", "Jn")] == [11, 26, 53, None, 50]
    assert bible.marked_passages("vul|John|14|6|0|0;vul|Gen|1|0|3|0;vul|Ps|2|3|2|5;|X|1") == [(50, 14, [6]), (1, 1, []), (1, 2, []), (1, 3, []), (21, 2, [3, 4, 5])]
    assert bible.printed_passages("3 Kings 10:4,5-7") == [(11, 10, [4, 5, 6, 7])] and bible.printed_passages("Ep. 137") == []


def test_numbering():
    pages = list(range(1, 21))
    heads = [[] if p in (1, 2, 9) else [p + 10] for p in pages]
    heads[14] = [85]  # 25 misread by a digit that is not confused: an outlier
    heads[15] = [28]  # 26 misread as 28
    out = scans.numbering(pages, heads, ["i" if p == 1 else "" for p in pages])
    assert out[2:] == [str(p + 10) for p in pages[2:]] and out[0] == "11" and out[1] == "12"
    assert scans.numbering([1, 2], [[], []], ["iv", ""]) == ["iv", ""]
    twin = scans.numbering(list(range(1, 13)), [[2 * p, 2 * p + 1] for p in range(1, 13)], [""] * 12)
    assert twin[0] == "2-3" and twin[-1] == "24-25"
    shifted = scans.numbering(list(range(1, 31)), [[p] if p < 15 else [p - 1] if p > 15 else [] for p in range(1, 31)], [""] * 30)
    assert shifted[13] == "14" and shifted[15] == "15" and shifted[14] in ("", "15")
    assert scans.nearly(384, 334) and not scans.nearly(384, 344) and not scans.nearly(84, 384)


def test_scanned_pages(spark):
    kind = "book_id string, page int, blocks array<struct<label: string, html: string, reading_order: int, bbox: array<double>>>"
    block = lambda label, html, n: (label, html, n, [0.0, 0.0, 1.0, 1.0])
    rows = [("b", p, [block("PageHeader", f"<p>[ {p + 4} ]</p>", 0), block("Caption", "<p>x</p>", 2), block("Text", "<b> </b>", 3), block("Picture", "p", 4), block("Text", "<p>body</p>", 1)]) for p in range(1, 6)]
    pages = spark.createDataFrame(rows, kind)
    got = [(r.position, r.label) for r in scans.blocks(pages).where("page_number = 1").orderBy("position").collect()]
    assert got == [(0, "PageHeader"), (1, "Text"), (2, "Text")]
    assert {r.page: r.printed for r in scans.printed_numbers(pages).collect()} == {p: str(p + 4) for p in range(1, 6)}


NOTES = [(1, "PageHeader", "<p>Running head</p>"), (2, "Text", "<p>Body text.</p>"), (3, "Footnote", "<p><sup>1</sup> First note.</p><p><sup>2</sup> Second note.</p>"), (4, "Footnote", "<p>continued second note.</p><p><sup>3</sup> Third note.</p>"), (5, "PageFooter", "<p>12</p>")]


def test_source_pages(spark):
    blocks = spark.createDataFrame([(k, "b", 7, k, label, h) for k, label, h in NOTES] + [(20, "b", 8, 1, "PageHeader", "<p>x</p>")], "id long, book_id string, page_number int, position int, label string, html string")
    asked = [(10, 3, 7, "1"), (11, 3, 7, "2)"), (12, 4, 7, "9"), (13, 4, 7, ""), (14, 3, 7, ""), (15, 4, 7, " 3. "), (16, 99, 7, "1"), (17, 3, 7, None), (18, 20, 8, "1"), (19, 1, 9, "1")]
    shown = scans.source_pages(spark.createDataFrame([(i, k, "b", n, m) for i, k, n, m in asked], "id long, block_id long, book_id string, page_number int, footnote string"), blocks)
    body, whole = "<p>Body text.</p>", NOTES[2][2]
    assert {r.id: r.html for r in shown.collect()} == {
        10: f"{body}\n<p><sup>1</sup> First note.</p>",
        11: f"{body}\n<p><sup>2</sup> Second note.</p>\n<p>continued second note.</p>",
        12: f"{body}\n{NOTES[3][2]}",
        13: f"{body}\n<p>continued second note.</p>",
        14: f"{body}\n{whole}",
        15: f"{body}\n<p><sup>3</sup> Third note.</p>",
        16: body,
        17: f"{body}\n{whole}",
        18: "",
    }
    cited = spark.createDataFrame([(10, 3, "b", 7, "1"), (11, 4, "b", 7, "3"), (12, 3, "b", 7, "9")], "id long, block_id long, book_id string, page_number int, footnote string")
    placed = {r.id: r.position for r in scans.placed_citations(cited, blocks).collect()}
    assert placed == {10: 3, 11: 4, 12: None}


def test_answers(spark):
    cite = {"author": "Bible", "title": "John", "location": "3:16", "raw": "John 3:16", "locationsCited": [[{"rawLabel": "3", "type": "chapter", "values": [3]}]]}
    answer = json.dumps({"footnotes": [{"identifier": "1", "citations": [cite, cite]}, {"identifier": "", "citations": []}], "additionalInsights": []})
    rows = scans.answered_citations(spark.createDataFrame([("b", 4, answer), ("b", 5, "no json")], "book_id string, page int, answer string")).collect()
    assert [(r.footnote, r.n, r.title, r.locations[0][0].values) for r in rows] == [("1", 0, "John", [3.0]), ("1", 1, "John", [3.0])]


def test_texts_that_come_again_are_read_once_a_batch(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from folioweave.operators import reading, scans
    from folioweave.sources import books

    class Caught:
        """Takes the function that a frame is given, to be run here."""

        def __init__(self, kept):
            self.kept = kept

        columns = ("pattern", "prefix", "work")

        def __getattr__(self, name):
            return lambda *x, **y: self

        def mapInArrow(self, run, schema):  # noqa: N802
            self.kept.append(run)
            return self

    for of, name in ((reading.readers, "father_places"), (reading.readers, "summa_places"), (books.thml, "marked")):
        n = []
        read = getattr(of, name)
        monkeypatch.setattr(of, name, lambda *x, read=read, n=n: n.append(x) or read(*x))
        kept = []
        if name == "father_places":
            reading.father_places(Caught(kept))
            batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.nulls(9, pa.string()), pa.array([f"c. {i % 3 + 1}" for i in range(9)]), *([pa.array([""] * 9)] * 2), pa.array([["chapter"]] * 9), *([pa.nulls(9, pa.string())] * 2)], names=list("abcdefgh"))
            got = [p[0][0]["value"] for p in next(kept[0](iter([batch]))).column(2).to_pylist()]
            assert got == [i % 3 + 1 for i in range(9)] and len(n) == 3
        elif name == "summa_places":
            reading.summa_places(Caught(kept))
            raws = ["Summa Theol., 1a, q. 1", "Ibid., a. 2", "Ibid., a. 2", "Summa Theol., 1a, q. 3", "Ibid., a. 2", "Summa Theol., 1a, q. 1"]
            batch = pa.RecordBatch.from_arrays([pa.array(["b"] * 6), pa.array(range(6)), pa.array(raws)], names=list("abc"))
            got = [[p["value"] for p in x[0]] for x in next(kept[0](iter([batch]))).column(1).to_pylist()]
            assert got == [[1, 1], [1, 1, 2], [1, 1, 2], [1, 3], [1, 3, 2], [1, 1]] and len(n) == 4
        else:
            books.marked_blocks(Caught(kept))
            batch = pa.RecordBatch.from_arrays([pa.array(list("abcd")), pa.array(["(De Trin. i, 1)", "none", "(De Trin. i, 1)", ""])], names=["key", "thml"])
            got = next(kept[0](iter([batch]))).to_pylist()
            assert [len(r["footnotes"]) for r in got] == [1, 0, 1, 0] and got[0]["html"] == got[2]["html"] and len(n) == 3
    want = np.arange(-20, 12000)
    for c in (0, 3, 9, 10, 38, 109, 1880):
        digits = lambda w: w >= 0 and len(str(w)) == len(str(c)) and [x for x in zip(str(c), str(w), strict=True) if x[0] != x[1]]  # noqa: B023, E731
        assert scans.nearly(c, want).tolist() == [bool(d) and len(d) == 1 and "".join(d[0]) in scans.CONFUSED for d in map(digits, want.tolist())]
    each = scans.nearly(np.array([[0], [38], [1880]]), want[None, :])
    assert all((each[i] == scans.nearly(c, want)).all() for i, c in enumerate((0, 38, 1880)))

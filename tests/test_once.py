"""What is read or compared is made once, and in many tasks: rows of a file that is one split, pairs that come again."""

import pytest
from pyspark.sql import functions as F

from folioweave.functions import places as P
from folioweave.functions import text as X
from folioweave.operators import layout, linkage
from folioweave.plans.model import Library
from folioweave.plans.session import checkpoints, tables
from folioweave.sources import books

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_books_are_dealt_to_all_tasks(spark, monkeypatch):
    """A file of books is one split; its rows are many tasks', more of them for more rows."""
    assert Library(spark, SF).books.rdd.getNumPartitions() >= 4
    monkeypatch.setattr("folioweave.plans.model.DEALT", 10)
    lib = Library(spark, SF)
    assert lib.pages.rdd.getNumPartitions() == -(-lib.table("part").count() // 10)
    assert sorted(map(tuple, layout.contents(lib.places, lib.pages).collect()), key=str)


def test_citations_are_counted_without_a_sort(spark, tmp_path):
    """The least flag of a group is told by truths, nulls left out, as min does."""
    flags = [("R", "R"), ("A", "R"), ("R", "Z"), ("Z", "Z"), (None, "R"), (None, None), ("N", None)]
    rows = [(i, 1, 7, 3, 5.0, f) for i, pair in enumerate(flags) for f in pair]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = Library(spark, str(tmp_path)).citations
    assert {r.id: r.reference_book_id is None for r in found.collect()} == {i * 8 + 1: min((f for f in pair if f), default=None) == "R" for i, pair in enumerate(flags)}
    assert "SortAggregate" not in found.select("id", "reference_book_id")._jdf.queryExecution().executedPlan().toString()


def test_steps_of_places_and_numerals_are_made_once(spark):
    """A step named several times was made as often, and once more for each step upon it."""
    df = spark.createDataFrame([([("book", "b.", [1.0, 2.0, 1.0]), ("chapter", "c.", [3.0, 1.5])],), ([],), (None,)], "g array<struct<type: string, rawLabel: string, values: array<double>>>")
    found = df.select(P.places("g").alias("p"))
    assert plan(found).count("v_") < 40
    got = [None if r.p is None else [(x.raw, [tuple(y) for y in x.parts]) for x in r.p] for r in found.collect()]
    assert got == [[("b., c.", [("book", 1), ("chapter", 3)]), ("b., c.", [("book", 2), ("chapter", 3)])], [], None]
    said = spark.createDataFrame([("Works, vol. XIV",), ("tom. 12",), ("none",), (None,)], "s string").select(X.volume_of(F.col("s")).alias("n"))
    assert [r.n for r in said.collect()] == [14, 12, None, None]
    assert plan(said).count("regexp_extract") == 1


def test_pairs_that_come_again_are_compared_once(spark):
    kinds = [("J. Migne", "The Church of old, vol. 2", "Migne, J.", "Church of old: a study"), ("J. Migne", "A Lost Treatise on the Church", "Migne, J.", "Church of old"), ("J. Migne", None, "Migne, J.", "Church"), (None, "Church of old", "Migne, J.", "Church of old")]
    pairs = spark.createDataFrame([(i, *kinds[i % 4]) for i in range(400)], "id long, author string, title string, w_author string, w_title string")
    found = linkage.same_books(pairs)
    assert [r.same for r in found.orderBy("id").collect()] == [True, False, None, None] * 100
    assert plan(found).rindex("ArrowEvalPython") < plan(found).index("Aggregate [author")  # the aggregate is below, so before it


@pytest.mark.parametrize("read", ["song", "edition"])
def test_documents_are_parsed_once(spark, read):
    checkpoints(spark)
    made = []
    table = tables(spark, "parsed")

    def counted(df):
        made.append(df)
        return table(df)

    if read == "song":
        files = spark.createDataFrame([("a.html", "<body><h2>BOOK I.</h2><h3>I.</h3><p>a</p></body>")], "path string, html string")
        found = books.song_pages(files, "c", "C", "B", table=counted)
    else:
        files = spark.createDataFrame([("a.xhtml", 0, "W.xhtml", "<body><h2>Chapter 1</h2><p>a &amp; b</p></body>")], "path string, document int, name string, xhtml string")
        found = books.edition_pages(files, "", table=counted)
    assert found.count() == 1 and len(made) == 1
    assert plan(found).count("MapInPandas") == (0 if read == "song" else 1)  # notes are read by one step

"""Ids that many books share: the rows of a plain reading, and no step as large as books times citations."""

import random

import pytest
from pyspark.sql import functions as F

from folioweave.operators import citing, insights

PART = "array<struct<type: string, value: int>>"
KINDS = ("cited_counts", "cited_ways", "set_matches", "prefix_matches", "number_matches", "counted", "citations_of_pages", "page_sources")


def library(spark, n_books, n_citations, seed=1):
    r = random.Random(seed)
    part = lambda t, n: {"type": t, "value": r.randint(1, n)}
    place = lambda: [part("page", 3)] if r.random() < 0.3 else [part("book", 3), *([part("chapter", 2)] if r.random() < 0.6 else [])] if r.random() < 0.9 else []
    books = [f"b{i}" for i in range(n_books)]
    aliases = [(b, b) for b in books] + [(b, "alt") for b in books if r.random() < 0.9]
    citations = [(i, r.choice([*books, "out", "hid", "alt"]), r.randint(1, 4), r.choice(["", "1", "2"]), r.choice(["alt", "alt", "alt", None, *books[:5]])) for i in range(n_citations)]
    groups = [(i, place()) for i, *_ in citations for _ in range(r.randint(0, 3))]
    places = [(b, p, place()) for b in books for p in (1, 2, 3) for _ in range(r.randint(0, 2))]
    pages = [(b, p, r.choice([str(p), "x", "99999999999"])) for b in books for p in (1, 2, 3)]
    checks = [(1, "hid", "likely_copyrighted", 1)]
    raw = dict(aliases=aliases, citations=citations, groups=groups, places=places, pages=pages)
    f = spark.createDataFrame
    frames = dict(
        aliases=f(aliases, "book_id string, cited_id string"), checks=f(checks, "id long, book_id string, status string, created_at long"),
        citations=f(citations, "id long, source_book_id string, source_page int, footnote string, reference_book_id string"),
        groups=f(groups, f"citation_id long, parts {PART}"), places=f(places, f"book_id string, page_number int, parts {PART}"), pages=f(pages, "book_id string, page_number int, printed string"),
    )
    return raw, frames


def found(kind, t):
    of = citing.counting(t["citations"], t["aliases"], t["checks"])
    if kind == "counted":
        return citing.counted(t["citations"], t["aliases"], t["checks"])
    if kind in ("citations_of_pages", "page_sources"):
        return getattr(citing, kind)(*(t[k] for k in ("pages", "places", "groups", "citations", "aliases", "checks")))
    if kind in ("cited_counts", "cited_ways"):
        return getattr(citing, kind)(t["pages"], t["places"], t["groups"], of, t["aliases"])
    return getattr(citing, kind)(t["pages" if kind == "number_matches" else "places"], t["groups"], of, t["aliases"])


def plain(kind, raw):
    """Every book's every citation beside its every row."""
    ids = lambda b: {c for x, c in raw["aliases"] if x == b}
    books = sorted({b for b, _ in raw["aliases"]})
    listing = kind in ("citations_of_pages", "page_sources")
    of = [(b, c) for b in books for c in raw["citations"] if c[4] in ids(b) and c[1] != "hid" and (listing or c[1] not in ids(b))]
    if kind == "counted":
        return sorted((b, c[0]) for b, c in of)
    key = lambda ps: [(p["type"], p["value"]) for p in ps]
    by_set = kind == "set_matches" or listing
    met = lambda row, g: row and g and (row[0] == g[0] and set(row) <= set(g) if by_set else g[: len(row)] == row)
    out, numbers, said = [], [], {c[0]: c for c in raw["citations"]}
    for b, c in of:
        gs = [key(g) for i, g in raw["groups"] if i == c[0]]
        out += [(b, p, c[0]) for x, p, row in raw["places"] if x == b for g in gs if met(key(row), g)]
        numbers += [(b, p, c[0]) for x, p, n in raw["pages"] if x == b and n.isdigit() for g in gs for t, v in g if t == "page" and v == int(n)]
    if kind in ("set_matches", "prefix_matches", "number_matches"):
        return sorted(numbers if kind == "number_matches" else out)
    both = out + numbers
    if kind == "citations_of_pages":
        return sorted({(*x, *said[x[2]][1:]) for x in both}, key=str)
    pages = sorted({x[:2] for x in both})
    if kind == "page_sources":
        want = []
        for b, p in pages:
            cs = [said[i] for i in sorted({x[2] for x in both if x[:2] == (b, p)})]
            for rank, at in enumerate(sorted({c[1:3] for c in cs})[:10], 1):
                want.append((b, p, *at, rank, list(dict.fromkeys(c[3] for c in cs if c[1:3] == at and c[3]))))
        return sorted(want, key=str)
    return [(b, p, len(of_page if kind == "cited_ways" else set(of_page))) for b, p in pages for of_page in [[x for x in both if x[:2] == (b, p)]]]


@pytest.mark.parametrize("kind", KINDS)
def test_rows_of_a_plain_reading(spark, kind):
    raw, frames = library(spark, 12, 90)
    got = sorted((tuple(x) for x in found(kind, frames).collect()), key=str)
    assert got == sorted(plain(kind, raw), key=str) and got


@pytest.mark.parametrize("kind", KINDS)
def test_nothing_as_large_as_books_times_citations(spark, kind):
    _, frames = library(spark, 300, 600)
    sc, was = spark.sparkContext, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sc.setJobGroup(kind, kind)
        found(kind, frames).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        sc.setLocalProperty("spark.jobGroup.id", None)
    store, tracker = sc._jsc.sc().statusStore(), sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(kind) for s in tracker.getJobInfo(j).stageIds}
    assert max(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) < 300 * 600 / 8


def test_counts_move_by_what_changed(spark):
    _, t = library(spark, 12, 90)
    before, after = (citing.counting(t["citations"].where(w), t["aliases"], t["checks"]) for w in ("id % 7 <> 3", "id % 5 <> 0"))
    counts, gone, new, want = (citing.cited_counts(t["pages"], t["places"], t["groups"], of, t["aliases"]) for of in (before, *citing.count_changes(before, after), after))
    assert sorted(map(tuple, citing.moved(counts, gone, new).collect())) == sorted(map(tuple, want.collect()))
    assert gone.agg(F.sum("n")).first()[0] and new.agg(F.sum("n")).first()[0]


def test_insights_of_a_keyword_on_many_pages(spark):
    pages = spark.createDataFrame([(i, f"a large economy {i} small" if i % 2 else f"the economy {i}") for i in range(400)], "page_id long, text string")
    known = spark.createDataFrame([(i, 5) for i in range(400)], "id long, score int")
    words = spark.createDataFrame([(i, w) for i in range(400) for w in ("Economy", "SMALL", "large economy", "nowhere")[i % 4 :]], "id long, keyword string")
    sc, was = spark.sparkContext, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = insights.for_pages(pages, known, words).groupBy("page_id").agg(F.count("*").alias("n"), F.countDistinct("insight_id").alias("d")).collect()
        sc.setJobGroup("insights", "insights")
        insights.for_pages(pages, known, words).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert {(r.page_id, r.n, r.d) for r in got} == {(i, n, n) for i in range(400) for n in [300 if i % 2 else 100]}
    store, tracker = sc._jsc.sc().statusStore(), sc.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("insights") for s in tracker.getJobInfo(j).stageIds}
    assert max(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages) < 400 * 400 / 8

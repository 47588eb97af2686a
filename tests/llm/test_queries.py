"""The registered corpus queries over whole small tables, against plain Python; and the pipeline, stage by stage."""

import hashlib
import html as entities
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioweave.llm import quality
from folioweave.llm.oracle import ORACLE_SQL
from folioweave.llm.queries import QUERIES

from .test_near import brute as brute_near
from .test_rules_and_words import PLAIN, WORD, brute_contamination, brute_measure, brute_targets, lower
from .test_simhash import brute_components, brute_print
from .test_suffix import brute as brute_suffix

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_main_text(spark):
    want = {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        body = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?(?:b|i)>", "", p))).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        want[r.page_id] = "\n".join(p for p in parts if p)
    rows = QUERIES["op4_main_text"](spark, SF).collect()
    assert {r.page_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows) and len(rows) == len(want)


def test_mixing(spark, documents):
    sizes, by = {d: len(WORD.findall(t or "")) for d, t, *_ in documents}, {}
    for d, _, _, s, _ in documents:
        by[s] = by.get(s, 0) + sizes[d]
    want, taken, most = brute_targets(by), {}, {}
    source = {d: s for d, _, _, s, _ in documents}
    rows = QUERIES["op5_mixing"](spark, SF).collect()
    assert len(rows) == len(documents)
    for r in rows:
        s = source[r.doc_id]
        assert r.size == sizes[r.doc_id] and r.source_size == by[s] and abs(r.target - want[s]) < 1e-6 and r.taken in (0, r.size, 2 * r.size)
        taken[s], most[s] = taken.get(s, 0) + r.taken, max(most.get(s, 0), r.size)
    assert all(abs(taken[s] - want[s]) <= most[s] for s in by)


def test_license_scan(spark, documents):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    rows = {r.doc_id: r for r in QUERIES["op6_license_scan"](spark, SF).collect()}
    for d, t, *_ in documents:
        w = PLAIN.findall(lower(t))
        at = sorted((i, x) for p, x in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        r = rows[d]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_suffix_dedup(spark, documents):
    got = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op7_suffix_dedup"](spark, SF).collect()], key=str)
    assert got == brute_suffix([(d, t) for d, t, *_ in documents])


def test_simhash(spark, documents):
    prints = [(d, brute_print(t)) for d, t, *_ in documents]
    rows = QUERIES["op9_simhash"](spark, SF).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {d: f"{p:016x}" for d, p in prints}
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=str) == brute_components(prints)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    theirs = sorted(str(tuple(r[i] for i in order)) for r in cur.fetchall())
    assert sorted(df.columns) == sorted(columns) and sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect()) == theirs


def brute_quality(t):
    n, chars, symbols, dup, rep = brute_measure(t)
    lines = len([x for x in (t or "").split("\n") if WORD.search(x)])
    upper, letters = len(re.findall("[A-Z]", t or "")), len(re.findall("[A-Za-z]", t or ""))
    return not (n < 50 or 100 * rep > 50 * n or 100 * symbols > 5 * chars or 100 * dup > 50 * lines or (letters >= 50 and 100 * upper > 45 * letters) or chars > 40 * n or (n > 0 and chars < 2 * n))


def test_pipeline(spark, documents, tmp_path):
    """Each stage on what the one before kept."""
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "source_mixing"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    stages = []
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SF).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        stages.append({r.doc_id: r for r in docs.collect()})
        assert i == 4 or docs.columns == list(corpus_pipeline.COLUMNS)
    first, second, third, fourth, last = stages
    assert set(first) == {d for d, t, *_ in documents if brute_quality(t)}
    assert set(second) == brute_near([(d, r.text) for d, r in first.items()])
    cut = {d: sha for d, *_, sha in brute_suffix([(d, r.text) for d, r in second.items()])}
    for d, r in third.items():
        raw = second[d].text.encode()
        if hashlib.sha256(r.text.encode()).hexdigest() != cut[d]:  # only where a run ended inside a character
            assert len(r.text.encode()) < len(raw) and not r.text.isascii()
        assert r.n_chars == len(r.text) and (r.lang, r.source) == (second[d].lang, second[d].source)
    assert set(second) - set(third) == {d for d in second if cut[d] == hashlib.sha256(b"").hexdigest()}
    bad = {d for d, *_, c in brute_contamination([(d, r.text) for d, r in third.items()], items) if c}
    assert set(fourth) == set(third) - bad
    by = {}
    for r in fourth.values():
        by[r.source] = by.get(r.source, 0) + len(WORD.findall(r.text))
    want = brute_targets(by)
    assert set(last) <= set(fourth) and all(r.copies in (1, 2) and r.taken == r.copies * r.size for r in last.values())
    for s in by:
        assert abs(sum(r.taken for r in last.values() if r.source == s) - want[s]) <= max(len(WORD.findall(r.text)) for r in fourth.values() if r.source == s)


def test_pipeline_run_and_empty_input(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).count() > 0
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert quality.POLICIES["v1"].rules[:2] == quality.BASE.rules

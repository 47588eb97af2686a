import hashlib
import zlib

from folioweave.llm import html, warc
from folioweave.llm.workspace import Workspace
from pyspark.sql import functions as F

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/x">menu</a></ul></nav><!-- <p>not this</p> --><div class="ad">buy</div>
<article><h1>Head &amp; line</h1><p><b>First&nbsp;one<br>here <p>Second <i>two</i>
 text</p><div class="cookie-notice">We use cookies</div><form><p>mail</p></form><p title="a hidden > thing">Third</p><ul><li>item a<li>item b</ul>
<div class="comments"><article class="comment"><p>reader says</p></article></div><footer>by</footer></article>
<aside>side</aside><footer>&copy; foot</footer></body></html>"""


def test_article_of_a_page(spark):
    want = "Head & line\nFirst one here\nSecond two text\nThird\nitem a\nitem b"
    pages = [(1, "http://h/1", PAGE), (2, None, None), (3, "x", ""), (4, "x", "plain text &lt;b&gt;"), (5, "x", "<p>open <b>bold"), (6, "x", "<main><p>in main</p></main><p>out</p>"), (1, "http://h/1", PAGE), (None, None, "<article>a<script>x</article>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(0)).withColumn("blocks", F.lit(0))
    rows = html.main_text(df).collect()
    got = sorted(((r.page_id, r.text, r.n_chars) for r in rows), key=str)
    texts = [(1, want), (2, ""), (3, ""), (4, "plain text <b>"), (5, "open bold"), (6, "in main"), (1, want), (None, "a")]
    assert got == sorted(((k, t, len(t)) for k, t in texts), key=str)
    assert html.main_text(df.limit(0)).count() == 0


def test_host_suffixes(spark):
    shared = "<div>subscribe to our weekly letter with all the news that we print here every day</div>"
    own = [f"<div>page {i} tells a story of its own about the number {i} and what came of {i * 7}</div>" for i in range(5)]
    pages = [(i, "http://one.org/" + str(i), shared + x + shared) for i, x in enumerate(own)] + [(9, "http://other.org/", shared + own[1])]
    rows = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i, x in enumerate(own):
        assert rows[i] == x[5:-6]
    assert rows[9] == shared[5:-6] + "\n" + own[1][5:-6]


def test_odd_markup_ends():
    for bad in ("<" * 500, "<p '" * 300, '<a "' * 300, "<!--" * 300, "</div>" * 300 + "x", "<div>" * 3000 + "deep", "<script>" * 50, "&#xD800; &bogus; &#0;", "<p\x00>a"):
        html.blocks(bad)
    assert html.blocks("<div><article>a</div>b</article>c")[0] == ["a"]
    assert html.blocks("<p>a</p><!-- open > b")[0] == ["a"] and html.blocks("<p>a</p> b < c")[0] == ["a", "b < c"]


def test_long_odd_markup_takes_linear_time():
    for bad in ('<a "' * 50_000, "</section>" * 50_000 + "<div>" * 50_000, "<div>" * 30_000 + "</x>" * 30_000, '<span class="ad">x' * 20_000, "<" * 100_000, "<!-- " * 50_000):
        html.blocks(bad)


def test_warc_round_trip(spark, tmp_path):
    long = "é" * 600
    pages = [(1, "http://a/\r\nX: y%", long), (2, None, long), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", long), (7, "u", long), (None, "n", long), (8, "u", "z" * 1000), (9, "u", "\r\n\r\nWARC/1.1\r\n" * 90), (None, "m", "q" * 2000), (None, "m", "q" * 2000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(0)).withColumn("key", F.lit(0)).repartition(3)
    work = Workspace(spark, "test")
    index = warc.write(df, work)
    rows = warc.read(index).collect()
    assert len(rows) == len(pages)
    by = {}
    for k, u, h in pages:
        raw = (h or "").encode()
        last = max((x for x, _, y in pages if x is not None and y == h), default=None) if len(raw) >= 1000 else None
        refers = last if last is not None and k != last else None
        by.setdefault((k, u, len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers, (h or "") if refers is None else None), []).append(1)
    got = {}
    for r in rows:
        got.setdefault((r.key, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.html), []).append(1)
    assert got == by
    some = warc.read(index.filter("key in (5, 8)")).collect()
    assert sorted(r.key for r in some) == [5, 8]
    for name in {r.archive for r in index.collect()}:  # archives are whole gzip files of records in a row
        raw, n = open(name.removeprefix("file://"), "rb").read(), 0
        while raw:
            member = zlib.decompressobj(31)
            assert member.decompress(raw).startswith(b"WARC/1.1\r\n")
            raw, n = member.unused_data, n + 1
        assert n == index.filter(F.col("archive") == name).count()
    assert warc.read(warc.write(df.limit(0), Workspace(spark, "test"))).count() == 0


def test_ranges(monkeypatch):
    monkeypatch.setattr(warc, "GAP_BYTES", 10)
    monkeypatch.setattr(warc, "RANGE_BYTES", 100)
    assert warc.ranges([(0, 20), (20, 30), (55, 10), (80, 40), (200, 500), (700, 1)]) == [(0, 65, 0, 3), (80, 120, 3, 4), (200, 700, 4, 5), (700, 701, 5, 6)]

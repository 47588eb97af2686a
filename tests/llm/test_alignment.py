"""Token alignment against a scan of both token lists from tokenizers' own whole-text encodings."""

from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from folioweave.llm import alignment
from folioweave.llm.queries import QUERIES
from folioweave.llm.workspace import Workspace

A, B = f"{alignment.TOKENIZERS}/{alignment.A}", f"{alignment.TOKENIZERS}/{alignment.B}"
ODD = [
    "one", " two  three", "a\n  b \n\n c", "trailing  ", "\t", " ", "", None, "x <|endoftext|> <s></s> y", "it's we'll 12345 don't", "ümlaut 東京 \U0001f600 é", "▁ low ▁line", "\x00nul", "a  b  c", "\r\n x",
    "w" * 300 + " " + "ab1," * 200, "The same. The same. The same.", "The same. The same. The same.",
]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(text, both):
    a, b = both
    chars = alignment._byte_of_char()
    left = [(i, bytes(chars[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids] if text else []
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)] if text else []
    raw = (" " + (text or "")).encode()
    return (left, right) if text and all(b"".join(x for _, x in side) == raw for side in (left, right)) else ([], [])


def brute(docs, both):
    seen, counts, best = [], Counter(), Counter()
    for text in docs:
        left, right = tokens(text, both)
        spans = []
        for side in (left, right):
            at, own = 0, []
            for i, x in side:
                own.append((i, at, at + len(x)))
                at += len(x)
            spans.append(own)
        links, j = [], 0
        for i, begin, end in spans[0]:
            while j and spans[1][j][1] > begin:
                j -= 1
            while j < len(spans[1]) and spans[1][j][2] <= begin:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < end:
                links.append((i, spans[1][k][0]))
                k += 1
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups = [[",".join(str(i) for i, _, e in side if b < e <= c) for side in spans] for b, c in zip([0, *cuts], cuts)]
        counts.update(links)
        seen.append((len(left), len(right), len(groups), links, ";".join("|".join(g) for g in groups)))
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    return [(a, b, g, len(l), sum(counts[x] == best[x[1]] for x in l), sum(counts[x] for x in l), t) for a, b, g, l, t in seen]


def rows(df, **more):
    found = alignment.align(df, **more).collect()
    return sorted((r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups)) for r in found)


@pytest.mark.parametrize("hot", [alignment.HOT, 3])
def test_odd_texts(spark, both, hot):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string").selectExpr("doc_id", "text", "1 AS batch", "'x' AS words").repartition(2)
    assert rows(df, hot=hot) == list(enumerate(brute(ODD, both)))


def test_nulls_repeats_and_no_rows(spark, both):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted(r.n_a for r in alignment.align(df).collect()) == [0, 2, 2]
    assert alignment.align(df.limit(0)).count() == 0


def test_whole_table(spark, both):
    import hashlib

    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = {k: (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "") for (k, _), w in zip(docs, brute([t for _, t in docs], both), strict=True)}
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op11_token_alignment"](spark, "/root/testdata/sf0.001").collect()} == want


def test_every_character_splits_alike(both):
    """The tokens do not depend on which library splits the text, nor on words being taken apart."""
    pair = alignment.pair(A, B)
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 4000):
        text = " ".join(f"a{chr(c)}b{chr(c)}{chr(c)} {chr(c)}" for c in points[i : i + 4000])
        ids = pair._encoded(" " + text)
        want = both[0].encode(" " + text, add_special_tokens=False).ids
        assert ids is None or list(ids[0]) == want


def test_words_rows_are_gone_before_the_last_step(spark, monkeypatch):
    """Words meet their sums in rounds, and only the texts' numbers are still on disk when the sums are shuffled to the batches."""
    from pathlib import Path

    spaces, last = [], alignment._texts
    monkeypatch.setattr(alignment, "Workspace", lambda *a: spaces.append(w := Workspace(*a)) or w)
    seen = []
    monkeypatch.setattr(alignment, "_texts", lambda df: seen.extend(sorted(p.name for p in Path(spaces[0].root.removeprefix("file://")).iterdir())) or last(df))
    df = spark.createDataFrame([(1, "one two one"), (2, "two three"), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_a > 0) for r in alignment.align(df).collect()) == [(1, True), (2, True), (3, False)]
    assert seen == ["docs", "each"]
    assert [r.docs is None for r in spark.read.parquet(spaces[0].path("docs")).select("docs").collect()].count(True) == 0

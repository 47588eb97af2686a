"""Collocations against plain counting; the registered query has SQL besides."""

import random
import re
from collections import Counter

from folioweave.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def named(lang):
    return "und" if lang is None else lang


def brute(docs, least, top, longest=4):
    f, n = Counter(), Counter()
    for lang, text in docs:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[named(lang)] += len(w)
            for k in range(1, longest + 1):
                f.update((named(lang), tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    many = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    out = []
    for (lang, p), a in many.items():
        inside = any(l == lang and len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (l, q), b in many.items())
        if not inside:
            score, _, l, r = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.append((lang, -score, -a, " ".join(p).encode(), l, r))
    ranked = []
    for lang in sorted({x[0] for x in out}):
        for rank, (_, s, a, p, l, r) in enumerate(sorted(x for x in out if x[0] == lang)[:top], 1):
            ranked.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return ranked


def rows(df, **more):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocations.collocations(df, **more).collect())


def test_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 500)
    rnd = random.Random(4)
    words = ["New", "york", "é", "the", "Of", "a.b", "x y", "don't", "É", "city"]
    phrases = ["new York city hall", "of the", "the city of", "x y z"]
    docs = [(rnd.choice(["en", "fr", "und", None, ""]), "".join(rnd.choice([*words, *phrases]) + rnd.choice([" ", "  ", "\t", ". ", "\n", "! ", " ", " "]) for _ in range(rnd.randint(0, 60)))) for _ in range(120)] + [("en", None), ("en", ""), ("de", "..."), ("en", "...")]
    df = spark.createDataFrame(docs, "lang string, text string").selectExpr("lang", "text", "1 AS phrase", "2 AS n", "3 AS f").repartition(3)
    for least, top in ((5, 2000), (3, 4), (10**6, 5)):
        assert rows(df, least=least, top=top) == sorted(brute(docs, least, top))


def test_long_text_and_no_rows(spark):
    docs = [("en", "a b c. " * 400_000)]
    df = spark.createDataFrame(docs, "lang string, text string")
    assert rows(df) == [("en", 1, "a b c", 400_000, 400_000, 400_000, 1_200_000, 1_000_000)]
    assert rows(df.limit(0)) == []

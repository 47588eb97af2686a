import hashlib
import random

import numpy as np

from folioweave.llm import suffix_dedup as sd


def brute(docs, length=50):
    """Per row (doc, n_bytes, n_removed, n_spans, sha) by looking up every string."""
    least = {}
    for d, t in docs:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if d is not None:
                least[s] = min(least.get(s, d), d)
    out = []
    for d, t in docs:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 2, bool)
        for i in range(len(raw) - length + 1):
            if d is not None and least[raw[i : i + length]] < d:
                gone[i + 1 : i + 1 + length] = True
        starts = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(b for b, g in zip(raw, gone[1:], strict=False) if not g)
        out.append((d, len(raw), len(raw) - len(kept), starts, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def ran(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    rows = sd.deduplicate(df).collect()
    return sorted([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in rows], key=str)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("aeinrtßé") for _ in range(rnd.randint(1, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(rnd.randint(4, 60)) for _ in range(6)]
    docs = []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.2 and docs:
            t = rnd.choice(docs)[1]
        elif kind < 0.5 and docs:
            w = (rnd.choice(docs)[1] or "").split(" ")
            for _ in range(rnd.randint(1, 4)):
                w[rnd.randrange(len(w))] = word()
            t = " ".join(w)
        elif kind < 0.8:
            t = prose(rnd.randint(0, 80)) + rnd.choice(passages) + prose(rnd.randint(0, 80)) + rnd.choice(passages)
        elif kind < 0.9:
            t = rnd.choice(["ab", "a", "xyzw "]) * rnd.randint(10, 200) + prose(5)
        else:
            t = prose(rnd.randint(1, 200))
        docs.append((i, t))
    rnd.shuffle(docs)
    return docs


def test_matches_brute_force(spark):
    for seed in range(3):
        docs = corpus(seed)
        assert ran(spark, docs) == brute(docs)


def test_odd_rows(spark):
    t = "the quick brown fox jumps over the lazy dog and then some more words follow it here"
    docs = [(1, t), (2, None), (3, ""), (4, t), (4, t), (5, t[:49]), (6, t[3:53]), (None, t)]
    assert ran(spark, docs) == brute(docs)


def test_empty_table_and_extra_columns(spark):
    assert ran(spark, []) == []
    df = spark.createDataFrame([(1, "x" * 60, 1, "k"), (2, "x" * 60, 2, "k")], "doc_id long, text string, doc int, _key string")
    assert {r.doc_id: r.n_removed for r in sd.deduplicate(df).collect()} == {1: 0, 2: 60}


def test_texts_under_one_key(spark, monkeypatch):
    a, b = "a fine day it was " * 9, "b another day it was " * 9
    docs = [(1, a), (1, b), (2, a), (2, a + " zz"), (3, b), (None, a), (4, None), (4, ""), (2, a)]
    assert ran(spark, docs) == brute(docs)
    assert [r[2] for r in ran(spark, docs) if r[0] == 2] == [len(a)] * 3
    for seed, size in ((11, None), (12, 200)):  # texts share keys, some a third of all
        if size:
            monkeypatch.setattr(sd, "GROUP", size)
        docs = [(-5 if i % 3 == 0 else i // 4, t) for i, t in corpus(seed, 50)]
        assert ran(spark, docs) == brute(docs)
    kept = sd.rewrite(spark.createDataFrame([(1, a, 1), (1, b, 2), (2, b, 3), (2, "x" + a, 4)], "doc_id long, text string, n int"), carry=("n",)).collect()
    assert {r.n: r.kept_text for r in kept} == {1: a, 2: b, 3: "", 4: "x"}


def test_slices_do_not_matter(monkeypatch):
    raw = np.frombuffer(random.Random(1).randbytes(5000), np.uint8) % 4
    whole, marks = sd.anchors(raw), sd.phrases(raw)
    monkeypatch.setattr(sd, "SLICE", 97)
    cut = sd.anchors(raw)
    assert whole[0].tolist() == cut[0].tolist() and whole[1].tolist() == cut[1].tolist()
    assert marks.tolist() == sd.phrases(raw).tolist()


def test_small_groups(spark, monkeypatch):
    docs = corpus(7, 40)
    monkeypatch.setattr(sd, "GROUP", 200)
    assert ran(spark, docs) == brute(docs)


def test_rewrite_keeps_whole_characters(spark):
    a = "é" * 40 + "abc" + "ü" * 40
    rows = sd.rewrite(spark.createDataFrame([(1, a), (2, "x" + a[5:] + "y"), (3, None)], "doc_id long, text string")).collect()
    got = {r.doc_id: r.kept_text for r in rows}
    assert got == {1: a, 2: "xy", 3: None}

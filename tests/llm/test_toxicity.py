"""Toxicity: held-out accuracy, folds, and what is defined for odd rows."""

import random
import zlib

from folioweave.llm import toxicity
from folioweave.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op12_toxicity"](spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for d, r in rows.items())
    labels = [(rows[x.doc_id], x.toxic) for x in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    held = [(r.predicted, t) for r, t in labels if r.held_out]
    hit = sum(p and t for p, t in held)
    assert hit >= 0.75 * sum(t for _, t in held) and hit >= 0.9 * sum(p for p, _ in held)


def made(n, seed):
    rnd = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        bad = rnd.random() < 0.3
        words = [f"w{rnd.randrange(300)}" for _ in range(60)]
        for _ in range(4 if bad else 0):
            words[rnd.randrange(60)] = rnd.choice(["Grobian", "you grobianish", "GROBIAN!", "gr0bian"])
        texts.append((i, " ".join(words), "en"))
        labels.append((i, int(bad)))
    return texts, labels


def test_labels_of_held_out_rows_do_not_count(spark):
    texts, labels = made(400, 1)
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    lie = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, lie))
    assert a == b
    assert sum((a[i] >= 0.7) == bool(t) for i, t in labels) > 380


def test_features():
    tokens = toxicity._Tokens({"=grobian": 5.0, "grob": 2.0})
    row = lambda t: dict(zip(toxicity.FEATURES, toxicity.features(t, tokens), strict=True))
    assert row(None) == row("") == row(" \n") and not any(row("").values())
    assert row("you Grobian, x")["near_you"] > 0 and row("x Grobian x")["near_you"] == 0
    assert row("GROBIAN x")["lexicon_in_capitals"] > 0 and row("gr0bian x")["lexicon_obfuscated"] > 0 and row("gr0bian x")["strong"] == row("grobian x")["strong"]
    assert row("grobful x")["medium"] > 0 and row("grobful x")["strong"] == 0 and row("what?! no")["exclamations"] == 1


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, None), (1, "a b"), (2, ""), (2, "")], "doc_id long, text string").selectExpr("doc_id", "text", "0.5 AS score", "true AS held_out", "1 AS features")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, none).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.0} and not [r for r in got if r.doc_id is None][0].held_out
    odd = spark.createDataFrame([(1, None), (None, 1), (3, 1), (3, 1)], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, odd).count() == 5 and toxicity.toxicity(docs.limit(0), odd).count() == 0

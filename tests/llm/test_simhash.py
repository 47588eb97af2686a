import random
import re

import numpy as np
import xxhash

from folioweave.llm import simhash
from folioweave.llm.components import components
from folioweave.llm.workspace import Workspace


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    parts = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    """Smallest key reachable, from (key, fingerprint) rows."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(prints):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, least.get(find(i))) for i, (k, _) in enumerate(prints)), key=str)


def ran(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return simhash.near_duplicates(df).collect()


def test_fingerprints():
    for t in (None, "", "  \n", "one", "One two\tthree", "a b c d", "É È a B C d É", "x y z w " * 50, " ".join(map(str, range(1000)))):
        assert simhash.fingerprint(t) == brute_print(t)


def test_masks_and_mix():
    assert len(simhash.masks(2)) == 2081 and len(set(simhash.masks(2).tolist())) == 2081
    x = np.random.default_rng(1).integers(0, 1 << 63, 1000, np.uint64)
    assert (simhash._unmix(simhash.mix(x)) == x).all()


def test_texts_match_brute_force(spark):
    rnd = random.Random(2)
    docs = []
    for i in range(120):
        if docs and rnd.random() < 0.5:
            w = (rnd.choice(docs)[1] or "x").split(" ")
            for _ in range(rnd.randint(0, 2)):
                w[rnd.randrange(len(w))] = str(rnd.random())
            t = " ".join(w)
        else:
            t = " ".join(rnd.choice("abcdefghij") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 300)))
        docs.append((i, t))
    docs += [(200, None), (201, ""), (202, " \n"), (5, docs[5][1]), (None, docs[3][1]), (None, "only here")]
    rnd.shuffle(docs)
    rows = ran(spark, docs)
    signed = [(k, brute_print(t)) for k, t in docs]
    assert sorted(r.fp % (1 << 64) for r in rows) == sorted(p for _, p in signed)
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=str) == brute_components(signed)


def test_links_reach_every_close_pair(spark):
    rnd = random.Random(3)
    prints = {rnd.getrandbits(64) for _ in range(40)}
    for p in list(prints):  # chains and balls around each
        for _ in range(6):
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                p ^= 1 << b
            prints.add(p)
    rows = [(int(np.uint64(p).view(np.int64)),) for p in prints]
    work = Workspace(spark, "test")
    links = simhash.links(spark.createDataFrame(rows, "fp long"), work, group_words=5000)
    roots = {r.node: r.root for r in components(links, work).collect()}
    got = {}
    for i, (p,) in enumerate(rows):
        got.setdefault(roots.get(p, p), set()).add(i)
    want = {}
    for k, c in brute_components([(i, p % (1 << 64)) for i, (p,) in enumerate(rows)]):
        want.setdefault(c, set()).add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(300, 300), (9, 8), (8, 9)]
    rows = components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "test")).collect()
    want = {i: 100 for i in range(100, 141)} | {i: 7 for i in range(200, 260)} | {7: 7, 8: 8, 9: 8}
    assert {r.node: r.root for r in rows} == want and len(rows) == len(want)
    assert components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "test")).count() == 0


def test_empty_table_extra_columns_and_keep(spark):
    assert ran(spark, []) == []
    df = spark.createDataFrame([(1, "a b c d e", "z", 1), (2, "a b c d e", "y", 2), (3, "other words in this one", "x", 3)], "doc_id long, text string, fp string, component_id int")
    assert sorted(r.component_id for r in simhash.near_duplicates(df).collect()) == [1, 1, 3]
    kept = simhash.keep(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]

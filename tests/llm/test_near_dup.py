import random

import numpy as np
from pyspark.sql import functions as F

from waymeter.llm import near_dup
from waymeter.llm.graph import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(pairs, ids):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    pairs = []
    for x, (i, a) in enumerate(sets):
        for j, b in sets[x + 1 :]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
                pairs.append((i, j))
    return groups(pairs, {i for i, _ in rows if i is not None})


def check(df):
    rows = [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]
    want = brute(rows)
    got = near_dup.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.n_shingles) for r in got) == sorted((str(i), len(shingles(t))) for i, t in rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is None or r.doc_id == r.component_id)


def test_documents(documents):
    check(documents)


def test_odd(odd_docs):
    check(odd_docs)


def test_empty(no_docs):
    assert near_dup.near_duplicates(no_docs).collect() == []


def test_chains_and_large_groups(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(160):  # a drifting chain and a cloud around its start
        if i % 2:
            base[rng.randrange(120)] = f"n{i}"
            rows.append((i, " ".join(base)))
        else:
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(120)] = f"m{rng.randrange(10**6)}"
            rows.append((i, " ".join(w)))
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_large_buckets_block_by_block(spark, documents, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 2)
    check(documents)


def test_texts_of_one_id(spark):
    """Rows of one id with other texts: links of each of them count."""
    base = [f"a{i} b{i} c{i} d{i}" for i in range(4)]
    texts = [" ".join(f"{b} {k}" for k in range(40)) for b in base]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[1] + " more words"), (3, texts[0] + " other words"), (4, texts[2]), (5, texts[2] + " x"), (5, texts[3]), (6, texts[3] + " y z")]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_sketch_fills_and_agrees():
    rng = np.random.default_rng(1)
    for n in (1, 2, 9, 400, 5000):
        s = rng.integers(0, 2**63, n).astype(np.uint64)
        a = near_dup.sketch(np.unique(s))
        assert (a != ~np.uint64(0)).all() and len(a) == near_dup.T
    common, other = (rng.integers(0, 2**63, 3000).astype(np.uint64) for _ in range(2))
    agree = (near_dup.sketch(np.unique(common)) == near_dup.sketch(np.unique(np.concatenate([common, other[:1000]])))).mean()
    assert 0.6 < agree < 0.9


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 60)] + [(100, 5), (5, 10), (7, 7), (None, 3), (200, 201), (201, 202)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 5 for i in range(10, 61)}, 100: 5, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_cross_join(documents):
    plan = near_dup.near_duplicates(documents.where(F.lit(True)))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan

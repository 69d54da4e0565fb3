"""Proximity matches against brute force: items with substituted, dropped and added words."""

import math
import random
import re

from waymeter.llm import decontaminate, queries

SPELT = re.compile(r"[a-z0-9]+")


def brute(text, item, slop=3, share=0.8):
    """Whether some alignment has enough of the item's words within slop of their place."""
    w, it = SPELT.findall((text or "").lower()), SPELT.findall((item or "").lower())
    if not it:
        return False
    at = {}
    for p, x in enumerate(w):
        at.setdefault(x, []).append(p)
    for diag in range(-len(it) - slop, len(w) + slop + 1):
        if sum(any(abs(p - diag - i) <= slop for p in at.get(x, ())) for i, x in enumerate(it)) >= math.ceil(share * len(it)):
            return True
    return False


def test_proximity_of_items_with_substituted_words(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rnd.choice(words) for _ in range(n))) for k, n in enumerate([1, 3, 5, 14, 20, 30, 45])]
    items += [(7, " ".join(f"new{i}" if i % 6 == 0 else rnd.choice(words) for i in range(30))), (8, None)]
    docs = []
    for k, t in items:
        for changed in (0.0, 0.1, 0.15, 0.3):
            said = [x if rnd.random() >= changed else rnd.choice(words) for x in (t or "").split() if not x.startswith("new")]
            if changed and len(said) > 8:
                said.insert(rnd.randrange(len(said)), "extra")
            docs.append((len(docs) if len(docs) % 9 else None, " ".join([rnd.choice(words) for _ in range(rnd.randrange(9))] + said + ["tail"])))
    docs += [(1, None), (2, ""), (3, docs[9][1])]
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), near=True).collect()
    want = sorted((str(i), sorted(str(k) for k, t in items if brute(d, t))) for i, d in docs)
    assert sorted((str(r.doc_id), r.near_items) for r in got) == want
    assert any(set(r.near_items) - set(r["items"]) for r in got) and all(set(r["items"]) or not r.contaminated for r in got)
    # an item with an unseen word in each window has no exact phrase, but is near
    assert any("7" in r.near_items and "7" not in r["items"] for r in got)


def test_proximity_query_keeps_the_exact_columns(spark, sf):
    exact, both = (queries.QUERIES[n](spark, sf) for n in ("op5_benchmark_decontamination", "op5_proximity_decontamination"))
    rows = both.collect()
    assert sorted(map(str, exact.collect())) == sorted(map(str, both.select(*exact.columns).collect()))
    assert any(r.n_near_items for r in rows) and all(r.n_near_items >= 0 for r in rows)

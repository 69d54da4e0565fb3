import random

from pyspark.sql import functions as F

from waymeter.llm import substring_dedup


def brute(rows, v):
    """rows: (id, text); v: text hash by text. Rows equal in id and text are one."""
    seen, out = set(), {}
    for i, _, t in sorted({(2**63 if i is None else i, v[t], t or "") for i, t in rows}):
        w = t.encode().split()
        covered = [False] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s : s + 20])
            if k in seen:
                covered[s : s + 20] = [True] * 20
            seen.add(k)
        out[(i, t)] = (len(w), sum(covered), b" ".join(x for x, c in zip(w, covered) if not c).decode())
    return out


def check(df):
    rows = [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]
    v = {r[0]: r[1] for r in df.select("text", F.xxhash64("text")).collect()}
    want = brute(rows, v)
    got = substring_dedup.remove_repeats(df, carry=["doc_id", "text"]).select("row.*", "n_words", "n_removed", "kept").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept) == want[(2**63 if r.doc_id is None else r.doc_id, r.text or "")]


def test_documents(documents):
    check(documents)


def test_odd(odd_docs):
    check(odd_docs)


def test_empty(no_docs):
    assert substring_dedup.remove_repeats(no_docs).collect() == []


def test_every_alignment(spark):
    rng = random.Random(5)
    word = lambda: f"u{rng.randrange(10**9)}"
    passage = [word() for _ in range(20)]
    rows = [(i, " ".join([word() for _ in range(i % 29)] + passage + [word() for _ in range(i % 7)])) for i in range(60)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_small_vocabulary(spark):
    rng = random.Random(6)
    check(spark.createDataFrame([(i, " ".join(rng.choice("ab") for _ in range(200))) for i in range(30)], "doc_id long, text string"))


def test_hot_lines_over_many_chunks(spark):
    """A line in every document, and passages in some, over several chunks of one task: what the task remembers changes nothing."""
    rng = random.Random(7)
    word = lambda: f"v{rng.randrange(10**7)}"
    hot, some = " ".join(word() for _ in range(25)), [" ".join(word() for _ in range(30)) for _ in range(5)]
    text = lambda i: " ".join([*(word() for _ in range(900)), hot, *(word() for _ in range(i % 40)), some[i % 5] if i % 3 else "", *(word() for _ in range(300)), hot])
    ids = list(range(250))
    rng.shuffle(ids)
    df = spark.createDataFrame([(i, text(i)) for i in ids], "doc_id long, text string").coalesce(1)
    assert sum(len(r.text) for r in df.collect()) > 2 * substring_dedup.CHUNK
    check(df)
    marks = df.select(F.col("doc_id").alias("uid"), F.col("text").alias("t")).select("uid", "t").mapInArrow(substring_dedup._anchors, "h long, id long, p int")
    assert marks.groupBy("h").count().agg(F.max("count")).first()[0] <= 4


def test_cover():
    d = substring_dedup
    assert all(any((i + s) % d.PERIOD in d.COVER and (j + s) % d.PERIOD in d.COVER for s in range(d.PERIOD)) for i in range(d.PERIOD) for j in range(d.PERIOD))
    assert d.PERIOD - 1 + d.ANCHOR == d.WINDOW

"""Vector codes, hard negatives and language-model scores against plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymeter.llm import codes, kneser_ney, negatives, queries

VECTORS = "vec_id long, embedding array<float>, label int, row long, part int, pos int, tree long"


def odd_vectors(n, dims, seed=3):
    """Clusters, one vector that a third of the rows share, ties, repeated ids, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.4, (4, dims))
    rows = []
    for i in range(n):
        v = centres[0] if i % 3 == 0 else np.round(centres[i % 4] + rng.normal(0, 0.1, dims), 2)
        rows.append((i, [float(x) for x in v.astype(np.float32)], None if i % 37 == 5 else int(i % 5), i, 1, 2, 3))
    rows += [(7, rows[8][1], 3, 0, 0, 0, 0), (7, rows[7][1], 2, 0, 0, 0, 0), (None, rows[9][1], 1, 0, 0, 0, 0), (n + 1, None, 1, 0, 0, 0, 0), (n + 2, [], 1, 0, 0, 0, 0)]
    rows += [(n + 3, [float("nan")] * dims, 1, 0, 0, 0, 0), (n + 4, [1.0] * (dims - 1) + [None], 1, 0, 0, 0, 0), (n + 5, [float("inf")] + [0.0] * (dims - 1), 1, 0, 0, 0, 0), (n + 6, [1.0] * (2 * dims), 1, 0, 0, 0, 0)]
    return rows


def floors(v):
    return [math.floor(256 * x) for x in v]


def usable(v, dims):
    return v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)


def lloyd(rows, dims, parts, entries, rounds):
    """rows: (vec_id, vector); codes and errors in that order, and the books."""
    w = dims // parts
    kept = [(i, floors(v)) for i, v in rows if usable(v, dims)]
    least = {}
    for i, q in kept:
        least[i] = min(q, least.get(i, q))
    first = sorted(least, key=lambda i: (i is None, i or 0))[:entries]
    books = [[least[i][p * w : p * w + w] for i in first] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for _, q in kept:
                x = q[p * w : p * w + w]
                members[near(p, x)[1]].append(x)
            books[p] = [[sum(c) // len(members[e]) for c in zip(*members[e], strict=True)] if members[e] else b for e, b in enumerate(books[p])]
    out = []
    for i, q in kept:
        found = [near(p, q[p * w : p * w + w]) for p in range(parts)]
        out.append((i, [e for _, e in found], sum(d for d, _ in found)))
    return out, books


def test_codes_odd(spark):
    rows = odd_vectors(90, 8)
    df = spark.createDataFrame(rows, VECTORS).repartition(5)
    got = codes.compress(df, parts=4, entries=12, rounds=3)
    want, books = lloyd([(r[0], r[1]) for r in rows], 8, 4, 12, 3)
    assert got.books.tolist() == books
    assert sorted(map(repr, [(r.vec_id, list(r.code), r.error) for r in got.rows.collect()])) == sorted(map(repr, want))
    sums = Counter()
    errors = codes.with_label_error(got.rows).collect()
    for r in errors:
        sums[r.label] += r.error
    assert len(errors) == len(want) and all(r.label_error == sums[r.label] for r in errors) and None in sums


def test_codes_of_few_and_none(spark):
    few = codes.compress(spark.createDataFrame(odd_vectors(12, 4), VECTORS), parts=2, entries=64)
    want, books = lloyd([(r[0], r[1]) for r in odd_vectors(12, 4)], 4, 2, 64, 2)
    assert few.books.tolist() == books and sorted(map(repr, [(r.vec_id, list(r.code), r.error) for r in few.rows.collect()])) == sorted(map(repr, want))
    none = codes.compress(spark.createDataFrame([], VECTORS))
    assert none.rows.count() == 0 and codes.with_label_error(none.rows).count() == 0 and none.books.size == 0
    # components beyond the bound count as it
    big = codes.compress(spark.createDataFrame([(1, [3e38, -3e38], 0), (2, [1.0, 2.0], 0)], "vec_id long, embedding array<float>, label int"), parts=2)
    assert [r.error for r in big.rows.collect()] == [0, 0] and big.books.max() == codes.LIMIT


def test_only_members_that_change_entry_move(spark):
    """Of the first placement all, of later rounds only those with another entry go through an exchange."""
    members = spark.createDataFrame([(i, i, 0, [i], 0, i % 2) for i in range(10)], "row long, vec_id long, pos int, part array<int>, salt int, entry int")
    out = codes._nearest(members, np.array([[[0], [9]]])).collect()
    assert {(r.row, r.entry) for r in out} == {(i, int(i > 4)) for i in range(10)}
    assert all(r.moved == (r.entry != r.row % 2) for r in out)


def hard(rows, every, n_pos, k, lo, hi):
    """rows: {id: (label, integers)}."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for a, (label, v) in rows.items():
        if a % every:
            continue
        scored = sorted((-dot(v, x), i) for i, (lab, x) in rows.items() if i != a)
        for s, p in [(s, i) for s, i in scored if rows[i][0] == label][:n_pos]:
            fit = [(t, i) for t, i in scored if rows[i][0] != label and lo * -s <= 100 * -t <= hi * -s][:k]
            out += [(a, p, r, i, -s, -t) for r, (t, i) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("cells", [1 << 19, 64 * 8])
def test_hard_negatives_odd(spark, monkeypatch, cells):
    """Against brute force: in one tree, and in many of them with levels and waves."""
    monkeypatch.setattr(negatives, "TREE_CELLS", cells)
    monkeypatch.setattr(negatives, "WIDER", 3)
    monkeypatch.setattr(negatives, "WAVE", 2)
    monkeypatch.setattr(negatives, "SERVED", 2)
    rows = odd_vectors(700, 8)
    least = {}
    for i, v, label, *_ in rows:
        if i is not None and label is not None and usable(v, 8):
            x = (floors(v), label)
            least[i] = min(x, least.get(i, x))
    want = hard({i: (label, q) for i, (q, label) in least.items()}, 10, 4, 3, 50, 95)
    got = negatives.mine(negatives.prepared(spark.createDataFrame(rows, VECTORS).repartition(4)), 10, 4, 3)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 200


def test_hard_negatives_of_none(spark):
    one = [(0, [1.0, 2.0], 1, 0, 0, 0, 0)]
    for rows in ([], one, one + [(1, [1.0, 1.0], 2, 0, 0, 0, 0)]):
        assert negatives.mine(negatives.prepared(spark.createDataFrame(rows, VECTORS))).count() == 0


def test_negatives_plan_has_no_cross_join(spark, sf):
    plan = queries.op12_hard_negatives(spark, sf)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


class Brute:
    """Interpolated modified Kneser-Ney with dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.words = Counter()
        top = Counter()
        for t in texts:
            line = ["<s>"] * (order - 1) + t + ["</s>"]
            self.words.update(line[order - 1 :])
            top.update(tuple(line[i : i + order]) for i in range(len(line) - order + 1))
        self.counts = {order: top}
        for n in range(order - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g, c in self.counts[n + 1].items() if c > 0)
        self.off = {n: (0.0, *kneser_ney.discounts([sum(c == k for c in self.counts[n].values()) for k in (1, 2, 3, 4)])) for n in self.counts}
        self.after = {n: defaultdict(list) for n in self.counts}
        for n, grams in self.counts.items():
            for g, c in grams.items():
                self.after[n][g[:-1]].append(c)

    def p(self, gram):
        n = len(gram)
        if not n:
            return 1 / (len(self.words) + 1)
        below, follow = self.p(gram[1:]), self.after[n].get(gram[:-1])
        if not follow:
            return below
        c = self.counts[n].get(gram, 0)
        return (c - self.off[n][min(c, 3)] + sum(self.off[n][min(x, 3)] for x in follow) * below) / sum(follow)


SPACES = " \t\n\x0b\x0c\r"


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for s in SPACES:
        low = low.replace(s, " ")
    return [w for w in low.split(" ") if w]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_against_dictionaries(spark, odd_texts, order, monkeypatch):
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(kneser_ney, "CHUNK", 3000)
    rnd = random.Random(order)
    texts = [" ".join(rnd.choice("the a of cat dog sat on mat ran É off up by it".split()) + rnd.choice(["", "", "", "s", "x" + str(rnd.randrange(40))]) for _ in range(rnd.randrange(12))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(r[0], r[1]) for r in odd_texts] + [(9000, "never seen words of cat"), (9001, "the cat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    learnt = docs.where("doc_id is null or doc_id < 9000")
    model = kneser_ney.train(learnt, order)
    brute = Brute([tokens(t) for i, t in rows if i is None or i < 9000], order)
    assert model.tokens == sum(brute.words.values()) and model.types == len(brute.words)
    got = kneser_ney.score(docs, model, ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        line = ["<s>"] * (order - 1) + tokens(r.row.text) + ["</s>"]
        grams = [tuple(line[i : i + order]) for i in range(len(line) - order + 1)]
        assert r.n_tokens == len(grams) and r.n_known == sum(g[-1] in brute.words for g in grams)
        if len(grams) < 1000:
            assert r.score == pytest.approx(sum(math.log10(brute.p(g)) for g in grams), abs=1e-8)
            assert r.base_score == pytest.approx(sum(math.log10((brute.words[g[-1]] + 1) / (model.tokens + model.types + 1)) for g in grams), abs=1e-8)
    # after each context the words and one unknown word sum to 1
    for context in [("<s>",) * (order - 1), ("cat",) * (order - 1), ("unseen",) * (order - 1)]:
        assert sum(brute.p((*context, w)) for w in [*brute.words, "<unk>"]) == pytest.approx(1)


def test_language_model_of_nothing(spark, no_docs, odd_docs):
    model = kneser_ney.train(no_docs)
    assert model.tokens == 0 and kneser_ney.score(no_docs, model, ["doc_id"]).count() == 0
    got = kneser_ney.score(odd_docs, model, odd_docs.columns)
    assert got.select("row.*").columns == odd_docs.columns and all(r.n_known == 0 and math.isfinite(r.score) for r in got.collect())


def test_lm_query_learns_from_rows_not_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op13_lm_scores(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    brute = Brute([tokens(t) for i, t in texts.items() if not held(i)], 2)
    assert set(got) == set(texts) and all(r.held_out == held(i) and r.train_tokens == sum(brute.words.values()) for i, r in got.items())
    for i in sorted(texts)[::20]:
        line = ["<s>", *tokens(texts[i]), "</s>"]
        assert got[i].score == pytest.approx(sum(math.log10(brute.p(g)) for g in zip(line, line[1:], strict=False)), rel=1e-9)
    held_rows = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held_rows) > sum(r.base_score for r in held_rows)


def test_vector_codes_query(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    want, books = lloyd([(r.vec_id, r.embedding) for r in rows], 64, 16, 64, 2)
    got = queries.op11_vector_codes(spark, sf).collect()
    assert {(r.vec_id, r.code, r.error) for r in got} == {(i, "".join(f"{e:02x}" for e in c), d) for i, c, d in want}
    digest = hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()
    assert {r.codebooks_sha256 for r in got} == {digest}

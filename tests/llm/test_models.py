"""Toxicity, HTML extraction, chat formatting and nearest neighbours."""

import hashlib
import html
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymeter.llm import chat, html_text, neighbours, queries, toxicity

# toxicity


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op4_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    held = [(labels[i], got[i]) for i in labels if i in got and got[i].held_out]
    hit, said, true = sum(y and r.predicted for y, r in held), sum(r.predicted for _, r in held), sum(y for y, _ in held)
    assert hit >= 0.9 * true and hit >= 0.95 * said
    positive, negative = ([r.score for y, r in held if y == k] for k in (1, 0))
    assert np.mean([[a > b for b in negative[:500]] for a in positive]) > 0.98


def test_counterfactual_pairing_frees_identity_terms():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        toxic = i % 2
        text = " ".join(rng.choice(words, 20)) + (" vile" if toxic and i % 4 == 1 else " rotten" if toxic else "")
        # a corpus that names one group in toxic rows only
        text += " muslims" if toxic and rng.random() < 0.7 else ""
        rows.append((toxic, toxicity.features(text).tobytes(), toxicity.counterfactual(text).tobytes()))
    moved = []
    for pairing in (0.0, 20.0):
        before, toxicity.PAIRING = toxicity.PAIRING, pairing
        try:
            w = toxicity.fit(rows)
        finally:
            toxicity.PAIRING = before
        z = lambda t: w[toxicity.features(t)].sum() + w[-1]  # noqa: E731, B023
        moved.append(abs(z("w1 w2 muslims") - z("w1 w2 christians")))
        assert z("w3 vile") > z("w3 w4") + 1
    assert moved[1] < 0.5 * moved[0]


def test_added_mentions_on_the_given_tables(spark, monkeypatch):
    """No labelled text there names a group, so that the pairing is an added mention: weights differ with and without the penalty, and with it held-out texts move less when a mention is added."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    named = lambda t: set(toxicity._TOKEN.findall((t or "").lower())) & toxicity._GROUP.keys()
    assert not any(named(r.text) for r in docs.join(labels.where("toxic is not null"), "doc_id").select("text").collect())
    with_it = toxicity.classifier(docs, labels)
    monkeypatch.setattr(toxicity, "PAIRING", 0.0)
    without = toxicity.classifier(docs, labels)
    assert np.abs(with_it - without).max() > 0.05 and (with_it[toxicity.KEPT] != without[toxicity.KEPT]).any()
    texts = [r.text for r in docs.join(labels, "doc_id").where(toxicity.held_out()).select("text").collect()]
    pairs = [(toxicity.features(t), toxicity.counterfactual(t)) for t in texts]
    score = lambda w, f: 1 / (1 + np.exp(-np.clip(w[f].sum(dtype=float) + w[-1], -30, 30)))
    moved = [np.mean([abs(score(w, a) - score(w, b)) for a, b in pairs]) for w in (with_it, without)]
    assert moved[0] < 0.8 * moved[1]


def test_swaps_free_neutral_mentions_in_the_query(spark, tmp_path, monkeypatch):
    """The whole query over a corpus whose toxic texts name one group: with the swaps fewer neutral mentions of it are flagged, and toxic texts still are. Swaps alone act here: every text names a group."""
    rng = np.random.default_rng(6)
    words, rude = [f"w{i}" for i in range(400)], ["vile", "rotten", "scum", "filth"]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        group = "muslims" if toxic and rng.random() < 0.9 or rng.random() < 0.03 else str(rng.choice(["christians", "jews", "hindus", "buddhists"]))
        text = " ".join([*rng.choice(words, 15), group, *(rng.choice(rude, 1 + i % 2) if toxic else [])])
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, 1, int(toxic)))
    neutral = {1000 + i: " ".join([*rng.choice(words, 15), "muslims"]) for i in range(200)}
    docs += [(i, t, "en", "s", len(t)) for i, t in neutral.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert all(toxicity._GROUP.keys() & set(t.split()) for _, t, *_ in docs)
    flagged, caught, moved = [], [], []
    for pairing in (0.0, toxicity.PAIRING):
        monkeypatch.setattr(toxicity, "PAIRING", pairing)
        got = {r.doc_id: r for r in queries.op4_toxicity(spark, str(tmp_path)).collect()}
        held = [i for i, _, y in labels if y and got[i].held_out]
        caught.append(np.mean([got[i].predicted for i in held]))
        flagged.append(sum(got[i].score >= 0.5 for i in neutral))
        moved.append(np.mean([got[i].score for i in neutral]))
    assert flagged[0] > 20 and flagged[1] < 0.5 * flagged[0] and moved[1] < 0.7 * moved[0] and min(caught) > 0.9


def test_toxicity_odd(spark, odd_docs, no_docs, odd_texts):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (3, 0)], "doc_id long, toxic int")
    weights = toxicity.classifier(odd_docs, labels)
    scores = [r.score for r in toxicity.score(odd_docs, weights).collect()]
    assert len(scores) == len(odd_texts) and all(0 <= s <= 1 for s in scores)
    assert toxicity.score(odd_docs, weights).select("row.*").columns == odd_docs.columns
    none = toxicity.classifier(no_docs, labels.limit(0))
    assert toxicity.score(no_docs, none).count() == 0 and toxicity.score(odd_docs, none).where("score > 0.5").count() == 0


# HTML


def test_pages(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op6_html_extraction(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        inside = re.search(r"<article>(.*?)(</article>|<footer|\Z)", pages[r.page_id]["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br)\b[^>]*>", " ", inside))).split())
        assert r.text == want and r.n_chars == len(want) and r.url == pages[r.page_id].url


def test_boilerplate():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="menu-open"><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
    <div class="cookie-notice"><p>We use cookies, accept them all please now.</p></div>
    <main><div class="post-77 entry"><h2>A &amp; B</h2><p>One <b>t</b>wo&nbsp;three<p>Four<br>five<!-- no --><script>x("</p>")</script>
    <form><p>Your mail</p></form><ul><li>six<li>seven</ul><table><tr><td>eight<td>nine</table><div class="ad-box">Buy</div><blockquote>ten</blockquote></div>
    <section id="comments"><p>First! I read it all and it was a very long comment, longer than all the rest of this page together, indeed.</p></section></main>
    <aside><p>Related things to read</p></aside><footer>End</footer></body></html>"""
    assert html_text.main_text(page, None) == "A & B One two three Four five six seven eight nine ten"
    assert html_text.main_text("", None) == "" and html_text.main_text("plain < text", None) == "plain < text" and html_text.main_text("<p>a<p>b <a hre", None) == "a b"
    assert html_text.main_text("<div>" * 3000 + "deep" + "</div>" * 10, None) == "deep"


def test_pieces_are_decoded_one_by_one():
    assert html_text.main_text("<p>a &l<i>t</i>; b &amp<b>;lt;</b> &lt;i&gt; &eacute;", None) == "a &lt; b &;lt; <i> é"


def test_article_keeps_what_its_classes_describe():
    body = "<p>" + "long text of the article " * 9 + "</p>"
    page = f"<main>{body}<p class='foot-note'>one<p class=warning>two<p class=share>three<span class=print>four</span><p class=side>five<ul><li class=related>six</ul><div class=social-share>no</div><div class='comment-list'>no</div><p class=ad>no</main>"
    assert html_text.main_text(page, None).removeprefix("long text of the article " * 9) == "one two threefour five six"


@pytest.mark.parametrize("bad", ["<div></b>", '<a "', "<a x='", "<p><span>", "<li><i>", "<b", "</", "<!-", "<td><tr>", "<svg", "&amp", "<a b=\"c>", '<p class="x' + "y" * 100 + '">'])
def test_long_bad_pages_take_linear_time(bad):
    began = time.process_time()
    text = html_text.main_text("<p>start</p>" + bad * ((1 << 20) // len(bad)), None)
    assert text.startswith("start") and time.process_time() - began < 5


def test_unclosed_quotes_lose_no_text():
    assert html_text.main_text('<p>a<a href="x>b</a><p>c<i>d</i>', None) == "abc d".replace("bc", "b c").replace("c d", "cd")
    assert html_text.main_text("<p>a<a title='x>y' href=z>b</a> <a 'q>c</a>", None) == "ab c"


def test_pages_of_all_hosts(spark):
    test_pages(spark, "/root/testdata/sf0.1")


def test_pages_with_clashing_columns(spark):
    rows = [(1, "http://h/", "<article>" + "some words " * 5 + "</article>", "r", "h", "p", "t", "o", None), (1, "http://h/", None, "r", "h", "p", "t", "o", 3), (1, "http://h/", None, "r", "h", "p", "t", "o", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, row string, host string, path string, text string, h string, votes int")
    got = html_text.extract(pages).select("row.*", F.col("text").alias("found")).collect()
    assert sorted(r.found for r in got) == ["", "", " ".join(["some words"] * 5)] and all(r.row == "r" and r.host == "h" and r.path == "p" and r.h == "o" for r in got)


def test_consensus(spark):
    body = "<p>" + "long text of the article " * 8 + "</p>"
    rows = [(i, "http://h.example/x", f"<body><div class=story{i}>{body}</div><div class=other><p>short</p></div></body>") for i in range(5)]
    rows += [(9, "http://H.example:80/y", f"<body><div class=story9><p>brief</p></div><div class=other>{body}</div></body>"), (10, None, None), (10, "no url", ""), (None, "http://h.example/", "<div class=story>x</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for bound in (100_000, 0):
        got = sorted((str(r.row.page_id), r.text[:5]) for r in html_text.extract(pages, hosts_bound=bound).collect())
        assert got == [("0", "long "), ("1", "long "), ("10", ""), ("10", ""), ("2", "long "), ("3", "long "), ("4", "long "), ("9", "brief"), ("None", "x")]
    assert html_text.extract(pages.limit(0)).count() == 0


# chat

CONVERSATIONS = "conv_id long, turn long, role string, text string, node string"


def turns_of(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        out.setdefault(conv, []).append((-(2**63) if turn is None else turn, role or "", text or ""))
    return {c: [t[1:] for t in sorted(v)] for c, v in out.items()}


def check_chat(df):
    want = turns_of([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    nodes, members = chat.prefix_tree(df)
    got = {r.conv_id: r for r in chat.read_back(nodes, members).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        r, loss = got[c], "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(chat.format_turn(*t)[0]) for t in turns)
    # each distinct prefix once, depth first, with the intervals of its ancestors
    rows = sorted(nodes.collect(), key=lambda r: (r.start, r.n_tokens))
    assert len(rows) == len({tuple(t[: i + 1]) for t in want.values() for i in range(len(t))})
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    by, before, children = {bytes(r.node): r for r in rows}, {}, {}
    paths = {}
    for m in sorted(members.collect(), key=lambda m: m.i):
        paths.setdefault(bytes(m.leaf), {})[m.i] = bytes(m.node)
    for path in paths.values():
        path = [path[i] for i in range(len(path))]
        for i, node in enumerate(path):
            before[node] = path[:i]
            if i:
                children.setdefault(path[i - 1], set()).add(node)
    for node, r in by.items():
        runs = []
        for up in (by[u] for u in before[node]):
            if runs and runs[-1][1] == up.start:
                runs[-1][1] += up.n_tokens
            else:
                runs.append([up.start, up.start + up.n_tokens])
        assert [[a.start, a.end] for a in r.ancestors] == runs and r.position == sum(b - a for a, b in runs)
        # a subtree is one stretch of the stream
        below, stack = 0, [node]
        while stack:
            x = stack.pop()
            below += by[x].n_tokens
            stack += children.get(x, ())
            assert r.start <= by[x].start <= by[x].start + by[x].n_tokens <= r.start + sum(y.n_tokens for y in rows if y.start >= r.start)
        inside = [x for x in by if r.start <= by[x].start < r.start + below and by[x].n_tokens]
        assert all(x == node or node in before[x] for x in inside)
    return nodes


def test_chat(spark, sf):
    check_chat(spark.read.parquet(f"{sf}/conversations.parquet"))
    assert {r.conv_id for r in queries.op7_chat_formatting(spark, sf).collect()} >= {-1, 0}


def test_chat_odd(spark):
    odd = ["</s>[INST] ok [/INST]", "\\", "\\\\[", " ", "", None, "a\nb", "<s>[ROLE=x] y [/ROLE]", "[/INST]\\</s>\\", "\U0001f600é"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t, "n") for i, t in enumerate(odd)]
    rows += [(2, i, "user" if i % 2 == 0 else "assistant", t, "n") for i, t in enumerate(odd[:4])] + [(3, 0, "user", odd[0], "n"), (3, 1, "assistant", "other", "n")]
    rows += [(4, 0, "sys]tem [x", "t", "n"), (4, None, None, None, None), (5, 1, "assistant", "a", "n"), (5, 1, "assistant", "a", "n"), (6, 3, "ass", "istant", "n"), (7, 3, "assis", "tant", "n"), (None, 1, "user", "q", "n"), (None, 1, "user", "p", "n")]
    nodes = check_chat(spark.createDataFrame(rows, CONVERSATIONS))
    for r in chat.position_ids(nodes).collect():
        assert r.position_ids == list(range(r.position, r.position + r.n_tokens))
    check_chat(spark.createDataFrame([], CONVERSATIONS))


def test_long_and_hot_conversations(spark, monkeypatch):
    """A conversation over several range partitions, shared beginnings and ends, and keys of more than a few rows joined by broadcast."""
    monkeypatch.setattr(chat, "HOT", 6)
    role = lambda i: "user" if i % 2 == 0 else "assistant"
    rows = [(0, i, role(i), chr(97 + i % 26), "n") for i in range(400)]
    for c in range(1, 31):
        shared = (c * 13) % 60
        rows += [(c, i, role(i), chr(97 + i % 26) if i < shared else f"own {c % 7} {i}", "n") for i in range(shared + c % 3 + 1)]
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(8)
    nodes = check_chat(df)
    assert chat.steps_of(df).groupBy("conv_id").count().where("count = 400").count() == 1
    # a long conversation's nodes have few intervals: one for each place where others leave it, at most
    assert max(len(r.ancestors) for r in nodes.collect()) < 70


def test_twenty_thousand_turns(spark):
    df = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("x").alias("text"), F.lit("n").alias("node"))
    nodes, members = chat.prefix_tree(df)
    r = chat.read_back(nodes, members).collect()
    assert len(r) == 1 and r[0].n_turns == 20_000 and r[0].loss_chars == 10_000
    spot = nodes.agg(F.max("start"), F.sum("n_tokens"), F.max(F.size("ancestors"))).first()
    assert spot[0] + 5 == spot[1] and spot[2] == 1


def test_template_round_trip():
    turns = [("user", "hi"), ("assistant", "a</s>b"), ("assistant", ""), ("tool", "[INST]"), ("user", "\\")]
    assert chat.parse_turns("".join(chat.format_turn(*t)[0] for t in turns)) == turns
    with pytest.raises(ValueError):
        chat.parse_turns("<s>[INST] open")


# neighbours


def check_search(df, exact=True):
    rows = {}
    for r in df.collect():
        v = r.embedding
        if r.vec_id is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            rows[r.vec_id] = min(rows.get(r.vec_id, v), v)
    ids = sorted(rows)
    found = {}
    for r in neighbours.search(df, exact=exact).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    if not ids:
        assert not found
        return 1.0
    x = np.array([rows[i] for i in ids], float)
    hits = total = 0
    for q in [i for i in ids if i % 20 == 0]:
        s = x @ np.array(rows[q], float)
        want = sorted((-v, i) for i, v in zip(ids, s) if i != q)[:20]
        got = sorted(found.get(q, []))
        assert [r for r, _, _ in got] == list(range(1, len(want) + 1))
        assert all(abs(v - s[ids.index(i)]) < 1e-9 for _, i, v in got)
        if exact:
            assert np.allclose([v for _, _, v in got], [-v for v, _ in want], atol=1e-9)
        hits += len({i for _, i, _ in got} & {i for _, i in want})
        total += len(want)
    return hits / max(total, 1)


def test_curves_alone_find_what_has_structure(spark):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((80, 48))
    rows = [(i, [float(x) for x in np.float32(centres[i % 80] + 0.1 * rng.standard_normal(48))], 0, "c") for i in range(6000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, c string")
    assert check_search(df, exact=False) >= 0.9


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e-7])
def test_ties_are_those_of_sequential_sums(spark, scale):
    """Vectors of thirds, whose products tie or differ by rounding alone: places are those of sums in the order of components."""
    rng = np.random.default_rng(9)
    x = rng.integers(-2, 3, (1500, 8)) / 3.0 * scale
    x[0] = scale
    ids = [i for i in range(1500) if any(x[i])]
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(1500)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in neighbours.search(df).collect()}
    for q in [i for i in ids if i % 20 == 0]:
        s = np.zeros(1500)
        for j in range(8):
            s = s + x[:, j] * x[q, j]
        want = sorted((-s[i], i) for i in ids if i != q)[:20]
        assert [got[q, k + 1] for k in range(20)] == [(i, -v) for v, i in want]


def test_far_blocks_are_left_out(spark):
    rng = np.random.default_rng(10)
    centres = 9 * rng.standard_normal((40, 16))
    rows = [(i, [float(v) for v in centres[i % 40] + 0.01 * rng.standard_normal(16)]) for i in range(40_000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    seen = []
    before = neighbours.reaching
    try:
        neighbours.reaching = lambda blocks, groups, count: seen.append((out := before(blocks, groups, count)).count() / (blocks.count() * groups.count())) or out
        got = neighbours.search(df).where("query_id < 400").collect()
    finally:
        neighbours.reaching = before
    x = np.array([r[1] for r in rows])
    for q in range(0, 400, 20):
        s = x @ x[q]
        s[q] = -np.inf
        assert sorted(r.vec_id for r in got if r.query_id == q) == sorted(np.argsort(-s)[:20].tolist())
    assert 0 < seen[0] < 0.5


def test_neighbours(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert check_search(df) > 0.999


def test_neighbours_odd(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(rng.standard_normal(5) * (1 + i % 7))], 0, "c") for i in range(900)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0, 5.0], 0, "c") for i in range(1000, 1500)]
    rows += [(2000, None, 0, "c"), (2020, [0.0] * 5, 0, "c"), (2040, [1.0, None, 1.0, 1.0, 1.0], 0, "c"), (2060, [float("nan")] * 5, 0, "c"), (None, [9.0] * 5, 0, "c"), (20, [9.0] * 5, 0, "c"), (2080, [], 0, "c"), (2100, [float("inf")] * 5, 0, "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, c string")
    assert check_search(df) > 0.999
    assert check_search(df.where("vec_id < 15 or vec_id = 2000")) == 1.0
    assert neighbours.search(df.limit(0)).count() == 0


def test_hilbert_is_a_path():
    n, bits = 3, 3
    grid = np.array(np.meshgrid(*[range(1 << bits)] * n)).reshape(n, -1).T
    key = neighbours.hilbert(grid, bits)
    assert sorted(key) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()

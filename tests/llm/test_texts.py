"""Licences, sharding, decontamination and BPE against brute force."""

import base64
import hashlib
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from waymeter.llm import bpe, decontaminate, licences, queries, shard

RANKS = public_tokenizers.path(queries.RANKS)


def rows_of(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


# licences


def test_known_texts_match_in_any_dress(spark):
    mit = licences.KNOWN[0][1]
    dressed = "Copyright (c) 2019 Someone\n  (c) 2020 Other\nAll rights reserved.\n\n" + mit.replace(" ", "\n  ", 30).upper().replace("NONINFRINGEMENT", "NON-INFRINGEMENT")
    rows = [(1, dressed), (2, mit + " and more"), (3, "Some words.\n// Released under the MIT Licence\nmore"), (4, None), (5, ""), (None, "Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].license_id == "MIT" and got[2].license_id is None and got[3].notices == "MIT" and got[3].license_id is None
    assert got[4].digest == got[5].digest == hashlib.sha256(b"").hexdigest() and got[4].license_id is None
    assert got[None].license_id == "CC-BY-NC-4.0"


def test_files_as_they_are_found(spark, tmp_path):
    text = dict((i, t) for i, t in licences.KNOWN if len(t) > 200)
    bsd = text["BSD-3-Clause"]
    files = {
        "BSD-3-Clause": 'BSD 3-Clause "New" or "Revised" License\n\nCopyright Jane Doe 2020\n\n' + bsd,
        "BSD-3-Clause ": "Copyright (c) 2001, A.\n" + bsd.replace("\n1. ", "\n   * ").replace("\n2. ", "\n   * ").replace("\n3. ", "\n   * "),
        "BSD-3-Clause  ": bsd.replace("\n1. ", "\n(a) ").replace("\n2. ", "\n b) ").replace("\n3. ", "\n3) "),
        "ISC": "ISC License\n\nCopyright 2019 B\n" + text["ISC"],
        "MIT": "The MIT License (MIT)\n\nCOPYRIGHT: © Someone\n" + text["MIT"].replace(" sublicense,", " sub-licence,").replace("copyright notice", "copyright\nnotice"),
        "Zlib": text["Zlib"].replace("\n1. ", " 1. ") + " licence licence",
    }
    docs = spark.createDataFrame(list(files.items()), "doc_id string, text string")
    got = {r.doc_id: r.license_id for r in licences.scan(docs).collect()}
    assert got == {k: None if k == "Zlib" else k.strip() for k in files}
    # spelt alike words side by side are all spelt anew
    pair = spark.createDataFrame([("licence licence licence",), ("license license license",)], "t string").select(licences.canonical(F.col("t"))).distinct().collect()
    assert [r[0] for r in pair] == ["license license license"]
    (tmp_path / "OWN-1.0.txt").write_text("Do as you like.\n")
    own = licences.read_known(spark, str(tmp_path))
    got = licences.scan(spark.createDataFrame([(1, "do AS you like"), (2, "no")], "doc_id long, text string"), own).collect()
    assert {r.doc_id: r.license_id for r in got} == {1: "OWN-1.0", 2: None}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts here")
def test_long_licences(spark):
    known = {r.digest for r in licences.read_known(spark, "/usr/share/common-licenses/*").collect()}
    assert len(known & {d for _, d in licences.LONG}) >= 5


def test_licences_odd(odd_docs, no_docs, odd_texts):
    assert licences.scan(odd_docs).count() == len(odd_texts)
    assert licences.scan(no_docs).count() == 0


def test_licences_are_native(documents):
    assert not re.search("Python|Arrow|Pandas", licences.scan(documents)._jdf.queryExecution().toString())


# sharding


def check_shards(df, n, **options):
    rows = rows_of(df)
    got = shard.shards(df, n, **options).collect()
    assert sorted(map(str, ((r.id, r.t) for r in got))) == sorted(map(str, rows))
    assert all(r["size"] == len((r.t or "").encode()) + 1 for r in got)
    counts = [sum(r["shard"] == s for r in got) for s in range(n)]
    assert max(counts) - min(counts) <= 1
    for s in range(n):
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(counts[s]))
    return {(r.id, r.t): (r["shard"], r.slot) for r in got}


def test_shards(documents, odd_docs, no_docs):
    one = check_shards(documents, 8, bucket_bytes=1 << 16)
    assert one == check_shards(documents.repartition(3, "text"), 8, bucket_bytes=1 << 16)  # whatever order rows come in
    assert one != check_shards(documents, 8, bucket_bytes=1 << 16, seed=18)
    check_shards(odd_docs, 8, bucket_bytes=1000)
    assert shard.shards(no_docs).count() == 0


def test_written_shards_keep_all_columns(spark, odd_docs, documents, tmp_path):
    docs = odd_docs.withColumnRenamed("h", "id").withColumnRenamed("key", "row").withColumnRenamed("pos", "bucket")
    shard.write_shards(docs, str(tmp_path / "odd"), 3, bucket_bytes=1000)
    back = spark.read.parquet(str(tmp_path / "odd"))
    assert sorted(map(str, back.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    assert sorted(r["shard"] for r in back.select("shard").distinct().collect()) == [0, 1, 2]
    shard.write_shards(documents.select("doc_id", "text"), str(tmp_path / "two"), 2)
    sizes = spark.read.parquet(str(tmp_path / "two")).groupBy("shard").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.count("*").alias("n")).collect()
    assert all(r.a == 0 and r.b + 1 == r.n for r in sizes) and len(sizes) == 2
    with pytest.raises(ValueError):
        shard.write_shards(documents.withColumn("slot", F.lit(1)), str(tmp_path / "no"))


def test_hot_rows_are_dealt_out(spark):
    df = spark.range(600).select(F.when(F.col("id") < 300, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same text").alias("text"))
    check_shards(df, 7, bucket_bytes=200)
    assert shard.scatter(df, 1, "doc_id", "text", 200).groupBy("bucket").count().agg(F.max("count")).first()[0] < 60


def test_shuffle_is_uniform(spark):
    got = np.zeros((4, 4))
    for seed in range(40):
        for r in shard.shuffled(spark.range(4).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).coalesce(1), seed=seed).collect():
            got[r.id, r.place] += 1
    assert got.min() >= 3 and got.max() <= 19


# decontamination


def contamination(rows, items):
    token = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    spelt = lambda t: token.findall((t or "").encode().lower())
    windows = {}
    for item, t in items:
        w = spelt(t)
        for s in range(max(len(w) - 12, 1) if w else 0):
            windows.setdefault(tuple(w[s : s + 13]), set()).add(item)
    lengths = {len(k) for k in windows}
    out = []
    for i, t in rows:
        w = spelt(t)
        hit, named = set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if (k := tuple(w[s : s + n])) in windows:
                    hit.update(range(s, s + n))
                    named |= windows[k]
        named = sorted(str(x) for x in named if x is not None)
        out.append((i, len(w), len(hit), len(named), named, bool(hit) and 20 * len(hit) >= len(w)))
    return out


def check_contamination(docs, benchmark):
    want = contamination(rows_of(docs), [(r[0], r[1]) for r in benchmark.collect()])
    got = decontaminate.contamination(docs, benchmark).drop("v").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    return got


def test_contamination(spark, sf, documents):
    assert any(r.contaminated for r in check_contamination(documents, spark.read.parquet(f"{sf}/benchmark.parquet")))


def test_contamination_odd(spark, odd_docs, no_docs, odd_texts):
    items = spark.createDataFrame([(1, odd_texts[6][1]), (2, "one TWO!"), (3, None), (4, ""), (1, odd_texts[6][1]), (5, "w w w"), (None, "É, é"), (12, "absent words"), (1, "one")], "item_id long, text string")
    assert any(r.n_items > 1 for r in check_contamination(odd_docs, items))
    check_contamination(no_docs, items)
    check_contamination(odd_docs, items.where("item_id = 3"))


def test_contamination_is_native(spark, sf, documents):
    out = decontaminate.contamination(documents, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert not re.search("Python|Arrow|Pandas|Cartesian", out._jdf.queryExecution().toString())


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "zero the quick red brown fox jumps over it"), (2, "quick as a fox the brown")], "doc_id long, text string")
    _, spelt = decontaminate._items(spark.createDataFrame([(1, "the quick brown fox jumps")], "item_id long, text string"), "item_id", "text")
    postings = decontaminate.build_index(docs, spelt.select("term").distinct())
    anchors = spelt.where("term = 'quick'").select("k", spelt["pos"].alias("ipos"), "term")
    got = decontaminate.proximity_matches(postings, spelt, decontaminate.candidates(postings, anchors), slop=2).collect()
    assert [(r.id, r.diag, r.found) for r in got] == [(1, 1, 5)]


# BPE


@pytest.fixture(scope="module")
def enc():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check_bpe(df, enc):
    got = {(r.id, r.decoded): r for r in bpe.encode_decode(df, RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in rows_of(df):
        r, ids = got[(i, (t or "").encode())], enc.encode_ordinary(t or "")
        assert r.n_tokens == len(ids) and np.frombuffer(r.ids, "<u4").tolist() == ids


def test_bpe(documents, odd_docs, no_docs, enc):
    check_bpe(documents, enc)
    check_bpe(odd_docs, enc)
    assert bpe.encode_decode(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


def test_pieces_are_safe(enc):
    texts = ["a" * 300 + " b" * 300, "it's  \n\n x 'll\t y　z " * 60, "   ".join("w1!" for _ in range(200)), " " * 500 + "x" + " " * 500, "é" * 400, "\U0001f600 " * 200]
    for t in texts:
        for size in (1, 2, 7, 50):
            parts = list(bpe.pieces(t, size))
            assert "".join(parts) == t
            assert [x for p in parts for x in enc.encode_ordinary(p)] == enc.encode_ordinary(t)
    assert regex.findall(public_tokenizers.PATTERN, texts[1])


# queries


def test_op2_columns(spark, sf):
    got = queries.op2_two_pass_sharding(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id").collect()
    assert all(r.text_crc32 == zlib.crc32(r.text.encode()) and r.law == "rows" and r.grown_shard is None for r in got)

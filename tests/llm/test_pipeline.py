"""The pipeline's stages against brute force on each stage's own input, and the registered operators against their SQL."""

import base64
import hashlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_near_dup import brute as near_groups
from test_substring_dedup import brute as repeats
from test_texts import contamination

import corpus_pipeline
from waymeter.llm import queries, toxicity

TABLES = "documents embeddings pages benchmark labels conversations".split()


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, sf, documents, tmp_path):
    steps, docs = dict(corpus_pipeline.STAGES), documents
    assert list(steps) == ["toxicity", "minhash_near_dedup", "substring_dedup", "benchmark_decontamination", "byte_bpe"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        kept[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = kept[name][1]
        if name != "byte_bpe":
            assert docs.dtypes == documents.dtypes
    before, after = kept["toxicity"]
    weights = toxicity.classifier(before, spark.read.parquet(f"{sf}/labels.parquet"))
    z = lambda t: 1 / (1 + np.exp(-np.clip(weights[toxicity.features(t)].sum(dtype=float) + weights[-1], -30, 30)))
    assert sorted(pairs(after)) == sorted((i, t) for i, t in pairs(before) if z(t) < toxicity.PREDICT_FROM)
    before, after = kept["minhash_near_dedup"]
    groups = near_groups(pairs(before))
    assert sorted(pairs(after)) == sorted((i, t) for i, t in pairs(before) if groups[i] == i)
    before, after = kept["substring_dedup"]
    want = repeats(pairs(before), {r[0]: r[1] for r in before.select("text", F.xxhash64("text")).collect()})
    got = {r.doc_id: r for r in after.collect()}
    for i, t in pairs(before):
        n, gone, left = want[(i, t)]
        assert got[i].text == (left if gone else t) and (not gone or got[i].n_chars == len(left))
    before, after = kept["benchmark_decontamination"]
    bad = {r[0] for r in contamination(pairs(before), [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]) if r[-1]}
    assert bad and sorted(pairs(after)) == sorted((i, t) for i, t in pairs(before) if i not in bad)
    before, after = kept["byte_bpe"]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(queries.RANKS), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in after.collect()}
    for i, t in pairs(before):
        ids = np.array(enc.encode_ordinary(t), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert sorted(got) == sorted(i for i, _ in pairs(before))


def test_stages_take_odd_rows(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        docs.collect()


def test_stages_take_clashing_columns(spark, sf, odd_docs):
    """Columns named as inner ones come out of every stage as they went in, in place, whatever it removes."""
    names = ["_gone", "_id", "_v", "id", "v", "t", "row", "score", "kept", "uid", "near", "of", "of_class", "component_id", "bucket", "starts"]
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", *(F.concat(F.lit(f"{c} of "), F.coalesce("text", F.lit(""))).alias(c) for c in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf)
        assert docs.columns == before.columns
        rows = docs.collect()
        said = {tuple(r[c] for c in names) for r in before.collect()}
        assert all(tuple(r[c] for c in names) in said for r in rows)
    assert corpus_pipeline.token_ids(spark, docs, sf).count() == len(rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(name, spark, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda df: sorted(tuple(None if v is None or v != v else str(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert sorted(map(str, plain(got))) == sorted(map(str, plain(want)))

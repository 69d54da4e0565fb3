"""The registered ``opN_<name>`` queries: each applies its operator to the whole of its table and derives the contract's columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, codes, decontaminate, html_text, kneser_ney, licences, near_dup, negatives, neighbours, shard, substring_dedup, toxicity
from .common import read
from .oracles import ORACLES  # noqa: F401

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(read(spark, sf_dir, "documents"))


def op2_two_pass_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard.shards(read(spark, sf_dir, "documents"), 8)
    return out.select(F.col("id").alias("doc_id"), "size", F.crc32(F.coalesce("t", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    weights = toxicity.classifier(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, weights, carry=["doc_id"]).select("row.doc_id", "score")
    return scored.select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.PREDICT_FROM).cast("int").alias("predicted"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_proximity_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), near=True)
    digest = lambda c: F.sha2(F.array_join(c, ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest("items").alias("items_sha256"), "contaminated", F.size("near_items").cast("long").alias("n_near_items"), digest("near_items").alias("near_items_sha256"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extract(read(spark, sf_dir, "pages"), carry=["page_id", "url"])
    return out.select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    nodes, members = chat.prefix_tree(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe))
    return chat.read_back(nodes, members)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = codes.compress(read(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("code", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
    digest = hashlib.sha256(",".join(map(str, out.books.ravel().tolist())).encode()).hexdigest()
    return codes.with_label_error(out.rows).select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return negatives.mine(negatives.prepared(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))))


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    docs = read(spark, sf_dir, "documents")
    model = kneser_ney.train(docs.where(~held_out))
    out = kneser_ney.score(docs.select("doc_id", "text", held_out.alias("held_out")), model, ["doc_id", "held_out"])
    return out.select("row.doc_id", "row.held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_license_scan, op2_two_pass_sharding, op3_minhash_near_dedup, op4_toxicity, op5_benchmark_decontamination, op5_proximity_decontamination, op6_html_extraction, op7_chat_formatting, op8_nearest_neighbours, op9_byte_bpe, op10_substring_dedup, op11_vector_codes, op12_hard_negatives, op13_lm_scores)
}

"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark contamination, token ids.

Each stage takes all that its predecessor kept, as a table with the columns of documents, and returns such a table; the last one
returns the ids' digests. ``run`` applies them one after another, each written to the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymeter.llm import bpe, decontaminate, near_dup, substring_dedup, toxicity
from waymeter.llm.common import few, materialise, read
from waymeter.llm.queries import RANKS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ``toxicity.PREDICT_FROM``, by a classifier learnt from the labels of these documents that aren't held out.

    Null and empty texts are scored as texts without words, rows are judged one by one, and an empty table stays empty.
    """
    weights = toxicity.classifier(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, weights).where(F.col("score") < toxicity.PREDICT_FROM).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id; rows equal in id go or stay together.

    Texts without words and rows without an id are in no group and stay; an empty table stays empty.
    """
    gone = near_dup.near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(few(materialise(gone, "gone")), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; those that lose words become the words left, joined by one space, with ``n_chars`` to match. Others stay as they are, null and empty texts too."""
    out = substring_dedup.remove_repeats(docs, carry=docs.columns)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    chars = F.when(F.col("n_removed") > 0, F.char_length("kept").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select(*(text.alias(c) if c == "text" else chars.alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's passages don't contaminate. Null and empty texts have no words and stay; rows of one id are judged each by its text."""
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark")).where("contaminated")
    found = materialise(found.select("doc_id", "v").distinct(), "contaminated")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("of"))
    return rows.join(few(found), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("of") == F.col("v")), "left_anti").select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document left; null text is empty text."""
    out = bpe.encode_decode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", token_ids),
]

#: No SQL says what a trained classifier or tiktoken give; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

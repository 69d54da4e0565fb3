"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are cut before white space that follows other characters: no match of the pre-splitting pattern crosses such a place, and
none looks back, so the pieces' ids, one after another, are the text's ids. Without such places a text is encoded in one piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Characters of a piece, about.
PIECE = 1 << 16
_SAFE = regex.compile(r"(?<=\S)(?=\s)")


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The rank file has one base64 token and its rank a line; no special tokens."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str, enc: tiktoken.Encoding) -> np.ndarray:
    return np.concatenate([np.asarray(enc.encode_to_numpy(p, disallowed_special=()), "<u4") for p in pieces(text)])


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, decoded) for each row: ``ids`` packed as little-endian unsigned 32-bit integers, ``decoded`` the raw bytes that they stand for.

    Null text is empty text: no ids. Rows are independent of each other; repeated rows and null ids pass through; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks_path, pattern)
        for batch in batches:
            for lo in range(0, len(batch), 256):  # so that ids of a few texts at a time are held
                part = batch.slice(lo, 256)
                ids = [encode(t.as_py() or "", enc) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([enc.decode_bytes(x.tolist()) for x in ids], pa.binary())], ["id", "n_tokens", "ids", "decoded"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, docs.select(F.col(id_col).alias("id")).schema.add("n_tokens", "long").add("ids", "binary").add("decoded", "binary")).withColumn("id", F.col("id").cast(kind))

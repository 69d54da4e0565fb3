"""Substring dedup with difference-cover anchors.

A window is ``WINDOW`` = 20 consecutive words of one document. Anchors are runs of ``ANCHOR`` = 8 words at word positions that are,
modulo ``PERIOD`` = 13, in the difference cover {0, 1, 3, 9}: for any two positions i, j some shift below 13 brings both into the
cover at once, so two equal windows always contain one aligned pair of equal anchors (13 - 1 + 8 = 20). Only four anchors in
thirteen words are hashed and shuffled. Anchors that occur twice extend to the windows around them; those windows are hashed in
full (96 bits) and all but the first occurrence of each are covered.

Skew: a repeated line or passage meets in each chunk of rows first, and a task remembers what it has sent in ``SLOTS`` slots. Of an
anchor two rows a task are shuffled under its own key, of a window those that come earlier than all before in the task; of both a
few more where a slot was needed for another in between. What else repeats is decided where it is read and travels under keys of
its own, so that a key that a third of all rows hold has a few rows for each task that read it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bound_batches, discard, materialise, ranked, release
from .words import U, mix, words

WINDOW, PERIOD, COVER = 20, 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
CHUNK = 1 << 20
#: Slots of what a task remembers of the anchors or windows it has sent.
SLOTS = 1 << 18
_IN_COVER = np.isin(np.arange(PERIOD), COVER)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows in order of precedence: whether each is the first of its key, and whether its key occurs again."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    size = np.diff(np.append(np.flatnonzero(new), len(order)))
    first, repeats = np.zeros(len(order), bool), np.zeros(len(order), bool)
    first[order[new]] = True
    repeats[order] = np.repeat(size > 1, size)
    return first, repeats


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U).view(np.int64) if x.dtype == U else x.astype(np.int64))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, twice = np.zeros(SLOTS, U), np.zeros(SLOTS, bool)
    for batch in batches:
        all_ids = batch.column(0).to_numpy(zero_copy_only=False)
        for w in words(batch.column(1), chunk_bytes=CHUNK):
            fits = w.whole(ANCHOR)
            n, row = len(fits), w.rows()
            pos = np.arange(len(row)) - w.at[row]
            at = np.flatnonzero(fits & _IN_COVER[pos[:n] % PERIOD] & (w.counts()[row[:n]] >= WINDOW))
            h, ids, pos = w.windows(ANCHOR)[at], all_ids[w.first + row[at]], pos[at]
            if len(at):
                first, repeats = _groups(h)
                # a task tells others of an anchor twice at most, as far as it remembers: with the second time all know that it repeats
                slot = (h & U(SLOTS - 1)).astype(np.int64)
                known = last[slot] == h
                tell = first & ~(known & twice[slot])
                repeats |= known
                last[slot[tell]], twice[slot[tell]] = h[tell], known[tell]
                # rows that are known to repeat and need not tell others travel under keys of their own
                key = np.where(tell, h, mix(ids.astype(np.int64).view(U) ^ mix(pos.astype(U), 17)))
                yield pa.RecordBatch.from_arrays([_long(key), pa.array(ids, pa.int64()), pa.array(pos.astype(np.int32) * 2 + repeats)], ["h", "id", "p"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, check, last_id, last_start = np.zeros(SLOTS, U), np.zeros(SLOTS, U), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    for batch in batches:
        all_ids = batch.column(0).to_numpy(zero_copy_only=False)
        near = batch.column(2)
        for w in words(batch.column(1), chunk_bytes=CHUNK):
            n = max(0, len(w.hashes) - WINDOW + 1)
            anchors = near.slice(w.first, w.last - w.first)
            at = anchors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            rows = np.repeat(np.arange(len(anchors)), anchors.value_lengths().to_numpy(zero_copy_only=False))
            edge = np.zeros(len(w.hashes) + 1, np.int32)
            at = w.at[rows] + at
            np.add.at(edge, np.maximum(w.at[rows], at - (WINDOW - ANCHOR)), 1)
            np.add.at(edge, np.minimum(w.at[rows + 1], at + 1), -1)
            at = np.flatnonzero((np.cumsum(edge)[:n] > 0) & w.whole(WINDOW))
            if not len(at):
                continue
            row = w.rows()[at]
            ids, start = all_ids[w.first + row], at - w.at[row]
            order = np.lexsort((start, ids))
            ids, start, at = ids[order], start[order], at[order]
            one, two = w.windows(WINDOW)[at], w.windows(WINDOW, 1)[at] >> U(32)
            first, _ = _groups(one, two)
            # so is one of which the task remembers, and has told, an earlier occurrence
            slot = (one & U(SLOTS - 1)).astype(np.int64)
            first &= ~((last[slot] == one) & (check[slot] == two) & ((last_id[slot] < ids) | ((last_id[slot] == ids) & (last_start[slot] < start))))
            told = slot[first]
            last[told], check[told], last_id[told], last_start[told] = one[first], two[first], ids[first], start[first]
            spread = mix(ids.astype(np.int64).view(U) ^ mix(start.astype(U), 23))
            place = np.where(first, two, U(0)) << U(32) | start.astype(U) << U(1) | first.astype(U)
            yield pa.RecordBatch.from_arrays([_long(np.where(first, one, spread)), pa.array(ids, pa.int64()), _long(place)], ["k", "id", "p"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, removed, kept = [], [], []
        for text, starts in zip(batch.column(1), batch.column(2), strict=True):
            ws = (text.as_py() or "").encode().split()
            cover = np.zeros(len(ws) + 1, np.int32)
            if starts.is_valid:
                s = starts.values.to_numpy(zero_copy_only=False)
                np.add.at(cover, s, 1)
                np.add.at(cover, s + WINDOW, -1)
            keep = np.cumsum(cover)[:-1] == 0
            n.append(len(ws))
            removed.append(len(ws) - int(keep.sum()))
            kept.append(b" ".join(compress(ws, keep)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["row", "n_words", "n_removed", "kept"])


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``uid``: the id where ids are distinct; else the place of (id, text hash) in order, nulls last. And (uid, t) once each."""
    ids = docs.groupBy("id").count()
    if ids.where("count > 1 or id is null").isEmpty():
        docs = docs.withColumn("uid", F.col("id"))
        return docs, docs.select("uid", "t")
    texts = docs.withColumn("v", F.xxhash64("t"))
    order = ranked(texts.select(F.coalesce("id", F.lit(2**63 - 1)).alias("o"), F.col("id").isNull().cast("int").alias("none"), "v").distinct(), ["none", "o", "v"], "order")
    order = materialise(order.select(F.when(F.col("none") == 0, F.col("o")).alias("_id"), F.col("v").alias("_v"), F.col("rank").alias("uid")), "uids")
    docs = texts.join(order, F.col("id").eqNullSafe(F.col("_id")) & (F.col("v").eqNullSafe(F.col("_v")))).drop("v", "_id", "_v")
    return docs, docs.groupBy("uid").agg(F.first("t").alias("t"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(row, n_words, n_removed, kept) for each row of ``docs``: ``row`` is a struct of the columns in ``carry`` (default: the id), ``kept`` the words left, joined by one space.

    A word goes if a window that covers it has the words of a window that starts earlier: in a smaller id, or before it in the same
    text. Null or empty texts have no words. A null id comes after all others. Rows with the same id but other texts are documents
    in the order of a text hash; rows equal in id and text are one document, and each is returned.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry or [id_col])).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    docs, texts = _numbered(docs)
    marks = texts.select("uid", "t").mapInArrow(_anchors, "h long, id long, p int")
    again = marks.withColumn("n", F.count("*").over(Window.partitionBy("h"))).where("n > 1 or p % 2 = 1")
    near = materialise(again.groupBy("id").agg(F.collect_set(F.expr("p div 2").cast("int")).alias("near")), "near")
    release(spark)

    # a merge join gives each task its texts in the order of ids: the same rows whenever it has to be run again
    some = texts.select(F.col("uid").alias("id"), "t").join(near.hint("merge"), "id").mapInArrow(_windows, "k long, id long, p long")
    # p: 32 more bits of the window's hash, its start, and whether other chunks may hold an earlier one; it is shuffled in one piece
    start, check = F.shiftright("p", 1).bitwiseAND(2**31 - 1).cast("int"), F.shiftright("p", 32)
    some = some.repartition("k").select("k", check.alias("c"), "id", start.alias("start"), (F.col("p") % 2 != 0).alias("open"))
    earliest = F.min(F.struct("id", "start")).over(Window.partitionBy("k", "c"))
    later = some.withColumn("e", earliest).where("not open or e <> struct(id, start)")
    covered = materialise(later.groupBy("id").agg(F.collect_set("start").alias("starts")), "covered")
    discard(near)
    release(spark)
    cut = docs.join(covered.select(F.col("id").alias("uid"), "starts").hint("shuffle_hash"), "uid", "left").select("row", "t", "starts")
    return cut.mapInArrow(_cut, docs.select("row").schema.add("n_words", "long").add("n_removed", "long").add("kept", "string"))

"""MinHash near-duplicates: fast similarity sketches, banding, and exact verification on full shingle sets.

The sketch (Dahlgaard, Knudsen, Thorup, "Fast similarity sketching", 2017) throws every shingle into one of ``T`` bins in each of ``T``
rounds and, in ``T`` more rounds, into bin 0, 1, ..., so that every coordinate is filled; a bin keeps its least (round, hash). Sets
of many shingles fill all bins in the first rounds and stop there. Bands of ``ROWS`` coordinates are the candidate keys: a pair
with similarity 0.75 shares none of the 32 bands with probability 5e-6.

Cost and skew. Equal sets become one class first (an aggregate on a fingerprint), so exact copies never meet. In a band's bucket
members are checked against a few pivots of the bucket, one row each, never all against all; what is connected already is not
compared again. Only members that are in a different component from most of their bucket are compared with all of it, which is
exact and split into blocks of members, so that no task holds a bucket. Sets travel as binary columns of sorted 64-bit shingle hashes and only for documents that share a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, few, materialise, release
from .graph import components
from .words import U, Words, mix, words

SHINGLE, THRESHOLD = 5, (75, 100)
T, ROWS = 128, 4
#: Coordinates of the finer sketch, and how many bits of it may differ: at 0.75, five standard deviations more than expected.
FINE = 2048
APART = int(FINE * 0.125 + 5 * (FINE * 0.125 * 0.875) ** 0.5)
#: Members of a bucket that are compared with one another in one place; larger buckets are compared block by block.
BLOCK = 2048
_SEED = mix(np.arange(2 * FINE, dtype=U), 11)


def shingle_sets(w: Words, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles: all runs of ``size`` words, or the whole text where it has fewer."""
    full, short = w.windows(size), {k: w.windows(k, 1) for k in range(1, size)}
    for lo, hi in zip(w.at[:-1], w.at[1:], strict=True):
        n = hi - lo
        yield np.zeros(0, U) if n == 0 else np.unique(full[lo : hi - size + 1]) if n >= size else short[int(n)][lo : lo + 1]


def sketch(s: np.ndarray, t: int = T) -> np.ndarray:
    """The ``t`` coordinates, a power of two, of a non-empty set of hashes."""
    out = np.full(t, ~U(0))
    done, step = 0, int(np.clip(6 * t // len(s), 1, min(t, max(1, (1 << 16) // len(s)))))
    while done < t and (out == ~U(0)).any():
        rounds = np.arange(done, min(t, done + step), dtype=U)
        h = mix(s[None, :] ^ _SEED[rounds.astype(int), None])
        np.minimum.at(out, (h & U(t - 1)).astype(np.int64).ravel(), ((rounds[:, None] << U(52)) | (h >> U(12))).ravel())
        done += len(rounds)
    for b in np.flatnonzero(out == ~U(0)):
        out[b] = U((t + int(b)) << 52) | (mix(s ^ _SEED[t + b]).min() >> U(12))
    return out


def fine_bits(s: np.ndarray) -> np.ndarray:
    """One bit of each coordinate of a sketch of ``FINE`` coordinates, as ``FINE // 64`` longs. Two sets with similarity J agree in (1 + J) / 2 of the bits."""
    return np.packbits((mix(sketch(s, FINE), 13) & U(1)).astype(np.uint8)).view(np.int64)


def bands(coordinates: np.ndarray) -> np.ndarray:
    grouped = coordinates.reshape(-1, ROWS)
    key = mix(np.arange(len(grouped), dtype=U), 29)
    for c in grouped.T:
        key = mix(key ^ c)
    return key.astype(np.int64) if key.dtype != U else key.view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for w in words(batch.column(1), lower=True):
            n, one, two, keys = [], [], [], []
            for s in shingle_sets(w):
                n.append(len(s))
                one.append(int(np.bitwise_xor.reduce(mix(s, 3)).view(np.int64)) if len(s) else 0)
                two.append(int(np.sum(mix(s, 5), dtype=U).view(np.int64)) if len(s) else 0)
                keys.append(bands(sketch(s)).tolist() if len(s) else [])
            yield pa.RecordBatch.from_arrays([ids.slice(w.first, w.last - w.first), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n", "f1", "f2", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for w in words(batch.column(1), lower=True):
            sets = list(shingle_sets(w))
            yield pa.RecordBatch.from_arrays([ids.slice(w.first, w.last - w.first), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([fine_bits(s) if len(s) else np.zeros(FINE // 64, np.int64) for s in sets], pa.list_(pa.int64()))], ["id", "s", "bits"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), U) for v in (a, b))
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(THRESHOLD[1] * common >= THRESHOLD[0] * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b) those whose sets are as similar as asked."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(_linked, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, n_shingles, component_id, kept).

    Words are lower-cased over A-Z. Null or empty texts have no shingles and are linked with nothing. Rows that share an id are one
    document, linked if any of the rows is; a row without an id is in no component (null) and is kept. Other columns are not read.
    """
    spark = docs.sparkSession
    sk = materialise(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInArrow(_sketches, "id long, n long, f1 long, f2 long, keys array<long>"), "sketches")
    # a class is a set of shingles; its representative is its smallest id
    classes = sk.where("n > 0 and id is not null").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"), F.max("id").alias("_max"), F.min_by("keys", "id").alias("keys"))
    classes = materialise(classes.select("n", "f1", "f2", "rep", (F.col("_max") > F.col("rep")).alias("many"), "keys"), "classes")
    buckets = classes.select(F.explode("keys").alias("key"), "rep", "n")
    pivots = buckets.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last"), *(F.min_by("rep", F.xxhash64(F.lit(k), "rep")).alias(f"probe{k}") for k in (1, 2))).where("first < last")
    members = materialise(buckets.join(pivots.drop("last"), "key"), "members")
    release(spark)

    shared = few(members.select(F.col("rep").alias("id")).distinct())
    sets = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).join(shared, "id", "left_semi")
    sets = materialise(sets.mapInArrow(_sets, "id long, s binary, bits array<long>"), "sets")
    release(spark)

    # Rows of one id may be of several classes: the id joins them.
    pairs = members.where("first < rep").groupBy(F.col("rep").alias("a")).agg(F.min("first").alias("b"))
    links = materialise(_verified(pairs, sets), "linked")
    release(spark)
    same = lambda df, c, labels: df.join(labels.select(F.col("id").alias(f"_{c}"), F.col("root").alias(f"of_{c}")), F.col(c) == F.col(f"_{c}"), "left").withColumn(f"of_{c}", F.coalesce(f"of_{c}", c)).drop(f"_{c}")

    def further(candidates: DataFrame, links: DataFrame) -> DataFrame:
        """Links among candidates, distinct pairs that are not connected yet, added to ``links``."""
        return materialise(links.unionByName(_verified(candidates.select("a", "b"), sets)), "linked")

    lanes = [f"b{i}" for i in range(FINE // 64)]
    # an id with several texts has several rows: a pair is looked at if any two of them are alike
    bits = sets.select("id", *(F.get("bits", F.lit(i)).alias(b) for i, b in enumerate(lanes)))

    def differ(x: str, y: str) -> Column:
        return reduce(Column.__add__, [F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in lanes])

    # pivots of each bucket: the first and two at random, as far as the finer sketches say that they may be alike
    labels = components(links)
    spread = members.select(F.col("rep").alias("a"), F.explode(F.array_distinct(F.array("first", "probe1", "probe2"))).alias("b")).where("a <> b").distinct()
    apart = same(same(spread, "a", labels), "b", labels).where("of_a <> of_b")
    likely = apart.select("a", "b").alias("p").join(bits.alias("x"), F.col("p.a") == F.col("x.id")).join(bits.alias("y"), F.col("p.b") == F.col("y.id")).where(differ("x", "y") <= APART)
    links = further(likely.select("p.a", "p.b").distinct(), links)
    release(spark)

    # what is still apart from most of its bucket meets all of it, once, in the least bucket that both share
    labels = components(links)
    placed = materialise(same(members.select("key", "rep", "n"), "rep", labels), "placed")
    each = placed.groupBy("key", "of_rep").count()
    sizes = each.groupBy("key").agg(F.max_by("of_rep", F.struct("count", "of_rep")).alias("most"), F.count("*").alias("labels"), F.sum("count").alias("all"), F.max("count").alias("in_most")).where("labels > 1")
    # a bucket of many rows is compared block by block: odd members meet each block of members, and members each block of odd ones
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = sizes.select("key", "most", blocks(F.col("all")).alias("blocks"), blocks(F.col("all") - F.col("in_most")).alias("odd_blocks"))
    profiles = classes.select("rep", "keys").join(bits.withColumnRenamed("id", "rep"), "rep")
    mixed = placed.join(sizes, "key").withColumn("odd", F.col("of_rep") != F.col("most")).drop("most").join(profiles, "rep")
    mixed = materialise(mixed.withColumns({"block": F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"), "odd_block": F.pmod(F.xxhash64("rep"), F.col("odd_blocks")).cast("int")}), "mixed")
    every = lambda n, c: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(c)
    x = mixed.where("odd").drop("block").select("*", every("blocks", "block")).alias("x")
    y = mixed.drop("odd_block").select("*", every("odd_blocks", "odd_block")).alias("y")
    close = (THRESHOLD[0] * F.col("x.n") <= THRESHOLD[1] * F.col("y.n")) & (THRESHOLD[0] * F.col("y.n") <= THRESHOLD[1] * F.col("x.n"))
    once = (~F.col("y.odd") | (F.col("x.rep") < F.col("y.rep"))) & (F.array_min(F.array_intersect("x.keys", "y.keys")) == F.col("x.key"))
    meet = reduce(Column.__and__, [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "block", "odd_block")])
    rest = x.join(y, meet & (F.col("x.of_rep") != F.col("y.of_rep")) & close & (differ("x", "y") <= APART) & once).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()
    links = further(rest, links)
    labels = components(links)
    discard(sets, members, placed, mixed)
    release(spark)

    of = same(classes.where("many").select("n", "f1", "f2", "rep"), "rep", labels).select("n", "f1", "f2", F.col("of_rep").alias("of_class"))
    of = of.unionByName(same(classes.where("not many").join(labels.select(F.col("id").alias("rep")), "rep", "left_semi").select("n", "f1", "f2", "rep"), "rep", labels).select("n", "f1", "f2", F.col("of_rep").alias("of_class")))
    # a class may be reached by several of its ids; its representative's component is the one
    out = sk.select("id", "n", "f1", "f2").join(of, ["n", "f1", "f2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("of_class", "id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))

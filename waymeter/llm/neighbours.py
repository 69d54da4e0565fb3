"""Nearest neighbours by largest inner product, over several shifted Hilbert orderings.

Vectors get one more coordinate that brings all to one length (queries get 0 there), so that the largest inner product is the least
distance. Each of ``CURVES`` orderings rotates and projects them to ``DIMS`` coordinates, shifts these, and ranks the Hilbert keys
by range partitions. A query is compared with the blocks of ``BLOCK`` vectors around its own place on every curve, and the results
are merged. That alone finds what is near in projection; on vectors without structure it is far from all.

The rest is exact. Blocks of the first curve are balls (a centre and a radius), ``FAN`` of them are in a larger one, and so on up.
Queries lie in balls too, each with the least of its queries' last scores found so far. A group of queries comes down from the
widest balls to those, level by level, in which some product may still reach that score; only the balls travel, and only pairs of
a group and a block that are left at the end are shipped as matrices, each one matrix product. Products tell what may be among the
best, within the bound of their rounding errors; sums in the order of components decide.

Equal vectors are one class with its smallest ids, so that a vector that a third of all rows share is compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialise, ranked, release

CURVES, DIMS, BITS, BLOCK, FAN = 4, 6, 10, 512, 32
#: Vectors that the scale of the projections is taken from.
SAMPLE = 10_000


def hilbert(coords: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows) of ``bits`` bits a coordinate (Skilling, "Programming the Hilbert curve", 2004)."""
    x = coords.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            x[0] = np.where(high, x[0] ^ p, x[0])
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= t
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """Rotations, shifts and the scale of the projections."""

    def __init__(self, dims: int, longest: float, sample: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.longest = longest
        self.axes = [np.linalg.qr(rng.standard_normal((dims + 1, min(DIMS, dims + 1))))[0] for _ in range(CURVES)]
        lifted = self.lift(sample)
        self.low = [(lifted @ a).min(0) for a in self.axes]
        self.wide = [np.maximum((lifted @ a).max(0) - low, 1e-12) for a, low in zip(self.axes, self.low, strict=True)]
        self.shift = [rng.random(a.shape[1]) / 2 for a in self.axes]

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))[:, None]], 1)

    def keys(self, x: np.ndarray, curve: int) -> np.ndarray:
        y = (self.lift(x) @ self.axes[curve] - self.low[curve]) / self.wide[curve]
        return hilbert(np.clip((y + self.shift[curve]) / 1.5 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _sums(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed one component after another, as a sequential sum rounds them."""
    total = np.zeros(len(q))
    for j in range(q.shape[1] if len(q) else 0):
        total = total + q[:, j] * x[:, j]
    return total


def _best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, least: np.ndarray) -> pa.RecordBatch:
    """For each query its ``k`` highest scores that reach ``least``, ties to smaller ids. Whatever rounding in the matrix product may have put below them is summed again."""
    scores = q @ x.T
    slack = 4 * (q.shape[1] + 2) * np.finfo(float).eps * np.sqrt((q * q).sum(1) * (x * x).sum(1).max())
    last = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(q), -np.inf)
    row, at = np.nonzero(scores >= np.maximum(last, least)[:, None] - slack[:, None])
    found = _sums(q[row], x[at])
    order = np.lexsort((ids[at], -found, row))
    row, at, found = row[order], at[order], found[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    keep = (place < k) & (found >= least[row])
    return pa.RecordBatch.from_arrays([pa.array(q_ids[row[keep]]), pa.array(ids[at[keep]]), pa.array(found[keep])], ["q", "c", "s"])


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                ids, q_ids = (np.asarray(batch.column(c)[r].values) for c in ("ids", "q_ids"))
                x, q = (np.asarray(batch.column(c)[r].values, float).reshape(len(i), -1) for c, i in (("m", ids), ("q", q_ids)))
                least = np.asarray(batch.column("least")[r].values, float)
                centre = x.mean(0)
                radius = np.sqrt(((x - centre) ** 2).sum(1).max())
                length = np.sqrt((q * q).sum(1))
                may = q @ centre + length * radius + 1e-9 * length * (radius + np.sqrt((centre * centre).sum())) >= least
                if may.any():
                    yield _best(q_ids[may], q[may], ids, x, k, least[may])

    return run


def _balls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed vectors (n, m) the ball around their mean: centre, radius, and the greatest length of a vector."""
    for batch in batches:
        centres, radii, lengths = [], [], []
        for n, m in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            x = np.asarray(m.values, float).reshape(n, -1)
            centres.append(x.mean(0))
            radii.append(np.sqrt(((x - centres[-1]) ** 2).sum(1).max()))
            lengths.append(np.sqrt((x * x).sum(1).max()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(centres, pa.list_(pa.float64())), pa.array(radii, pa.float64()), pa.array(lengths, pa.float64())], ["node", "centre", "radius", "longest"])


_BALL = "node long, centre array<double>, radius double, longest double"


def _wider(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of balls packed by ``FAN`` (node, centres, radii) the ball that holds them."""
    for batch in batches:
        centres, radii = [], []
        for m, r in zip(batch.column(1), batch.column(2), strict=True):
            r = np.asarray(r.values, float)
            x = np.asarray(m.values, float).reshape(len(r), -1)
            centres.append(x.mean(0))
            radii.append((np.sqrt(((x - centres[-1]) ** 2).sum(1)) + r).max())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(centres, pa.list_(pa.float64())), pa.array(radii, pa.float64())], ["node", "centre", "radius"])


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def reaching(blocks: DataFrame, groups: DataFrame, count: int) -> DataFrame:
    """(g, node): the blocks (node, centre, radius), numbered below ``count``, in which a query of a group (g, centre, radius, longest, least) may score ``least`` or more."""
    levels = [blocks]
    while count > FAN:
        above = levels[-1].groupBy(F.expr(f"node div {FAN}").alias("node")).agg(F.flatten(F.collect_list("centre")).alias("m"), F.collect_list("radius").alias("r"))
        levels.append(materialise(above.mapInArrow(_wider, "node long, centre array<double>, radius double"), "balls"))
        count = -(-count // FAN)
    left = groups.withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, count - 1)).cast("long"))))
    for level in reversed(range(len(levels))):
        ball = levels[level].select("node", F.col("centre").alias("c"), F.col("radius").alias("r"))
        met = left.join(ball, "node").withColumn("far", F.sqrt(_dot("c", "c")))
        most = _dot("centre", "c") + F.col("radius") * F.col("far") + F.col("longest") * F.col("r")
        left = met.where(most + 1e-9 * F.col("longest") * (F.col("far") + F.col("r")) >= F.col("least")).drop("c", "r", "far")
        if level:
            left = materialise(left.withColumn("node", F.explode(F.expr(f"sequence(node * {FAN}, node * {FAN} + {FAN - 1})"))), "left")
    return left.select("g", "node")


def _top(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("q", "c").agg(F.max("s").alias("s"))
    return best.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "c"))).where(F.col("_r") <= k).drop("_r")


def valid(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v): vectors that take part, as doubles, an id once (its least vector). Null ids, null or zero vectors, vectors with null or non-finite components, and vectors of another than the commonest length don't."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    rows = rows.groupBy("id").agg(F.min("v").alias("v"))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("v") == (common[0]["n"] if common else 0))


def search(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", exact: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by ``every`` the ``k`` nearest others, ties to smaller ids.

    With ``exact`` false only the neighbourhoods on the curves are compared. An empty table, or one without queries, gives no rows.
    """
    spark = vectors.sparkSession
    own = materialise(valid(vectors, id_col, vec_col), "vectors")
    stats = own.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m"), F.max(F.size("v")).alias("d")).first()
    # classes of equal vectors: the smallest k + 1 ids of each (Spark limits each task's share of a class before the shuffle)
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    classes = own.withColumn("_n", place).where(F.col("_n") <= k + 1).groupBy("v").agg(F.min("id").alias("c"), F.array_sort(F.collect_list("id")).alias("ids"))
    classes = materialise(classes, "classes")
    asked = materialise(own.where(F.col("id") % every == 0).select("id", F.col("v").alias("qv")).join(classes.select("v", F.col("c").alias("q")), F.col("qv") == F.col("v")).select("id", "q"), "asked")
    sample = classes.orderBy(F.xxhash64("c")).limit(SAMPLE).select("v").toArrow()
    x = _matrix(sample.column("v").combine_chunks()) if sample.num_rows else np.zeros((1, 1))
    curves = Curves(stats["d"] or 1, float(np.sqrt(stats["m"] or 0)), x)

    def place_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1))
            for curve in range(CURVES):
                if len(m):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), curve, np.int32)), pa.array(curves.keys(m, curve)), *batch.columns], ["curve", "key", "c", "v"])

    total = classes.count()
    on = ranked(classes.select("c", "v").mapInArrow(place_on, "curve int, key long, c long, v array<double>"), ["curve", "key", "c"], "curves")
    on = materialise(on.withColumn("block", F.expr(f"(rank - curve * {total}L) div {BLOCK}")).drop("rank", "key"), "on")
    pack = lambda df, ids, m: df.groupBy("curve", "block").agg(F.collect_list(F.struct("c", "v")).alias("all")).select("curve", "block", F.col("all.c").alias(ids), F.flatten("all.v").alias(m))
    blocks = materialise(pack(on, "ids", "m"), "blocks")
    queries = materialise(on.join(asked.select(F.col("q").alias("c")).distinct(), "c", "left_semi"), "queries")
    around = queries.withColumn("block", F.explode(F.expr("sequence(block - 1, block + 1)")))
    around = pack(around, "q_ids", "q").withColumn("least", F.transform("q_ids", lambda _: F.lit(float("-inf"))))
    found = blocks.join(around, ["curve", "block"]).mapInArrow(_tiles(k + 1), "q long, c long, s double")
    found = materialise(_top(found, k + 1), "found")
    if exact:
        least = found.groupBy("q").agg(F.when(F.count("*") > k, F.min("s")).otherwise(F.lit(float("-inf"))).alias("least"))
        own_q = queries.where("curve = 0").join(least.withColumnRenamed("q", "c"), "c", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        # groups of queries, as they lie on the first curve
        packed = own_q.groupBy(F.expr("block div 8").alias("g")).agg(F.collect_list(F.struct("c", "v", "least")).alias("all")).select("g", F.col("all.c").alias("q_ids"), F.flatten("all.v").alias("q"), F.col("all.least").alias("least"))
        packed = materialise(packed, "groups")
        first = blocks.where("curve = 0").drop("curve")
        balls = materialise(first.select("block", F.size("ids"), "m").mapInArrow(_balls, _BALL).drop("longest"), "balls")
        around = packed.select("g", F.size("q_ids"), "q").mapInArrow(_balls, _BALL).withColumnRenamed("node", "g").join(packed.select("g", F.array_min("least").alias("least")), "g")
        left = reaching(balls, materialise(around, "around"), max(1, -(-total // BLOCK)))
        rest = left.join(packed, "g").join(first, F.col("node") == F.col("block")).mapInArrow(_tiles(k + 1), "q long, c long, s double")
        found = materialise(_top(rest.unionByName(found), k + 1), "found")
        discard(packed, balls)
    discard(blocks, on)
    release(spark)
    # scores of the pairs left, summed one way
    v = classes.select("c", "v", "ids")
    pairs = found.select("q", "c").join(v, "c").join(v.select(F.col("c").alias("q"), F.col("v").alias("qv")), "q")
    dot = F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    near = pairs.select("q", F.explode("ids").alias("vec_id"), dot.alias("score"))
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("_r") <= k + 1)
    out = asked.join(near, "q").where("id <> vec_id")
    return out.select(F.col("id").alias("query_id"), F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "vec_id")).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

"""Hard-negative mining: the best inner products within score windows, by a forest of STR-packed R-trees.

Rows are packed by sort-tile-recursive: into slabs by label, these by the coordinate that varies most, these by the next one, cut
into trees of a bounded size by counts inside range partitions; inside a tree by further coordinates, into pages. A box (the least
and greatest of each coordinate, and of the label) bounds a query's inner product with all that it holds: each coordinate adds
between the lesser and the greater of its products with the two ends.

Queries that lie in one tree go together, as groups. A group comes down from the widest boxes of trees, level by level, as long as
the box's interval meets one of its windows. The trees left are ordered by what they promise at most, and searched in waves of 1, 7,
56, ...: each wave starts with the scores found in those before and drops the trees that stay strictly below a group's k-th. In
a tree each query has a queue of boxes, best first, and opens none that is outside its windows or strictly below its k-th score.
So results are exact, and what travels is at most k rows a query and tree. On vectors without structure boxes exclude little, and
the queries meet nearly all pages.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .codes import finite, integers
from .common import discard, materialise, ranked

SCALE = 256
#: Scaled components beyond this count as it, so that products of up to 1,024 components stay in 64 bits.
LIMIT = 1 << 26
#: Components in a tree, rows in a page, pages in an inner box, queries in a group, trees in a wider box, and how much a wave is larger than all before.
TREE_CELLS, PAGE, FAN, GROUP, WIDER, WAVE = 1 << 19, 64, 16, 64, 32, 8
#: Groups that a copy of a tree serves.
SERVED = 32
NONE = 1 << 62


def prepared(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE) -> DataFrame:
    """(id, label, v): rows that take part, with integer components.

    Null ids, null labels, vectors that are null or empty or hold null or non-finite components, and vectors of another length than
    the commonest don't; of rows of one id the least (vector, label) counts.
    """
    rows = vectors.where(finite(F.col(vec_col)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.struct(integers(F.col(vec_col), scale, LIMIT).alias("v"), F.col(label_col).cast("long").alias("label")).alias("x"))
    rows = rows.groupBy("id").agg(F.min("x").alias("x")).select("id", "x.label", "x.v")
    rows = materialise(rows, "vectors")
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("v") == (common[0]["n"] if common else 0))


def _tile(x: np.ndarray, at: np.ndarray, axes: list[int]) -> np.ndarray:
    """The rows ``at`` in the order of sort-tile-recursive: slabs along the first axis, in each of them along the next, and so on."""
    if not axes or len(at) <= PAGE:
        return at
    pages = -(-len(at) // PAGE)
    size = -(-pages // int(np.ceil(pages ** (1 / len(axes))))) * PAGE
    at = at[np.argsort(x[at, axes[0]], kind="stable")]
    return np.concatenate([_tile(x, at[i : i + size], axes[1:]) for i in range(0, len(at), size)])


_TREE = "tree long, ids array<long>, labels array<long>, m array<int>, lo array<int>, hi array<int>, label_lo long, label_hi long"


def plant(rows: DataFrame, n: int, dims: int) -> tuple[DataFrame, DataFrame, int]:
    """(trees, places, count): packed trees, the tree and place of each id, and how many trees there are."""
    size = max(PAGE, TREE_CELLS // max(1, dims) // PAGE * PAGE)
    count = -(-n // size)
    spread = rows.agg(*(F.variance(F.col("v")[j]).alias(str(j)) for j in range(dims))).first() if dims else []
    axes = sorted(range(dims), key=lambda j: (-(spread[j] or 0.0), j))
    a, b, inner = axes[0], axes[min(1, dims - 1)], axes[2:5] or axes[:1]
    slabs = int(np.ceil(count ** (1 / 3)))
    keys = rows.select("id", "label", F.col("v")[a].alias("a"), F.col("v")[b].alias("b"))
    keys = ranked(keys, ["label", "a", "id"], "by_label").withColumn("s", F.expr(f"rank div {size * slabs * slabs}L")).drop("rank")
    keys = ranked(keys, ["s", "a", "id"], "by_first").withColumn("s", F.expr(f"rank div {size * slabs}L")).drop("rank")
    keys = ranked(keys, ["s", "b", "id"], "by_second")
    places = materialise(keys.select("id", F.expr(f"rank div {size}L").alias("tree"), "rank"), "places")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(len(batch)):
                ids, labels = (np.asarray(batch.column(c)[r].values) for c in ("ids", "labels"))
                x = np.asarray(batch.column("m")[r].values).reshape(len(ids), -1)
                at = _tile(x, np.argsort(ids), inner)
                x, labels = x[at], labels[at]
                values = [batch.column("tree")[r].as_py(), ids[at], labels, x.ravel(), x.min(0), x.max(0), labels.min(), labels.max()]
                types = [pa.int64(), *[pa.list_(pa.int64())] * 2, *[pa.list_(pa.int32())] * 3, pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], ["tree", "ids", "labels", "m", "lo", "hi", "label_lo", "label_hi"])

    full = rows.join(places, "id").groupBy("tree").agg(F.collect_list(F.struct("id", "label", "v")).alias("all"))
    trees = materialise(full.select("tree", F.col("all.id").alias("ids"), F.col("all.label").alias("labels"), F.flatten("all.v").alias("m")).mapInArrow(pack, _TREE), "trees")
    return trees, places, count


def _reaching(trees: DataFrame, groups: DataFrame, count: int, dims: int, same: bool) -> DataFrame:
    """(g, tree, most): the trees that may hold something for a group (g, glo, ghi, glabel_lo, glabel_hi, gfrom, gto), and the highest score they may."""
    box = trees.select(F.col("tree").alias("node"), "lo", "hi", "label_lo", "label_hi")
    levels = [box]
    while count > WIDER:
        ends = [f(F.col(c)[j]).alias(f"{c}{j}") for c, f in (("lo", F.min), ("hi", F.max)) for j in range(dims)]
        up = levels[-1].groupBy(F.expr(f"node div {WIDER}").alias("node")).agg(*ends, F.min("label_lo").alias("label_lo"), F.max("label_hi").alias("label_hi"))
        levels.append(materialise(up.select("node", F.array(*(f"lo{j}" for j in range(dims))).alias("lo"), F.array(*(f"hi{j}" for j in range(dims))).alias("hi"), "label_lo", "label_hi"), "boxes"))
        count = -(-count // WIDER)
    left = groups.withColumn("node", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(0, count - 1)).cast("long"))))
    ends = "glo[j] * bigint(lo[j]), glo[j] * bigint(hi[j]), ghi[j] * bigint(lo[j]), ghi[j] * bigint(hi[j])"
    bound = lambda f: F.expr(f"aggregate(sequence(0, {dims - 1}), 0L, (s, j) -> s + {f}({ends}))")
    label = "label_lo <= glabel_hi and label_hi >= glabel_lo" if same else "not (label_lo = label_hi and glabel_lo = glabel_hi and label_lo = glabel_lo)"
    for level in reversed(range(len(levels))):
        met = left.join(levels[level], "node").where(label).withColumns({"most": bound("greatest"), "least": bound("least")}).where("most >= gfrom and least <= gto")
        left = met.drop("lo", "hi", "label_lo", "label_hi", "least")
        if level:
            left = materialise(left.drop("most").withColumn("node", F.explode(F.expr(f"sequence(node * {WIDER}, node * {WIDER} + {WIDER - 1})"))), "left")
    return left.select("g", F.col("node").alias("tree"), "most")


def _boxes(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(x), size)
    return np.minimum.reduceat(x, at), np.maximum.reduceat(x, at)


class _Tree:
    """A tree's rows, pages and inner boxes, and the bounds of queries' scores in these."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, exact: type) -> None:
        self.ids, self.labels, self.x = ids, labels, x.astype(exact)
        self.lo, self.hi = _boxes(self.x, PAGE)
        low, high = _boxes(self.labels[:, None], PAGE)
        self.label_lo, self.label_hi = low[:, 0], high[:, 0]
        self.inner = -(-len(self.lo) // FAN)
        at = np.arange(0, len(self.lo), FAN)
        self.wide_lo, self.wide_hi = np.minimum.reduceat(self.lo, at), np.maximum.reduceat(self.hi, at)

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest score of each query in each box: inner boxes, then pages."""
        lo, hi = np.concatenate([self.wide_lo, self.lo]), np.concatenate([self.wide_hi, self.hi])
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        return up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T

    def open_pages(self, label: int, same: bool) -> np.ndarray:
        """Pages that may hold rows of this label, or of others."""
        return (self.label_lo <= label) & (self.label_hi >= label) if same else ~((self.label_lo == label) & (self.label_hi == label))

    def search(self, q: np.ndarray, own: int, label: int, same: bool, windows: list[tuple[int, int]], kth: list[int], k: int, least: np.ndarray, most: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (from, to) its first ``k`` (scores, ids) in this tree, of those that reach its ``kth``."""
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(windows)
        floor = [max(lo, t) for (lo, _), t in zip(windows, kth, strict=True)]
        pages = self.open_pages(label, same)
        queue = [(-most[b], b) for b in range(self.inner)]
        heapq.heapify(queue)
        while queue:
            top, b = heapq.heappop(queue)
            if -top < min(floor):
                break
            if not any(-top >= f and least[b] <= hi for f, (_, hi) in zip(floor, windows, strict=True)):
                continue
            if b < self.inner:
                for p in range(b * FAN, min(len(self.lo), b * FAN + FAN)):
                    if pages[p] and most[self.inner + p] >= min(floor):
                        heapq.heappush(queue, (-most[self.inner + p], self.inner + p))
                continue
            rows = slice((b - self.inner) * PAGE, (b - self.inner) * PAGE + PAGE)
            scores, ids = (self.x[rows] @ q).astype(np.int64), self.ids[rows]
            right = ((self.labels[rows] == label) == same) & (ids != own)
            for w, (_, hi) in enumerate(windows):
                sel = right & (scores >= floor[w]) & (scores <= hi)
                if sel.any():
                    s, i = np.concatenate([best[w][0], scores[sel]]), np.concatenate([best[w][1], ids[sel]])
                    order = np.lexsort((i, -s))[:k]
                    best[w] = s[order], i[order]
                    if len(order) == k:
                        floor[w] = max(floor[w], int(s[order[-1]]))
        return best


def _searching(k: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = dict(zip(batch.schema.names, batch.columns, strict=True))
            get = lambda c, r: np.asarray(at[c][r].values)
            for r in range(len(batch)):
                ids, q_ids = get("ids", r), get("q_ids", r)
                x, q = get("m", r).reshape(len(ids), -1), get("q", r).reshape(len(q_ids), -1)
                exact = float if float(np.abs(x).max()) * float(np.abs(q).max()) * q.shape[1] < 2**52 else np.int64
                tree, q = _Tree(ids, get("labels", r), x, exact), q.astype(exact)
                least, most = (np.rint(b).astype(np.int64) for b in tree.bounds(q))
                q_labels, wins = get("q_labels", r), at["wins"][r].as_py()
                out: list[list[np.ndarray]] = [[], [], [], []]
                for n in range(len(q_ids)):
                    found = tree.search(q[n], q_ids[n], q_labels[n], same, [(w["from"], w["to"]) for w in wins[n]], [w["kth"] for w in wins[n]], k, least[n], most[n])
                    for w, (s, i) in zip(wins[n], found, strict=True):
                        for column, values in zip(out, (np.full(len(s), q_ids[n]), np.full(len(s), w["w"]), i, s), strict=True):
                            column.append(values)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], ["q", "w", "id", "s"])

    return run


def windowed(asked: DataFrame, trees: DataFrame, count: int, dims: int, k: int, same: bool) -> DataFrame:
    """(q, w, id, s, rank): for each query and window the first ``k`` rows of the same label, or of others, with scores in it.

    ``asked``: (q, label, v, tree, rank, wins array<struct<w, from, to>>). Higher scores come first, ties by smaller id; a query itself never counts.
    """
    spark = asked.sparkSession
    order = Window.partitionBy("tree").orderBy("rank", "q")
    asked = asked.withColumn("g", F.expr(f"tree * {TREE_CELLS}L") + F.floor((F.row_number().over(order) - 1) / GROUP)).drop("rank", "tree")
    asked = materialise(asked, "asked")
    ends = [f(F.col("v")[j]).alias(f"{c}{j}") for c, f in (("lo", F.min), ("hi", F.max)) for j in range(dims)]
    groups = asked.groupBy("g").agg(*ends, F.min("label").alias("glabel_lo"), F.max("label").alias("glabel_hi"), F.min(F.array_min("wins.from")).alias("gfrom"), F.max(F.array_max("wins.to")).alias("gto"))
    groups = groups.select("g", F.array(*(F.col(f"lo{j}").cast("long") for j in range(dims))).alias("glo"), F.array(*(F.col(f"hi{j}").cast("long") for j in range(dims))).alias("ghi"), "glabel_lo", "glabel_hi", "gfrom", "gto")
    place = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("most"), "tree")) - 1
    pairs = _reaching(trees, materialise(groups, "groups"), count, dims, same).withColumn("place", place)
    pairs = materialise(pairs.withColumn("wave", F.when(F.col("place") == 0, 0).otherwise(1 + F.floor(F.log(F.col("place").cast("double")) / F.log(F.lit(float(WAVE))) + 1e-9)).cast("int")).drop("place"), "pairs")
    best = Window.partitionBy("q", "w").orderBy(F.desc("s"), "id")
    found = spark.createDataFrame([], "q long, w long, id long, s long, rank int")
    waves = pairs.agg(F.max("wave")).first()[0]
    for wave in range(0 if waves is None else waves + 1):
        kth = found.where(F.col("rank") == k).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("w", "s"))).alias("kths"))
        wins = F.transform("wins", lambda w: w.withField("kth", F.coalesce(F.try_element_at("kths", w["w"]), F.lit(-NONE))))
        now = asked.join(kth, "q", "left").withColumn("wins", wins).drop("kths")
        packed = now.groupBy("g").agg(F.collect_list(F.struct("q", "label", "v", "wins")).alias("all"), F.min(F.array_min(F.transform("wins", lambda w: F.greatest(w["from"], w["kth"])))).alias("floor"))
        packed = packed.select("g", F.col("all.q").alias("q_ids"), F.col("all.label").alias("q_labels"), F.flatten("all.v").alias("q"), F.col("all.wins").alias("wins"), "floor")
        packed = materialise(packed, "packed")
        due = materialise(pairs.where(F.col("wave") == wave).join(packed.select("g", "floor"), "g").where("most >= floor").select("g", "tree"), "due")
        # a tree that many groups come to is there once for each SERVED of them
        copies = due.groupBy("tree").agg(F.ceil(F.count("*") / SERVED).cast("int").alias("copies"))
        sent = due.join(copies, "tree").withColumn("copy", F.pmod(F.xxhash64("g"), "copies").cast("int")).join(packed, "g")
        there = trees.join(copies, "tree").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).select("tree", "copy", "ids", "labels", "m")
        new = sent.join(there, ["tree", "copy"]).select("q_ids", "q_labels", "q", "wins", "ids", "labels", "m").mapInArrow(_searching(k, same), "q long, w long, id long, s long")
        last, found = found, materialise(found.drop("rank").unionByName(new).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "found")
        discard(packed, due, *([last] if wave else []))
    discard(pairs, asked)
    return found


def mine(rows: DataFrame, every: int = 50, positives: int = 5, k: int = 3, at_least: int = 50, at_most: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows (id, label, v): for each id divisible by ``every`` and each of its best ``positives`` of the same label the best ``k`` of other labels that score ``at_least`` to ``at_most`` per cent of the positive.

    An anchor without others of its label, or without negatives in a window, gives no rows; an empty table gives none.
    """
    n, dims = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    trees, places, count = plant(rows, n, dims or 0) if n else (None, None, 0)
    if not n:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = materialise(rows.where(F.col("id") % every == 0).join(places, "id").withColumnRenamed("id", "q"), "anchors")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("w"), F.lit(-NONE).alias("from"), F.lit(NONE).alias("to")))
    near = windowed(anchors.withColumn("wins", whole), trees, count, dims, positives, True)
    window = near.select("q", "rank", "id", "s", F.expr(f"-((-{at_least} * s - pmod(-{at_least} * s, 100L)) div 100L)").alias("from"), F.expr(f"({at_most} * s - pmod({at_most} * s, 100L)) div 100L").alias("to")).where(F.col("from") <= F.col("to"))
    wins = window.groupBy("q").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").cast("long").alias("w"), "from", "to"))).alias("wins"))
    far = windowed(anchors.join(wins, "q"), trees, count, dims, k, False)
    met = near.select("q", F.col("rank").cast("long").alias("w"), F.col("id").alias("positive_id"), F.col("s").alias("positive_score")).join(far, ["q", "w"])
    return met.select(F.col("q").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("s").alias("negative_score"))

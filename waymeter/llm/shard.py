"""A two-pass external shuffle into shards.

Pass one scatters records uniformly into buckets by a seeded hash, as many buckets as keep each within ``bucket_bytes``. Pass two
shuffles each bucket by Fisher-Yates with a generator seeded by the bucket, in memory, and writes it. Buckets one after another
are a uniform permutation of all rows; it is cut into shards whose row counts differ by one at most (the ``rows`` law).

Rows of one hot id or text would all hash to one bucket, so repeats are told apart first: a bucket that turns out larger than its
share is dealt again by row. Bucket offsets are prefix sums over the table of bucket sizes, in blocks, so that no task sees more
than ``BLOCK`` of them at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, release

BUCKET_BYTES = 8 << 20
BLOCK = 4096
#: Parts that a bucket's number leaves room for.
PARTS = 1 << 24


def scatter(docs: DataFrame, seed: int, id_col: str, text_col: str, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` as (row, id, t, size, bucket): bucket numbers hold about ``bucket_bytes`` each."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("t")).withColumn("size", (F.coalesce(F.octet_length("t"), F.lit(0)) + 1).cast("long"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    n = max(1, -(-int(total) // bucket_bytes))
    rows = rows.withColumn("b", F.pmod(F.xxhash64(F.lit(seed), "id", "t"), F.lit(n)).cast("int"))
    # a bucket is large by chance (within half of its share) or by repeats of one row
    large = rows.groupBy("b").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > 1.5 * bucket_bytes).select("b", F.ceil(F.col("bytes") / bucket_bytes).cast("int").alias("parts"))
    dealt = F.pmod(F.xxhash64(F.lit(seed + 1), F.monotonically_increasing_id()), F.coalesce("parts", F.lit(1))).cast("int")
    return rows.join(F.broadcast(large) if n <= 1 << 20 else large, "b", "left").withColumn("bucket", F.col("b").cast("long") * PARTS + dealt).drop("b", "parts")


def _fisher_yates(seed: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("h", "ascending"), ("h2", "ascending")])  # the same start whatever order rows came in
        rng = np.random.default_rng([seed, key[0].as_py()])
        order = list(range(len(table)))
        for i, j in zip(range(len(table) - 1, 0, -1), rng.integers(0, np.arange(len(table), 1, -1)).tolist(), strict=True):
            order[i], order[j] = order[j], order[i]
        return table.take(pa.array(order)).drop_columns(["h", "h2"]).append_column("place", pa.array(np.arange(len(table))))

    return run


def shuffled(docs: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, carry: list[str] | None = None) -> DataFrame:
    """The shuffled buckets as written to the shared folder: (id, t, size, bucket, place), place from 0 in each bucket; with ``carry`` also ``row``, a struct of those columns."""
    rows = scatter(docs, seed, id_col, text_col, bucket_bytes).withColumns({"h": F.xxhash64(F.lit(seed), "id", "t"), "h2": F.xxhash64("t")})
    more = [F.struct(*(F.col(f"row.`{c}`") for c in carry)).alias("row")] if carry else []
    out = rows.select("id", "t", "size", "bucket", *more, "h", "h2")
    schema = out.drop("h", "h2").schema.add("place", "long")
    return materialise(out.groupBy("bucket").applyInArrow(_fisher_yates(seed), schema), "shuffled")


def _offsets(counts: DataFrame) -> DataFrame:
    """(bucket, base): how many rows stand in the buckets before, in two levels."""
    blocks = counts.withColumn("block", F.expr(f"bucket div {PARTS} div {BLOCK}"))
    inner = F.sum("n").over(Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = blocks.groupBy("block").agg(F.sum("n").alias("all"))
    outer = F.sum("all").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    before = sums.select("block", F.coalesce(outer, F.lit(0)).alias("before"))
    return blocks.withColumn("inner", F.coalesce(inner, F.lit(0))).join(before, "block").select(F.col("bucket").alias("_bucket"), (F.col("inner") + F.col("before")).alias("base"))


def shards(docs: DataFrame, n: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, carry: list[str] | None = None) -> DataFrame:
    """All rows as (id, t, size, shard, slot): shard 0 to n - 1, slot gapless from 0 in each; with ``carry`` also ``row``, a struct of those columns.

    Null texts are kept, of size 1; null ids too. Repeated rows are rows like any others. An empty table gives no rows.
    """
    rows = shuffled(docs, seed, id_col, text_col, bucket_bytes, carry)
    release(docs.sparkSession)
    counts = materialise(rows.groupBy("bucket").agg(F.count("*").alias("n")), "buckets")
    total = counts.agg(F.sum("n")).first()[0] or 0
    small = counts.count() <= 1 << 16
    base = _offsets(counts)
    placed = rows.join(F.broadcast(base) if small else base, F.col("bucket") == F.col("_bucket")).withColumn("rank", F.col("base") + F.col("place"))
    q, r = divmod(int(total), n)  # the first r shards have a row more
    wide = r * (q + 1)
    shard = F.when(F.col("rank") < wide, F.expr(f"rank div {q + 1}")).otherwise(F.expr(f"{r} + (rank - {wide}) div {max(q, 1)}"))
    slot = F.when(F.col("rank") < wide, F.col("rank") % (q + 1)).otherwise((F.col("rank") - wide) % max(q, 1))
    return placed.select("id", "t", "size", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), *(["row"] if carry else []))


def write_shards(docs: DataFrame, path: str, n: int = 8, id_col: str = "doc_id", text_col: str = "text", **options) -> None:
    """Writes the shards, with all columns of ``docs``, as Parquet folders ``shard=0`` ... under ``path``; inside a folder rows are in files by ranges of slots, in order.

    ``docs`` may have no columns named shard or slot. Other columns than id and text travel beside them, so that a text is carried once.
    """
    if clash := {c.lower() for c in docs.columns} & {"shard", "slot"}:
        raise ValueError(f"columns are named as those of shards: {sorted(clash)}")
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    out = shards(docs, n, id_col=id_col, text_col=text_col, carry=others, **options)
    kept = [F.col("id").alias(c) if c == id_col else F.col("t").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns]
    out = out.select(*kept, "shard", "slot").repartitionByRange("shard", "slot")
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

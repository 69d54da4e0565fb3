"""Vector code compression: product codes, their codebooks found by a Lloyd iteration whose members stay with their owners.

Vectors become integers and are cut into parts. A member is one part of one vector; its owner is (position, entry, salt), and the
salt divides an entry that a third of all rows share. In each round every owner's members give sums and counts, from which the
entry's next components follow; members look for the nearest entry where they lie, without a shuffle; those that find another than
theirs migrate to their new owner in the next shuffle, and nobody else does. What all tasks need of a round is the codebooks:
entries times components integers, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Scaled components beyond this count as it, so that squares and their sums stay in 64 bits.
LIMIT = 1 << 24
#: Salts of an owner: so many at least, and one for so many vectors.
SALTS, SALT_ROWS = 16, 1_000_000


@dataclass
class Codes:
    """``rows``: (row, vec_id, label, code array<int>, error); ``books``: [position][entry][component]."""

    rows: DataFrame
    books: np.ndarray


def integers(vec: Column | str, scale: int = SCALE, limit: int = LIMIT) -> Column:
    """``floor(scale * x)`` of each component as a double, held within ``limit``."""
    return F.transform(vec, lambda x: F.greatest(F.lit(-limit), F.least(F.lit(limit), F.floor(x.cast("double") * scale))).cast("int"))


def finite(vec: Column | str) -> Column:
    """Whether the vector is there, not empty, and without null or non-finite components."""
    return F.coalesce((F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _kept(vectors: DataFrame, parts: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    rows = vectors.where(finite(F.col(vec_col)) & (F.size(vec_col) % parts == 0))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), integers(F.col(vec_col)).alias("q"))
    rows = materialise(rows, "vectors")
    common = rows.groupBy(F.size("q").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("q") == (common[0]["n"] if common else 0))


def _first_books(kept: DataFrame, parts: int, entries: int) -> np.ndarray:
    ids = [r[0] for r in kept.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()]
    own = F.col("vec_id").isin([i for i in ids if i is not None]) | (F.col("vec_id").isNull() if None in ids else F.lit(False))
    first = kept.where(own).groupBy("vec_id").agg(F.min("q").alias("q")).orderBy(F.asc_nulls_last("vec_id")).collect()
    x = np.array([r["q"] for r in first], np.int64)
    return x.reshape(len(first), parts, -1).transpose(1, 0, 2) if len(first) else np.zeros((parts, 0, 0), np.int64)


_MEMBER = "row long, vec_id long, pos int, part array<int>, salt int, entry int, error long, moved boolean"


def _nearest(members: DataFrame, books: np.ndarray) -> DataFrame:
    """Each member's nearest entry, ties to the lower index, its squared distance, and whether the entry is another than before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = dict(zip(batch.schema.names, batch.columns, strict=True))
            pos, entry = at["pos"].to_numpy(zero_copy_only=False), at["entry"].to_numpy(zero_copy_only=False)
            x = at["part"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(pos), books.shape[2])
            far = ((x[:, None, :] - books[pos]) ** 2).sum(2)
            best = far.argmin(1).astype(np.int32) if len(pos) else np.zeros(0, np.int32)
            error = far[np.arange(len(pos)), best]
            yield pa.RecordBatch.from_arrays([at["row"], at["vec_id"], at["pos"], at["part"], at["salt"], pa.array(best), pa.array(error), pa.array(best != entry)], ["row", "vec_id", "pos", "part", "salt", "entry", "error", "moved"])

    return members.select("row", "vec_id", "pos", "part", "salt", "entry").mapInArrow(run, _MEMBER)


def _updated(resident: DataFrame, books: np.ndarray) -> np.ndarray:
    """The entries' next components: floored means of the members, partial sums where these lie; unused entries stay."""
    width = books.shape[2]
    sums = resident.groupBy("pos", "entry").agg(F.count("*").alias("n"), *(F.sum(F.col("part")[j].cast("long")).alias(f"s{j}") for j in range(width)))
    out = books.copy()
    for r in sums.select("pos", "entry", F.array(*(F.expr(f"(s{j} - pmod(s{j}, n)) div n") for j in range(width))).alias("mean")).collect():
        out[r["pos"], r["entry"]] = r["mean"]
    return out


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> Codes:
    """Codes and codebooks of all vectors.

    Vectors that are null or empty, hold null or non-finite components, can't be cut into ``parts`` equal parts, or are of another
    length than the commonest, are left out. Rows of one id are each encoded; of these the least vector counts for the first
    codebook, and null ids come last there. Fewer ids than ``entries`` make fewer entries; no vectors make none and no codes.
    """
    kept = _kept(vectors, parts, id_col, vec_col, label_col)
    books = _first_books(kept, parts, entries)
    width = books.shape[2]
    salts = max(SALTS, -(-kept.count() // SALT_ROWS))
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("q", p * width + 1, width)) if width else F.array().cast("array<array<int>>")
    members = kept.select("row", "vec_id", F.posexplode(cut).alias("pos", "part")).withColumns({"salt": F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"), "entry": F.lit(-1)})
    at = materialise(_nearest(members, books), "members", "moved")
    for _ in range(rounds):
        move = at.where("moved").repartition("pos", "entry", "salt")
        resident = materialise(at.where("not moved").unionByName(move).drop("moved"), "resident")
        discard(at)
        books = _updated(resident, books)
        at = materialise(_nearest(resident, books), "members", "moved")
        discard(resident)
    coded = at.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "entry"))).alias("c"), F.sum("error").alias("error"))
    coded = coded.select("row", F.col("c.entry").alias("code"), "error")
    return Codes(kept.select("row", "vec_id", "label").join(coded, "row"), books)


def with_label_error(rows: DataFrame) -> DataFrame:
    """``label_error``: the errors summed over rows of equal label, nulls together. Labels that hold a thousandth of the rows or more (a thousand labels at most) go by broadcast, the others shuffle."""
    rows = materialise(rows, "codes")
    sums = materialise(rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label_errors")
    least = rows.count() // 1000
    common, rare = sums.where(F.col("n") >= least).drop("n"), sums.where(F.col("n") < least).drop("n")
    same = lambda s: F.col("label").eqNullSafe(F.col("of"))
    met = rows.join(F.broadcast(common.select(F.col("label").alias("of"), "label_error")), same(common), "left")
    found = met.where("label_error is not null").drop("of")
    rest = met.where("label_error is null").drop("of", "label_error")
    return found.unionByName(rest.join(rare.select(F.col("label").alias("of"), "label_error"), same(rare)).drop("of"))

"""Language-model scoring: an interpolated modified Kneser-Ney n-gram model, counted in Spark, read by workers as memory-mapped arrays.

Counting. Tasks take the training texts in chunks and count a chunk's distinct n-grams, of 48-bit word hashes, with ``order - 1``
start marks before and one end behind each text. The 64-bit hash of an n-gram decides its shard, so that shards are even however
common a word is; an n-gram comes at most once from a chunk. A shard's task adds up its n-grams, writes them as arrays sorted by hash
to the shared folder, and sends what the level below needs to that level's shards: to the n-gram without its first word, that it
has one more predecessor; to the one without its last, the total and the numbers of its continuations. The number of shards follows
the size of the training texts, so a task holds ``SHARD_BYTES`` of text worth of n-grams.

Scoring. Workers map the arrays into memory (on a store without a file system they read them) and look a chunk's distinct n-grams up
in the order of the hashes. Unknown words share what the discounts leave of the lowest level: the words of the training texts, the end
and one unknown word sum to 1 after every context.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, materialise, shared_dir
from .words import U, mix, words

#: Words in an n-gram of the query's model.
ORDER = 2
#: Words of a chunk that are counted or looked up together, and bytes of training text for each shard.
CHUNK, SHARD_BYTES = 1 << 22, 1 << 25
START, END = U(1), U(2)


def key(columns: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of the n-grams whose words are given by columns."""
    k = mix(columns[0], 1)
    for c in columns[1:]:
        k = mix(k * U(0x9E3779B97F4A7C15) + c, 2)
    return k


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash: one after another they are one sorted array."""
    return ((keys >> U(32)) * U(shards)) >> U(32)


def n_grams(column: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The n-grams that end at each token of each text, as columns of word hashes, and each text's number of tokens, its end included."""
    parts, counts = [], []
    for w in words(column, lower=True):
        n = w.counts() + 1
        begins = np.cumsum(n + order - 1) - n  # of the first token of each text
        line = np.full(int((n + order - 1).sum()), START, U)
        line[np.repeat(begins - np.concatenate([[0], np.cumsum(n - 1)[:-1]]), n - 1) + np.arange(len(w.hashes))] = np.maximum(w.hashes >> U(16), U(3))
        line[begins + n - 1] = END
        at = np.repeat(begins - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
        parts.append([line[at - back] for back in range(order - 1, -1, -1)])
        counts.append(n)
    joined = [np.concatenate([p[j] for p in parts]) if parts else np.zeros(0, U) for j in range(order)]
    return joined, np.concatenate(counts) if counts else np.zeros(0, np.int64)


def _narrow(x: np.ndarray) -> np.ndarray:
    """``x`` in the narrowest unsigned type that holds it."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _pack(columns: list[np.ndarray], values: list[np.ndarray]) -> bytes:
    out = io.BytesIO()
    for c in columns:
        np.save(out, (c & U(0xFFFFFFFF)).astype("<u4"))
        np.save(out, (c >> U(32)).astype("<u2"))
    for v in values:
        np.save(out, _narrow(v))
    return out.getvalue()


def _unpack(blobs: list[bytes], columns: int, values: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    cols: list[list[np.ndarray]] = [[] for _ in range(columns)]
    vals: list[list[np.ndarray]] = [[] for _ in range(values)]
    for blob in blobs:
        at = io.BytesIO(blob)
        for c in cols:
            low = np.load(at).astype(U)
            c.append(low | (np.load(at).astype(U) << U(32)))
        for v in vals:
            v.append(np.load(at).astype(np.int64))
    return [np.concatenate(c) for c in cols], [np.concatenate(v) for v in vals]


def _merged(columns: list[np.ndarray], values: list[np.ndarray], by: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Equal n-grams once, their values added, in the order of ``by``."""
    if not len(by):
        return columns, values, by
    order = np.argsort(by)
    columns = [c[order] for c in columns]
    first = np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], 0)]) if len(by) > 1 else np.ones(1, bool)
    at = np.flatnonzero(first)
    return [c[at] for c in columns], [np.add.reduceat(v[order], at) for v in values], by[order][at]


def _scatter(columns: list[np.ndarray], values: list[np.ndarray], shards: int) -> Iterator[tuple[int, bytes]]:
    """(shard, packed n-grams), in each shard in the order of the words, which compresses well."""
    by = (columns[0] << U(16)) & U(0xFFFFFFFF00000000) | (columns[-1] >> U(16))
    columns, values, _ = _merged(columns, values, by)
    shard = shard_of(key(columns), shards).astype(np.uint32)
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    for s in range(shards):
        at = order[ends[s] : ends[s + 1]]
        if len(at):
            yield s, _pack([c[at] for c in columns], [v[at] for v in values])


def _store(base: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(base if "://" in base or base.startswith("file:") else f"file://{base}")


def _put(base: str, name: str, x: np.ndarray) -> None:
    """Writes an array under its name at once: a repeated task writes the same again."""
    fs, folder = _store(base)
    fs.create_dir(folder, recursive=True)
    part = f"{folder}/{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        np.lib.format.write_array(out, x) if not isinstance(fs, LocalFileSystem) else out.write(_bytes(x))
    fs.move(part, f"{folder}/{name}.npy") if not isinstance(fs, LocalFileSystem) else os.replace(part, f"{folder}/{name}.npy")


def _bytes(x: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, x)
    return out.getvalue()


@lru_cache(maxsize=1 << 14)
def _get(base: str, name: str) -> np.ndarray:
    fs, folder = _store(base)
    if isinstance(fs, LocalFileSystem):
        return np.load(f"{folder}/{name}.npy", mmap_mode="r")
    with fs.open_input_stream(f"{folder}/{name}.npy") as data:
        return np.load(io.BytesIO(data.read()))


#: What a level holds: ``count`` (of the highest level occurrences, else distinct predecessors), ``raw`` (occurrences), ``total`` and ``weight`` (as a context: the counts of what follows, and the share left to the level below).
FIELDS = ("count", "raw", "total", "weight")


@dataclass(frozen=True)
class Model:
    """``discounts``: of each level from 1 the discounts of counts 1, 2 and more; ``weight``, ``total`` of level 0; ``tokens``, ``types`` of the training texts."""

    base: str
    order: int
    shards: tuple[int, ...]
    discounts: tuple[tuple[float, float, float], ...]
    weight: float
    total: int
    tokens: int
    types: int
    there: tuple[frozenset[int], ...]

    def look_up(self, level: int, columns: list[np.ndarray], fields: tuple[str, ...]) -> list[np.ndarray]:
        """The fields of the given n-grams in a level, 0 where it has none."""
        keys, back = np.unique(key(columns), return_inverse=True)
        out = [np.zeros(len(keys)) for _ in fields]
        shards = self.shards[level - 1]
        ends = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1, dtype=U))
        for s in range(shards):
            needles = keys[ends[s] : ends[s + 1]]
            if len(needles) and s in self.there[level - 1]:
                known = _get(self.base, f"{level}-{s}-key")
                at = np.minimum(np.searchsorted(known, needles), len(known) - 1)
                hit = np.flatnonzero(known[at] == needles)
                for x, f in zip(out, fields, strict=True):
                    x[ends[s] + hit] = _get(self.base, f"{level}-{s}-{f}")[at[hit]]
        return [x[back] for x in out]

    def probabilities(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Probability and number of occurrences in the training texts of each n-gram's last word."""
        p = np.full(len(columns[0]), 1 / (self.types + 1))
        raw = np.zeros(len(columns[0]))
        for level in range(1, self.order + 1):
            last = columns[self.order - level :]
            if level == 1:
                total, weight = float(self.total), self.weight
                count, raw = self.look_up(1, last, ("count", "raw"))
            else:
                total, weight = self.look_up(level - 1, last[:-1], ("total", "weight"))
                (count,) = self.look_up(level, last, ("count",))
            off = np.array([0.0, *self.discounts[level - 1]])[np.minimum(count, 3).astype(int)]
            p = np.where(np.asarray(total) > 0, (count - off) / np.maximum(total, 1) + weight * p, p)
        return p, raw


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and more (Chen, Goodman, "An empirical study of smoothing techniques", 1998) from how many n-grams have counts 1 to 4. Where such numbers are missing, or a discount would be none or more than its count, 0.5, 1 and 1.5 hold."""
    usual = (0.5, 1.0, 1.5)
    if min(n) == 0:
        return usual
    y = n[0] / (n[0] + 2 * n[1])
    found = tuple(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))
    return found if all(0 < d < k for k, d in zip((1, 2, 3), found, strict=True)) else usual


_LEVEL = "shard int, data binary, size long, tokens long, found array<long>"


def _level(level: int, order: int, base: str, shards_below: int, above: tuple[float, float, float]) -> Callable[[pa.Table], pa.Table]:
    """Adds up a shard of a level, writes it, and makes the rows for the level below and one row of its statistics."""
    top = level == order

    def run(table: pa.Table) -> pa.Table:
        own = table.column("shard")[0].as_py()
        columns, values = _unpack(table.column("data").to_pylist(), level, 1 if top else 6)
        columns, values, keys = _merged(columns, values, key(columns))
        count = values[0]
        raw = count if top else values[1]
        _put(base, f"{level}-{own}-key", keys)
        _put(base, f"{level}-{own}-count", _narrow(count))
        if level == 1:
            _put(base, f"1-{own}-raw", _narrow(raw))
        if not top:
            total = values[2]
            left = sum(d * v for d, v in zip(above, values[3:], strict=True))
            _put(base, f"{level}-{own}-total", _narrow(total))
            _put(base, f"{level}-{own}-weight", np.divide(left, total, out=np.zeros(len(total)), where=total > 0))
        # how many n-grams have counts 1, 2, 3 and 4, then how many have 3 or more, then the sum of counts, then how many occur
        found = [int((count == k).sum()) for k in (1, 2, 3, 4)] + [int((count > 2).sum()), int(count.sum()), int((raw > 0).sum())]
        rows: list[tuple] = [(own, None, len(keys), int(raw.sum()), found)]
        if level > 1:
            seen = np.flatnonzero(count > 0)
            one, none = np.ones(len(seen), np.int64), np.zeros(len(seen), np.int64)
            c = count[seen]
            kinds = [(c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64)]
            below = [np.concatenate([a[seen], b[seen]]) for a, b in zip(columns[1:], columns[:-1], strict=True)]
            given = [np.concatenate(x) for x in ((one, none), (raw[seen], none), (none, c), *((none, k) for k in kinds))]
            rows += [(s, data, None, None, None) for s, data in _scatter(below, given, shards_below)]
        types = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["shard", "data", "size", "tokens", "found"])

    return run


def train(texts: DataFrame, order: int = ORDER, text_col: str = "text") -> Model:
    """The model of all rows of ``texts``. A null text is an empty one: an end alone. Without rows every word has the same probability."""
    spark = texts.sparkSession
    bound_batches(spark)
    base = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    size = texts.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate([h[j] for h in held]) for j in range(order)]
            held.clear()
            for s, data in _scatter(columns, [np.ones(len(columns[0]), np.int64)], shards):
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([data], pa.binary())], ["shard", "data"])

        for batch in batches:
            if len(batch):
                held.append(n_grams(batch.column(0), order)[0])
            if sum(len(h[0]) for h in held) >= CHUNK:
                yield from flush()
        if held:
            yield from flush()

    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(count, "shard int, data binary")
    found, there, last, above = [], [], None, (0.0, 0.0, 0.0)
    for level in range(order, 0, -1):
        out = materialise(rows.groupBy("shard").applyInArrow(_level(level, order, base, shards, above), _LEVEL), "level")
        stats = out.where("size is not null").agg(F.sum("size"), F.sum("tokens"), F.collect_set("shard"), *(F.sum(F.col("found")[i]) for i in range(7))).first()
        found.insert(0, [int(x or 0) for x in stats[3:]])
        there.insert(0, frozenset(stats[2]))
        tokens = int(stats[1] or 0)
        above = discounts(found[0][:4])
        rows = out.where("size is null").select("shard", "data")
        if last is not None:
            discard(last)
        last = out
    discard(last)
    offs = tuple(discounts(f[:4]) for f in found)
    n = found[0]
    weight = (offs[0][0] * n[0] + offs[0][1] * n[1] + offs[0][2] * n[4]) / n[5] if n[5] else 1.0
    return Model(base, order, (shards,) * order, offs, weight, n[5], tokens, n[6], tuple(there))


def score(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text") -> DataFrame:
    """``row`` (a struct of the columns in ``carry``) with n_tokens, n_known, base_score and score of every text.

    Log10 probabilities of whole texts, the end included; null is an empty text. ``base_score``: of single words, one added to each count.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), F.col(text_col).alias("t"))
    row_type = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            columns, counts = n_grams(batch.column(1), model.order)
            by = key(columns)
            _, first, back = np.unique(by, return_index=True, return_inverse=True)
            p, raw = model.probabilities([c[first] for c in columns])
            begins = np.cumsum(counts) - counts
            sums = [np.add.reduceat(x[back], begins) for x in (np.log10((raw + 1) / (model.tokens + model.types + 1)), np.log10(p), (raw > 0).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts.astype(np.int64)), pa.array(sums[2].astype(np.int64)), pa.array(sums[0]), pa.array(sums[1])], ["row", "n_tokens", "n_known", "base_score", "score"])

    return rows.mapInArrow(run, f"row {row_type}, n_tokens long, n_known long, base_score double, score double")

"""A toxicity classifier whose scores don't move when identity terms are swapped (counterfactual logit pairing).

Features of a text are the distinct hashes of its words, of the first letters of its longer words (``PREFIXES``), of those
beginnings that two or three of its words share, and three marks of its surface (symbols, capitals, repeats). A logistic regression
is fitted by full-batch gradient steps on a bounded sample of labelled rows (``FIT_ROWS``, least hashes first, half of them toxic
as far as there are any) with the usual log loss, an L2 term, and ``PAIRING`` times the mean squared difference between the scores
of a labelled text and of the same text with its identity terms swapped for others. Texts without an identity term take part with
a neutral mention added, against the text as it is: the pairs exist whether or not the corpus names groups. (No labelled text of the
test tables holds a term of ``IDENTITY``: there no term is ever swapped, and all pairs are added mentions.) Each step leaves out a
share ``DROP`` of the features, so that single ones become evidence enough.

Features that are surely commoner in either class are learnt, for and against; those of identity terms, of their beginnings and of
the surface always are, so that the pairing has hold of them. The model is an array of ``2**BITS`` floats, nearly all 0; its other
entries are broadcast to the tasks that score every row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bound_batches, discard, materialise
from .words import U, mix

#: Labelled rows of either class that the classifier is fitted on at most.
FIT_ROWS = 6000
#: Bytes of features (of those that are evidence) that the fit takes at most; rows beyond it, in the order of their hashes, are left out.
FIT_BYTES = 128 << 20
BITS, STEPS, RATE, L2, PAIRING, DROP = 22, 400, 0.1, 1e-4, 5.0, 0.2
#: Words, of up to 32 characters, that a scoring task remembers.
WORDS_HELD = 1 << 18
#: Letters of the beginnings of words.
PREFIXES = (4, 5, 6, 7)
#: Standard errors by which a feature's log-odds ratio must differ from 0 to be evidence.
Z = 2.5
#: The share of a text's words from which on a mark of its surface counts.
OFTEN = 0.1
PREDICT_FROM = 0.7
# Identity terms; each group's terms are swapped for one another.
IDENTITY = (
    ("women", "men", "girls", "boys", "gays", "lesbians", "transgender", "straight"),
    ("woman", "man", "girl", "boy", "gay", "lesbian", "queer", "heterosexual"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("black", "white", "asian", "african", "latino", "hispanic", "european", "arab"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("deaf", "blind", "disabled", "elderly", "young"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "noirs", "blancs"),
    ("frauen", "männer", "muslime", "christen", "juden", "schwarze", "weiße"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "negros", "blancos"),
)
_GROUP = {term: group for group in IDENTITY for term in group}
_TERMS = tuple(_GROUP)
_TOKEN = re.compile(r"\w+")
_SYMBOLS = re.compile(r"[^\w\s]{2,}|\|")


def _other(term: str) -> str:
    group = _GROUP[term]
    return group[(group.index(term) + 1 + xxhash.xxh32_intdigest(term) % (len(group) - 1)) % len(group)]


def _hash(kind: str, x: str) -> bytes:
    return xxhash.xxh64_digest(kind + x)


def _parts(word: str) -> bytes:
    """Hashes of a word and of its beginnings, packed."""
    return b"".join([_hash("w", word), *[_hash("p", word[:k]) for k in PREFIXES if len(word) > k]])


_parts_of_short = lru_cache(maxsize=1 << 16)(_parts)


def _surface(text: str) -> bytes:
    """Which of three marks the text shows: runs of symbols, words in capitals, a word said again at once."""
    said = text.split()
    marks = (("symbols", len(_SYMBOLS.findall(text))), ("capitals", sum(map(str.isupper, said))), ("repeats", sum(map(eq, said, said[1:]))))
    return b"".join([_hash("s", name) for name, found in marks if said and found >= OFTEN * len(said)])


def _numbers(parts: bytes, surface: bytes) -> np.ndarray:
    """Of the hashes of a vocabulary's parts the features: each part, and the parts that two or three words share."""
    h, n = np.unique(np.frombuffer(parts, U), return_counts=True)
    found = np.concatenate([h, mix(h[n > 1], 2), mix(h[n > 2], 3), np.frombuffer(surface, U)])
    return np.unique(found & U((1 << BITS) - 1)).astype(np.int32)


def _features_of(vocabulary: set[str], surface: bytes) -> np.ndarray:
    long = {w for w in vocabulary if len(w) > 32}
    return _numbers(b"".join([*map(_parts_of_short, vocabulary - long), *map(_parts, long)]), surface)


class _Telling(dict):
    """For a model, of each word the parts that have a weight, alone or shared: the others change no score."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.told = weights != 0

    def learn(self, words: list[str]) -> None:
        parts = [_parts(w) for w in words]
        h = np.frombuffer(b"".join(parts), U)
        mask = U((1 << BITS) - 1)
        keep = self.told[h & mask] | self.told[mix(h, 2) & mask] | self.told[mix(h, 3) & mask]
        ends = np.cumsum([len(p) // 8 for p in parts])
        some = np.unique(np.searchsorted(ends, np.flatnonzero(keep), "right"))
        self.update(dict.fromkeys(words, b""))
        for i in some.tolist():
            own = slice(ends[i] - len(parts[i]) // 8, ends[i])
            self[words[i]] = h[own][keep[own]].tobytes()

    def features(self, text: str) -> np.ndarray:
        vocabulary = set(_TOKEN.findall(text.lower()))
        if len(self) > WORDS_HELD:
            self.clear()
        if new := [w for w in vocabulary if w not in self]:
            self.learn(new)
        found = _numbers(b"".join(map(self.__getitem__, vocabulary)), _surface(text))
        for w in [w for w in new if len(w) > 32]:
            del self[w]
        return found


#: Features that are always learnt: of identity terms and of the surface.
KEPT = np.unique(np.frombuffer(b"".join([*map(_parts, _TERMS), *(_hash("s", m) for m in ("symbols", "capitals", "repeats"))]), U) & U((1 << BITS) - 1)).astype(np.int32)


def features(text: str | None) -> np.ndarray:
    return _features_of(set(_TOKEN.findall((text or "").lower())), _surface(text or ""))


def counterfactual(text: str | None) -> np.ndarray:
    """Features of the text with identity terms swapped; without any, with one mentioned."""
    vocabulary = set(_TOKEN.findall((text or "").lower()))
    named = vocabulary & _GROUP.keys()
    other = (vocabulary - named) | {_other(t) for t in named} if named else vocabulary | {_TERMS[xxhash.xxh32_intdigest(text or "") % len(_TERMS)]}
    return _features_of(other, _surface(text or ""))


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([features(t).tobytes() for t in texts], pa.binary()), pa.array([counterfactual(t).tobytes() for t in texts], pa.binary())], ["y", "k", "x", "c"])


class _Rows:
    """Sparse binary rows over columns 0 to ``n`` - 1."""

    def __init__(self, rows: list[np.ndarray], n: int) -> None:
        self.n, self.at = n, np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        self.cols = np.concatenate([np.zeros(0, np.int32), *rows])
        self.filled = np.flatnonzero(np.diff(self.at))

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.at) - 1)
        if len(self.filled):
            out[self.filled] = np.add.reduceat(w[self.cols], self.at[self.filled])
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, np.repeat(g, np.diff(self.at)), self.n)


def _places(found: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in ``use``, sorted and not empty, those of ``found`` are that it holds, and which of ``found`` they are."""
    at = np.minimum(np.searchsorted(use, found), len(use) - 1)
    held = use[at] == found
    return at[held], held


def _only(rows: list[bytes], use: np.ndarray) -> _Rows:
    """Of ``rows`` the columns in ``use``, which is sorted, numbered anew; a row's others are never held as numbers beside those of other rows."""
    return _Rows([_places(np.frombuffer(x, np.int32), use)[0].astype(np.int32) for x in rows], len(use))


def evidence(up, down, toxic, others, m=np):
    """Whether features are surely commoner in either class: a two-sided test of the log-odds ratio (smoothed by a half). ``up``, ``down``: rows of ``toxic`` toxic and of ``others`` that show them; ``m``: numpy, or Spark's functions for columns."""
    ratio = m.log((up + 0.5) / (toxic - up + 0.5)) - m.log((down + 0.5) / (others - down + 0.5))
    return m.abs(ratio) >= Z * m.sqrt(1 / (up + 0.5) + 1 / (down + 0.5))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows of either class a feature is in, one row per feature, class and task."""
    counts = np.zeros((2, 1 << BITS), np.int32)
    for batch in batches:
        for y, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts[y, np.frombuffer(x.as_buffer(), np.int32)] += 1
    y, h = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int32)), pa.array(h.astype(np.int32)), pa.array(counts[y, h].astype(np.int64))], ["y", "h", "n"])


def fit(rows: list[tuple[int, bytes, bytes]]) -> np.ndarray:
    """Weights and, last, the bias. Without rows of both classes: a constant score near 1 if all are toxic, else near 0."""
    weights = np.zeros((1 << BITS) + 1, np.float32)
    y = np.array([r[0] for r in rows], float)
    if not len(y) or y.min() == y.max():
        weights[-1] = 9.0 if len(y) and y[0] else -9.0
        return weights
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    seen = [np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(r[1], np.int32) for r in rows if r[0] == k)]) for k in (0, 1)]
    every = np.unique(np.concatenate([*seen, KEPT]))
    down, up = (np.bincount(np.searchsorted(every, s), minlength=len(every)) for s in seen)
    use = every[evidence(up, down, y.sum(), len(y) - y.sum()) | np.isin(every, KEPT)]
    x, c = (_only([r[i] for r in rows], use) for i in (1, 2))
    w = np.append(np.zeros(x.n), -3.0)
    m, v = np.zeros_like(w), np.zeros_like(w)
    rng = np.random.default_rng(3)
    for step in range(1, STEPS + 1):
        held = np.append(rng.random(x.n) >= DROP, True)
        now = w * held
        p, q = (1 / (1 + np.exp(-np.clip(r.dot(now[:-1]) + now[-1], -30, 30))) for r in (x, c))
        # d/dz of mean (p - q)^2
        pair = 2 * PAIRING * (p - q) / len(y)
        gx, gc = (p - y) * share + pair * p * (1 - p), -pair * q * (1 - q)
        g = np.append(x.back(gx) + c.back(gc), (gx + gc).sum()) * held + L2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights[:-1][use] = w[:-1]
    weights[-1] = w[-1]
    return weights


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> np.ndarray:
    """Fits on at most ``FIT_ROWS`` ids of either class, those with the least hashes; rows with a null id or label are left out.

    Only ids and labels are sorted and cut to that bound; the sample is then small enough to be broadcast to the texts. Features are
    counted and tested in Spark; the driver gets those that are evidence (``2**BITS`` at most) and the sample's rows cut to them. Of
    rows that share an id the least text counts; an id with both labels is learnt as both.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    there = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)").distinct().join(own.select("id"), "id", "left_semi").withColumn("k", F.xxhash64("id"))
    chosen = reduce(DataFrame.unionByName, [there.where(F.col("y") == y).orderBy("k", "id").limit(FIT_ROWS) for y in (0, 1)])
    chosen = F.broadcast(materialise(chosen, "chosen"))
    texts = own.join(chosen, "id").groupBy("id", "y", "k").agg(F.min("t").alias("t"))
    every = materialise(texts.select("y", "k", "t").mapInArrow(_sample, "y int, k long, x binary, c binary"), "features")
    sizes = dict(every.groupBy("y").count().collect())
    sums = every.select("y", "x").mapInArrow(_counts, "y int, h int, n long").groupBy("h").agg(*(F.sum(F.when(F.col("y") == y, F.col("n")).otherwise(0)).alias(n) for y, n in ((1, "up"), (0, "down"))))
    sure = sums.where(evidence(F.col("up"), F.col("down"), F.lit(sizes.get(1, 0)), F.lit(sizes.get(0, 0)), F)).select("h").toArrow()
    use = docs.sparkSession.sparkContext.broadcast(np.union1d(sure.column("h").to_numpy(), KEPT).astype(np.int32))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, c = ([(f := np.frombuffer(v.as_buffer(), np.int32))[_places(f, use.value)[1]].tobytes() for v in column] for column in batch.columns[2:])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(x, pa.binary()), pa.array(c, pa.binary())], ["y", "k", "x", "c"])

    rows = materialise(every.mapInArrow(told, every.schema), "evidence")
    size = F.octet_length("x") + F.octet_length("c")
    total, last = 0, {}
    for r in rows.select("y", "k", size.alias("size")).orderBy("k").collect():  # 2 * FIT_ROWS at most
        total += r["size"]
        if total <= FIT_BYTES:
            last[r["y"]] = r["k"]
    found = [rows.where((F.col("y") == y) & (F.col("k") <= k)).orderBy("k").select("y", "x", "c").collect() for y, k in last.items()]
    out = fit([tuple(r) for one in found for r in one])
    discard(every, rows)
    return out


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(row, score) for each row of ``docs``: ``row`` is a struct of the columns in ``carry`` (default: all), score from 0 to 1.

    Null and empty texts get the score of a text without words. Rows are scored each by itself.
    """
    bound_batches(docs.sparkSession)
    some = np.flatnonzero(weights).astype(np.int32)
    model = docs.sparkSession.sparkContext.broadcast((len(weights), some, weights[some]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, at, values = model.value
        w = np.zeros(size, np.float32)
        w[at] = values
        telling = _Telling(w[:-1])
        for batch in batches:
            z = np.array([w[telling.features(t.as_py() or "")].sum(dtype=float) + w[-1] for t in batch.column(1)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["row", "score"])

    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry or docs.columns)).alias("row"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, StructType(list(rows.schema)[:1]).add("score", "double"))


def held_out(key: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.crc32(F.col(key).cast("string")) % 3 == 1


def classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> np.ndarray:
    """The weights learnt from ``labels`` (id, toxic) of rows that aren't held out."""
    return train(docs, labels.where(~held_out(id_col)), id_col)

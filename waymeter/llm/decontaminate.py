"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

The index holds a posting (term, document, position) for every corpus token that some benchmark item uses. A benchmark window (13
words, or a shorter item) is looked up by its rarest term over the whole corpus: that term's postings, less its offset, are
candidate alignments. The remaining terms' postings of those documents, shifted alike, are intersected with them; runs of
consecutive hits as long as a window are exact phrases. Windows with a term that the corpus lacks are never looked up.
Proximity matches are items of whose words a share stands near its place; their candidates come from each item's rarest words.

The vocabulary and the anchors join by broadcast while their measured size is small, otherwise by a shuffle. A phrase that a third
of all documents share costs a row for each occurrence of its rarest term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, few, materialise, release

WINDOW = 13
#: The least share of a document's words, 1 in so many, that makes it contaminated.
SHARE = 20
#: Proximity: the words that one may stand away from its place, and the share of an item's words that must be there.
SLOP, NEAR = 3, 0.8
#: Bytes of terms that may be broadcast.
TERM_BYTES = 16 << 20
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone; texts of one byte a character take the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _split(text: Column) -> Column:
    """Words, with an empty string before or after them where the text begins or ends with other characters."""
    return F.split(F.coalesce(text, F.lit("")), _BETWEEN)


def word_count(text: Column) -> Column:
    w = _split(text)
    return (F.size(w) - (F.get(w, F.lit(0)) == "").cast("int") - ((F.size(w) > 1) & (F.element_at(w, -1) == "")).cast("int")).cast("long")


def tokens(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """(keys, pos, term), positions from 0."""
    w = df.select(*keys, _split(lower_ascii(F.col(text_col))).alias("w")).select(*keys, "w", (F.get("w", F.lit(0)) == "").cast("int").alias("lead"))
    return w.select(*keys, "lead", F.posexplode("w").alias("at", "term")).where("term <> ''").select(*keys, (F.col("at") - F.col("lead")).alias("pos"), "term")


def build_index(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (term, id, v, pos) of the corpus for the distinct ``terms``, written to the shared folder; v, a hash of the text, tells rows of one id apart."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("v"), F.col(text_col).alias("t"))
    size = terms.agg(F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()[0]
    return materialise(tokens(rows, ["id", "v"], "t").join(F.broadcast(terms) if size <= TERM_BYTES else terms, "term"), "postings")


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Distinct items (k, item_id) and their words (k, pos, term, n)."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("t")).distinct().withColumn("k", F.xxhash64("item_id", "t"))
    spelt = tokens(rows, ["k"], "t")
    return rows.select("k", "item_id"), spelt.join(spelt.groupBy("k").agg(F.count("*").cast("int").alias("n")), "k")


def _windows(spelt: DataFrame, freq: DataFrame) -> DataFrame:
    """Anchors (k, ipos, term): of each window whose terms all occur in the corpus the rarest term and its place in the item."""
    starts = spelt.where(F.col("pos") <= F.greatest(F.col("n") - WINDOW, F.lit(0))).select("k", F.col("pos").alias("start"), F.least("n", F.lit(WINDOW)).alias("size"))
    placed = starts.select("k", "start", "size", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("pos"))
    # frequencies meet the items' words, not their windows, in which a common word comes thirteen times as often
    known = placed.join(spelt.select("k", "pos", "term").join(freq, "term"), ["k", "pos"])
    best = known.groupBy("k", "start", "size").agg(F.count("*").alias("found"), F.min_by(F.struct("pos", "term"), F.struct("freq", "pos")).alias("a"))
    return best.where("found = size").select("k", F.col("a.pos").alias("ipos"), F.col("a.term").alias("term")).distinct()


def candidates(postings: DataFrame, anchors: DataFrame) -> DataFrame:
    """Alignments (id, v, k, diag): an item's first word would stand at word ``diag`` of the document."""
    size = anchors.agg(F.coalesce(F.sum(F.octet_length("term") + 32), F.lit(0))).first()[0]
    met = postings.join(F.broadcast(anchors) if size <= TERM_BYTES else anchors, "term")
    return met.select("id", "v", "k", (F.col("pos") - F.col("ipos")).alias("diag")).distinct()


def phrase_matches(postings: DataFrame, spelt: DataFrame, aligned: DataFrame) -> DataFrame:
    """Exact phrases (id, v, k, first, size): runs of at least a window, by intersecting the shifted posting lists of all terms."""
    docs = few(aligned.select("id", "v").distinct())
    own = postings.join(docs, postings["id"].eqNullSafe(docs["id"]) & (postings["v"] == docs["v"]), "left_semi").select(F.col("id").alias("_id"), F.col("v").alias("_v"), "pos", "term")
    expected = aligned.join(spelt, "k").select("id", "v", "k", "diag", "n", F.col("pos").alias("ipos"), "term", (F.col("diag") + F.col("pos")).alias("at"))
    hits = expected.join(own, F.col("id").eqNullSafe(F.col("_id")) & (F.col("v") == F.col("_v")) & (F.col("at") == F.col("pos")) & (expected["term"] == own["term"])).select("id", "v", "k", "diag", "n", "ipos").distinct()
    run = F.col("ipos") - F.row_number().over(Window.partitionBy("id", "v", "k", "diag").orderBy("ipos"))
    runs = hits.withColumn("run", run).groupBy("id", "v", "k", "diag", "n", "run").agg(F.min("ipos").alias("lo"), F.count("*").cast("int").alias("size"))
    return runs.where(F.col("size") >= F.least("n", F.lit(WINDOW))).select("id", "v", "k", (F.col("diag") + F.col("lo")).alias("first"), "size")


def near_candidates(postings: DataFrame, spelt: DataFrame, freq: DataFrame, slop: int, share: float, sure: int = 3) -> DataFrame:
    """Every alignment (id, v, k, diag) at which ``share`` of an item's words may stand within ``slop`` words of their place.

    Of an item's n words so many, say a, may be missing. Of its a + ``sure`` rarest words, those that the corpus lacks among them,
    at least ``sure`` must then be in place, so the postings of these words alone tell which alignments are possible.
    """
    width, missing = 2 * slop + 1, F.col("n") - F.ceil(share * F.col("n"))
    order = F.row_number().over(Window.partitionBy("k").orderBy("freq", "pos"))
    rare = spelt.join(freq, "term", "left").withColumn("freq", F.coalesce("freq", F.lit(0))).withColumn("r", order)
    rare = rare.where(F.col("r") <= missing + sure).select("k", F.col("pos").alias("ipos"), "term", (F.least(F.col("n"), missing + sure) - missing).alias("least"))
    size = rare.agg(F.coalesce(F.sum(F.octet_length("term") + 40), F.lit(0))).first()[0]
    met = postings.join(F.broadcast(rare) if size <= TERM_BYTES else rare, "term").withColumn("b", F.floor((F.col("pos") - F.col("ipos")) / width).cast("int"))
    # words within slop of one alignment lie in two neighbouring bins of diagonals
    bins = met.select("id", "v", "k", "least", "ipos", F.explode(F.array(F.col("b") - 1, F.col("b"))).alias("b"))
    bins = bins.groupBy("id", "v", "k", "b").agg(F.countDistinct("ipos").alias("found"), F.first("least").alias("least")).where("found >= least")
    low = F.col("b") * width + slop
    return bins.select("id", "v", "k", F.explode(F.sequence(low, low + width - 1)).alias("diag"))


def proximity_matches(postings: DataFrame, spelt: DataFrame, aligned: DataFrame, slop: int = SLOP, share: float = NEAR) -> DataFrame:
    """(id, v, k, diag, found): alignments at which at least ``share`` of the item's words stand within ``slop`` words of their place."""
    width = 2 * slop + 1
    docs = few(aligned.select("id", "v").distinct())
    own = postings.join(docs, postings["id"].eqNullSafe(docs["id"]) & (postings["v"] == docs["v"]), "left_semi")
    own = own.select(F.col("id").alias("_id"), F.col("v").alias("_v"), F.col("pos").alias("at"), F.col("term").alias("_term"), F.floor(F.col("pos") / width).alias("_b"))
    place = F.col("diag") + F.col("ipos")
    expected = aligned.join(spelt, "k").select("id", "v", "k", "diag", "n", F.col("pos").alias("ipos"), "term")
    expected = expected.select("*", F.explode(F.sequence(F.floor((place - slop) / width), F.floor((place + slop) / width))).alias("b"))
    hits = expected.join(own, F.col("id").eqNullSafe(F.col("_id")) & (F.col("v") == F.col("_v")) & (F.col("term") == F.col("_term")) & (F.col("b") == F.col("_b"))).where(F.abs(F.col("at") - place) <= slop)
    return hits.groupBy("id", "v", "k", "diag", "n").agg(F.countDistinct("ipos").alias("found")).where(F.col("found") >= share * F.col("n")).drop("n")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", near: bool = False) -> DataFrame:
    """(id, n_words, n_hit, n_items, items, contaminated) for each row of ``docs``; ``items`` are the item ids, as sorted strings.

    Null or empty texts and items have no words. Rows equal in id and text are judged alike, rows of one id with other texts each by
    itself, rows with a null id too. Items that share an id count once; an item without an id makes hits but is not listed.
    ``near`` adds near_items, the ids of items found by proximity as a whole (an exact window alone is not enough); ``contaminated`` stays exact.
    """
    spark = docs.sparkSession
    items, spelt = _items(benchmark, item_col, item_text_col)
    spelt = materialise(spelt, "items")
    postings = build_index(docs, spelt.select("term").distinct(), id_col, text_col)
    freq = postings.groupBy("term").agg(F.count("*").alias("freq"))
    aligned = materialise(candidates(postings, _windows(spelt, freq)), "aligned")
    phrases = materialise(phrase_matches(postings, spelt, aligned), "phrases")
    if near:
        possible = materialise(near_candidates(postings, spelt, freq, SLOP, NEAR), "possible")
        close = materialise(proximity_matches(postings, spelt, possible).select("id", "v", "k").distinct(), "close")
        discard(possible)
    discard(postings, aligned)
    release(spark)
    hit = phrases.select("id", "v", F.explode(F.expr("sequence(first, first + size - 1)")).alias("pos")).distinct().groupBy("id", "v").agg(F.count("*").alias("n_hit"))
    named = phrases.select("id", "v", "k").distinct().join(items, "k").groupBy("id", "v").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = hit.join(named, hit["id"].eqNullSafe(named["id"]) & (hit["v"] == named["v"])).select(hit["id"].alias("_id"), hit["v"].alias("_v"), "n_hit", "items")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("v"), word_count(F.col(text_col)).alias("n_words"))
    out = rows.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("v") == F.col("_v")), "left")
    more = []
    if near:
        close = close.join(items, "k").groupBy("id", "v").agg(F.array_sort(F.collect_set("item_id")).alias("near_items"))
        close = close.select(F.col("id").alias("_id1"), F.col("v").alias("_v1"), "near_items")
        out = out.join(close, F.col("id").eqNullSafe(F.col("_id1")) & (F.col("v") == F.col("_v1")), "left")
        more = [F.coalesce("near_items", F.array().cast("array<string>")).alias("near_items")]
    n_hit, listed = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(F.col("id").alias(id_col), "v", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), listed.alias("items"), ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"), *more)

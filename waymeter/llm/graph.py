"""Connected components by star contraction, as joins on tables in the shared folder; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _jump(parent: DataFrame) -> DataFrame:
    """Follows (id, root) pointers to their ends by doubling; pointers go to smaller ids, so they end."""
    while True:
        q = parent.select(F.col("id").alias("_q"), F.col("root").alias("_far"))
        far = parent.join(q, F.col("root") == F.col("_q"), "left").select("id", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("moved"))
        far = materialise(far, "jump")
        discard(parent)
        parent = far.select("id", "root")
        if far.where("moved").isEmpty():
            return parent


def components(edges: DataFrame) -> DataFrame:
    """Labels of the graph whose ``edges`` are columns (a, b): (id, root), root being the smallest id reachable.

    Each round hooks every id to its smallest smaller neighbour, follows those pointers to their ends and joins the edges anew on
    what they lead to; ids that have a smaller neighbour are gone after a round, so few rounds are needed. Ids that are their own
    root don't occur as ``id``. Null ends, loops and repeated edges are ignored.
    """
    links = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    labels = None
    while True:
        parent = links.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("root"))
        parent = _jump(materialise(parent, "parent"))
        if labels is None:
            labels = parent
        else:
            p = parent.select(F.col("id").alias("_p"), F.col("root").alias("_new"))
            old, labels = labels, materialise(labels.join(p, F.col("root") == F.col("_p"), "left").select("id", F.coalesce("_new", "root").alias("root")).unionByName(parent), "labels")
            discard(old)
        lo, hi = (parent.select(F.col("id").alias(f"_{c}"), F.col("root").alias(f"_to_{c}")) for c in ("lo", "hi"))
        on = links.join(hi, F.col("hi") == F.col("_hi")).join(lo, F.col("lo") == F.col("_lo"), "left")
        ends = F.col("_to_hi"), F.coalesce("_to_lo", "lo")
        nxt = materialise(on.select(F.greatest(*ends).alias("hi"), F.least(*ends).alias("lo")).where("hi <> lo").distinct(), "links")
        discard(links)
        links = nxt
        if links.isEmpty():
            return labels

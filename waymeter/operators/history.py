"""Whether people have looked at a way since its import: its last version first, its whole history where that doesn't tell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values.
IMPORT_USERS = ("DaveHansenTiger", "DaveHansen-TIGER", "TIGERcnl", "bot-mode", "Yellowbkpk", "TIGER_Ohio_Mapper", "emacsen", "woodpeck_fixbot", "balrog-kun", "Sundance")
BOT_NAME = "^(josm|bot-|import|fix|cleanup)"
REVIEW_TAGS = ("surface", "lanes", "maxspeed", "sidewalk", "cycleway", "lit", "turn:lanes", "turn:lanes:forward", "turn:lanes:backward", "parking:lane", "width", "foot", "bicycle", "access", "motor_vehicle", "hgv", "bridge", "tunnel", "layer", "service", "destination", "note")
WATCHED = ("oneway", "highway", "name", "junction", "access")


def import_user(user: Column) -> Column:
    """A known import account or a bot's name; null and empty are neither."""
    return F.coalesce(user.isin(*IMPORT_USERS) | F.lower(user).rlike(BOT_NAME), F.lit(False))


def by_last_version(ways: DataFrame) -> DataFrame:
    """``ways`` (version, usr) with status and confidence, null where the history must tell."""
    v, human = F.col("version"), ~import_user(F.col("usr"))
    status = F.when(v == 1, "UNREVIEWED").when((v >= 2) & human, "LIKELY_REVIEWED")
    confidence = F.when(v == 1, 0.95).when((v >= 2) & human, F.least(0.6 + (v - 2) * 0.05, F.lit(0.85)))
    return ways.withColumns({"status": status, "confidence": confidence})


def edits(versions: DataFrame) -> DataFrame:
    """``versions`` (way_id, version, usr, tags map, nodes array) with ``reason``: what a person's edit changed that matters, null if nothing."""
    w = Window.partitionBy("way_id").orderBy("version")
    v = versions.withColumns({"before": F.lag("tags").over(w), "nodes_before": F.lag("nodes").over(w)})
    other = lambda k: k.startswith("tiger:") | k.isin("source", "source:name")
    old, new = F.col("before"), F.col("tags")
    at = lambda m, k: F.try_element_at(m, F.lit(k) if isinstance(k, str) else k)
    added = F.array_sort(F.array_intersect(F.array_except(F.map_keys(new), F.map_keys(old)), F.array(*map(F.lit, REVIEW_TAGS))))
    only_other = F.forall(F.array_union(F.map_keys(old), F.map_keys(new)), lambda k: other(k) | at(old, k).eqNullSafe(at(new, k)))
    same_nodes = F.col("nodes").eqNullSafe(F.col("nodes_before"))
    plus, minus = F.size(F.array_except("nodes", "nodes_before")), F.size(F.array_except("nodes_before", "nodes"))
    changed = F.coalesce(*(F.when(~at(old, k).eqNullSafe(at(new, k)), F.concat(F.lit(f"changed '{k}': "), F.coalesce(at(old, k), F.lit("(absent)")), F.lit(" → "), F.coalesce(at(new, k), F.lit("(removed)")))) for k in WATCHED))
    moved = F.concat(F.lit("modified way geometry (+"), plus.cast("string"), F.lit("/-"), minus.cast("string"), F.lit(" nodes)"))
    what = F.when(F.size(added) > 0, F.concat(F.lit("added review-indicating tags: "), F.array_join(added, ", "))).when(changed.isNotNull(), changed).when(~same_nodes & ((plus > 0) | (minus > 0)), moved)
    what = F.concat(F.lit("Version "), F.col("version").cast("string"), F.lit(" by '"), F.coalesce("usr", F.lit("None")), F.lit("' "), what)
    counts = old.isNotNull() & ~import_user(F.col("usr")) & ~(only_other & same_nodes)
    return v.withColumn("reason", F.when(counts, what)).drop("before", "nodes_before")


def by_history(versions: DataFrame) -> DataFrame:
    """(way_id, status, confidence, reason) from whole histories; the first edit that matters is the reason."""
    g = edits(versions).groupBy("way_id").agg(F.bool_and(import_user(F.col("usr"))).alias("bots"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("version"))).alias("reason"))
    status = F.when(F.col("bots"), "UNREVIEWED").when(F.col("reason").isNotNull(), "LIKELY_REVIEWED").otherwise("INCONCLUSIVE")
    return g.select("way_id", status.alias("status"), F.when(F.col("bots"), 0.9).when(F.col("reason").isNotNull(), 0.75).otherwise(0.5).alias("confidence"), F.when(~F.col("bots"), F.col("reason")).alias("reason"))


def review(ways: DataFrame, versions: DataFrame) -> DataFrame:
    """``ways`` with status and confidence; only those that the last version leaves open meet their history (0.3 without one)."""
    first = by_last_version(ways)
    open_ = first.where("status is null").drop("status", "confidence")
    told = by_history(versions.join(open_.select(F.col("id").alias("way_id")), "way_id", "left_semi")).select(F.col("way_id").alias("id"), "status", "confidence")
    later = open_.join(told, "id", "left").withColumns({"status": F.coalesce("status", F.lit("INCONCLUSIVE")), "confidence": F.coalesce("confidence", F.lit(0.3))})
    return first.where("status is not null").unionByName(later)

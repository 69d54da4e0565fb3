"""What a finding does to routes: the live route against the one without it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REAL_PCT, NOISY_PCT = 15.0, 3.0


def decide(routes: DataFrame) -> DataFrame:
    """``routes`` (id, kind, live_m, perturbed_m; null: unreachable) with delta_pct, decision and confidence."""
    live, new, node = F.col("live_m"), F.col("perturbed_m"), F.col("kind").isin("barrier_unqualified", "broken_turn_restriction")
    pct = F.abs(new - live) / F.greatest(live, F.lit(1.0)) * 100
    delta = F.when(live.isNotNull() & new.isNotNull(), pct).when(live.isNull() & (new.isNull() | node), 0.0).otherwise(100.0)
    lost = live.isNull() != new.isNull()
    decision = F.when(live.isNull() & (new.isNull() | node), "inconclusive").when(lost, "real").when(pct > REAL_PCT, "real").when(pct < NOISY_PCT, "noisy").otherwise("inconclusive")
    confidence = F.when(live.isNull() & (new.isNull() | node), 0.2).when(lost, 0.9).otherwise(0.4 + F.least(pct, F.lit(30.0)) / 30 * 0.45)
    return routes.withColumns({"delta_pct": delta, "decision": decision, "confidence": confidence})


def tested(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """``asked`` (id, kind, origin, destination, nogo) with live_m, live_s, perturbed_m and perturbed_s: the landed answers (origin, destination, nogo, length_m, duration_s) to the same question without and with the place to avoid.

    Texts are keys: places as "lon,lat" to six digits, ``nogo`` as "lon,lat,radius" or '' for none. An answer without a length, as a
    service's refusal is kept, is an unreachable place like a question that nobody has answered.
    """
    one = lambda side: answers.groupBy("origin", "destination", "nogo").agg(F.max(F.struct("length_m", "duration_s")).alias(side))
    live = one("live").where("nogo = ''").drop("nogo")
    out = asked.join(live, ["origin", "destination"], "left").join(one("new"), ["origin", "destination", "nogo"], "left")
    return out.select(*asked.columns, F.col("live.length_m").alias("live_m"), F.col("live.duration_s").alias("live_s"), F.col("new.length_m").alias("perturbed_m"), F.col("new.duration_s").alias("perturbed_s"))


def lonlat(lat: Column, lon: Column) -> Column:
    """A place as routing services take it."""
    return F.format_string("%.6f,%.6f", lon, lat)


def nogo_radius(length_m: Column) -> Column:
    """How far to keep from a way's middle: half its length, from 20 to 60 m."""
    return F.greatest(F.lit(20.0), F.least(F.greatest(length_m, F.lit(1.0)) * 0.5, F.lit(60.0)))


# Fixes that change where one may drive.
ONEWAY_FIXES = ("set_oneway_cagis", "remove_oneway_cagis")


def fix_impact(proposed: DataFrame, decided: DataFrame) -> DataFrame:
    """``proposed`` (id, kind) with what routes say of each fix: decision, delta_pct, shift_s and, for those that none can test, ``skipped``, the reason.

    ``decided`` (id, decision, delta_pct, live_s, perturbed_s) has the routes of ways whose one-way is in question.
    """
    d = decided.groupBy("id").agg(F.max(F.struct("decision", "delta_pct", (F.coalesce("perturbed_s", F.lit(0)) - F.coalesce("live_s", F.lit(0))).alias("shift_s"))).alias("d"))
    can = F.col("kind").isin(*ONEWAY_FIXES)
    j = proposed.join(d, "id", "left")
    reason = F.when(~can, F.concat(F.lit("kind '"), "kind", F.lit("' does not perturb the routing graph"))).when(F.col("d").isNull(), "no route could be asked for")
    return j.select(*proposed.columns, *(F.when(can, F.col(f"d.{c}")).alias(c) for c in ("decision", "delta_pct", "shift_s")), reason.alias("skipped"))


def impact_summary(impact: DataFrame) -> DataFrame:
    """One row of :func:`fix_impact`: fixes in all, tested, skipped, by decision; of real ones the mean and largest change in per cent and the mean shift in seconds, 0 without any."""
    real, n = F.col("decision") == "real", F.count_if
    mean = lambda c: F.coalesce(F.avg(F.when(real, F.col(c))), F.lit(0.0))
    return impact.agg(F.count("*").alias("fixes_total"), n(F.col("decision").isNotNull()).alias("fixes_tested"), n(F.col("decision").isNull()).alias("fixes_skipped"), *(n(F.col("decision") == k).alias(k) for k in ("real", "inconclusive", "noisy")), mean("delta_pct").alias("mean_pct"), F.coalesce(F.max(F.when(real, F.col("delta_pct"))), F.lit(0.0)).alias("most_pct"), mean("shift_s").alias("mean_shift_s"))


def impact_by_kind(decided: DataFrame) -> DataFrame:
    """(kind, n, mean_pct, most_pct) of findings whose routes show them to be real."""
    return decided.where("decision = 'real'").groupBy("kind").agg(F.count("*").alias("n"), F.avg("delta_pct").cast("double").alias("mean_pct"), F.max("delta_pct").cast("double").alias("most_pct"))


def decisions(decided: DataFrame) -> DataFrame:
    """(decision, n) with every decision, also those that don't occur."""
    kinds = decided.sparkSession.createDataFrame([(x,) for x in ("real", "noisy", "inconclusive", "untested")], "decision string")
    n = decided.groupBy(F.coalesce("decision", F.lit("untested")).alias("decision")).agg(F.count("*").alias("n"))
    return kinds.join(n, "decision", "left").select("decision", F.coalesce("n", F.lit(0)).alias("n"))

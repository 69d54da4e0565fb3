"""Ways into defect classes: A, a suspicious one-way; B, a street in several segments; AB, both; C, neither."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.tables import written
from ..functions.text import blank, norm_name, oneway_truthy, unnamed_label
from .spatial import within

# Fixed values.
CLASS_A_HIGHWAYS = ("residential", "unclassified", "tertiary", "service")
ONEWAY_SERVICES = ("parking_aisle", "driveway", "alley", "emergency_access", "drive-through", "drive_through")
CLASS_RANK = ("AB", "A", "B", "C")


def isin(x: Column, values: tuple[str, ...]) -> Column:
    return F.coalesce(x.isin(*values), F.lit(False))


def class_a(unnamed_service: bool = False) -> Column:
    """A one-way on a small road, but for services that are rightly one-way and, unless asked for, unnamed service roads."""
    service = F.col("highway") == "service"
    right = service & isin(F.col("service"), ONEWAY_SERVICES)
    unnamed = service & F.col("name_key").isNull() & blank(F.col("service"))
    return isin(F.col("highway"), CLASS_A_HIGHWAYS) & oneway_truthy(F.col("oneway")) & ~F.coalesce(right, F.lit(False)) & (F.lit(unnamed_service) | ~F.coalesce(unnamed, F.lit(False)))


def class_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CLASS_RANK)), c)


def classify(ways: DataFrame, unnamed_service: bool = False) -> DataFrame:
    """``ways`` with name_key, name_display, segments (ways of that street), defect_class and severity. A null name is no street; repeated rows count as segments."""
    named = ways.withColumn("name_key", norm_name(F.col("name"))).withColumn("name_display", F.when(blank(F.col("name")), unnamed_label(F.col("highway"), F.col("service"))).otherwise(F.col("name")))
    # streets are counted by an aggregate and joined: a frequent name is summed before the shuffle
    streets = named.where("name_key is not null").groupBy("name_key").agg(F.count("*").alias("segments"))
    out = named.join(streets, "name_key", "left").withColumn("segments", F.coalesce("segments", F.lit(0)))
    a, b = class_a(unnamed_service), F.col("segments") >= 2
    out = out.withColumn("defect_class", F.when(a & b, "AB").when(a, "A").when(b, "B").otherwise("C"))
    return out.withColumn("severity", F.when(F.col("defect_class").isin("A", "AB"), "CRITICAL").when(F.col("defect_class") == "B", "HIGH").otherwise("LOW"))


def histogram(ways: DataFrame, by: str) -> DataFrame:
    return ways.groupBy(F.coalesce(F.nullif(F.col(by), F.lit("")), F.lit("(unset)")).alias(by)).agg(F.count("*").alias("n"))


def streets(classified: DataFrame) -> DataFrame:
    """Class-B streets: name_key, display name of the first way, ids in order."""
    return classified.where("segments >= 2").groupBy("name_key").agg(F.min_by("name_display", "id").alias("name"), F.count("*").alias("segments"), F.array_sort(F.collect_list("id")).alias("ids"))


#: Streets of as many ways at most meet as a whole, larger ones by grid cell.
SMALL = 64


def gap_pairs(classified: DataFrame, within_m: float = 30.0, touching_m: float = 0.01) -> DataFrame:
    """Pairs of ways of one street whose nearest ends are apart, but by no more than ``within_m``: way1 < way2, street, distance_m, lat, lon (between the ends).

    Ways of small streets meet by street alone. Ends of larger ones meet by street and grid cell, so that a name that a third of all
    ways bear is spread over the map's cells.
    """
    ends = classified.where("segments >= 2 and size(geometry) >= 2").select("name_key", "name_display", "id", "segments", geo.first(F.col("geometry")).alias("p0"), geo.last(F.col("geometry")).alias("p1"))
    right = lambda df: df.select("name_key", F.col("id").alias("id2"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
    small, large = (ends.where(c).drop("segments") for c in (f"segments <= {SMALL}", f"segments > {SMALL}"))
    spots = large.select("*", F.explode(F.array("p0", "p1")).alias("_p")).select("*", "_p.lat", "_p.lon").drop("_p")
    other = spots.select("name_key", F.col("id").alias("id2"), "lat", "lon")
    near = within(spots.select("name_key", "id", "lat", "lon"), other, within_m, ["id2"], on=("name_key",)).where("id < id2").select("name_key", "id", "id2").distinct()
    met = small.join(right(small), "name_key").where("id < id2").unionByName(near.join(large, ["name_key", "id"]).join(right(large), ["name_key", "id2"]))
    # an exploded array is worked out once, a column again for each condition on it
    valid = lambda p: geo.valid(p["lat"], p["lon"])
    ends4 = F.array(*(F.struct(F.col(f"p{i}").alias("p"), F.col(f"q{j}").alias("q"), F.lit(2 * i + j).alias("o")) for i in (0, 1) for j in (0, 1)))
    apart = lambda e: F.when(valid(e["p"]) & valid(e["q"]) & (F.abs(e["p"]["lon"] - e["q"]["lon"]) <= 180), F.struct(geo.between(e["p"], e["q"]).alias("d"), e["o"].alias("o")))
    # in degrees of latitude alone; those left are measured
    step = within_m / 110_000
    close = F.greatest(F.least("p0.lat", "p1.lat") - F.greatest("q0.lat", "q1.lat"), F.least("q0.lat", "q1.lat") - F.greatest("p0.lat", "p1.lat")) <= step
    best = met.where(close).select("*", F.inline(F.array(F.array_min(F.transform(ends4, apart))))).where((F.col("d") > touching_m) & (F.col("d") <= within_m))
    half = lambda c: ((F.when(F.col("o") < 2, F.col(f"p0.{c}")).otherwise(F.col(f"p1.{c}")) + F.when(F.col("o") % 2 == 0, F.col(f"q0.{c}")).otherwise(F.col(f"q1.{c}"))) / 2).alias(c)
    return best.select("name_key", F.col("name_display").alias("street"), F.col("id").alias("way1_id"), F.col("id2").alias("way2_id"), F.col("d").alias("distance_m"), half("lat"), half("lon"))


def cluster_gaps(gaps: DataFrame, within_m: float = 5.0) -> DataFrame:
    """Gaps that are not within ``within_m`` of a kept smaller gap of their street, ties in the order of ids.

    Decided in rounds: gaps without an undecided smaller neighbour are kept and take out their neighbours. No street is gathered.
    """
    gaps = written(gaps, "gaps")
    place = F.struct(F.floor(F.col("distance_m") * 10 + 0.5).alias("d"), "way1_id", "way2_id")
    a = gaps.select("name_key", "lat", "lon", place.alias("lo"))
    near = within(a, a.withColumnRenamed("lo", "hi"), within_m, ["hi"], on=("name_key",), wide=4).where("lo < hi")
    left, gone = written(near.select("lo", "hi"), "near"), None
    while not left.isEmpty():
        kept = left.select("lo").join(left.select(F.col("hi").alias("lo")), "lo", "left_anti").distinct()
        out = written(left.join(kept, "lo").select("hi").distinct(), "gone")
        gone = out if gone is None else gone.unionByName(out)
        decided = kept.unionByName(out.withColumnRenamed("hi", "lo"))
        left = written(left.join(decided, "lo", "left_anti").join(out, "hi", "left_anti").select("lo", "hi"), "near")
    if gone is None:
        return gaps
    return gaps.join(gone.select("hi.way1_id", "hi.way2_id"), ["way1_id", "way2_id"], "left_anti").select(*gaps.columns)


#: Kinds of findings and what their counts are called in a summary.
COUNTED = {"oneway_minus_one": "findings_oneway_minus_one", "oneway_conflict": "findings_oneway_conflicts", "access_blocked": "findings_access_blocked", "barrier_unqualified": "findings_barriers_unqualified", "broken_turn_restriction": "findings_broken_turn_restrictions", "arterial_named_residential": "findings_arterial_named_residential", "missing_maxspeed": "findings_missing_maxspeed", "bus_stop_misplaced": "findings_bus_stops_misplaced"}


def whole_summary(classified: DataFrame, gaps: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: :func:`summary`, the number of gaps, of findings of each kind, and of all findings. Each table is read once; the three rows are put side by side."""
    kinds = findings.agg(*(F.count_if(F.col("kind") == k).alias(c) for k, c in COUNTED.items()), F.count("*").alias("findings_total"))
    parts = [summary(classified), gaps.agg(F.count("*").alias("gaps_found")), kinds]
    rows = [p.select(F.lit(1).alias("_one"), "*") for p in parts]
    return rows[0].join(rows[1], "_one").join(rows[2], "_one").drop("_one")


def summary(classified: DataFrame) -> DataFrame:
    """One row of counts."""
    n = lambda c: F.count_if(c).alias
    k = F.col("defect_class")
    return classified.agg(
        F.count("*").alias("total_ways"), n(F.col("highway") == "residential")("residential"), n(oneway_truthy(F.col("oneway")))("oneway_total"), n(k.isin("A", "AB"))("class_a_count"), n(k == "AB")("class_ab_count"),
        n(k.isin("B", "AB"))("class_b_way_count"), n(k == "C")("class_c_count"), F.countDistinct(F.when(F.col("segments") >= 2, F.col("name_key"))).alias("class_b_streets"), n(F.size("geometry") == 0)("missing_geometry"),
    )

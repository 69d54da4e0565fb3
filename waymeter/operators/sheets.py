"""The audit's workbook: eight sheets of rows, as the workbook sink takes them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.ranking import numbered
from ..functions.tables import written
from ..functions.text import oneway_truthy
from .classify import class_rank

# The sheets in their order, and the work that a defect asks for.
SHEETS = ("Executive Summary", "Class A - Highest Risk", "Class A - Moderate Risk", "Class B - Multi-Segment", "All Ways", "Zones", "Work Plan", "Query")
WORK = (("P1", "class AB", 12), ("P2", "class A alone", 4), ("P3", "streets of class B", 7), ("P4", "other residential ways", 2))
SEGMENTS = 5


def facts(classified: DataFrame) -> DataFrame:
    """One row of what the first and the seventh sheet count. Here a one-way is the exact value yes, but in ``oneways``."""
    k, home = F.col("defect_class"), F.coalesce(F.col("highway") == "residential", F.lit(False))
    return classified.agg(
        F.count("*").alias("total"), F.count_if(home).alias("residential"), F.count_if(home & (F.col("oneway") == "yes")).alias("residential_oneway"), F.count_if(oneway_truthy(F.col("oneway"))).alias("oneways"),
        F.countDistinct(F.when(F.col("segments") >= 2, F.col("name_key"))).alias("streets_b"), F.count_if(k == "AB").alias("ways_ab"), F.count_if(k == "A").alias("ways_a"), F.count_if(k.isin("A", "AB")).alias("ways_a_ab"),
    )


def metrics(classified: DataFrame) -> DataFrame:
    """(place, metric, value): the first sheet's figures; the last is the share of residential ways in per cent, to one digit, null of no ways."""
    names = ("total", "residential", "residential_oneway", "oneways", "streets_b", "ways_ab")
    share = geo.rounded(F.try_divide(100.0 * F.col("residential"), F.col("total")), 1)
    rows = [F.struct(F.lit(i).alias("place"), F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for i, n in enumerate(names, 1)]
    rows.append(F.struct(F.lit(len(names) + 1).alias("place"), F.lit("residential_pct").alias("metric"), share.alias("value")))
    return facts(classified).select(F.inline(F.array(*rows)))


def work_plan(classified: DataFrame) -> DataFrame:
    """(phase, work, items, minutes, hours) of the four phases; the last takes residential ways without a false one-way."""
    items = (F.col("ways_ab"), F.col("ways_a"), F.col("streets_b"), F.greatest(F.col("residential") - F.col("ways_a_ab"), F.lit(0)))
    rows = [F.struct(F.lit(p).alias("phase"), F.lit(w).alias("work"), n.cast("long").alias("items"), F.lit(m).alias("minutes"), (n * m / 60.0).alias("hours")) for (p, w, m), n in zip(WORK, items, strict=True)]
    return facts(classified).select(F.inline(F.array(*rows)))


def streets_ab(classified: DataFrame) -> DataFrame:
    """(street, segments, ids) of ways of class AB, by the name shown."""
    g = classified.where("defect_class = 'AB'").groupBy(F.col("name_display").alias("street")).agg(F.count("*").alias("segments"), F.array_sort(F.collect_list("id")).alias("ids"))
    return g.withColumn("ids", F.array_join(F.transform("ids", lambda i: i.cast("string")), ", "))


def streets_b(classified: DataFrame, least: int = SEGMENTS) -> DataFrame:
    """(key, street, segments, oneways, types) of streets with many ways; the name is the first way's."""
    kind = F.coalesce(F.when(F.col("highway") != "", F.col("highway")), F.lit("(unset)"))
    g = classified.where("segments >= 2").groupBy(F.col("name_key").alias("key")).agg(F.min_by("name_display", "id").alias("street"), F.count("*").alias("segments"), F.count_if(F.col("oneway") == "yes").alias("oneways"), F.array_join(F.array_sort(F.collect_set(kind)), ", ").alias("types"))
    return g.where(F.col("segments") >= least)


def zones(known: DataFrame, counted: DataFrame, own: str, total: Column) -> DataFrame:
    """(zone, status, segments, notes) of zones (key, name, description): those that are audited, ``own`` with ``total``, others by ``counted`` (key, n), and those that aren't yet."""
    j = known.join(counted, "key", "left")
    n = F.when(F.col("key") == own, total).otherwise(F.col("n"))
    return j.select("key", F.col("name").alias("zone"), F.when(n.isNotNull(), "AUDIT COMPLETE").otherwise("NOT STARTED").alias("status"), n.alias("segments"), F.col("description").alias("notes"))


def _said(*values: Column | str) -> Column:
    """Cells: numbers stay numbers."""
    number = lambda c: F.struct(c.cast("double").alias("n"), F.lit(None).cast("string").alias("s"))
    text = lambda c: F.struct(F.lit(None).cast("double").alias("n"), F.coalesce(c.cast("string"), F.lit("")).alias("s"))
    return F.array(*(v if isinstance(v, Column) else number(F.col(v[1:])) if v[0] == "=" else text(F.col(v)) for v in values))


def _sheet(no: int, rows: DataFrame, header: list[str], cells: list[Column | str], order: list[str]) -> DataFrame:
    """A sheet's rows behind its header, in the order given, which should have no ties; ``rank`` counts them from 0."""
    name, spark = SHEETS[no - 1], rows.sparkSession
    body = numbered(rows, order).withColumn("#", F.col("rank") + 1)
    body = body.select(F.lit(no).alias("sheet_no"), F.lit(name).alias("sheet"), (F.col("rank") + 1).cast("long").alias("place"), _said(*cells).alias("cells"))
    top = spark.range(1).select(F.lit(no).alias("sheet_no"), F.lit(name).alias("sheet"), F.lit(0).cast("long").alias("place"), F.array(*(F.struct(F.lit(None).cast("double").alias("n"), F.lit(h).alias("s")) for h in header)).alias("cells"))
    return top.unionByName(body)


def workbook(classified: DataFrame, known_zones: DataFrame, counted: DataFrame, own: str, index_street: str = "", query: str = "") -> DataFrame:
    """All eight sheets. ``classified`` may have tiger_cfcc, tiger_name_base, status (of the review), usr and timestamp; what it hasn't is empty."""
    for c in ("tiger_cfcc", "tiger_name_base", "status", "usr", "timestamp"):
        if c not in classified.columns:
            classified = classified.withColumn(c, F.lit(None).cast("string"))
    ways = classified.withColumns({"_name": F.lower("name_display"), "_class": class_rank(F.col("defect_class")), "todo": F.when((F.lit(index_street) != "") & (F.trim("name") == index_street), "INDEX CASE").otherwise("Not started")})
    ways = written(ways.drop("geometry"), "ways")
    start = F.lit("Not started")
    total = ways.agg(F.count("*").alias("_total"))
    zoned = zones(known_zones.join(total.withColumn("key", F.lit(own)), "key", "left"), counted, own, F.col("_total"))
    lines = ways.sparkSession.createDataFrame([(i, line) for i, line in enumerate(query.splitlines())] or [(0, "")], "line long, text string")
    plan = work_plan(ways)
    plan = plan.unionByName(plan.agg(F.sum("hours").alias("hours")).select(F.lit("Total").alias("phase"), F.lit("").alias("work"), F.lit(None).cast("long").alias("items"), F.lit(None).cast("int").alias("minutes"), "hours"))
    parts = (
        _sheet(1, metrics(ways), ["Metric", "Count"], ["metric", "=value"], ["place"]),
        _sheet(2, streets_ab(ways).withColumns({"_name": F.lower("street"), "severity": F.lit("CRITICAL"), "todo": start}), ["#", "Street", "Segments", "Way ids", "Severity", "Status"], ["=#", "street", "=segments", "ids", "severity", "todo"], ["_name", "street"]),
        _sheet(3, ways.where("defect_class = 'A'"), ["#", "Street", "Way id", "Severity", "Status"], ["=#", "name_display", "=id", "severity", "todo"], ["_name", "id"]),
        _sheet(4, streets_b(ways).withColumns({"_most": -F.col("segments"), "todo": start}), ["#", "Street", "Segments", "One-ways", "Road types", "Status"], ["=#", "street", "=segments", "=oneways", "types", "todo"], ["_most", "key"]),
        _sheet(5, ways, ["Way id", "Street", "Highway", "Oneway", "Class", "Severity", "tiger:cfcc", "tiger:name_base", "Review", "Last editor", "Last edit"], ["=id", "name_display", "highway", "oneway", "defect_class", "severity", "tiger_cfcc", "tiger_name_base", "status", "usr", "timestamp"], ["_class", "_name", "id"]),
        _sheet(6, zoned, ["Zone", "Audit", "Segments", "Notes"], ["zone", "status", "=segments", "notes"], ["key"]),
        _sheet(7, plan, ["Phase", "Work", "Items", "Minutes an item", "Hours"], ["phase", "work", "=items", "=minutes", "=hours"], ["phase"]),
        _sheet(8, lines, ["Query"], ["text"], ["line"]),
    )
    return reduce(DataFrame.unionByName, parts)

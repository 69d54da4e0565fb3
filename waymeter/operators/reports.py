"""Report tables and the rows of exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.ranking import numbered
from ..functions.text import oneway_truthy
from .classify import class_rank

MINUTES = {"AB": 12, "A": 4, "B": 7, "GAP": 2}
SEVERITY_RANK = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def top_findings(found: DataFrame, n: int = 50) -> DataFrame:
    """The first findings by impact, severity, id and kind."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITY_RANK)), F.col("severity"))
    return found.orderBy(F.desc("routing_impact"), rank, "id", "kind").limit(n)


def ordered_ways(classified: DataFrame) -> DataFrame:
    """All ways with their place by class, name and id. Places are counted inside class, which is a window over a class at a time: see :func:`first_ways` for the head of the list."""
    return classified.orderBy(class_rank(F.col("defect_class")), F.lower("name_display"), "id")


def first_ways(classified: DataFrame, n: int = 200) -> DataFrame:
    return ordered_ways(classified).select("id", "defect_class", "name_display").limit(n)


def segment_sheet(classified: DataFrame, least: int = 5) -> DataFrame:
    """Streets of many segments: count, one-ways, kinds of road."""
    g = classified.where("name_key is not null").groupBy("name_key").agg(F.count("*").alias("segments"), F.count_if(oneway_truthy(F.col("oneway"))).alias("oneways"), F.array_join(F.array_sort(F.collect_set("highway")), ", ").alias("types"))
    return g.where(F.col("segments") >= least)


def street_ids(classified: DataFrame, kind: str = "AB") -> DataFrame:
    """Streets with ways of a class: count and ids in order."""
    return classified.where(F.col("defect_class") == kind).groupBy("name_display").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("ids"))


def work_plan(classified: DataFrame, gaps: DataFrame) -> DataFrame:
    """(item, n, hours) of the work that each class and the gaps ask for."""
    rows = classified.where("defect_class <> 'C'").groupBy(F.col("defect_class").alias("item")).agg(F.count("*").alias("n"))
    rows = rows.unionByName(gaps.agg(F.count("*").alias("n")).select(F.lit("GAP").alias("item"), "n"))
    minutes = F.element_at(F.create_map(*(F.lit(x) for kv in MINUTES.items() for x in kv)), F.col("item"))
    return rows.select("item", "n", (F.col("n") * minutes / 60.0).alias("hours"))


def gap_counts(classified: DataFrame, gaps: DataFrame) -> DataFrame:
    """(name_key, segments, gaps) of every street, 0 where there is no gap."""
    s = classified.where("segments >= 2").groupBy("name_key").agg(F.count("*").alias("segments"))
    return s.join(gaps.groupBy("name_key").agg(F.count("*").alias("gaps")), "name_key", "left").select("name_key", "segments", F.coalesce("gaps", F.lit(0)).alias("gaps"))


def impact_by_way(ways: DataFrame, found: DataFrame) -> DataFrame:
    """(id, impact): the largest impact of a way's findings, 0 without one."""
    top = found.groupBy("id").agg(F.max("routing_impact").alias("impact"))
    return ways.select("id").join(top, "id", "left").select("id", F.coalesce("impact", F.lit(0)).alias("impact"))


def viewport(ways: DataFrame, s: float, w: float, n: float, e: float) -> DataFrame:
    """(defect_class, n) of ways whose envelope meets a view."""
    b = geo.envelope(F.col("geometry"))
    seen = ways.where((F.size("geometry") > 0) & (b["s"] <= n) & (b["n"] >= s) & (b["w"] <= e) & (b["e"] >= w))
    return seen.groupBy("defect_class").agg(F.count("*").alias("n"))


def page(rows: DataFrame, order: list, number: int, size: int = 50) -> DataFrame:
    """A page, from 1. Places are counted inside range partitions, so that a deep page is no more work than the first."""
    names = [f"_o{i}" for i in range(len(order))]
    keyed = rows.withColumns(dict(zip(names, (F.col(o) if isinstance(o, str) else o for o in order), strict=True)))
    first = (number - 1) * size
    return numbered(keyed, names, "_r").where((F.col("_r") >= first) & (F.col("_r") < first + size)).drop("_r", *names)


def ordinals(rows: DataFrame, order: list[str]) -> DataFrame:
    """A sheet's rows with their number from 1."""
    return numbered(rows, order, "n").withColumn("n", F.col("n") + 1)


def row_count(lines: DataFrame) -> DataFrame:
    """(n) of a CSV file's lines, its header left out."""
    return lines.agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("n"))


#: Columns of the export of ways.
EXPORTED = ("id", "name", "highway", "oneway", "defect_class", "severity", "review_status", "review_confidence", "version", "user", "timestamp")


def exported(classified: DataFrame) -> DataFrame:
    """The export's eleven columns; null where the ways have none of them. The name is the displayed one."""
    own = {"name": "name_display", "review_status": "status", "review_confidence": "confidence", "user": "usr"}
    return classified.select(*((F.col(own.get(c, c)) if own.get(c, c) in classified.columns else F.lit(None).cast("string")).alias(c) for c in EXPORTED))


def csv_line(row: DataFrame) -> DataFrame:
    """(line) of each row: fields with a comma, a quote or a line break in quotes, quotes doubled, nulls empty."""
    field = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    quoted = lambda x: F.when(x.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    return row.select(F.concat_ws(",", *(quoted(field(c)) for c in row.columns)).alias("line"))


def largest_streets(classified: DataFrame, n: int = 25) -> DataFrame:
    """Streets of most segments."""
    return classified.where("name_key is not null").groupBy("name_key").agg(F.count("*").alias("segments")).orderBy(F.desc("segments"), "name_key").limit(n)


def ledger(entries: DataFrame, keep: int = 500) -> DataFrame:
    """The newest entries (seq), as a ledger keeps them."""
    return entries.orderBy(F.desc("seq")).limit(keep)


def investigations(listed: DataFrame, found: DataFrame) -> DataFrame:
    """Ways (id, list) to look into, by the largest impact of their findings, then id."""
    return impact_by_way(listed.where(F.col("list").isin("review", "unmatched")), found).orderBy(F.desc("impact"), "id")


def heat_weight(k: Column) -> Column:
    return F.when(k == "AB", 1.0).when(k == "A", 0.7).otherwise(0.4)


def priority(k: Column) -> Column:
    return F.when(k == "AB", 0).when(k == "A", 1).otherwise(2)


def way_url(id_: Column) -> Column:
    return F.concat(F.lit("https://www.openstreetmap.org/way/"), id_.cast("string"))


def tasks(matched: DataFrame) -> DataFrame:
    """(id, title, instruction, priority, feature) of ways (name_display, oneway, defect_class, geometry; of their match confidence, source_id, source_oneway): what a mapper is asked, by how sure the match is: to review, weak, or none."""
    said = F.format_string("Way %d (%s) is tagged oneway=%s. Class %s: the tag may come from an import alone.", "id", "name_display", F.coalesce("oneway", F.lit("")), "defect_class")
    c = F.col("confidence")
    match = F.when(c >= 0.6, F.format_string(" Centerline %s says oneway=%s with confidence %.2f: remove the tag if traffic runs both ways.", F.col("source_id").cast("string"), "source_oneway", c))
    match = match.when(c.isNotNull(), F.format_string(" A centerline matches with confidence %.2f only, a weak sign: judge by imagery.", c)).otherwise(F.lit(" No centerline lies within 100 m: judge by imagery."))
    rows = matched.where("size(geometry) >= 2").select("*", F.format_string("Way %d: %s (Class %s)", "id", "name_display", "defect_class").alias("title"), F.concat(said, match, F.lit(" "), way_url(F.col("id"))).alias("instruction"), priority(F.col("defect_class")).alias("priority"))
    shape = F.struct(F.lit("LineString").alias("type"), F.transform("geometry", lambda p: F.array(p["lon"], p["lat"])).alias("coordinates"))
    props = F.struct(F.col("title").alias("task_name"), F.col("instruction").alias("task_instruction"), way_url(F.col("id")).alias("osm_link"), F.col("id").alias("way_id"), "defect_class", "priority")
    return rows.select("id", "title", "instruction", "priority", F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), props.alias("properties"))).alias("feature"))


def challenge(tasks: DataFrame, name: str) -> DataFrame:
    """One row of facts about a set of tasks: its name and how many there are of each priority."""
    n = lambda p: F.count_if(F.col("priority") == p)
    return tasks.agg(F.lit(name).alias("name"), F.count("*").alias("tasks"), n(0).alias("high"), n(1).alias("medium"), n(2).alias("low"))


def feature_lines(ways: DataFrame) -> DataFrame:
    """(id, line): one GeoJSON feature a way, longitude first."""
    coords = F.transform("geometry", lambda p: F.array(p["lon"], p["lat"]))
    shape = F.struct(F.lit("LineString").alias("type"), coords.alias("coordinates"))
    props = F.struct("id", F.col("name_display").alias("name"), "defect_class")
    return ways.where("size(geometry) > 0").select("id", F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), props.alias("properties"))).alias("line"))


def unverified(matched: DataFrame) -> DataFrame:
    """Ways of class A or AB with a geometry that no match of high confidence covers."""
    return matched.where(F.col("defect_class").isin("A", "AB") & (F.size("geometry") >= 1) & (F.coalesce("confidence", F.lit(0.0)) < 0.85))


def gap_tasks(gaps: DataFrame) -> DataFrame:
    """Gaps with an instruction; those without a place are left out."""
    said = F.format_string("Two segments of %s end %.1f m apart. Join them if the road runs through.", "street", "distance_m")
    return gaps.where("lat is not null and lon is not null").withColumn("instruction", said)


def executive(classified: DataFrame) -> DataFrame:
    """(metric, n)."""
    k = F.col("defect_class")
    counts = {"ways": F.count("*"), "oneway_yes": F.count_if(F.col("oneway") == "yes"), "A": F.count_if(k == "A"), "AB": F.count_if(k == "AB"), "B": F.count_if(k == "B"), "residential": F.count_if(F.col("highway") == "residential")}
    one = classified.agg(*(c.alias(m) for m, c in counts.items()))
    return one.unpivot([], list(counts), "metric", "n")

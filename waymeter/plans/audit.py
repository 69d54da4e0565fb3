"""A whole audit as a set of DataFrames, and its tables on disk."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.ranking import numbered
from ..functions.tables import written
from ..operators import classify, detectors, fixes, history, matching, payloads, reports


@dataclass
class Inputs:
    """Landed tables; those that are None leave their part of the audit out."""

    ways: DataFrame
    nodes: DataFrame | None = None
    relations: DataFrame | None = None
    bus_stops: DataFrame | None = None
    transit_stops: DataFrame | None = None
    route_vertices: DataFrame | None = None
    versions: DataFrame | None = None
    centerlines: DataFrame | None = None
    second_lines: DataFrame | None = None


@dataclass
class Audit:
    ways: DataFrame
    gaps: DataFrame
    findings: DataFrame | None
    summary: DataFrame
    matches: DataFrame | None = None
    fixes: DataFrame | None = None
    failed: dict[str, str] = field(default_factory=dict)


#: Detectors by name. One that can't be planned is noted and the others go on; failures while running fail the write that runs them.
DETECTORS: dict[str, Callable[[Inputs], DataFrame | None]] = {
    "reversed_oneways": lambda x: detectors.reversed_oneways(x.ways),
    "blocked_access": lambda x: detectors.blocked_access(x.ways),
    "arterial_names": lambda x: detectors.arterial_names(x.ways),
    "missing_maxspeed": lambda x: detectors.missing_maxspeed(x.ways),
    "conflicts": lambda x: detectors.conflicts(x.ways, route_vertices=x.route_vertices),
    "barriers": lambda x: None if x.nodes is None else detectors.unqualified_barriers(x.nodes),
    "restrictions": lambda x: None if x.relations is None else detectors.broken_restrictions(x.relations),
    "bus_stops": lambda x: None if x.bus_stops is None else detectors.misplaced_stops(x.bus_stops, x.ways, x.transit_stops),
}


def run_audit(x: Inputs, only: list[str] | None = None) -> Audit:
    """Plans everything that ``x`` has tables for. Ways with their classes, and gaps, are written first, since all the rest reads them; the rest runs when a result is written or counted."""
    ways = written(classify.classify(x.ways), "ways")
    x = replace(x, ways=ways)
    if x.versions is not None:
        ways = history.review(ways, x.versions)
    if x.route_vertices is not None:
        ways = ways.join(detectors.corridors(x.ways, x.route_vertices), "id", "left")
    parts, failed = [], {}
    for name, detect in DETECTORS.items():
        if only is None or name in only:
            try:
                part = detect(x)
            except Exception as e:  # noqa: BLE001  the others go on
                failed[name] = str(e)[:200]
                continue
            if part is not None:
                parts.append(part)
    gaps = written(classify.cluster_gaps(classify.gap_pairs(ways)), "gaps")
    found = detectors.findings(*parts) if parts else None
    out = Audit(ways, gaps, found, classify.summary(ways) if found is None else classify.whole_summary(ways, gaps, found), failed=failed)
    if x.centerlines is not None:
        out.matches = matching.match(x.ways, x.centerlines)
        none = out.matches.limit(0)
        second = none if x.second_lines is None else matching.gated(x.ways, out.matches, x.second_lines)
        out.fixes = fixes.proposals(matching.beside(ways, out.matches, second))
    return out


def save_findings(x: Inputs, path: str, only: list[str] | None = None, tries: int = 2) -> DataFrame:
    """Runs each detector by itself into a folder of its own and gives (detector, kind, n, attempts, failed, message): a detector that fails while it runs leaves its row and the others their tables.

    A folder is written again from the start with each attempt; of a detector that has failed to the last nothing is left. Detectors
    that there are no tables for have no row.
    """
    spark, said = x.ways.sparkSession, []
    x = replace(x, ways=written(x.ways, "ways"))  # five detectors read them
    for name, detect in DETECTORS.items():
        if only is not None and name not in only:
            continue
        out, row = f"{path}/{name}", None
        for attempt in range(1, tries + 1):
            try:
                part = detect(x)
                if part is None:
                    break
                seen = Observation()
                part.observe(seen, F.count(F.lit(1)).alias("n"), F.max("kind").alias("kind")).write.mode("overwrite").parquet(out)
                row = (name, seen.get["kind"], int(seen.get["n"]), attempt, False, None)
                break
            except Exception as e:  # noqa: BLE001  the others go on
                row = (name, None, None, attempt, True, str(e).splitlines()[0][:200] if str(e) else type(e).__name__)
        if row is not None:
            said.append(row)
        if row is not None and row[4]:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return spark.createDataFrame(said, "detector string, kind string, n long, attempts int, failed boolean, message string")


def saved_findings(runs: DataFrame, path: str) -> DataFrame | None:
    """The findings that :func:`save_findings` has left, as one table."""
    names = [r.detector for r in runs.where("not failed").select("detector").collect()]
    parts = [runs.sparkSession.read.parquet(f"{path}/{n}") for n in names]
    return detectors.findings(*parts) if parts else None


def run_summary(runs: DataFrame, ways: DataFrame, gaps: DataFrame, found: DataFrame) -> DataFrame:
    """The whole summary with ``complete``: false if a detector failed, whose counts then are 0 for not knowing better, and ``failed_detectors`` by name."""
    failed = runs.agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("failed"), F.col("detector")))), ",").alias("failed_detectors"))
    one = F.lit(1).alias("_one")
    both = classify.whole_summary(ways, gaps, found).select(one, "*").join(failed.select(one, "*"), "_one").drop("_one")
    return both.withColumn("complete", F.col("failed_detectors") == "")


def save(audit: Audit, path: str) -> None:
    """One Parquet folder a table."""
    for f in fields(audit):
        table = getattr(audit, f.name)
        if isinstance(table, DataFrame):
            table.write.mode("overwrite").parquet(f"{path}/{f.name}")


def save_lists(audit: Audit, path: str) -> None:
    """The ways as CSV by class slice (all, A, A and AB, streets of class B with their gaps), and as GeoJSON lines."""
    cols = ["id", "name_display", "highway", "service", "oneway", "defect_class", "severity", "segments"]
    k = F.col("defect_class")
    for name, rows in (("all", audit.ways), ("class_a", audit.ways.where(k == "A")), ("class_ab", audit.ways.where(k.isin("A", "AB")))):
        reports.ordered_ways(rows).select(cols).write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
    streets = reports.gap_counts(audit.ways, audit.gaps).orderBy(F.desc("gaps"), "name_key")
    streets.write.mode("overwrite").option("header", True).csv(f"{path}/class_b")
    reports.feature_lines(audit.ways).select("line").write.mode("overwrite").text(f"{path}/features")
    reports.gap_tasks(audit.gaps).select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"), F.struct("street", "way1_id", "way2_id", "instruction").alias("properties")))).write.mode("overwrite").text(f"{path}/gap_features")


def save_changes(ways: DataFrame, proposed: DataFrame, path: str) -> None:
    """Accepted fixes as change files' rows: (batch, id, xml), at most 500 ways a batch. ``ways`` has id, version and tags."""
    changes = proposed.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("tag", "value"))).alias("changes"))
    rows = ways.join(changes, "id").select("id", payloads.way_xml(F.col("id"), F.col("version"), fixes.apply_changes(F.col("tags"), F.col("changes"))).alias("xml"))
    numbered(rows, ["id"]).withColumn("batch", F.expr(f"rank div {fixes.BATCH}")).drop("rank").write.mode("overwrite").parquet(path)


def dashboard(audit: Audit, most: int = 5000) -> str:
    """A page with the first ways and the summary as JSON; ``most`` bounds what the driver holds."""
    first = audit.ways.where("defect_class <> 'C' and size(geometry) > 0").orderBy("id").limit(most)
    rows = reports.feature_lines(first).orderBy("id").collect()
    counts = audit.summary.select(F.to_json(F.struct("*"))).first()[0]
    data = ",".join(r.line for r in rows).replace("</", "<\\/")
    return f'<!doctype html><title>Road audit</title><script id="summary" type="application/json">{counts}</script><script id="ways" type="application/json">[{data}]</script>'


def manifest(diagnosed: DataFrame, path: str, **facts: str) -> None:
    """A baseline: the diagnosis of each way, and facts about the run as columns."""
    diagnosed.withColumns({k: F.lit(v) for k, v in facts.items()} | {"hausdorff_m": geo.rounded(F.col("hausdorff_m"), 2)}).write.mode("overwrite").parquet(path)


REVIEW = "id long, n int, kind string, tag string, value string, review boolean"


def save_review(fixes: DataFrame, path: str) -> None:
    """Accepted fixes as JSON lines, so that a review can be taken up, or sent, later."""
    fixes.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def load_review(spark: SparkSession, path: str, schema: str = REVIEW) -> DataFrame:
    """What :func:`save_review` has written; a line that is no fix fails the read, since a review in part is none."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)

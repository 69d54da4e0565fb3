"""What landed payloads say, as rows, and the rows that go out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..functions.tables import written
from ..functions.text import oneway_truthy, xml_escape
from .classify import CLASS_A_HIGHWAYS, isin
from .detectors import DRIVABLE
from .history import IMPORT_USERS
from .spatial import vertices, within

# The accounts and the days of the first import.
FIRST_IMPORT = ("2007-08-03T00:00:00Z", "2008-05-04T00:00:00Z")
# What a route may start and end on.
ROUTED = tuple(h for h in DRIVABLE if h != "service")


def harvest(ways: DataFrame) -> DataFrame:
    """Ways that any of the harvest's selectors takes, each once."""
    imported = F.col("tiger_cfcc").isNotNull() if "tiger_cfcc" in ways.columns else F.lit(False)
    small = isin(F.col("highway"), CLASS_A_HIGHWAYS) & oneway_truthy(F.col("oneway"))
    plain = F.coalesce((F.col("highway") == "residential") & (F.col("oneway") == "yes"), F.lit(False))
    return ways.where(imported | plain | small | isin(F.col("highway"), DRIVABLE))


def imported(ways: DataFrame) -> DataFrame:
    """Ways last touched by an import account while the first import ran; times are ISO texts, which sort as they are."""
    return ways.where(F.col("usr").isin(*IMPORT_USERS[:5]) & (F.col("timestamp") > FIRST_IMPORT[0]) & (F.col("timestamp") < FIRST_IMPORT[1]))


def bbox_hash(s: Column, w: Column, n: Column, e: Column) -> Column:
    return F.left(F.sha1(F.format_string("%.6f,%.6f,%.6f,%.6f", *(c.cast("double") for c in (s, w, n, e)))), F.lit(12))


def feed_url(catalog: DataFrame, feed_id: int, default: str) -> DataFrame:
    return catalog.where(F.col("feed_id") == feed_id).agg(F.coalesce(F.max("url"), F.lit(default)).alias("url"))


def notes(raw: DataFrame) -> DataFrame:
    """Notes of GeoJSON texts (value): without coordinates or id they are left out; the status is open, a comment's text its html, where none is given."""
    shape = "features array<struct<properties:struct<id:bigint,status:string,date_created:string,comments:array<struct<text:string,html:string,user:string,date:string>>>,geometry:struct<coordinates:array<double>>>>"
    f = raw.select(F.inline(F.from_json("value", shape)["features"])).where("properties.id is not null and size(geometry.coordinates) >= 2")
    said = F.transform("properties.comments", lambda c: F.struct(F.coalesce(c["text"], c["html"]).alias("text"), c["user"].alias("user"), c["date"].alias("date")))
    return f.select("properties.id", F.coalesce("properties.status", F.lit("open")).alias("status"), "properties.date_created", F.col("geometry.coordinates")[1].alias("lat"), F.col("geometry.coordinates")[0].alias("lon"), said.alias("comments"))


def itineraries(raw: DataFrame) -> DataFrame:
    """(id, length_m, duration_s) of the first itinerary: its legs' distances, and its duration or, without one, its end less its start. Null without itineraries."""
    shape = "itineraries array<struct<duration:int,startTime:string,endTime:string,legs:array<struct<distance:double>>>>"
    it = F.get(F.from_json("value", shape)["itineraries"], F.lit(0))
    seconds = F.coalesce(it["duration"].cast("long"), F.unix_timestamp(F.try_to_timestamp(it["endTime"])) - F.unix_timestamp(F.try_to_timestamp(it["startTime"])))
    return raw.select("id", F.aggregate(it["legs"], F.lit(0.0), lambda a, leg: a + leg["distance"]).alias("length_m"), seconds.alias("duration_s"))


def alerts(raw: DataFrame) -> DataFrame:
    """(id, title) of alerts on the network itself and on its routes."""
    a = F.from_json("value", "alerts array<struct<title:string>>, routes array<struct<alerts:array<struct<title:string>>>>")
    none = F.array().cast("array<struct<title:string>>")
    return raw.select("id", F.inline(F.concat(F.coalesce(a["alerts"], none), F.coalesce(F.flatten(F.transform(a["routes"], lambda x: F.coalesce(x["alerts"], none))), none))))


def sanity(rows: DataFrame, least: int = 100) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), (F.count("*") < least).alias("few"))


def issues_by_element(issues: DataFrame) -> DataFrame:
    """(id, issue, matches) of issues (uuid, id): the first by uuid, and how many there are."""
    return issues.groupBy("id").agg(F.min("uuid").alias("issue"), F.count("*").alias("matches"))


def nearest_other(points: DataFrame, roads: DataFrame, radii: tuple[float, ...] = (8.0, 40.0, 240.0, 480.0, 800.0), keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keys, distance, other, at): for a point of a way (keys with id, lat, lon) the nearest vertex of another way, and where that is, in widening rings; none beyond the last. The first rings are narrow: where vertices are dense, a wide one holds more of them than can be met.

    Places meet, not vertices: of the ways at a place the two smallest ids are kept, since one of them
    is not the point's own. Points at a place of another way have found theirs there; only the others look round.
    """
    # of the ids of each place at most two leave a task
    first = F.dense_rank().over(Window.partitionBy("lat", "lon").orderBy("id"))
    two = roads.select("id", "lat", "lon").where("lat + lon is not null").withColumn("_k", first).where("_k <= 2")
    places = written(two.groupBy("lat", "lon").agg(F.min("id").alias("_a"), F.max("id").alias("_b")), "places").withColumn("at", geo.point(F.col("lat"), F.col("lon")))
    own = written(points.select(*keys, *(c for c in ("id", "lat", "lon") if c not in keys)), "points")
    other = F.when(F.col("id") != F.col("_a"), F.col("_a")).when(F.col("id") != F.col("_b"), F.col("_b"))

    def best(near: DataFrame) -> DataFrame:
        near = near.withColumn("other", other).where("other is not null")
        return written(near.groupBy(*keys).agg(F.min(F.struct("distance", "other", "at")).alias("b")).select(*keys, "b.*"), "ring")

    # what is in range of the cells, as in the rings
    here = own.where(geo.valid(F.col("lat"), F.col("lon"))).join(places.hint("merge"), ["lat", "lon"])
    out = best(here.withColumn("distance", F.lit(0.0)))
    rest = written(own.join(out.select(*keys).hint("merge"), list(keys), "left_anti"), "rest")
    for metres in radii:
        if rest.isEmpty():
            break
        found = best(within(rest, places, metres, ["_a", "_b", "at"]))
        out = out.unionByName(found)
        rest = written(rest.join(found.select(*keys).hint("merge"), list(keys), "left_anti"), "rest")
    return out


def route_ends(ways: DataFrame) -> DataFrame:
    """(id, origin, destination) of every way with two vertices or more: the vertices of other drivable ways nearest to its start and its end, as (lat, lon). Both are null where either is missing."""
    g = F.col("geometry")
    ways = written(ways.select("id", "highway", "geometry"), "ways")
    ends = ways.where("size(geometry) >= 2").select("id", F.explode(F.array(F.struct(F.lit(0).alias("end"), geo.first(g).alias("p")), F.struct(F.lit(1).alias("end"), geo.last(g).alias("p")))).alias("e"))
    ends = ends.select("id", "e.end", F.col("e.p.lat").alias("lat"), F.col("e.p.lon").alias("lon"))
    roads = vertices(ways.where(F.col("highway").isin(*ROUTED)), "id")
    near = nearest_other(ends, roads, keys=("id", "end"))
    both = ends.select("id", "end").join(near.select("id", "end", "at"), ["id", "end"], "left").groupBy("id").agg(F.max(F.when(F.col("end") == 0, F.col("at"))).alias("o"), F.max(F.when(F.col("end") == 1, F.col("at"))).alias("d"))
    found = F.col("o").isNotNull() & F.col("d").isNotNull()
    return both.select("id", F.when(found, F.col("o")).alias("origin"), F.when(found, F.col("d")).alias("destination"))


def way_xml(id_: Column, version: Column, tags: Column) -> Column:
    """A way of a change set with its tags in the map's order."""
    quoted = lambda x: xml_escape(x)
    each = F.transform(F.map_entries(tags), lambda t: F.concat(F.lit('<tag k="'), quoted(t["key"]), F.lit('" v="'), quoted(t["value"]), F.lit('"/>')))
    return F.concat(F.lit('<way id="'), id_.cast("string"), F.lit('" version="'), version.cast("string"), F.lit('">'), F.array_join(each, ""), F.lit("</way>"))


# What a change set says of its source, when a fix rests on it.
ATTRIBUTION = "Source: CAGIS Open Data Hub (Hamilton County, Ohio) — used as-is per license; quarterly-updated street centerlines."
#: Fixes in a change set, at most.
BATCH = 500


def change_sets(fixes: DataFrame, ways: DataFrame, comment: str, size: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """Accepted fixes as change sets: (batch, place, id, xml, error) of each fix, and (batch, comment, attribution, fixes, applied) of each set.

    ``fixes``: place (from 0, without gaps), id, action, tag, changes map, evidence map; ``ways``: the current id, version and tags. A
    fix is made on the way as it is now; one that can't be made has an error and no element, and the others of its set go on. A set
    names its source if a fix of it has a centerline's id as evidence, even one with an error; several sets are numbered.
    """
    batch = F.expr(f"place div {size}").alias("batch")
    changes = F.when(F.col("action") == "remove_tag", F.create_map(F.col("tag"), F.lit(None).cast("string"))).when(F.col("action") == "modify_tag", F.coalesce("changes", F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))))
    rows = fixes.withColumn("_c", changes).join(ways.select(F.col("id").alias("_id"), "version", "tags"), F.col("id") == F.col("_id"), "left")
    who = F.concat(F.lit("Way "), F.coalesce(F.col("id").cast("string"), F.lit("None")), F.lit(": "))
    error = F.when(F.col("_c").isNull(), F.concat(who, F.lit("Unknown action: "), F.coalesce("action", F.lit("None")))).when(F.col("_id").isNull(), F.concat(who, F.lit("No <way> element in API response")))
    kept = F.map_filter("tags", lambda k, v: ~F.array_contains(F.map_keys("_c"), k))
    put = F.map_concat(kept, F.map_filter("_c", lambda k, v: v.isNotNull()))
    elements = rows.withColumn("error", error).select(batch, "place", "id", F.when(error.isNull(), way_xml(F.col("id"), F.col("version"), put)).alias("xml"), "error", F.try_element_at("evidence", F.lit("cagis_id")).isNotNull().alias("_sourced"))
    sets = elements.groupBy("batch").agg(F.when(F.bool_or("_sourced"), ATTRIBUTION).alias("attribution"), F.count("*").alias("fixes"), F.count("xml").alias("applied"))
    n = fixes.agg(F.ceil(F.count("*") / size).alias("_n"))
    said = F.when(F.col("_n") > 1, F.concat(F.lit(f"{comment} (batch "), (F.col("batch") + 1).cast("string"), F.lit("/"), F.col("_n").cast("string"), F.lit(")"))).otherwise(comment)
    sets = sets.withColumn("_one", F.lit(1)).join(F.broadcast(n.withColumn("_one", F.lit(1))), "_one").select("batch", said.alias("comment"), "attribution", "fixes", "applied")
    return elements.drop("_sourced"), sets

"""Queries that write files from the tables as fetches land them, read them back with the readers, and say what they hold; and the audit's own files."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.tables import folder
from ..operators import history, matching
from ..sources import landed, live, realtime
from ..sources.fixtures import Roads
from . import audit
from .oracles import LABEL, TRUTHY, r
from .registry import _versions, classified, query


#: Elements of a bundle by their ids, and positions and trips of a message: landed files are more with larger tables, not larger.
BUNDLE, MESSAGE, TRIPS = 5000, 5000, 100


def _land(rows: DataFrame, name: Column, value: Column) -> str:
    """A folder with texts as files."""
    path = folder(rows.sparkSession, "files")
    data = value if dict(rows.select(value.alias("v")).dtypes)["v"] == "binary" else F.encode(value, "utf-8")
    live.land(rows.select(name.alias("snapshot"), data.alias("data")), path)
    return path


def _bundles(rows: DataFrame, by: Column, one: Column, around: str = '{"elements":[%s]}', end: str = "json") -> str:
    """Files of JSON objects in a list, or of CSV lines, one for each value of ``by``."""
    head, tail = around.split("%s")
    g = rows.select(by.cast("string").alias("_by"), one.alias("_one")).groupBy("_by").agg(F.concat(F.lit(head), F.array_join(F.collect_list("_one"), "," if end == "json" else ""), F.lit(tail)).alias("value"))
    return _land(g, F.concat(F.col("_by"), F.lit(f".{end}")), F.col("value"))


# element bundles


def _elements(x: Roads) -> DataFrame:
    """Ways with vertices out of range among theirs, barrier nodes and relations, as landed bundles."""
    point = lambda lat, lon: F.struct(F.lit(lat).cast("double").alias("lat"), F.lit(lon).cast("double").alias("lon"))
    tags = F.map_filter(F.create_map(*(v for k in ("name", "highway", "service", "oneway", "maxspeed", "access") for v in (F.lit(k), F.col(k)))), lambda k, v: v.isNotNull())
    shape = F.concat(F.col("geometry"), F.when(F.col("id") % 5 == 0, F.array(point(95.0, 0.0), point(39.2, None))).otherwise(F.array().cast("array<struct<lat:double,lon:double>>")))
    ways = x.ways.select(F.to_json(F.struct(F.lit("way").alias("type"), "id", tags.alias("tags"), shape.alias("geometry"), "version", F.col("usr").alias("user"))).alias("one"), "id")
    nodes = x["barrier_nodes"].select(F.to_json(F.struct(F.lit("node").alias("type"), "id", F.create_map(F.lit("barrier"), F.col("barrier")).alias("tags"), "lat", "lon")).alias("one"), "id")
    relations = x["restrictions"].select(F.to_json(F.struct(F.lit("relation").alias("type"), "id")).alias("one"), "id")
    other = nodes.select(F.lit('{"type":"area","id":1}').alias("one"), "id").where("id % 50 = 0")
    rows = ways.unionByName(nodes).unionByName(relations).unionByName(other)
    return landed.elements(x.spark, _bundles(rows, F.expr(f"id div {BUNDLE}"), F.col("one")))


@query("select 'way' as type, count(*) n, sum(o_orderkey)::bigint ids from orders union all select 'node', count(*), sum(p_partkey)::bigint from part union all select 'relation', count(*), sum(event_id)::bigint from events")
def prj_1_split(x):
    """Elements by type; other types are in none."""
    parts = landed.split(_elements(x))
    count = lambda k: parts[k].agg(F.lit(k).alias("type"), F.count("*").alias("n"), F.sum("id").alias("ids"))
    return count("way").unionByName(count("node")).unionByName(count("relation"))


@query("select w.id, name, highway, service, oneway, maxspeed, access, version, usr, coalesce(n,0) vertices from ways_attr w left join (select id, count(*) n from way_vertices group by 1) v on v.id=w.id", "ways_attr", "way_vertices")
def prj_2_way_records(x):
    """Ways of bundles with their tags as columns, without vertices that are null or out of range."""
    w = landed.ways(_elements(x))
    return w.select("id", "name", "highway", "service", "oneway", "maxspeed", "access", "version", "usr", F.size("geometry").cast("long").alias("vertices"))


# centerlines and routes of feature services


@query("select id, label, case trvl_dir when 1 then 'yes' when -1 then '-1' else 'no' end oneway, case when id%3=0 then 2 when id%3=1 then 3 else 4 end vertices, case when id%3=1 then 0.5 else 0.0 end north from centerlines where id%8<>7", "centerlines")
def src_7_centerline_features(x):
    """Features of one line or of several, of which the longest counts, the first of equals; those with a single vertex are left out."""
    c = x["centerlines"]
    i = F.col("id")
    line = lambda n, up=0.0: F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.array(F.col("lon1") + k * 0.001, F.col("lat") + up))
    parts = F.when(i % 3 == 1, F.array(line(2), line(3, 0.5), line(3, 0.7))).otherwise(F.array(line(1), line(4)))
    kind = F.when((i % 8 == 7) | (i % 3 == 0), "LineString").otherwise("MultiLineString")
    coordinates = F.when(i % 8 == 7, F.to_json(line(1))).when(i % 3 == 0, F.to_json(line(2))).otherwise(F.to_json(parts))
    said = F.struct(F.when(i % 4 == 0, F.lit("")).otherwise(F.col("label")).alias("STRLABEL"), F.col("label").alias("MAPLABEL"), i.alias("OBJECTID"), F.col("trvl_dir").alias("TRVL_DIR"))
    one = F.concat(F.lit('{"properties":'), F.to_json(said), F.lit(',"geometry":{"type":"'), kind, F.lit('","coordinates":'), coordinates, F.lit("}}"))
    got = landed.features(x.spark, _bundles(c, i % 8, one, '{"features":[%s]}'), "STRLABEL string, MAPLABEL string, OBJECTID bigint, TRVL_DIR int").where("size(parts) > 0")
    shape = landed.longest_part(F.col("parts"))
    rows = got.select(F.col("OBJECTID").alias("id"), F.coalesce(F.nullif("STRLABEL", F.lit("")), "MAPLABEL").alias("label"), matching.travel_direction(F.col("TRVL_DIR")).alias("oneway"), F.size(shape).cast("long").alias("vertices"), geo.first(shape)["lat"].alias("lat"))
    return rows.join(c.select("id", F.col("lat").alias("own")), "id").select("id", "label", "oneway", "vertices", geo.rounded(F.col("lat") - F.col("own"), 3).alias("north"))


#: Customers' keys that a shapefile spans.
SHAPES_BLOCK = 100_000


@query(
    """select c_custkey id, c_name as name, 'r'||cast(c_custkey as varchar) route, 2+c_custkey%3 vertices from customer where c_custkey%10<>0 and c_custkey%7<>0"""
)
def src_8_10_shapefile(x):
    """Shapefiles with attributes, a pair for each nation and block of keys, so that no file grows with the table: null shapes and deleted rows shift nobody's attributes."""
    path = folder(x.spark, "shapes")
    block = F.floor(F.col("c_custkey") / SHAPES_BLOCK).alias("block")
    live.land(x.table("customer").select("c_nationkey", "c_custkey", "c_name", block).groupBy("c_nationkey", "block").applyInArrow(_shapefile, "snapshot string, data binary"), path)
    rows = landed.shapefile(x.spark, path)
    value = lambda k: F.element_at("attributes", F.lit(k))
    return rows.select(value("ID").try_cast("long").alias("id"), value("NAME").alias("name"), value("ROUTE").alias("route"), F.size("geometry").cast("long").alias("vertices"))


def _shapefile(table: pa.Table) -> pa.Table:
    """A polyline shapefile and its dBASE table of a nation's customers: every tenth shape is null, every seventh row deleted."""
    shapes, rows = b"", b""
    people = sorted(table.select(["c_custkey", "c_name"]).to_pylist(), key=lambda p: p["c_custkey"])
    for n, p in enumerate(people, 1):
        k = p["c_custkey"]
        points = [(k + j / 8, 39.0 + j) for j in range(2 + k % 3)]
        body = struct.pack("<i", 0)
        if k % 10:
            body = struct.pack("<i4d2i", 3, 0, 0, 0, 0, 2, len(points) + 1) + struct.pack("<2i", 0, 1) + struct.pack(f"<{2 * len(points) + 2}d", 0, 0, *(c for xy in points for c in xy))
        shapes += struct.pack(">2i", n, len(body) // 2) + body
        rows += (b"*" if k % 7 == 0 else b" ") + f"{k:>10}".encode() + p["c_name"].encode().ljust(30) + f"r{k}".encode().ljust(12)
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(shapes)) // 2) + struct.pack("<2i8d", 1000, 3, *[0.0] * 8)
    fields = b"".join(name.encode().ljust(11, b"\0") + kind + bytes(4) + bytes([width, 0]) + bytes(14) for name, kind, width in (("ID", b"N", 10), ("NAME", b"C", 30), ("ROUTE", b"C", 12)))
    dbf = struct.pack("<4BIHH20x", 3, 124, 1, 1, len(people), 32 + len(fields) + 1, 53) + fields + b"\r" + rows
    name = f"n{table.column('c_nationkey')[0].as_py()}_{table.column('block')[0].as_py()}"
    return pa.table({"snapshot": [f"{name}.shp", f"{name}.dbf"], "data": pa.array([head + shapes, dbf], pa.binary())})


# transit files


@query("select cast(s_suppkey as varchar) stop_id, s_name as name, 39.0+s_suppkey/1024.0 lat, -84.5 lon from supplier where s_suppkey%4<2 and s_suppkey%7<>0")
def src_12_feed_stops(x):
    """A feed's stops: stations are left out, and stops without numbers for coordinates."""
    k = F.col("s_suppkey")
    kind = F.when(k % 4 == 0, "").when(k % 4 == 1, " 0 ").otherwise("1")
    line = F.concat_ws(",", k.cast("string"), F.concat(F.lit('"'), F.col("s_name"), F.lit('"')), F.when(k % 7 == 0, F.lit("n/a")).otherwise(F.concat(F.lit(" "), (39 + k / 1024).cast("string"))), F.lit("-84.5"), kind)
    path = _bundles(x.table("supplier").withColumn("line", line), k % 4, F.concat(F.col("line"), F.lit("\n")), "stop_id,stop_name,stop_lat,stop_lon,location_type\n%s", "csv")
    return landed.stops(x.spark, path)


@query("select cast(event_id as varchar) trip_id, cast(user_id as varchar) vehicle_id, epoch_us(ts)//1000000 as timestamp, event_id%5 status from events")
def src_15_vehicle_positions(x):
    """Vehicle positions of landed messages."""
    e = x.table("events")
    rows = e.select(F.expr(f"event_id div {MESSAGE}").cast("string").alias("snapshot"), F.col("event_id").cast("string").alias("trip_id"), F.col("user_id").cast("string").alias("vehicle_id"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("timestamp"), (F.col("event_id") % 5).cast("int").alias("current_status"))
    m = live.messages(rows)
    path = _land(m, F.concat("snapshot", F.lit(".pb")), F.col("data"))
    got = realtime.vehicle_positions(x.spark, path)
    return got.select("trip_id", "vehicle_id", "timestamp", F.col("current_status").cast("long").alias("status"))


@query("select cast(user_id as varchar) trip_id, cast(user_id%7 as varchar) route_id, event_id stop, case when event_id%3<>0 then event_id-50 end delay, case when event_id%2=0 then epoch_us(ts)//1000000 end departs from events")
def src_16_trip_updates(x):
    """Trip updates with their stop times: delays may be negative, what is absent is null."""
    e = x.table("events").withColumn("t", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    stop = F.struct("event_id", "t")
    trips = e.groupBy("user_id").agg(F.array_sort(F.collect_list(stop)).alias("stops"))  # bounded: a client's calls of the test tables
    path = _land(trips.groupBy(F.expr(f"user_id div {TRIPS}").alias("file")).applyInArrow(_updates, "file string, data binary"), F.concat("file", F.lit(".pb")), F.col("data"))
    u = realtime.trip_updates(x.spark, path).select("trip_id", "route_id", F.inline("stop_time_updates"))
    return u.select("trip_id", "route_id", F.col("stop_id").cast("long").alias("stop"), F.col("arrival_delay").cast("long").alias("delay"), F.col("departure_time").alias("departs"))


def _updates(table: pa.Table) -> pa.Table:
    field, out = realtime._field, [realtime._field(1, realtime._field(1, "2.0"))]
    for trip in table.to_pylist():
        stops = []
        for n, s in enumerate(trip["stops"]):
            i = s["event_id"]
            come = field(2, field(1, i - 50)) if i % 3 else b""
            go = field(3, field(2, s["t"])) if i % 2 == 0 else b""
            stops.append(field(2, field(1, n) + come + go + field(4, str(i))))
        who = field(1, str(trip["user_id"])) + field(5, str(trip["user_id"] % 7))
        out.append(field(2, field(1, str(trip["user_id"])) + field(3, field(1, who) + b"".join(stops))))
    return pa.table({"file": [str(table.column("user_id")[0].as_py() // TRIPS)], "data": pa.array([b"".join(out)], pa.binary())})


# histories, routes, polygons, baselines


@query("select way_id, version, usr, 2 nodes, case when surface is not null then 1 else 0 end surfaced from way_versions", "way_versions")
def src_21_histories(x):
    """Histories, a file an element; versions that landed twice count once, elements that are gone give nothing."""
    v = _versions(x)
    one = F.to_json(F.struct(F.lit("way").alias("type"), F.col("way_id").alias("id"), "version", F.col("usr").alias("user"), "tags", "nodes"))
    twice = v.unionByName(v.where("version = 1"))
    path = _bundles(twice, F.concat(F.lit("w"), "way_id"), one)
    live.land(v.limit(1).select(F.lit("gone.json").alias("snapshot"), F.encode(F.lit(""), "utf-8").alias("data")), path)
    h = landed.histories(x.spark, path)
    return h.select("way_id", "version", "usr", F.size("nodes").alias("nodes"), F.map_contains_key("tags", F.lit("surface")).cast("int").alias("surfaced"))


@query("select w.id, case when n is null then 'none' when not seen then 'INCONCLUSIVE' else 'told' end status from ways_attr w left join (select way_id, count(*) n, true seen from way_versions group by 1) v on v.way_id=w.id where version>=2 and coalesce(usr in ('DaveHansenTiger','bot-mode') or lower(usr) like 'import%', false)", "ways_attr", "way_versions")
def jn_14_history_lookup(x):
    """Ways that their last version leaves open, and whether a history was landed for them."""
    open_ = history.by_last_version(x["ways_attr"]).where("status is null").select("id")
    told = history.by_history(_versions(x)).select(F.col("way_id").alias("id"), F.lit("told").alias("status"))
    return open_.join(told, "id", "left").select("id", F.coalesce("status", F.lit("none")).alias("status"))


@query("select id origin, case when live_m is not null then live_m end length_m, case when live_m is not null then live_m/10 end duration_s from routes", "routes")
def src_22_routes(x):
    """A routing service's answers: a refusal stays as a row without a length."""
    v = x["routes"]
    track = F.concat(F.lit('{"features":[{"properties":{"track-length":"'), F.col("live_m").cast("long").cast("string"), F.lit('","total-time":'), (F.col("live_m") / 10).cast("string"), F.lit("}}]}"))
    line = F.to_json(F.struct(F.struct(F.col("id").cast("string").alias("origin"), F.lit("d").alias("destination")).alias("request"), F.coalesce(track, F.lit("no route found")).alias("answer")))
    path = folder(x.spark, "answers")
    v.select(line.alias("value")).write.text(path)
    return landed.routes(x.spark, path).select(F.col("origin").cast("long").alias("origin"), "length_m", "duration_s")


@query(f"select 'z'||cast(n_nationkey as varchar) as zone, case when n_nationkey%2=0 then 1 else 3 end rings, {r('39.0+n_nationkey/100.0', 4)} south from nation")
def src_25_zone_polygons(x):
    """Polygons of one ring, and collections of several with holes, a file a zone."""
    k = F.col("n_nationkey")
    ring = lambda s: F.array(*(F.array(F.lit(-84.0) + a, 39.0 + k / 100.0 + b) for a, b in ((0, 0), (s, 0), (s, s), (0, 0))))
    shape = F.when(k % 2 == 0, F.concat(F.lit('{"type":"Polygon","coordinates":['), F.to_json(ring(0.5)), F.lit("]}"))).otherwise(F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), F.to_json(ring(0.5)), F.lit(","), F.to_json(ring(0.1)), F.lit("],["), F.to_json(ring(0.2)), F.lit("]]}")))
    text = F.when(k % 3 == 0, F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit("}"))).otherwise(F.concat(F.lit('{"features":[{"geometry":'), shape, F.lit("}]}")))
    rows = landed.rings(x.spark, _land(x.table("nation"), F.concat(F.lit("z"), k.cast("string"), F.lit(".geojson")), text))
    south = F.array_min(F.flatten(F.transform("rings", lambda g: F.transform(g, lambda p: p["lat"]))))
    return rows.select("zone", F.size("rings").alias("rings"), geo.rounded(south, 4).alias("south"))


@query("select bucket, a, b, b-a delta from (select defect_class bucket, count(*) filter (id%2=0) a, count(*) filter (id%3<>0) b from cls group by 1)", "cls")
def src_27_snk_7_baselines(x):
    """Baselines written as manifests; the two newest are compared, the older first."""
    c = classified(x).select("id", F.col("defect_class").alias("bucket"), F.lit(1.5).alias("hausdorff_m"))
    paths = [folder(x.spark, "baseline") for _ in range(3)]
    for path, keep in zip(paths, ("id < 0", "id % 2 = 0", "id % 3 <> 0"), strict=True):
        audit.manifest(c.where(keep), path, zone="all")
    older, newer = landed.manifests(x.spark, paths)
    return matching.bucket_changes(older, newer).select("bucket", "a", "b", "delta")


# the audit's own files


def _audit(x: Roads) -> audit.Audit:
    return audit.run_audit(audit.Inputs(x.ways, nodes=x["barrier_nodes"]), ["reversed_oneways", "blocked_access", "arterial_names", "missing_maxspeed", "barriers"])


@query(f"select kind, count(*) n from found group by 1 union all select 'barrier_unqualified', count(*) from barrier_nodes where barrier in ('gate','bollard','lift_gate','swing_gate','cycle_barrier') and coalesce(access,'')='' and coalesce(foot,'')='' union all select 'ways', count(*) from ways_attr union all select 'AB', count(*) from cls where defect_class='AB'", "found", "barrier_nodes", "cls")
def snk_2_src_26_saved_audit(x):
    """A whole audit saved as tables and loaded again."""
    path = folder(x.spark, "audit")
    audit.save(_audit(x), path)
    table = lambda n: x.spark.read.parquet(f"{path}/{n}")
    kinds = table("findings").groupBy("kind").agg(F.count("*").alias("n"))
    ways = table("ways")
    return kinds.unionByName(ways.agg(F.lit("ways").alias("kind"), F.count("*").alias("n"))).unionByName(ways.agg(F.lit("AB").alias("kind"), F.count_if(F.col("defect_class") == "AB").alias("n")))


@query("select slice, id, name_display, defect_class from (select 'all' slice, * from cls union all select 'class_a', * from cls where defect_class='A' union all select 'class_ab', * from cls where defect_class in ('A','AB'))", "cls")
def snk_3_csv_slices(x):
    """The audit's lists as CSV, read back."""
    path = folder(x.spark, "lists")
    audit.save_lists(_audit(x), path)
    part = lambda n: x.spark.read.option("header", True).csv(f"{path}/{n}").select(F.lit(n).alias("slice"), F.col("id").cast("long").alias("id"), "name_display", "defect_class")
    return part("all").unionByName(part("class_a")).unionByName(part("class_ab"))


@query("select id, defect_class from cls where defect_class<>'C' and id in (select id from ends) order by id limit 5000", "cls", "ends")
def snk_5_dashboard(x):
    """The ways with a geometry on the dashboard's page (the first 5,000), read out of it again."""
    page = audit.dashboard(_audit(x), 5000)
    data = page[page.index('id="ways"') :]
    text = data[data.index(">") + 1 : data.index("</script>")]
    rows = x.spark.createDataFrame([(text,)], "value string").select(F.explode(F.from_json("value", "array<struct<properties:struct<id:bigint,defect_class:string>>>")).alias("f"))
    return rows.select("f.properties.id", "f.properties.defect_class")


@query(f"select id, {LABEL} as name, {TRUTHY} truthy from ways_attr where id=(select min(id) from ways_attr where name is not null)", "ways_attr")
def jn_18_one_way(x):
    """The way with an id that is asked for."""
    from ..functions import text

    c = classified(x)
    first = c.where("name is not null").agg(F.min("id")).first()[0]
    return c.where(F.col("id") == first).select("id", F.col("name_display").alias("name"), text.oneway_truthy(F.col("oneway")).alias("truthy"))

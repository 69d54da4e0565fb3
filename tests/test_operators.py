"""Behaviours of the road operators on small tables, against plain Python."""

import math
import struct
from difflib import SequenceMatcher

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymeter.functions import geo, text
from waymeter.operators import classify, detectors, fixes, history, matching, routes, spatial
from waymeter.sources import landed
from waymeter.streaming import vehicles

LINE = "array<struct<lat:double,lon:double>>"


def hav(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371000 * math.asin(min(1, math.sqrt(h)))


def ways(spark, rows):
    """(id, name, highway, service, oneway, points)"""
    schema = f"id long, name string, highway string, service string, oneway string, maxspeed string, access string, motor_vehicle string, geometry {LINE}"
    return spark.createDataFrame([(i, n, h, s, o, None, None, None, [{"lat": float(a), "lon": float(b)} for a, b in p]) for i, n, h, s, o, p in rows], schema)


def test_classes(spark):
    rows = [(1, " Oak St ", "residential", None, "YES", []), (2, "oak st", "primary", None, "no", []), (3, None, "service", None, "yes", []), (4, "Lot", "service", "parking_aisle", "yes", []), (5, "", "service", "slipway", "-1", []), (6, None, None, None, None, []), (7, "Elm", "tertiary", None, " true ", [])]
    got = {r.id: r for r in classify.classify(ways(spark, rows)).collect()}
    assert {i: r.defect_class for i, r in got.items()} == {1: "AB", 2: "B", 3: "C", 4: "C", 5: "A", 6: "C", 7: "A"}
    assert got[3].name_display == "Service road" and got[5].name_display == "Slipway" and got[6].name_display == "Unnamed way"
    assert classify.classify(ways(spark, rows), unnamed_service=True).where("id = 3").first().defect_class == "A"
    assert classify.classify(ways(spark, rows).limit(0)).count() == 0


def test_gaps_cluster(spark):
    rows = [(i, "Main", "residential", None, None, [(39.1, -84.5 + 0.0004 * i), (39.1, -84.5 + 0.0004 * i + 0.0003)]) for i in range(5)]
    rows += [(9, "Main", "residential", None, None, [(39.1 + 1e-5, -84.5 + 0.0004), (39.2, -84.5)])]
    raw = classify.gap_pairs(classify.classify(ways(spark, rows)))
    kept = []
    for g in sorted(raw.collect(), key=lambda g: (math.floor(g.distance_m * 10 + 0.5), g.way1_id, g.way2_id)):
        if all(hav((g.lat, g.lon), (k.lat, k.lon)) > 5 for k in kept):
            kept.append(g)
    assert {(g.way1_id, g.way2_id) for g in classify.cluster_gaps(raw).collect()} == {(g.way1_id, g.way2_id) for g in kept}
    assert 0 < len(kept) < raw.count()


def test_conflicts_reject_chains_and_carriageways(spark):
    east = lambda lat, lo=-84.5: [(lat, lo), (lat, lo + 0.001), (lat, lo + 0.002)]
    rows = [(1, "A", "residential", None, "yes", east(39.1)), (2, "A", "residential", None, "yes", east(39.1002)), (3, "B", "residential", None, "yes", east(39.1)), (4, "B", "residential", None, "yes", east(39.1002)[::-1]), (5, "C", "residential", None, "yes", east(39.1)), (6, "C", "residential", None, "yes", east(39.1, -84.498)), (7, "B", "residential", None, "-1", east(39.1004)[::-1])]
    got = detectors.conflicts(ways(spark, rows)).collect()
    assert {(r.id, r.id_other) for r in got} >= {(1, 2)} and not {(3, 4), (5, 6)} & {(r.id, r.id_other) for r in got}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-70, 70), st.floats(-170, 170)), min_size=1, max_size=6), st.lists(st.tuples(st.floats(-0.003, 0.003), st.floats(-0.003, 0.003), st.integers(0, 5)), min_size=1, max_size=25), st.sampled_from([30.0, 200.0]))
def test_within(spark, left, near, metres):
    right = [(left[k % len(left)][0] + a, left[k % len(left)][1] + b) for a, b, k in near]
    frame = lambda xs, key: spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(xs)], f"{key} int, lat double, lon double")
    got = {(r.id, r.other) for r in spatial.within(frame(left, "id"), frame(right, "other"), metres, ["other"]).collect()}
    sure = lambda by: {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if hav(a, b) <= metres + by}
    assert sure(-1e-6) <= got <= sure(1e-6)


def test_nearest_widens(spark):
    a = spark.createDataFrame([(1, 39.0, -84.0), (2, 39.5, -84.0), (3, None, -84.0)], "id int, lat double, lon double")
    b = spark.createDataFrame([(10, 39.0001, -84.0), (11, 39.02, -84.0), (12, 39.45, -84.0)], "k int, lat double, lon double")
    got = {r.id: (r.nearest.k, r.distance) for r in spatial.nearest(a, b, "id", ["k"]).collect()}
    assert got[1][0] == 10 and got[2][0] == 12 and 3 not in got and abs(got[2][1] - hav((39.5, -84), (39.45, -84))) < 1e-6


def test_similarity(spark):
    pairs = [("oak street", "oak st"), ("tide", "diet"), ("diet", "tide"), ("", "x"), (None, "x"), ("same", "same"), ("harbor view 9 court", "almond 9 avenue")] * 2
    want = {(a, b): 0.0 if not a or not b else 1.0 if a == b or b == "oak st" else SequenceMatcher(None, a, b).ratio() for a, b in pairs}
    got = text.with_similarity(spark.createDataFrame(pairs, "a string, b string"), "a", "b").collect()
    assert len(got) == len(pairs) and all(abs(r.name_similarity - want[(r.a, r.b)]) < 1e-12 for r in got)


def test_match_and_fallback(spark):
    line = lambda lat, n=5: [(lat, -84.5 + 0.001 * i) for i in range(n)]
    rows = [(1, "Oak Street", "residential", None, None, line(39.1)), (2, "Elm Road", "residential", None, None, line(39.1005)), (3, "Far", "residential", None, None, line(39.2)), (4, "Dot", "residential", None, None, [(39.1, -84.5)])]
    centre = spark.createDataFrame([(7, "OAK ST", 0, 5, 25, [{"lat": 39.1, "lon": -84.501}, {"lat": 39.1, "lon": -84.49}])], f"id long, label string, trvl_dir int, class int, speed int, geometry {LINE}")
    records = matching.centerline_records(centre)
    got = {r.id: r for r in matching.match(ways(spark, rows), records).collect()}
    assert got[1].confidence > 0.99 and not got[1].via_fallback and got[2].via_fallback and got[2].confidence <= 0.6 and set(got) == {1, 2}
    assert {r.id: r.bucket for r in matching.diagnose(ways(spark, rows), records).collect()} == {1: "MATCHED_HIGH", 2: "MATCHED_FALLBACK_REVIEW", 3: "F1_NO_CANDIDATE", 4: "F1_NO_CANDIDATE"}


def test_segment_distance(spark):
    df = spark.createDataFrame([(39.1, -84.5)], "lat double, lon double")
    p = F.struct("lat", "lon")
    at = lambda a, b: geo.point(F.lit(a), F.lit(b))
    d = df.select(geo.segment_distance(p, at(39.1, -84.51), at(39.1, -84.49)), geo.segment_distance(p, at(39.101, -84.5), at(39.101, -84.5)), geo.line_distance(p, F.array().cast(LINE)), geo.line_distance(p, F.array(at(39.101, -84.5)))).first()
    assert d[0] < 1e-6 and abs(d[1] - 111.19) < 0.1 and d[2] == math.inf and abs(d[3] - d[1]) < 1e-9


def test_history_cases(spark):
    v = [(1, 1, "bot-mode", {"name": "A"}, [1, 2]), (1, 2, "me", {"name": "A", "tiger:reviewed": "no"}, [1, 2]), (1, 3, "me", {"name": "A", "surface": "asphalt"}, [1, 2]), (2, 1, "bot-mode", {}, [1]), (2, 2, "import_y", {"name": "B"}, [1]), (3, 1, "me", {}, [1, 2]), (3, 2, "me", {}, [1, 3]), (4, 1, None, {}, [1])]
    got = {r.way_id: (r.status, r.confidence, r.reason) for r in history.by_history(spark.createDataFrame(v, "way_id long, version int, usr string, tags map<string,string>, nodes array<int>")).collect()}
    assert got == {1: ("LIKELY_REVIEWED", 0.75, "added surface"), 2: ("UNREVIEWED", 0.9, None), 3: ("LIKELY_REVIEWED", 0.75, "nodes +1/-1"), 4: ("INCONCLUSIVE", 0.5, None)}


def test_route_logic(spark):
    rows = [(1, "oneway_conflict", None, 5.0), (2, "oneway_conflict", None, None), (3, "oneway_conflict", 5.0, None), (4, "oneway_conflict", 100.0, 120.0), (5, "oneway_conflict", 100.0, 101.0), (6, "barrier_unqualified", None, 5.0), (7, "oneway_conflict", 100.0, 110.0)]
    got = {r.id: (r.decision, round(r.delta_pct, 6)) for r in routes.decide(spark.createDataFrame(rows, "id int, kind string, live_m double, perturbed_m double")).collect()}
    assert got == {1: ("real", 100), 2: ("inconclusive", 0), 3: ("real", 100), 4: ("real", 20), 5: ("noisy", 1), 6: ("inconclusive", 0), 7: ("inconclusive", 10)}


def test_tag_changes(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": None, "c": "3"})], "t map<string,string>, c map<string,string>")
    assert df.select(fixes.apply_changes(F.col("t"), F.col("c"))).first()[0] == {"b": "2", "c": "3"}


def test_polyline(spark):
    df = spark.createDataFrame([("_p~iF~ps|U_ulLnnqC_mqNvxq`@",), ("_p~iF~ps|U_u",), (None,)], "s string")
    a, b, c = (r[0] for r in df.select(landed.decode_polyline(5)("s")).collect())
    assert [(p.lat, p.lon) for p in a] == [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)] and len(b) == 1 and c is None


def test_landed_files(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"elements":[{"type":"way","id":1,"tags":{"name":"A","highway":"residential"},"geometry":[{"lat":1,"lon":2},{"lat":95,"lon":2},null],"version":2},{"type":"node","id":2,"lat":1.0,"lon":2.0}]}')
    e = landed.elements(spark, str(tmp_path / "e.json"))
    assert landed.split(e)["node"].count() == 1
    w = landed.ways(e).first()
    assert w.name == "A" and len(w.geometry) == 1
    (tmp_path / "f.json").write_text('{"features":[{"properties":{"k":1},"geometry":{"type":"LineString","coordinates":[[1,2],[3,4]]}},{"properties":{"k":2},"geometry":{"type":"MultiLineString","coordinates":[[[1,2],[3,4]],[[1,2],[3,4],[5,6]],[[9,9]]]}}]}')
    f = {r.k: r for r in landed.features(spark, str(tmp_path / "f.json"), "k int").withColumn("longest", landed.longest_part(F.col("parts"))).collect()}
    assert f[1].longest[0].lat == 2 and len(f[2].parts) == 2 and len(f[2].longest) == 3
    (tmp_path / "s.txt").write_text("stop_id,stop_name,stop_lat,stop_lon,location_type\n1,A, 39.1,-84.5,0\n2,B,x,1,\n3,C,39,-84,1\n4,D,39,-84,\n")
    assert {r.stop_id for r in landed.stops(spark, str(tmp_path / "s.txt")).collect()} == {"1", "4"}


def test_shapefile(spark, tmp_path):
    def record(n, body):
        return struct.pack(">ii", n, len(body) // 2) + body

    def polyline(*parts):
        xs = [p for part in parts for p in part]
        starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
        return struct.pack("<i4d2i", 3, 0, 0, 0, 0, len(parts), len(xs)) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in xs)

    shp = struct.pack(">i", 9994) + b"\0" * 28 + struct.pack("<i", 3) + b"\0" * 64 + record(1, polyline([(1, 2), (3, 4)])) + record(2, struct.pack("<i", 0)) + record(3, polyline([(1, 1), (2, 2)], [(5, 6), (7, 8), (9, 9)]))
    dbf = b"\x03\0\0\0" + struct.pack("<IHH", 3, 65, 5) + b"\0" * 20 + b"NAME\0\0\0\0\0\0\0C" + b"\0" * 4 + bytes([4]) + b"\0" * 15 + b"\r" + b" one " + b"*two " + b" thr "
    (tmp_path / "r.shp").write_bytes(shp)
    (tmp_path / "r.dbf").write_bytes(dbf)
    got = {r.record: (r.attributes["NAME"], [(p.lat, p.lon) for p in r.geometry]) for r in landed.shapefile(spark, str(tmp_path)).collect()}
    assert got == {1: ("one", [(2, 1), (4, 3)]), 3: ("thr", [(6, 5), (8, 7), (9, 9)])}


@pytest.fixture
def stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def ran(df, spark, tmp_path, mode):
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table("out")


def test_streams_equal_batch(spark, sf, stream, tmp_path):
    batch = vehicles.positions(spark.read.parquet(f"{sf}/events.parquet"))
    got = ran(vehicles.latest(vehicles.positions(stream)), spark, tmp_path / "1", "complete").collect()
    assert sorted(got) == sorted(vehicles.latest(batch).collect())
    got = ran(vehicles.distinct_positions(vehicles.positions(stream)), spark, tmp_path / "2", "append").count()
    assert got == batch.select("event_id").distinct().count()
    closed = {(r.start, r.route_id): r.n for r in ran(vehicles.delays(vehicles.positions(stream)), spark, tmp_path / "3", "append").collect()}
    whole = {(r.start, r.route_id): r.n for r in vehicles.delays(batch).collect()}
    assert closed and closed.items() <= whole.items() and len(whole) - len(closed) <= 14


def test_limit_as_state(spark, sf, stream, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    got = {(r.vehicle_id, r.event_id) for r in ran(vehicles.limited(vehicles.positions(stream), 3, 4 * 3600), spark, tmp_path, "append").collect()}
    want = set()
    pdf = vehicles.positions(spark.read.parquet(f"{sf}/events.parquet")).toPandas()
    for v, g in pdf.sort_values(["ts", "event_id"]).groupby("vehicle_id"):
        recent = []
        for t, e in zip(g.ts.map(pd.Timestamp.timestamp), g.event_id):
            recent = [x for x in recent if x > t - 4 * 3600]
            if len(recent) < 3:
                recent.append(t)
                want.add((v, e))
    assert got == want and len(got) < len(pdf)


def message(n, body, kind=2):
    return bytes([n << 3 | kind]) + (bytes([len(body)]) if kind == 2 else b"") + body


def test_realtime_messages(spark, tmp_path):
    from waymeter.sources import realtime

    trip = message(1, message(1, b"T1") + message(5, b"R9"))
    place = message(2, message(1, struct.pack("<f", 39.5), 5) + message(2, struct.pack("<f", -84.5), 5))
    vehicle = message(4, trip + place + message(4, b"\x02", 0) + message(5, b"\xac\x02", 0) + message(8, message(1, b"V7")))
    stop = message(2, message(1, b"\x03", 0) + message(2, message(1, b"\xff" * 9 + b"\x01", 0) + message(2, b"\x64", 0)) + message(4, b"S4"))
    update = message(3, trip + stop + message(4, b"\x05", 0))
    (tmp_path / "a.pb").write_bytes(message(1, b"") + message(2, message(1, b"e1") + vehicle) + message(2, message(1, b"e2") + update))
    (tmp_path / "b.pb").write_bytes(b"")
    v = realtime.vehicle_positions(spark, str(tmp_path)).collect()
    assert len(v) == 1 and (v[0].vehicle_id, v[0].trip_id, v[0].route_id, v[0].lat, v[0].lon, v[0].current_status, v[0].timestamp, v[0].speed) == ("V7", "T1", "R9", 39.5, -84.5, 2, 300, None)
    u = realtime.trip_updates(spark, str(tmp_path)).collect()
    s = u[0].stop_time_updates[0]
    assert len(u) == 1 and (u[0].timestamp, s.stop_sequence, s.stop_id, s.arrival_time, s.arrival_delay, s.departure_time) == (5, 3, "S4", 100, -1, None)


def test_audit(spark, sf, tmp_path):
    from waymeter.plans import audit
    from waymeter.sources.fixtures import Roads

    x = Roads(spark, sf)
    got = audit.run_audit(audit.Inputs(x.ways, nodes=x["barrier_nodes"], bus_stops=x["bus_stops"], transit_stops=x["gtfs_stops"], route_vertices=x["route_vertices"], centerlines=matching.centerline_records(x.centerline_shapes)))
    assert not got.failed
    audit.save(got, str(tmp_path / "tables"))
    kinds = {r.kind: r["count"] for r in spark.read.parquet(str(tmp_path / "tables/findings")).groupBy("kind").count().collect()}
    assert {"oneway_minus_one": 196, "access_blocked": 34, "bus_stop_misplaced": 3}.items() <= kinds.items() and "barrier_unqualified" in kinds
    assert spark.read.parquet(str(tmp_path / "tables/fixes")).count() > 0
    audit.save_lists(got, str(tmp_path / "lists"))
    assert spark.read.option("header", True).csv(str(tmp_path / "lists/all")).count() == 1500
    page = audit.dashboard(got, 20)
    assert page.count('"Feature"') == 20 and "total_ways" in page
    ways_ = x["ways_attr"].select("id", "version", F.create_map(F.lit("oneway"), F.coalesce("oneway", F.lit("no"))).alias("tags"))
    audit.save_changes(ways_, spark.read.parquet(str(tmp_path / "tables/fixes")).where("kind = 'remove_false_oneway'"), str(tmp_path / "changes"))
    rows = spark.read.parquet(str(tmp_path / "changes")).groupBy("batch").count().orderBy("batch").collect()
    assert rows[0]["count"] == 500 and "oneway" not in spark.read.parquet(str(tmp_path / "changes")).first().xml

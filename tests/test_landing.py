"""What lands and what is read back: snapshots, streams, pages, payloads, workbooks; joins by cells of several sizes; admission and readiness."""

import datetime
import json
import math
import os
import random
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from waymeter.functions import geo
from waymeter.operators import admission, matching, payloads, readiness, spatial, variants, zones
from waymeter.sources import live, pages, realtime, snapshots, workbook
from waymeter.streaming import runs


def line(*points):
    return [(float(a), float(b)) for a, b in points]


LINES = "geometry array<struct<lat:double,lon:double>>"


# realtime


def test_feed_goes_on_behind_its_last_snapshot(spark, tmp_path):
    live.register(spark)
    feed, run = tmp_path / "feed", runs.Run(spark, str(tmp_path / "run"))
    feed.mkdir()
    put = lambda name, *ids: (feed / name).write_bytes(realtime.vehicles_message([{"vehicle_id": i, "timestamp": 5, "speed": 1.5, "lat": 39.5} for i in ids]))
    read = lambda: spark.readStream.format("transit_snapshots").option("path", str(feed)).load()
    put("v-1.pb", "a", "b")
    put(".v-2.pb", "being written")
    assert sorted(r.vehicle_id for r in run.go(read()).collect()) == ["a", "b"]
    put("v-2.pb", "c")
    (feed / "v-3.pb").write_bytes(realtime.vehicles_message([{"vehicle_id": "torn"}])[:-2])
    put("v-4.pb", "d")
    # a new run of the same place, as after a restart: every snapshot once, the torn one not at all
    rows = runs.Run(spark, str(tmp_path / "run")).go(read()).collect()
    assert sorted((r.snapshot, r.vehicle_id) for r in rows) == [("v-1.pb", "a"), ("v-1.pb", "b"), ("v-2.pb", "c"), ("v-4.pb", "d")]
    assert {(r.lat, r.speed, r.timestamp, r.bearing) for r in rows} == {(39.5, 1.5, 5, None)}
    assert run.go(read()).count() == 4
    assert [r.detail for r in live.errors(spark, str(feed / "v-*")).collect()] == ["v-3.pb"]


def test_newest_snapshot_that_can_be_read(spark, tmp_path):
    live.register(spark)
    batch = lambda path, feed="vehicles": spark.read.format("transit_snapshots").option("path", str(path)).option("feed", feed).load()
    assert batch(tmp_path / "nowhere").count() == 0
    (tmp_path / "1.pb").write_bytes(realtime.vehicles_message([{"vehicle_id": "old"}]))
    (tmp_path / "2.pb").write_bytes(b"\x12\x7f")
    assert [(r.snapshot, r.vehicle_id) for r in batch(tmp_path).collect()] == [("1.pb", "old")]
    assert batch(tmp_path, "nope").count() == 0 and "stop_time_updates" in batch(tmp_path, "trips").columns


# snapshots


def test_store(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "s"), least=10, keep=2)
    assert store.read("a") is None and store.versions("a") == [] and not store.fresh("a", 1e9)
    assert store.publish("a", spark.range(9)) is None and os.listdir(tmp_path / "s") == []
    for n in (10, 20, 30):
        store.publish("a", spark.range(n), sha="x")
    store.publish("a-b", spark.range(50))
    assert store.read("a").count() == 30 and len(store.versions("a")) == 2 and store.manifest(store.versions("a")[-1]) == {"rows": 30, "sha": "x"}
    # without its manifest, or with less than it says, a version is passed over
    last = store.versions("a")[-1]
    os.remove(f"{last.path}/manifest.json")
    assert store.read("a").count() == 20
    (tmp_path / "s" / last.name / "manifest.json").write_text(json.dumps({"rows": 31}))
    assert store.read("a").count() == 20
    assert store.fresh("a", 3600) and not store.fresh("a", 3600, now=store.newest("a").millis / 1000 + 3601)

    def fails():
        raise OSError("offline")

    assert snapshots.refreshed(store, "a", fails, 0).count() == 20 and snapshots.refreshed(store, "new", fails, 0) is None
    assert snapshots.refreshed(store, "a", lambda: spark.range(3), 0).count() == 20
    assert snapshots.refreshed(store, "a", lambda: spark.range(40), 0).count() == 40


# pages


def test_pages(spark, tmp_path):
    feature = {"properties": {"id": 1}, "geometry": {"type": "LineString", "coordinates": [[-84, 39], [-84.1, 39.1]]}}

    def answer(name, *said):
        folder = tmp_path / name
        folder.mkdir()
        for n, s in said:
            (folder / f"page-{n:06d}.json").write_text(s if isinstance(s, str) else json.dumps({"features": [feature] * s[0], "exceededTransferLimit": s[1]}))
        return str(folder)

    wrong = {
        "no page after page 1": answer("a", (1, (2, True))),
        "page 2 can't be read": answer("b", (1, (3, False)), (2, "{"), (3, (1, False))),
        "no page before page 2": answer("c", (2, (1, False))),
        "page 2 follows the last one": answer("d", (1, (2, False)), (2, (1, False))),
    }
    for problem, path in wrong.items():
        with pytest.raises(pages.IncompletePages, match=problem):
            pages.features(spark, path, "id bigint", full=3)
    # a full page goes on even if it doesn't say so; an empty last page is one
    assert pages.features(spark, answer("e", (1, (3, False)), (2, (2, True)), (3, (0, False))), "id bigint", full=3).count() == 5
    with pytest.raises((pages.IncompletePages, PySparkException)):
        pages.features(spark, str(tmp_path / "nothing"), "id bigint")


# payloads


def test_odd_payloads(spark):
    said = ["", "null", "[]", "7", "{", '{"uuid":0,"elems":"way/3"}', '{"id":"i","lat":{},"lon":1,"title":[1]}', '{"elements":[{"type":"RELATION","id":2.9},"node/ 5 ","way/7/8"]}', None]
    got = variants.issues(spark.createDataFrame([(s,) for s in said], "value string")).collect()
    assert [(r.id, r.lat, r.lon, r.item_title, r.ways, r.nodes, r.relations, r.url) for r in sorted(got, key=lambda r: r.id or "")] == [
        (None, None, None, None, [], [5], [2], "https://osmose.openstreetmap.fr/"),
        ("i", None, None, None, [], [], [], "https://osmose.openstreetmap.fr/issue/i"),
    ]
    e = variants.elements(spark.createDataFrame([('{"type":"way","id":"4","tags":{"a":1,"b":true,"name":" "},"geometry":{"lat":1}}',), (None,)], "value string")).collect()
    assert [(r.id, r.name, r.tags, r.geometry) for r in e] == [(4, None, {"a": "1", "name": " "}, [])]


# joins by cells


def test_long_lines_are_in_few_cells_and_lose_no_pair(spark):
    rnd = random.Random(3)
    short = [(i, line((39 + rnd.random(), -85 + rnd.random()), (39 + rnd.random(), -85 + rnd.random()))) if i % 9 == 0 else (i, line((a := 39 + rnd.random(), b := -85 + rnd.random()), (a + 0.001, b + 0.002))) for i in range(120)]
    long = [(1000 + i, line((36.5, -87.5), (41.5, -82.5 + i))) for i in range(2)] + [(2000 + i, g) for i, (_, g) in enumerate(short[::3])] + [(3000, line((10, 10), (10, 10)))]
    a, b = spark.createDataFrame(short, f"id long, {LINES}"), spark.createDataFrame(long, f"other long, {LINES}")
    env = lambda g: (min(p[0] for p in g), max(p[0] for p in g), min(p[1] for p in g), max(p[1] for p in g))
    near = lambda p, q, d: p[0] - d <= q[1] and q[0] <= p[1] + d and p[2] - d <= q[3] and q[2] <= p[3] + d
    want = sorted((i, j) for i, g in short for j, h in long if near(env(g), env(h), 0.01))
    assert sorted((r.id, r.other) for r in spatial.overlapping(a, b, 0.01, ["other"]).select("id", "other").collect()) == want
    back = spatial.overlapping(b.withColumnRenamed("other", "id"), a.withColumnRenamed("id", "other"), 0.01, ["other"])
    assert sorted((r.other, r.id) for r in back.select("id", "other").collect()) == want
    # a line across five degrees is in some hundred cells of its level
    size, cell = 5.0, 0.004
    level = max(0, math.ceil(math.log(size / (cell * spatial.WIDER)) / math.log(spatial.WIDER)))
    assert (size / (cell * spatial.WIDER**level) + 1) ** 2 < 1000


def test_nearest_line_however_far(spark):
    rnd = random.Random(5)
    ways = [(i, f"w{i}", line((a := rnd.uniform(-60, 60), b := rnd.uniform(-170, 170)), (a + 0.01, b + 0.02), (a + 0.03, b))) for i in range(40)]
    lines = [(i, line((a := rnd.uniform(30, 45), b := rnd.uniform(-100, -60)), (a + rnd.uniform(-3, 3), b + rnd.uniform(-3, 3)))) for i in range(25)]

    def planar(p, a, b):
        dx, dy = b[1] - a[1], b[0] - a[0]
        t = max(0, min(1, ((p[1] - a[1]) * dx + (p[0] - a[0]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(p[1] - a[1] - t * dx, p[0] - a[0] - t * dy)

    w, c = spark.createDataFrame(ways, f"id long, name string, {LINES}"), spark.createDataFrame(lines, f"source_id long, {LINES}").withColumn("source_name", F.lit("x"))
    probes = [(i, k, *g[k]) for i, _, g in ways for k in (0, 1, 2)]
    want = {(i, k): min((planar((lat, lon), *g), j) for j, g in lines)[1] for i, k, lat, lon in probes}
    got = spatial.nearest_segments(spark.createDataFrame(probes, "id long, at int, lat double, lon double"), c, ["id", "at"], "source_id").collect()
    assert {(r.id, r["at"]): r.source_id for r in got} == want
    away = {r.id: r.nearest_distance_m for r in matching.nearest_lines(w, c).collect()}
    assert set(away) == {i for i, *_ in ways} and max(away.values()) > 1_000_000


def test_zones_by_cells(spark):
    square = lambda s, w, n, e: line((s, w), (s, e), (n, e), (n, w), (s, w))
    polygons = [("big", [square(0, 0, 40, 50), square(10, 10, 20, 20)]), ("small", [square(5, 5, 5.001, 5.001)]), ("thin", [line((1, 1), (1.0001, 30), (1, 30.1), (1, 1))]), ("none", [])]
    rnd = random.Random(2)
    points = [(i, rnd.uniform(-1, 41), rnd.uniform(-1, 51)) for i in range(300)] + [(1000 + i, 5 + rnd.random() / 900, 5 + rnd.random() / 900) for i in range(50)]
    points += [(2000, 0.0, 7.0), (2001, 40.0, 50.0), (2002, 15.0, 10.0), (2003, None, 3.0), (2004, 5.0, 5.0005), (2005, 95.0, 0.0)]

    def within(p, rings):
        odd = False
        for g in rings:
            for (a, b), (c, d) in zip(g, g[1:], strict=False):
                if (b - d) * (p[0] - a) == (a - c) * (p[1] - b) and min(a, c) <= p[0] <= max(a, c) and min(b, d) <= p[1] <= max(b, d):
                    return False
                if (a > p[0]) != (c > p[0]) and p[1] < b + (p[0] - a) * (d - b) / (c - a):
                    odd = not odd
        return odd

    cover = zones.cover(spark.createDataFrame(polygons, "zone string, rings array<array<struct<lat:double,lon:double>>>"), side=16)
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    want = sorted((z, i) for i, lat, lon in points if lat is not None and abs(lat) <= 90 for z, rings in polygons if within((lat, lon), rings))
    found = zones.zones_of(df, cover)
    assert sorted((r.zone, r.id) for r in found.collect()) == want and {z for z, _ in want} >= {"big", "small"}
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and cover.cells.groupBy("zone").count().agg(F.max("count")).first()[0] <= 18 * 18
    assert sorted(r.id for r in zones.clipped(df, cover, "id").collect()) == sorted({i for _, i in want} | {2003})


def test_clip_counts_come_with_the_write(spark, tmp_path):
    rows = spark.createDataFrame([(1, "way", 0.5, 0.5), (2, "way", 5.0, 5.0), (3, "node", None, None), (4, "area", 0.5, 0.5)], "id long, kind string, lat double, lon double")
    ring = F.array(*(geo.point(F.lit(a), F.lit(b)) for a, b in ((0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0))))
    kept, seen = spatial.clip_observed(rows, F.array(ring), ["way", "node"])
    kept.write.parquet(str(tmp_path / "clip"))
    assert seen.get == {"way_kept": 1, "way_dropped": 1, "way_no_centroid": 0, "node_kept": 0, "node_dropped": 0, "node_no_centroid": 1}
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "clip")).collect()) == [1, 3, 4]


# admission, readiness, change sets


def test_admission_equals_a_loop(spark):
    rnd = random.Random(8)
    t, calls = 1_704_067_200.0 + 28 * 86_400, []
    for i in range(4000):
        t += rnd.choice([1, 2, 7, 30, 400]) if i < 3000 else 3
        calls.append((i, t))
    calls += [(9000 + i, calls[-1][1]) for i in range(9)]
    recent, used, want = [], {}, []
    for i, t in sorted(calls, key=lambda c: (c[1], c[0])):
        month = datetime.datetime.fromtimestamp(t, datetime.UTC).strftime("%Y-%m")
        recent = [x for x in recent if x > t - 60]
        if used.get(month, 0) < 700 and len(recent) < 5:
            recent.append(t)
            used[month] = used.get(month, 0) + 1
            want.append(i)
    df = spark.createDataFrame(calls + [(99_999, None)], "event_id long, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = admission.admitted(df.repartition(7), quota=1000, share=0.7)
        assert sorted(r.id for r in got.collect()) == sorted(want) and max(used.values()) == 700
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_readiness_of_folders(spark, tmp_path):
    (tmp_path / "east").mkdir()
    (tmp_path / "token.json").write_text('{"scope": "write_api"}')
    for d in readiness.DRAFTS:
        (tmp_path / d).write_text("x")
    (tmp_path / "east" / "scan-results.json").write_text('{"summary_stats": {"cagis_matched": 4, "route_impact": {"real": 2}}}')
    (tmp_path / "east" / "polygon.geojson").write_text("{}")
    (tmp_path / "east" / "cagis_baseline_1.json").write_text("{}")
    os.utime(tmp_path / "east" / "scan-results.json", (1_700_000_000, 1_700_000_000))
    now = F.lit("2023-11-15T00:00:00Z")
    tools = spark.createDataFrame([("lint", 0), ("tests", 1)], "tool string, exit_code int")
    both = spark.createDataFrame([("east",), ("west",)], "zone string")
    got = readiness.checks(readiness.zone_facts(both, readiness.listed(spark, str(tmp_path)), tools, now), "https://wiki/own")
    status = {(r.zone, r.name): r.status for r in got.collect()}
    assert len(status) == 34 and status["east", "scan freshness"] == "PASS" and status["west", "scan freshness"] == "FAIL" and status["east", "tests pass"] == "FAIL" and status["east", "lint clean"] == "PASS"
    assert status["east", "fixes to send"] == status["east", "route impact run"] == status["east", "wiki page set"] == status["west", "token scope"] == "PASS" and status["west", "zone polygon"] == "FAIL"
    few = got.where("name <> 'tests pass' and zone = 'east'").withColumn("status", F.when(F.col("name") == "scan freshness", "WARN").otherwise(F.col("status")))
    assert [readiness.report(few, strict).first().exit_code for strict in (False, True)] == [0, 2] and readiness.report(got).where("zone = 'west'").first().exit_code == 1


def test_change_sets_name_their_source(spark):
    fixes = [(0, 1, "remove_tag", "oneway", None, None), (1, 2, "modify_tag", None, {"name": "A & B"}, {"cagis_id": None}), (2, 3, "remove_tag", "oneway", None, {"cagis_id": "7"}), (3, 4, "remove_relation", None, None, {"tiger_id": "1"})]
    f = spark.createDataFrame(fixes, "place long, id long, action string, tag string, changes map<string,string>, evidence map<string,string>")
    ways = spark.createDataFrame([(1, 5, {"oneway": "yes"}), (2, 1, {})], "id long, version int, tags map<string,string>")
    elements, sets = payloads.change_sets(f, ways, "Tidy", 2)
    assert [(r.id, r.xml, r.error) for r in elements.orderBy("place").collect()] == [
        (1, '<way id="1" version="5"></way>', None), (2, '<way id="2" version="1"><tag k="name" v="A &amp; B"/></way>', None), (3, None, "Way 3: No <way> element in API response"), (4, None, "Way 4: Unknown action: remove_relation")]
    assert [(r.comment, r.attribution, r.fixes, r.applied) for r in sets.orderBy("batch").collect()] == [("Tidy (batch 1/2)", None, 2, 2), ("Tidy (batch 2/2)", payloads.ATTRIBUTION, 2, 0)]
    assert payloads.change_sets(f.limit(1), ways, "Tidy")[1].first().comment == "Tidy"


# workbooks


def test_workbook(spark, tmp_path, monkeypatch):
    rows = [(1, "One: a/b", i, [(float(i), None), (None, f"<t>&\x01 {i}")]) for i in range(25)] + [(2, "One  a b", 0, [(None, None), None])]
    df = spark.createDataFrame(rows, workbook.ROWS)
    path = str(tmp_path / "x.xlsx")
    workbook.save(df, path)
    got = workbook.read(spark, path).orderBy("sheet", "place").collect()
    assert [(r.place, r.cells) for r in got if r.sheet == "One  a b"] == [(i, [str(i), f"<t>& {i}"]) for i in range(25)]
    assert [(r.sheet, r.cells) for r in got][25:] == [("One  a b (2)", [None, None])] and os.listdir(tmp_path) == ["x.xlsx"]
    with zipfile.ZipFile(path) as book:
        assert book.testzip() is None
    bad = df.withColumn("sheet_no", F.when(F.col("place") == 20, F.raise_error(F.lit("torn")).cast("int")).otherwise(F.col("sheet_no")))
    with pytest.raises(Exception, match="torn"):
        bad.write.format("workbook").mode("overwrite").save(path)
    assert os.listdir(tmp_path) == ["x.xlsx"] and workbook.read(spark, path).count() == 26
    with pytest.raises(Exception, match="x.xlsx"):
        df.write.format("workbook").mode("append").save(path)


# detectors run apart


def test_failing_detector_leaves_the_others(spark, tmp_path, monkeypatch):
    from waymeter.plans import audit

    point = lambda v: (v, v)
    ways = spark.createDataFrame([(1, "Elm", "residential", None, "-1", None, "no", None, [point(39.0)]), (2, "Oak Pike", "residential", None, None, None, None, None, [])], f"id long, name string, highway string, service string, oneway string, maxspeed string, access string, motor_vehicle string, {LINES}")
    broken = ways.withColumn("access", F.when(F.col("id") == 2, F.raise_error(F.lit("row 2 can't be read"))).otherwise(F.col("access")))
    real, tried = audit.DETECTORS["blocked_access"], []
    monkeypatch.setitem(audit.DETECTORS, "blocked_access", lambda x: (tried.append(1), real(audit.Inputs(broken)))[1])
    said = audit.save_findings(audit.Inputs(ways), str(tmp_path), ["reversed_oneways", "blocked_access", "arterial_names", "bus_stops"], tries=3)
    assert {(r.detector, r.n, r.attempts, r.failed) for r in said.collect()} == {("reversed_oneways", 1, 1, False), ("blocked_access", None, 3, True), ("arterial_names", 1, 1, False)}
    assert "row 2" in said.where("failed").first().message and len(tried) == 3 and sorted(os.listdir(tmp_path)) == ["arterial_names", "reversed_oneways"]
    found = audit.saved_findings(said, str(tmp_path))
    assert sorted((r.kind, r.id) for r in found.collect()) == [("arterial_named_residential", 2), ("oneway_minus_one", 1)]
    from waymeter.operators import classify

    w = classify.classify(ways)
    one = audit.run_summary(said, w, classify.gap_pairs(w), found).first()
    assert (one.complete, one.failed_detectors, one.findings_total, one.total_ways) == (False, "blocked_access", 2, 2)

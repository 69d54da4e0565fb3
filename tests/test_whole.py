"""Queries and operators do the whole of their job: no part of a table, of a method or of the globe is left out."""

import math

from waymeter.operators import detectors, payloads
from waymeter.plans import more, registry  # noqa: F401

LINE = "array<struct<lat:double,lon:double>>"


def hav(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000.0 * math.asin(min(1.0, math.sqrt(h)))


def test_route_ends_of_every_way(spark, sf):
    from waymeter.sources.fixtures import Roads

    ways = [r for r in Roads(spark, sf).ways.select("id", "highway", "geometry").collect() if len(r.geometry) >= 2][:150]
    kinds = {"motorway", "trunk", "primary", "secondary", "tertiary", "unclassified", "residential"}
    roads = [(r.id, (p.lat, p.lon)) for r in ways if r.highway in kinds for p in r.geometry]

    def nearest(i, p):
        d, at = min(((hav(p, q), q) for j, q in roads if j != i), default=(math.inf, None))
        return d if d <= 800 else None

    got = {r.id: r for r in payloads.route_ends(spark.createDataFrame(ways, f"id long, highway string, geometry {LINE}")).collect()}
    assert set(got) == {r.id for r in ways} and any(r.id % 50 for r in ways)
    for r in ways:
        first, last = ((p.lat, p.lon) for p in (r.geometry[0], r.geometry[-1]))
        a, b = nearest(r.id, first), nearest(r.id, last)
        o, d = got[r.id].origin, got[r.id].destination
        assert (o is None) == (d is None) == (a is None or b is None)
        if o:
            assert abs(hav(first, o) - a) < 1e-6 and abs(hav(last, d) - b) < 1e-6
    assert any(r.origin for r in got.values())


def test_no_end_without_the_other(spark):
    line = lambda *p: [{"lat": a, "lon": b} for a, b in p]
    ways = [(1, "residential", line((39.0, -84.0), (39.1, -84.0))), (2, "residential", line((39.0005, -84.0), (39.0005, -84.001))), (3, "service", line((39.1, -84.0), (39.1001, -84.0)))]
    got = {r.id: r for r in payloads.route_ends(spark.createDataFrame(ways, f"id long, highway string, geometry {LINE}")).collect()}
    assert len(got) == 3 and got[1].origin is None and got[1].destination is None and got[2].origin.lat == 39.0 and got[2].destination.lat == 39.0


def test_whole_tables(spark, sf):
    keys, lanes = registry.QUERIES["prj_22_all_cache_keys"](spark, sf), registry.QUERIES["flt_15_all_gap_tasks"](spark, sf)
    assert keys.count() == spark.read.parquet(f"{sf}/orders.parquet").count() and keys.where("id >= 1000").count()
    assert lanes.where("name_key not like '%lane'").count()


def test_stops_far_from_every_road(spark):
    road = [(1, "residential", None, [{"lat": 39.0, "lon": -84.0}, {"lat": 39.001, "lon": -84.0}]), (2, "residential", None, [{"lat": -17.0, "lon": 179.9999}])]
    ways = spark.createDataFrame(road, f"id long, highway string, service string, geometry {LINE}")
    stops = [(1, 0.0, 0.0), (2, -84.0, 39.0), (3, 39.0, -84.0), (4, 39.0, -90.0), (5, -17.0, -179.9999), (6, None, 1.0), (7, 0.0, 0.0), (8, 89.9, 10.0), (9, 139.0, -84.0)]
    got = {r.id: r.distance_m for r in detectors.misplaced_stops(spark.createDataFrame(stops, "id long, lat double, lon double"), ways).collect()}
    spots = [(p["lat"], p["lon"]) for w in road for p in w[3]]
    want = {i: min(hav((a, b), q) for q in spots) for i, a, b in stops if a is not None}
    assert set(got) == {i for i, d in want.items() if d > 20} == {1, 2, 4, 5, 7, 8, 9}
    assert all(abs(got[i] - want[i]) < 1e-3 for i in got)


def test_nearest_anywhere(spark):
    import random

    from waymeter.operators import spatial

    rnd = random.Random(1)
    points = lambda n: [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(n)]
    a, b = points(60), points(40) + [(100 + i, 39 + rnd.random() / 10, -84 + rnd.random() / 10) for i in range(300)]
    got = {r.id: (r.nearest.k, r.distance) for r in spatial.nearest(spark.createDataFrame(a, "id int, lat double, lon double"), spark.createDataFrame(b, "k int, lat double, lon double"), "id", ["k"]).collect()}
    for i, lat, lon in a:
        d, k = min((hav((lat, lon), q[1:]), q[0]) for q in b)
        assert got[i][0] == k and abs(got[i][1] - d) < 1e-3


def test_budget_of_what_the_cap_leaves(spark):
    from waymeter.operators import feeds

    usage = spark.createDataFrame([("2024-01", 1000), ("2024-02", 4000), ("2024-03", 4999)], "month string, used long")
    got = lambda *a: [tuple(r) for r in feeds.budget(usage, *a).collect()]
    assert got("2024-01-11") == [("2024-01", 3000, 21, 142)]
    assert got("2024-01-31", 3001) == [("2024-01", 3000, 1, 3000, False, 300100.0 / 3000)]
    assert got("2024-02-29", 1) == [("2024-02", 0, 1, 0, False, math.inf)]
    assert got("2024-03-01", 1) == [("2024-03", 0, 31, 0, False, math.inf)]
    assert got("2024-04-01", 1) == []

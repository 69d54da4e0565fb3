"""Centerlines that share a geometry, and arrays of distances against column functions."""

import random

from pyspark.sql import functions as F

from waymeter.functions import geo, lines
from waymeter.operators import matching

LINE = "array<struct<lat:double,lon:double>>"


def test_each_geometry_is_measured_once(spark):
    """Of 40 centerlines on one geometry the one of the way's name wins, else the smallest id; all count as candidates."""
    on, away = [(39.0, -84.0), (39.0, -83.998)], [(39.0002, -84.0), (39.0002, -83.998)]
    names = ["Elm St", "Oak Street", None, ""]
    ways = spark.createDataFrame([(i, n, on) for i, n in enumerate(names)], f"id long, name string, geometry {LINE}")
    c = [(100 - k, "OAK ST" if k == 3 else f"ROAD {k}", "no", "local", 25, on) for k in range(40)] + [(7, "ELM STREET", "no", "local", 25, away)]
    c = spark.createDataFrame(c, f"source_id long, source_name string, source_oneway string, functional_class string, speed_limit int, geometry {LINE}")
    assert matching.candidates(ways, matching.shapes(c)).count() == len(names) * 2
    assert matching.scored_pairs(ways, c, fuzzy=False).count() == len(names) * 41
    want = {0: 7, 1: 97, 2: 61, 3: 61}
    assert {r.id: r.source_id for r in matching.match(ways, c, fuzzy=False).collect()} == want
    assert {r.id: r.source_id for r in matching.match(ways, c).collect()} == want | {0: 97}  # its name is more like than it is near
    d = {r.id: r for r in matching.diagnose(ways, c).collect()}
    assert {r.candidates for r in d.values()} == {41} and d[1].bucket == "MATCHED_HIGH" and d[2].hausdorff_m < 0.01


def test_distances_of_arrays_are_those_of_columns(spark):
    rng = random.Random(5)
    line = lambda n: [(39 + rng.random() / 100, -84 + rng.random() / 100) for _ in range(n)]
    rows = [(line(rng.choice((0, 1, 2, 5, 40))), line(rng.choice((0, 1, 2, 7, 30)))) for _ in range(200)]
    rows += [(line(2500), line(500)), (None, line(2)), ([(39.0, -84.0)] * 2, [(39.0, -84.0)] * 3)]
    df = spark.createDataFrame(rows, f"a {LINE}, b {LINE}")
    a, b = F.col("a"), F.col("b")
    pairs = ((lines.directed_hausdorff(a, b), geo.directed_hausdorff(a, b)), (lines.hausdorff(a, b), geo.hausdorff(a, b)), (lines.least_distance(a, b), F.array_min(F.transform(a, lambda p: geo.line_distance(p, b)))))
    for got, want in pairs:
        away = df.select(got.alias("x"), want.alias("y")).where("not (x <=> y or abs(x - y) < 1e-6)")
        assert away.collect() == []

"""Work that must not grow with the rows at one place, with one group or with one file."""

import os

from pyspark.sql import functions as F

from waymeter.operators import classify, detectors, spatial, variants
from waymeter.plans import files
from waymeter.plans.registry import QUERIES
from waymeter.sources import live


def met(monkeypatch, module):
    """The rows that enter each distance join of a module."""
    seen, real = [], spatial.within

    def counted(left, right, *a, **k):
        seen.append((left.count(), right.count()))
        return real(left, right, *a, **k)

    monkeypatch.setattr(module, "within", counted)
    return seen


def test_rows_of_one_place_meet_once(spark, monkeypatch):
    points = spark.range(300).select("id", F.lit(39.0).alias("lat"), F.lit(-84.0).alias("lon"))
    notes = points.select((F.col("id") + 7).alias("id"), F.lit("open").alias("status"), F.lit("2015-01-01").alias("date_created"), "lat", "lon")
    seen = met(monkeypatch, detectors)
    got = detectors.latest_notes(points, notes).collect()
    assert len(got) == 300 and {(r.note_id, r.distance) for r in got} == {(7, 0.0)}
    routes = points.select((F.col("id") % 2).alias("route_id"), F.col("id").alias("seq"), "lat", "lon")
    assert {tuple(r.routes) for r in detectors._on_routes(points, routes, 25.0).collect()} == {(0, 1)}
    assert seen == [(1, 1), (1, 2)]
    seen = met(monkeypatch, spatial)
    assert {(r.distance, r.nearest.k) for r in spatial.nearest(points, points.withColumnRenamed("id", "k"), "id", ["k"]).collect()} == {(0.0, 0)}
    assert spatial.near_any(points, points, 5.0).count() == 300
    assert seen == [(1, 1), (1, 1)]


def street(spark, n):
    """Ways of one street, ends 20 m apart from the next way's first."""
    p = lambda x: F.struct(F.lit(39.0).alias("lat"), x.alias("lon"))
    at = F.col("id") * 0.0006
    return spark.range(n).select("id", F.lit("a").alias("name_key"), F.lit("A").alias("name_display"), F.lit(n).alias("segments"), F.array(p(at), p(at + 0.0004)).alias("geometry"))


def test_gaps_of_small_and_large_streets(spark, monkeypatch):
    seen = met(monkeypatch, classify)
    for n in (classify.SMALL, classify.SMALL + 1):
        got = {(r.way1_id, r.way2_id, round(r.distance_m, 2), round(r.lon, 5)) for r in classify.gap_pairs(street(spark, n)).collect()}
        assert got == {(i, i + 1, 17.28, round(i * 0.0006 + 0.0005, 5)) for i in range(n - 1)}
    assert [a for a, _ in seen] == [0, 2 * (classify.SMALL + 1)]


def test_issues_are_dealt(spark):
    raw = spark.createDataFrame([('{"id":"a"}',)], "value string").coalesce(1)
    got = variants.issues(raw)
    assert got.rdd.getNumPartitions() > 1 and [r.id for r in got.collect()] == ["a"]


def test_shapefiles_are_of_bounded_size(spark, sf, monkeypatch):
    names, land = [], live.land
    monkeypatch.setattr(live, "land", lambda rows, path: (land(rows, path), names.extend(os.listdir(path.removeprefix("file://")))))
    monkeypatch.setattr(files, "SHAPES_BLOCK", 20)
    assert QUERIES["src_8_10_shapefile"](spark, sf).count() > 0
    assert len([n for n in names if n.endswith(".shp")]) > 25


def test_conflicts_of_small_and_large_streets(spark, sf, monkeypatch):
    got = []
    for most in (detectors.SMALL, 0):
        monkeypatch.setattr(detectors, "SMALL", most)
        got.append(sorted(tuple(r) for r in QUERIES["jn_2_conflicts"](spark, sf).collect()))
    assert got[0] and got[0] == got[1]

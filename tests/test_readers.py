"""Readers of landed histories, routes, polygons and baselines, and the audit's second source."""

import json
import os

from waymeter.sources import landed


def test_landed_files(spark, tmp_path):
    (tmp_path / "h").mkdir()
    version = lambda v, user: {"type": "way", "id": 7, "version": v, "user": user, "timestamp": f"2020-01-0{v}T00:00:00Z", "tags": {"name": f"n{v}"}, "nodes": [1, v]}
    (tmp_path / "h" / "7.json").write_text(json.dumps({"elements": [version(2, "b"), version(1, "a"), version(2, "b")]}))
    (tmp_path / "h" / "8.json").write_text("")
    got = landed.histories(spark, str(tmp_path / "h")).orderBy("version").collect()
    assert [(r.way_id, r.version, r.usr, r.tags["name"], r.nodes) for r in got] == [(7, 1, "a", "n1", [1, 1]), (7, 2, "b", "n2", [1, 2])]

    track = json.dumps({"features": [{"properties": {"track-length": "120", "total-time": "30"}}]})
    lines = [{"request": {"origin": "a", "destination": "b", "nogo": "c"}, "answer": track}, {"request": {"origin": "a", "destination": "b"}, "answer": "no route"}, {"answer": track}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)))
    got = {(r.origin, r.destination, r.nogo): (r.length_m, r.duration_s) for r in landed.routes(spark, str(tmp_path / "r.jsonl")).collect()}
    assert got == {("a", "b", "c"): (120.0, 30.0), ("a", "b", ""): (None, None)}

    (tmp_path / "z").mkdir()
    ring = [[-84.0, 39.0], [-84.0, 39.1], [-83.9, 39.1], [-84.0, 39.0]]
    (tmp_path / "z" / "one.json").write_text(json.dumps({"features": [{"geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    (tmp_path / "z" / "two.geojson").write_text(json.dumps({"features": [{"geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring, ring]]}}]}))
    got = {r.zone: r.rings for r in landed.rings(spark, str(tmp_path / "z")).collect()}
    assert {k: len(v) for k, v in got.items()} == {"one": 1, "two": 3} and (got["one"][0][1].lat, got["one"][0][1].lon) == (39.1, -84.0)


def test_newest_two_baselines(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("a", "b", "c")]
    for k, p in enumerate(paths):
        spark.range(k + 1).write.parquet(p)
        for f in os.listdir(p):
            os.utime(f"{p}/{f}", (1_700_000_000 + 100 * ((k + 1) % 3),) * 2)
    older, newer = landed.manifests(spark, paths)
    assert (older.count(), newer.count()) == (1, 2)  # c has the oldest files, then a, then b
    assert landed.manifests(spark, paths[:1]) is None


def test_audit_with_a_second_source(spark, sf):
    from waymeter.operators import matching
    from waymeter.plans import audit
    from waymeter.sources.fixtures import Roads

    x = Roads(spark, sf)
    lines = matching.centerline_records(x.centerline_shapes)
    out = audit.run_audit(audit.Inputs(x.ways, centerlines=lines.where("source_id % 3 = 0"), second_lines=lines.where("source_id % 3 <> 0")))
    assert not out.failed and out.fixes.where("kind = 'set_name_tiger' or kind = 'set_name_cagis'").count() and out.summary.first().findings_total

"""Points on the edges of polygons, as SQL takes them."""

import duckdb
from pyspark.sql import functions as F

from waymeter.functions import geo
from waymeter.operators import zones
from waymeter.plans import registry


def test_points_on_edges_fall_as_in_sql(spark):
    """Places of the road tables' lattice on the slanted edges and next to them."""
    spots = [(k, 39.16 + i / 10_000 + j / 100_000, -84.44 + e / 10_000) for k, (i, j, e) in enumerate((i, j, e) for i in range(95, 760, 5) for j in range(3) for e in (*range(80, 112), *range(890, 1012)))]
    con = duckdb.connect()
    con.execute("create table mid (id bigint, lat double, lon double)")
    df = spark.createDataFrame(spots, "id long, lat double, lon double")
    con.register("spots", df.toPandas())
    con.execute("insert into mid select * from spots")
    want = {r[0] for r in con.execute(f"select id from mid where ({registry._IN})%2=1").fetchall()}
    got = {r.id for r in df.where(geo.inside(F.col("lat"), F.col("lon"), registry.rings())).collect()}
    assert want and got == want


def test_half_open_zones_share_an_edge(spark):
    """A point on an edge of two zones is in none of them, or half open in one: that to the north or the east."""
    square = lambda s, w: [[(s, w), (s, w + 1), (s + 1, w + 1), (s + 1, w), (s, w)]]
    four = [(n, [[(float(a), float(b)) for a, b in r] for r in square(*at)]) for n, at in (("sw", (0, 0)), ("se", (0, 1)), ("nw", (1, 0)), ("ne", (1, 1)))]
    cover = zones.cover(spark.createDataFrame(four, "zone string, rings array<array<struct<lat:double,lon:double>>>"))
    df = spark.createDataFrame([(1, 0.5, 1.0), (2, 1.0, 0.5), (3, 1.0, 1.0), (4, 0.5, 0.5)], "id long, lat double, lon double")
    assert {(r.id, r.zone) for r in zones.zones_of(df, cover, half_open=True).collect()} == {(1, "se"), (2, "nw"), (3, "ne"), (4, "sw")}
    assert {(r.id, r.zone) for r in zones.zones_of(df, cover).collect()} == {(4, "sw")}

"""Distance joins by grid cells: an equi-join on cells with the exact distance behind it. No pair of rows farther apart than a few cells meets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..functions.tables import written


def _lon_width(band: Column, h: float) -> Column:
    """Degrees of longitude of a cell in a band of latitude: at least as many metres as the band is high, anywhere in it and its neighbours."""
    return F.lit(h) / F.cos(F.radians(F.least(F.lit(89.0), (F.abs(band) + 2) * h)))


def within(left: DataFrame, right: DataFrame, metres: float, right_cols: list[str], on: tuple[str, ...] = (), wide: int = 1) -> DataFrame:
    """Pairs of rows, equal in the columns ``on``, whose points (lat, lon) lie within ``metres``, with ``distance``: the left columns and ``right_cols``, which must have other names. Points that are null or out of range meet nothing; nothing meets across the date line.

    Cells are ``wide`` times ``metres`` high and wide; a right row is in every cell that it may be near to, nine where they are 1 wide,
    some two where they are 4 wide, for which more rows meet: that pays where ``on`` leaves few rows together.
    """
    h = wide * metres / 110_000
    ok = lambda df: df.where(geo.valid(F.col("lat"), F.col("lon")))
    band = F.floor(F.col("lat") / h)
    a = ok(left).withColumn("_band", band).withColumn("_cell", F.floor(F.col("lon") / _lon_width(F.col("_band"), h)))
    reach = lambda c, size: F.explode(F.sequence(F.floor(c / size - 1 / wide), F.floor(c / size + 1 / wide)))
    b = ok(right).select(*on, *right_cols, F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), reach(F.col("lat"), F.lit(h)).alias("_band"))
    b = b.select("*", reach(F.col("_lon"), _lon_width(F.col("_band"), h)).alias("_cell"))
    d = geo.haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    return a.join(b, ["_band", "_cell", *on]).withColumn("distance", d).where(F.col("distance") <= metres).drop("_band", "_cell", "_lat", "_lon")


def near_any(points: DataFrame, others: DataFrame, metres: float, key: str = "id") -> DataFrame:
    """(key) of points (key, lat, lon) within ``metres`` of any of ``others`` (lat, lon). Places meet, each once, however many rows are there."""
    met = within(points.select("lat", "lon").distinct(), others.select("lat", "lon").distinct(), metres, []).select("lat", "lon").distinct()
    return points.join(met, ["lat", "lon"], "left_semi").select(key).distinct()


#: Cells of the unit ball for :func:`anywhere`: sides of 1/2 for the widest, then of an eighth of the side before.
LEVELS, SIDE = 4, 0.5
_AXES = ("x", "y", "z")


def nearest(left: DataFrame, right: DataFrame, key: str, right_cols: list[str], radii: tuple[float, ...] = (60.0, 600.0, 6_000.0, 60_000.0)) -> DataFrame:
    """(key, distance, nearest: struct of ``right_cols``) of the nearest right row, ties to its columns in order. Rings widen for rows that have found none; beyond the last the whole globe is searched. Only rows without a point have none."""
    points = left.select(key, "lat", "lon").where("lat + lon is not null")
    # rows at one place have one answer: places meet, each once on either side
    whole = right.groupBy("lat", "lon").agg(F.min(F.struct(*right_cols)).alias("_it"))
    places = written(points.select("lat", "lon").distinct().withColumn("_place", F.monotonically_increasing_id()), "places")
    return points.join(_nearest_of(places, written(whole, "whole"), radii), ["lat", "lon"]).select(key, "distance", "nearest")


def _nearest_of(places: DataFrame, whole: DataFrame, radii: tuple[float, ...]) -> DataFrame:
    """(lat, lon, distance, nearest) of places (_place, lat, lon)."""
    out, rest, key = None, places, "_place"
    for metres in radii:
        # grid cells end at the date line and the poles: what is near them leaves the rings out
        inner = rest.where((F.abs("lat") <= 80) & (F.abs("lon") <= 176))
        best = within(inner, whole, metres, ["_it"]).groupBy(key).agg(F.min(F.struct("distance", F.col("_it").alias("nearest"))).alias("b")).select(key, "b.*")
        best = written(best, "ring")
        out = best if out is None else out.unionByName(best)
        rest = written(rest.join(best.select(key), key, "left_anti"), "rest")
        if rest.isEmpty():
            break
    else:
        far = anywhere(rest, whole, key)
        out = far if out is None else out.unionByName(far)
    return places.join(out, key).drop(key)


def _on_ball(df: DataFrame) -> DataFrame:
    """``df`` with its points' x, y, z on the unit ball; angles out of range are carried round."""
    a, b = F.radians("lat"), F.radians("lon")
    return df.withColumns({"x": F.cos(a) * F.cos(b), "y": F.cos(a) * F.sin(b), "z": F.sin(a)})


def anywhere(points: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """(key, distance, nearest) of the right row (_it, lat, lon) nearest to each point (key, lat, lon), however far.

    Occupied cells of the ball are split level by level: of each point's cells those stay that are no farther at their nearest
    corner than the best cell is at its farthest, and only rows in the last ones are measured.
    """
    fine = SIDE / 8 ** (LEVELS - 1)
    spots = _on_ball(whole.where(geo.valid(F.col("lat"), F.col("lon")))).select("_it", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), *(F.floor((F.col(c) + 1) / fine).alias(f"_{c}") for c in _AXES))
    rows = _on_ball(points.where("lat + lon is not null and abs(lat + lon) < 1e9")).select(key, "lat", "lon", *_AXES)
    for c in _AXES:
        rows = rows.withColumn(f"_{c}", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(int(2 / SIDE)).cast("long"))))
    cells = [f"_{c}" for c in _AXES]
    for level in range(LEVELS):
        side, shift = SIDE / 8**level, 3 * (LEVELS - 1 - level)
        here = spots.select(*(F.shiftright(c, shift).alias(c) for c in cells)).distinct()
        if level == 0:
            rows = rows.join(here, cells)
        else:
            here = here.select(*(F.shiftright(c, 3).alias(c) for c in cells), *(F.col(c).alias(f"{c}1") for c in cells))
            rows = rows.join(here, cells).select(key, "lat", "lon", *_AXES, *(F.col(f"{c}1").alias(c) for c in cells))
        low = {c: F.col(f"_{c}") * side - 1 - F.col(c) for c in _AXES}
        least = sum((F.pow(F.greatest(F.lit(0.0), d, -d - side), 2) for d in low.values()), F.lit(0.0))
        most = sum((F.pow(F.greatest(F.abs(d), F.abs(d + side)), 2) for d in low.values()), F.lit(0.0))
        rows = rows.withColumn("_least", least).withColumn("_best", F.min(most).over(Window.partitionBy(key, "lat", "lon"))).where("_least <= _best + 1e-12").drop("_least", "_best")
    d = geo.haversine(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"))
    return rows.join(spots, cells).groupBy(key).agg(F.min(F.struct(d.alias("distance"), F.col("_it").alias("nearest"))).alias("b")).select(key, "b.*")


def vertices(lines: DataFrame, *cols: str) -> DataFrame:
    return lines.select(*cols, F.explode("geometry").alias("_p")).select(*cols, F.col("_p.lat").alias("lat"), F.col("_p.lon").alias("lon"))


#: How much wider a cell is than one of the level below.
WIDER = 8


def overlapping(left: DataFrame, right: DataFrame, grow: float | Column, right_cols: list[str], cell: float = 0.004, on: tuple[str, ...] = (), inside_m: float | None = None, among: tuple[DataFrame | None, DataFrame | None] = (None, None)) -> DataFrame:
    """Pairs of lines (geometry), equal in the columns ``on``, whose envelopes meet when the left one grows by ``grow`` degrees; right columns as given, its geometry as ``source``.

    An envelope has the level whose cells are at least an eighth of it: a line across a country is in a hundred cells, not in
    millions. Rows meet at the coarser of their two levels, in the one cell where both begin, so that a pair comes once; the finer
    one is spread over cells of that level, if the other table has any. Which levels there are is asked of both tables first.

    With ``inside_m``, pairs are left out in which a vertex of the left line is surely farther than that from the right one, by
    its envelope: for callers that keep no such pair. ``among``: tables whose lines have all levels of these ones, to be asked in
    their place where these are not written.
    """
    env = lambda g: F.struct(*(c.alias(k) for k, c in geo.envelope(F.col("geometry"), g).items()))
    size = F.greatest(F.col("_e.e") - F.col("_e.w"), F.col("_e.n") - F.col("_e.s"))
    level = F.greatest(F.lit(0), F.ceil(F.log(size / (cell * WIDER)) / F.log(F.lit(float(WIDER))))).cast("int")
    boxed = lambda df, g: df.where("size(geometry) > 0").withColumn("_e", env(g)).withColumn("_own", F.coalesce(level, F.lit(0)))
    a, b = boxed(left, grow), boxed(right, 0.0)
    asked = (df if wider is None else boxed(wider.select("geometry"), g) for df, wider, g in zip((a, b), among, (grow, 0.0), strict=True))
    in_use = [sorted(r[0] for r in df.select("_own").distinct().collect()) for df in asked]  # a few numbers

    def spread(df: DataFrame, other: list[int]) -> DataFrame:
        upper = F.filter(F.array(*map(F.lit, other)).cast("array<int>"), lambda x: x > F.col("_own"))
        df = df.withColumn("_l", F.explode(F.concat(F.array("_own"), upper))).withColumn("_h", cell * F.pow(F.lit(float(WIDER)), F.col("_l")))
        df = df.withColumns({"_x0": F.floor(F.col("_e.w") / F.col("_h")), "_y0": F.floor(F.col("_e.s") / F.col("_h"))})
        df = df.select("*", F.explode(F.sequence("_x0", F.floor(F.col("_e.e") / F.col("_h")))).alias("_x"))
        return df.select("*", F.explode(F.sequence("_y0", F.floor(F.col("_e.n") / F.col("_h")))).alias("_y"))

    a, b = spread(a, in_use[1]).drop("_h"), spread(b, in_use[0])
    reach = []
    if inside_m is not None:
        # vertices without a place are in the envelope by half, but not in a distance
        a = a.withColumn("_whole", F.forall("geometry", lambda p: (p["lat"] + p["lon"]).isNotNull() & ~F.isnan(p["lat"] + p["lon"])))
        dlat, top = inside_m / geo.BUFFER_DEGREE_M, F.greatest(F.abs("_e.s"), F.abs("_e.n"))
        dlon = F.when(top < 89, F.lit(dlat) / F.cos(F.radians(top + 0.01))).otherwise(360.0)
        reach = [F.struct((F.col("_e.s") - dlat).alias("s"), (F.col("_e.w") - dlon).alias("w"), (F.col("_e.n") + dlat).alias("n"), (F.col("_e.e") + dlon).alias("e")).alias("_r")]
    b = b.select(*on, *right_cols, F.col("geometry").alias("source"), "_l", "_x", "_y", F.col("_e").alias("_f"), F.col("_x0").alias("_x1"), F.col("_y0").alias("_y1"), F.col("_own").alias("_own1"), *reach)
    meet = (F.col("_e.w") <= F.col("_f.e")) & (F.col("_f.w") <= F.col("_e.e")) & (F.col("_e.s") <= F.col("_f.n")) & (F.col("_f.s") <= F.col("_e.n"))
    once = (F.col("_x") == F.greatest("_x0", "_x1")) & (F.col("_y") == F.greatest("_y0", "_y1")) & (F.col("_l") == F.greatest("_own", "_own1"))
    if reach:
        meet &= ~F.col("_whole") | ((F.col("_e.s") + grow >= F.col("_r.s")) & (F.col("_e.w") + grow >= F.col("_r.w")) & (F.col("_e.n") - grow <= F.col("_r.n")) & (F.col("_e.e") - grow <= F.col("_r.e")))
    return a.join(b, ["_l", "_x", "_y", *on]).where(meet & once).drop(*"_l _x _y _e _f _x0 _y0 _x1 _y1 _own _own1 _whole _r".split())


def planar(p: Column, a: Column, b: Column) -> Column:
    """Degrees from a point to a segment, as on a plane."""
    dx, dy = b["lon"] - a["lon"], b["lat"] - a["lat"]
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((p["lon"] - a["lon"]) * dx + (p["lat"] - a["lat"]) * dy, dx * dx + dy * dy))), F.lit(0.0))
    return F.hypot(p["lon"] - a["lon"] - t * dx, p["lat"] - a["lat"] - t * dy)


#: Cells of the plane for :func:`nearest_segments`, in degrees, the widest first.
PLANE = (64.0, 8.0, 1.0, 0.125)


def nearest_segments(points: DataFrame, lines: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """(keys, id_col): of lines (id_col, geometry) the one nearest in degrees to each point (keys, lat, lon), however far, ties to the smaller id.

    Occupied cells are split level by level: of each point's cells those stay that are no farther at their nearest than the best
    cell that holds a vertex is at its farthest, and only segments in the last ones are measured.
    """
    g = F.col("geometry")
    pieces = F.transform(F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))), lambda b, i: F.struct(F.get(g, i).alias("a"), b.alias("b")))
    fine, cell = PLANE[-1], lambda c, h: F.floor(c / h)
    segs = lines.select(F.col(id_col).alias("_id"), F.explode(pieces).alias("_s"))
    low, high = (lambda c, f=f: f(F.col(f"_s.a.{c}"), F.col(f"_s.b.{c}")) for f in (F.least, F.greatest))
    held = lambda y, x: (cell(F.col(f"_s.{y}.lat"), fine) == F.col("_y")) & (cell(F.col(f"_s.{x}.lon"), fine) == F.col("_x"))
    segs = segs.select("*", F.explode(F.sequence(cell(low("lat"), fine), cell(high("lat"), fine))).alias("_y")).select("*", F.explode(F.sequence(cell(low("lon"), fine), cell(high("lon"), fine))).alias("_x"))
    segs = segs.withColumn("_v", held("a", "a") | held("b", "b"))
    occupied = written(segs.groupBy("_y", "_x").agg(F.max("_v").alias("_v")), "occupied")
    rows = points.where("lat + lon is not null").select(*keys, "lat", "lon")
    last = None
    for h in PLANE:
        k = int(h / fine)
        here = occupied.select(F.floor(F.col("_y") / k).alias("_y"), F.floor(F.col("_x") / k).alias("_x"), "_v").groupBy("_y", "_x").agg(F.max("_v").alias("_v"))
        if last is None:
            reach = lambda top: F.explode(F.sequence(F.lit(int(-top // h)).cast("long"), F.lit(int(top // h)).cast("long")))  # noqa: E731, B023
            rows = rows.withColumn("_y", reach(90.0)).withColumn("_x", reach(180.0)).join(here, ["_y", "_x"])
        else:
            n = int(last / h)
            here = here.withColumnsRenamed({"_y": "_y1", "_x": "_x1"}).withColumns({"_y": F.floor(F.col("_y1") / n), "_x": F.floor(F.col("_x1") / n)})
            rows = rows.drop("_v").join(here, ["_y", "_x"]).drop("_y", "_x").withColumnsRenamed({"_y1": "_y", "_x1": "_x"})
        ends = [(F.col(c) * h - F.col(p), (F.col(c) + 1) * h - F.col(p)) for c, p in (("_y", "lat"), ("_x", "lon"))]
        least = F.hypot(*(F.greatest(F.lit(0.0), a, -b) for a, b in ends))
        most = F.hypot(*(F.greatest(F.abs(a), F.abs(b)) for a, b in ends))
        best = F.min(F.when(F.col("_v"), most)).over(Window.partitionBy(*keys))
        rows = rows.withColumn("_best", best).where(least <= F.col("_best") * (1 + 1e-12)).drop("_best")
        last = h
    away = planar(geo.point(F.col("lat"), F.col("lon")), F.col("_s.a"), F.col("_s.b"))
    met = rows.drop("_v").join(segs.drop("_v"), ["_y", "_x"])
    return met.groupBy(*keys).agg(F.min(F.struct(away.alias("d"), F.col("_id"))).alias("b")).select(*keys, F.col("b._id").alias(id_col))


def clip_counts(points: DataFrame, rings: Column, by: str) -> DataFrame:
    """(by, kept, dropped, no_centroid): rows (lat, lon) inside a polygon, outside of it, and without a point."""
    unplaced = F.col("lat").isNull() | F.col("lon").isNull()
    within_ = F.coalesce(geo.inside(F.col("lat"), F.col("lon"), rings), F.lit(False))
    return points.groupBy(by).agg(F.count_if(~unplaced & within_).alias("kept"), F.count_if(~unplaced & ~within_).alias("dropped"), F.count_if(unplaced).alias("no_centroid"))


def clip(points: DataFrame, rings: Column) -> DataFrame:
    """Rows inside a polygon, and rows without a point, which are kept."""
    unplaced = F.col("lat").isNull() | F.col("lon").isNull()
    return points.where(unplaced | geo.inside(F.col("lat"), F.col("lon"), rings))


def clip_observed(points: DataFrame, rings: Column, kinds: list[str], by: str = "kind") -> tuple[DataFrame, Observation]:
    """:func:`clip` with its counts as an observation: whatever writes the clip counts rows kept, dropped and without a place on the way, of each of the given kinds, without a scan of its own.

    The observation has <kind>_kept, <kind>_dropped and <kind>_no_centroid once the clip has been written.
    """
    unplaced = F.col("lat").isNull() | F.col("lon").isNull()
    within_ = F.coalesce(geo.inside(F.col("lat"), F.col("lon"), rings), F.lit(False))
    seen = Observation()
    tests = {"kept": ~F.col("_out") & within_, "dropped": ~F.col("_out") & ~within_, "no_centroid": F.col("_out")}
    counts = [F.count_if((F.col(by) == k) & F.col(f"_{t}")).alias(f"{k}_{t}") for k in kinds for t in tests]
    marked = points.withColumn("_out", unplaced).withColumns({f"_{t}": c for t, c in tests.items()})
    return marked.observe(seen, *counts).where(F.col("_kept") | F.col("_no_centroid")).select(*points.columns), seen

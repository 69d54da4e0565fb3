"""Column functions on points and polylines: arrays of struct<lat, lon>, in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M, DEGREE_M, BUFFER_DEGREE_M = 6_371_000.0, 111_320.0, 111_000.0


def valid(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on the sphere."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def between(p: Column, q: Column) -> Column:
    return haversine(p["lat"], p["lon"], q["lat"], q["lon"])


def rounded(x: Column, digits: int) -> Column:
    """Half up on the double, by floor: the same in every engine."""
    return F.floor(x * 10**digits + 0.5) / F.lit(float(10**digits))


def first(line: Column) -> Column:
    return F.get(line, F.lit(0))


def last(line: Column) -> Column:
    return F.get(line, F.size(line) - 1)


def middle(line: Column) -> Column:
    """The vertex at half of the count; null for an empty line."""
    return F.get(line, F.expr("0") + F.floor(F.size(line) / 2).cast("int"))


def point(lat: Column, lon: Column) -> Column:
    return F.struct(lat.alias("lat"), lon.alias("lon"))


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    """Metres from a point to a segment on a local plane; to the point where the segment has no length."""
    k = F.cos(F.radians((a["lat"] + b["lat"]) / 2)) * DEGREE_M
    dx, dy = (b["lon"] - a["lon"]) * k, (b["lat"] - a["lat"]) * DEGREE_M
    px, py = (p["lon"] - a["lon"]) * k, (p["lat"] - a["lat"]) * DEGREE_M
    square = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(px * dx + py * dy, square)))
    return F.when(square == 0, between(p, a)).otherwise(F.hypot(px - t * dx, py - t * dy))


def line_distance(p: Column, line: Column) -> Column:
    """Metres from a point to a polyline; infinite for an empty one."""
    by_segment = F.array_min(F.transform(F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), lambda b, i: segment_distance(p, F.get(line, i), b)))
    return F.when(F.size(line) == 0, F.lit(float("inf"))).when(F.size(line) == 1, between(p, first(line))).otherwise(by_segment)


def directed_hausdorff(observed: Column, source: Column) -> Column:
    """The largest distance of a vertex of ``observed`` from ``source``."""
    return F.array_max(F.transform(observed, lambda p: line_distance(p, source)))


def hausdorff(a: Column, b: Column) -> Column:
    return F.greatest(directed_hausdorff(a, b), directed_hausdorff(b, a))


def vertex_distance(p: Column, line: Column) -> Column:
    return F.array_min(F.transform(line, lambda v: between(p, v)))


def unit_vector(line: Column) -> Column:
    """struct<x, y> of the direction from the first vertex to the last, in degrees; null without one."""
    dx, dy = last(line)["lon"] - first(line)["lon"], last(line)["lat"] - first(line)["lat"]
    n = F.nullif(F.hypot(dx, dy), F.lit(0.0))
    return F.when((F.size(line) >= 2) & n.isNotNull(), F.struct((dx / n).alias("x"), (dy / n).alias("y")))


def alignment(a: Column, b: Column) -> Column:
    """0 to 1; 0 where either is null."""
    return F.coalesce(F.least(F.lit(1.0), F.abs(a["x"] * b["x"] + a["y"] * b["y"])), F.lit(0.0))


def length(line: Column) -> Column:
    steps = F.transform(F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0))), lambda q, i: between(F.get(line, i), q))
    return F.aggregate(steps, F.lit(0.0), lambda a, x: a + x)


def bearing(a: Column, b: Column) -> Column:
    """The initial bearing in radians."""
    la, lb, d = F.radians(a["lat"]), F.radians(b["lat"]), F.radians(b["lon"] - a["lon"])
    return F.atan2(F.sin(d) * F.cos(lb), F.cos(la) * F.sin(lb) - F.sin(la) * F.cos(lb) * F.cos(d))


def destination(p: Column, heading: Column, metres: Column) -> Column:
    la, lo, d = F.radians(p["lat"]), F.radians(p["lon"]), metres / EARTH_M
    lat = F.asin(F.sin(la) * F.cos(d) + F.cos(la) * F.sin(d) * F.cos(heading))
    lon = lo + F.atan2(F.sin(heading) * F.sin(d) * F.cos(la), F.cos(d) - F.sin(la) * F.sin(lat))
    return point(F.degrees(lat), F.degrees(lon))


def envelope(line: Column, grow: float | Column = 0.0) -> dict[str, Column]:
    side = lambda f, c, by: f(F.transform(line, lambda p: p[c])) + F.lit(by)
    return {"s": side(F.array_min, "lat", -grow), "w": side(F.array_min, "lon", -grow), "n": side(F.array_max, "lat", grow), "e": side(F.array_max, "lon", grow)}


def inside(lat: Column, lon: Column, rings: Column) -> Column:
    """Whether a point lies in a polygon of closed rings, by crossings over all of them: holes are out. Points on the boundary are undecided."""
    def crossings(ring: Column) -> Column:
        return F.aggregate(F.transform(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda b, i: _crosses(F.get(ring, i), b)), F.lit(0), lambda n, x: n + x)

    def _crosses(a: Column, b: Column) -> Column:
        at = a["lon"] + F.try_divide((lat - a["lat"]) * (b["lon"] - a["lon"]), b["lat"] - a["lat"])
        return F.when(((a["lat"] > lat) != (b["lat"] > lat)) & (lon < at), 1).otherwise(0)

    return F.aggregate(F.transform(rings, crossings), F.lit(0), lambda n, x: n + x) % 2 == 1

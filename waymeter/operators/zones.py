"""Points against many polygons, by a cover of cells: a cell inside a polygon decides by itself, one on its border asks the edges at the point's height.

Each polygon has cells of its own size, ``SIDE`` of them at most along its longer side, so that its cover is bounded however large
or small it is. Points meet cells by an equi-join, once for each size in use.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

#: Cells along the longer side of a polygon's envelope, at most but for one.
SIDE = 64


@dataclass
class Cover:
    """``cells``: (zone, level, x, y, inner); ``rows``: (zone, level, y, edges) of border cells' rows; ``levels`` in use: a cell of a level is 2 to its power degrees wide."""

    cells: DataFrame
    rows: DataFrame
    levels: list[int]


def _width(level: Column) -> Column:
    return F.pow(F.lit(2.0), level)


def cover(zones: DataFrame, side: int = SIDE) -> Cover:
    """The cover of polygons (zone, rings), rings closed, holes among them. Rings of fewer than two vertices have no edges; a zone without edges covers nothing."""
    shift = lambda ring: F.transform(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda b, i: F.struct(F.get(ring, i).alias("a"), b.alias("b")))
    edges = zones.select("zone", F.explode(F.flatten(F.transform("rings", shift))).alias("e")).select("zone", *(F.col(f"e.{p}.{c}").alias(f"{p}{c[:2]}") for p in "ab" for c in ("lat", "lon")))
    ends = {"s": F.min(F.least("ala", "bla")), "n": F.max(F.greatest("ala", "bla")), "w": F.min(F.least("alo", "blo")), "e": F.max(F.greatest("alo", "blo"))}
    boxes = edges.groupBy("zone").agg(*(c.alias(k) for k, c in ends.items()))
    extent = F.greatest(F.col("n") - F.col("s"), F.col("e") - F.col("w"), F.lit(1e-9))
    boxes = boxes.withColumn("level", F.ceil(F.log2(extent / side)).cast("int"))
    levels = sorted(r[0] for r in boxes.select("level").distinct().collect())  # bounded by the range of doubles
    edges = edges.join(boxes.select("zone", "level"), "zone").withColumn("h", _width(F.col("level")))
    cell = lambda c: F.floor(c / F.col("h"))
    span = lambda p, q: F.explode(F.sequence(cell(F.least(p, q)), cell(F.greatest(p, q))))
    # an edge's cells: those of its envelope that don't lie wholly on one side of its line; closed, so that a neighbour that it only touches is one too
    met = edges.select("*", F.explode(F.sequence(cell(F.least("ala", "bla")) - 1, cell(F.greatest("ala", "bla")))).alias("y"))
    met = met.select("*", F.explode(F.sequence(cell(F.least("alo", "blo")) - 1, cell(F.greatest("alo", "blo")))).alias("x"))
    south, west = F.col("y") * F.col("h"), F.col("x") * F.col("h")
    touching = (F.greatest("ala", "bla") >= south) & (F.least("ala", "bla") <= south + F.col("h")) & (F.greatest("alo", "blo") >= west) & (F.least("alo", "blo") <= west + F.col("h"))
    turn = lambda la, lo: (F.col("blo") - F.col("alo")) * (la - F.col("ala")) - (F.col("bla") - F.col("ala")) * (lo - F.col("alo"))
    turns = [turn(south + a * F.col("h"), west + b * F.col("h")) for a in (0, 1) for b in (0, 1)]
    border = met.where(touching & (F.least(*turns) <= 0) & (F.greatest(*turns) >= 0)).select("zone", "level", "x", "y").distinct()
    # a row's edges: all that reach its height, which are all that a ray along it may cross
    rows = edges.select("zone", "level", F.struct("ala", "alo", "bla", "blo").alias("edge"), F.explode(F.sequence(cell(F.least("ala", "bla")) - 1, cell(F.greatest("ala", "bla")))).alias("y"))
    rows = rows.where((F.greatest("edge.ala", "edge.bla") >= F.col("y") * _width(F.col("level"))) & (F.least("edge.ala", "edge.bla") <= (F.col("y") + 1) * _width(F.col("level"))))
    rows = rows.groupBy("zone", "level", "y").agg(F.collect_list("edge").alias("edges"))
    # cells off the border are inside or outside as their centres are
    every = boxes.withColumn("h", _width(F.col("level"))).select("zone", "level", "h", span("s", "n").alias("y"), "w", "e").select("zone", "level", "h", "y", span("w", "e").alias("x"))
    off = every.join(border, ["zone", "level", "x", "y"], "left_anti").join(rows, ["zone", "level", "y"])
    inner = off.where(_inside((F.col("y") + 0.5) * F.col("h"), (F.col("x") + 0.5) * F.col("h"), F.col("edges"))).select("zone", "level", "x", "y")
    cells = border.withColumn("inner", F.lit(False)).unionByName(inner.withColumn("inner", F.lit(True)))
    return Cover(cells, rows, levels)


def _inside(lat: Column, lon: Column, edges: Column, half_open: bool = False) -> Column:
    """By crossings of a ray to the east; points on an edge are not inside, or with ``half_open`` as the crossings say."""

    def crosses(e: Column) -> Column:
        at = e["alo"] + F.try_divide((lat - e["ala"]) * (e["blo"] - e["alo"]), e["bla"] - e["ala"])
        return F.when(((e["ala"] > lat) != (e["bla"] > lat)) & (lon < at), 1).otherwise(0)

    def on(e: Column) -> Column:
        turn = (e["blo"] - e["alo"]) * (lat - e["ala"]) - (e["bla"] - e["ala"]) * (lon - e["alo"])
        return (turn == 0) & lat.between(F.least(e["ala"], e["bla"]), F.greatest(e["ala"], e["bla"])) & lon.between(F.least(e["alo"], e["blo"]), F.greatest(e["alo"], e["blo"]))

    odd = F.aggregate(F.transform(edges, crosses), F.lit(0), lambda n, x: n + x) % 2 == 1
    return odd if half_open else odd & ~F.exists(edges, on)


def zones_of(points: DataFrame, covered: Cover, half_open: bool = False) -> DataFrame:
    """``points`` (lat, lon) with the ``zone`` that they lie in, a row for each such zone; points in none, or without a place, are left out. Boundaries belong to no zone, or with ``half_open`` to it where the zone lies north or east of them."""
    placed = points.where(geo.valid(F.col("lat"), F.col("lon")))
    at = placed.withColumn("_level", F.explode(F.array(*map(F.lit, covered.levels)))) if covered.levels else placed.withColumn("_level", F.lit(0)).limit(0)
    at = at.withColumns({"_y": F.floor(F.col("lat") / _width(F.col("_level"))), "_x": F.floor(F.col("lon") / _width(F.col("_level")))})
    cells = covered.cells.select("zone", F.col("level").alias("_level"), F.col("x").alias("_x"), F.col("y").alias("_y"), "inner")
    met = at.join(cells, ["_level", "_x", "_y"])
    rows = covered.rows.select("zone", F.col("level").alias("_level"), F.col("y").alias("_y"), "edges")
    asked = met.where("not inner").join(rows, ["zone", "_level", "_y"]).where(_inside(F.col("lat"), F.col("lon"), F.col("edges"), half_open))
    cols = [*points.columns, "zone"]
    return met.where("inner").select(cols).unionByName(asked.select(cols))


def clipped(points: DataFrame, covered: Cover, key: str) -> DataFrame:
    """Rows in any zone, and rows without a place, which are kept. ``key`` tells rows apart."""
    inside = zones_of(points.select(key, "lat", "lon"), covered).select(key).distinct()
    unplaced = F.col("lat").isNull() | F.col("lon").isNull()
    return points.where(unplaced).unionByName(points.where(~unplaced).join(inside, key, "left_semi"))

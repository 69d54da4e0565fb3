"""Landed files as tables: element bundles, GeoJSON, CSV feeds, issue lists, shapefiles with dBASE attributes, encoded polylines.

Fetching is not Spark's work; what a fetch has written is read here, in parallel by file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

ELEMENT = "struct<type:string,id:bigint,tags:map<string,string>,geometry:array<struct<lat:double,lon:double>>,lat:double,lon:double,members:array<struct<type:string,ref:bigint,role:string,geometry:string,members:string>>,version:int,timestamp:string,changeset:bigint,user:string,uid:bigint>"


def elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of bundles {"elements": [...]}, one row each."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.inline(F.from_json("value", f"elements array<{ELEMENT}>")["elements"]))


def split(elements: DataFrame) -> dict[str, DataFrame]:
    return {k: elements.where(F.col("type") == k) for k in ("way", "node", "relation")}


def ways(elements: DataFrame) -> DataFrame:
    """Ways with their tags as columns; vertices that are null or out of range are left out."""
    tag = lambda k: F.try_element_at("tags", F.lit(k)).alias(k.replace(":", "_"))
    shape = F.filter(F.coalesce("geometry", F.array().cast("array<struct<lat:double,lon:double>>")), lambda p: geo.valid(p["lat"], p["lon"]))
    keys = ("name", "highway", "service", "oneway", "tiger:reviewed", "tiger:name_base", "tiger:cfcc", "surface", "lanes", "maxspeed", "access", "motor_vehicle")
    return elements.where("type = 'way'").select("id", *map(tag, keys), shape.alias("geometry"), "version", "timestamp", "changeset", F.col("user").alias("usr"), "uid")


def features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """GeoJSON line features: the given properties (DDL) and ``parts``, an array of lines of struct<lat, lon>. A malformed file fails the job: a partial read is never used."""
    raw = spark.read.text(path, wholetext=True)
    f = raw.select(F.inline(F.from_json("value", f"features array<struct<properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>", {"mode": "FAILFAST"})["features"]))
    flat, nested = F.from_json("geometry.coordinates", "array<array<double>>"), F.from_json("geometry.coordinates", "array<array<array<double>>>")
    line = lambda xs: F.transform(xs, lambda p: geo.point(p[1], p[0]))
    parts = F.when(F.col("geometry.type") == "LineString", F.array(line(flat))).when(F.col("geometry.type") == "MultiLineString", F.transform(nested, line))
    return f.select("properties.*", F.filter(parts, lambda p: F.size(p) >= 2).alias("parts"))


def longest_part(parts: Column) -> Column:
    """The part with most vertices, the first of equals."""
    most = F.array_max(F.transform(parts, lambda p, i: F.struct(F.size(p).alias("n"), (-i).alias("o"))))
    return F.get(parts, -most["o"])


def bus_routes(features: DataFrame) -> DataFrame:
    """(route_id, route_short, route_long, part, geometry) of line features with ROUTE_ID, ROUTE_SHORT and ROUTE_LONG: each part of two vertices or more is a row, numbered from 0 in its feature."""
    return features.select(F.col("ROUTE_ID").alias("route_id"), F.col("ROUTE_SHORT").alias("route_short"), F.col("ROUTE_LONG").alias("route_long"), F.posexplode("parts").alias("part", "geometry"))


def route_vertices(routes: DataFrame) -> DataFrame:
    """(route_id, seq, lat, lon): the vertices of a route's parts, one part after another; a route without an id goes by its short name, or by ?."""
    rows = routes.select(F.coalesce(F.nullif(F.col("route_id"), F.lit("")), F.nullif(F.col("route_short"), F.lit("")), F.lit("?")).alias("route_id"), "part", F.posexplode("geometry").alias("at", "p"))
    return rows.select("route_id", F.struct("part", "at").alias("seq"), "p.lat", "p.lon")


def stops(spark: SparkSession, path: str) -> DataFrame:
    """(stop_id, name, lat, lon) of a feed's stops file: stops proper, with numeric coordinates."""
    raw = spark.read.csv(path, header=True)
    number = lambda c: F.trim(F.col(c)).try_cast("double").alias(c.removeprefix("stop_"))
    rows = raw.where(F.coalesce(F.trim("location_type"), F.lit("")).isin("", "0"))
    return rows.select("stop_id", F.col("stop_name").alias("name"), number("stop_lat"), number("stop_lon")).where("lat is not null and lon is not null")


def histories(spark: SparkSession, path: str) -> DataFrame:
    """(way_id, version, usr, timestamp, tags, nodes) of landed histories {"elements": [versions]}, one file an element. Elements that are gone have landed as empty files or without elements and give no rows; versions that landed twice count once."""
    shape = "elements array<struct<type:string,id:bigint,version:int,user:string,timestamp:string,visible:boolean,tags:map<string,string>,nodes:array<bigint>>>"
    e = spark.read.text(path, wholetext=True).select(F.inline(F.from_json("value", shape)["elements"])).where("id is not null and version is not null")
    none = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    rows = e.select(F.col("id").alias("way_id"), "version", F.col("user").alias("usr"), "timestamp", F.coalesce("tags", none).alias("tags"), F.coalesce("nodes", F.array().cast("array<bigint>")).alias("nodes"), F.col("type").alias("element"))
    return rows.groupBy("element", "way_id", "version").agg(*(F.first(c).alias(c) for c in ("usr", "timestamp", "tags", "nodes")))


def routes(spark: SparkSession, path: str) -> DataFrame:
    """(origin, destination, nogo, length_m, duration_s) of landed answers of a routing service, JSON lines {request: {origin, destination, nogo}, answer: GeoJSON as text}. A refusal or an answer without a track stays as a row without a length: what can't be reached is known."""
    raw = spark.read.text(path)
    shape = "request struct<origin:string,destination:string,nogo:string>, answer string"
    said = raw.select(F.from_json("value", shape).alias("r")).where("r.request is not null")
    track = F.get(F.from_json("r.answer", "features array<struct<properties:map<string,string>>>")["features"], F.lit(0))["properties"]
    value = lambda k: F.try_element_at(track, F.lit(k)).try_cast("double")
    return said.select("r.request.origin", "r.request.destination", F.coalesce("r.request.nogo", F.lit("")).alias("nogo"), value("track-length").alias("length_m"), value("total-time").alias("duration_s"))


def rings(spark: SparkSession, path: str) -> DataFrame:
    """(zone, rings) of GeoJSON polygons, one file a zone: rings of struct<lat, lon>, of all polygons in one array, to be counted across."""
    shape = "features array<struct<geometry:struct<type:string,coordinates:string>>>, geometry struct<type:string,coordinates:string>"
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"([^/]*)\.[^./]*$", 1).alias("zone"), F.from_json("value", shape).alias("f"))
    each = raw.select("zone", F.explode(F.coalesce(F.transform("f.features", lambda x: x["geometry"]), F.array("f.geometry"))).alias("g")).where("g is not null")
    one, many = F.from_json("g.coordinates", "array<array<array<double>>>"), F.from_json("g.coordinates", "array<array<array<array<double>>>>")
    spots = lambda ring: F.transform(ring, lambda p: geo.point(p[1], p[0]))
    got = F.when(F.col("g.type") == "Polygon", F.transform(one, spots)).when(F.col("g.type") == "MultiPolygon", F.transform(F.flatten(many), spots))
    return each.select("zone", got.alias("rings")).where("rings is not null").groupBy("zone").agg(F.flatten(F.collect_list("rings")).alias("rings"))


def manifests(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame] | None:
    """The two newest of baseline folders, the older first, by the time that their newest file was written; None of fewer than two."""
    if len(paths) < 2:
        return None
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "modificationTime")
    of = lambda p: F.max(F.when(F.col("path").contains(p.removeprefix("file:").rstrip("/") + "/"), F.col("modificationTime")))
    times = files.agg(*(of(p).alias(f"t{i}") for i, p in enumerate(paths))).first()
    newest = sorted((t, p) for t, p in zip(times, paths, strict=True) if t is not None)[-2:]
    return tuple(spark.read.parquet(p) for _, p in newest) if len(newest) == 2 else None


def issue_elements(ids: Column) -> Column:
    """array<struct<type, id>> from "way1/way2" texts as QA services give them: '["way/123", "node/4"]'."""
    said = F.from_json(ids, "array<string>")
    return F.filter(F.transform(said, lambda x: F.struct(F.split_part(x, F.lit("/"), F.lit(1)).alias("type"), F.split_part(x, F.lit("/"), F.lit(2)).try_cast("bigint").alias("id"))), lambda e: e["id"].isNotNull())


def _polyline(text: str, precision: int) -> list[dict]:
    out, at, where = [], 0, [0, 0]
    while at < len(text):
        for k in (0, 1):
            shift = value = 0
            while True:
                if at >= len(text):
                    return out
                byte = ord(text[at]) - 63
                at += 1
                value |= (byte & 31) << shift
                shift += 5
                if byte < 32:
                    break
            where[k] += ~(value >> 1) if value & 1 else value >> 1
        out.append({"lat": where[0] / 10**precision, "lon": where[1] / 10**precision})
    return out


def decode_polyline(precision: int = 6):
    """A column function from an encoded polyline to struct<lat, lon> vertices; what is cut off is dropped."""
    @F.udf("array<struct<lat:double,lon:double>>", useArrow=True)
    def decoded(text):
        return None if text is None else _polyline(text, precision)

    return decoded


def _shapes(data: bytes) -> Iterator[tuple[int, list]]:
    if len(data) < 100 or struct.unpack(">i", data[:4])[0] != 9994 or struct.unpack("<i", data[32:36])[0] != 3:
        raise ValueError("not a polyline shapefile")
    at = 100
    while at + 8 <= len(data):
        number, words = struct.unpack(">ii", data[at : at + 8])
        body = data[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        if struct.unpack("<i", body[:4])[0] != 3:
            continue  # a null shape
        parts, points = struct.unpack("<ii", body[36:44])
        starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
        xy = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
        a, b = max(zip(starts[:-1], starts[1:], strict=True), key=lambda s: s[1] - s[0])
        yield number, [{"lat": xy[2 * i + 1], "lon": xy[2 * i]} for i in range(a, b)]


def _records(data: bytes) -> Iterator[tuple[int, dict]]:
    count, head, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("ascii"), data[at + 16]))
        at += 32
    for i in range(count):
        row = data[head + i * size : head + (i + 1) * size]
        if row[:1] == b"*":
            continue  # a deleted row
        at, values = 1, {}
        for name, width in fields:
            values[name] = row[at : at + width].decode("latin-1").strip()
            at += width
        yield i + 1, values


def shapefile(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, geometry, attributes map) of .shp files with a .dbf beside each, joined on the record's number: neither null shapes nor deleted rows shift the others."""
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").rlike(r"\.(shp|dbf)$"))

    def shp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("lat", pa.float64()), ("lon", pa.float64())]))
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = list(_shapes(data))
                yield pa.RecordBatch.from_arrays([pa.array([name[:-4]] * len(got), pa.string()), pa.array([n for n, _ in got], pa.int32()), pa.array([g for _, g in got], kind)], ["file", "record", "geometry"])

    def dbf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                got = list(_records(data))
                yield pa.RecordBatch.from_arrays([pa.array([name[:-4]] * len(got), pa.string()), pa.array([n for n, _ in got], pa.int32()), pa.array([list(v.items()) for _, v in got], pa.map_(pa.string(), pa.string()))], ["file", "record", "attributes"])

    part = lambda end: files.where(F.lower("path").endswith(end)).select("path", "content")
    shapes = part(".shp").mapInArrow(shp, "file string, record int, geometry array<struct<lat:double,lon:double>>")
    return shapes.join(part(".dbf").mapInArrow(dbf, "file string, record int, attributes map<string,string>"), ["file", "record"])

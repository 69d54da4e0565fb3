"""Realtime transit feeds: landed protobuf messages as rows of vehicle positions and trip updates, by file, in Arrow batches.

The messages are read by field number; only the fields asked for are decoded. A message that can't be read gives no rows.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

VEHICLE = "vehicle_id string, trip_id string, route_id string, lat double, lon double, bearing double, speed double, timestamp long, current_status int, stop_id string, occupancy int"
UPDATE = "trip_id string, route_id string, vehicle_id string, timestamp long, stop_time_updates array<struct<stop_sequence:int,stop_id:string,arrival_time:bigint,arrival_delay:int,departure_time:bigint,departure_delay:int,schedule_relationship:int>>"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value): an int for varints, bytes for the rest."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        if at + size > len(data):
            raise ValueError("cut off")
        yield tag >> 3, data[at : at + size]
        at += size


def _all(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for n, v in _fields(data):
        out.setdefault(n, []).append(v)
    return out


def _get(fields: dict[int, list], n: int, read: Callable | None = None):
    return None if n not in fields else read(fields[n][-1]) if read else fields[n][-1]


def _text(b: bytes) -> str:
    return b.decode()


def _float(b: bytes) -> float:
    return struct.unpack("<f", b)[0]


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def _positive(v: int) -> int | None:
    return v if v > 0 else None


def _entities(message: bytes) -> Iterator[dict[int, list]]:
    return (_all(v) for n, v in _fields(message) if n == 2)


def vehicles_of(message: bytes) -> Iterator[dict]:
    """Entities without a vehicle are left out; what is absent is null."""
    for e in _entities(message):
        if 4 not in e:
            continue
        v = _all(e[4][-1])
        trip, place, who = (_all(_get(v, n) or b"") for n in (1, 2, 8))
        yield {
            "vehicle_id": _get(who, 1, _text), "trip_id": _get(trip, 1, _text), "route_id": _get(trip, 5, _text), "lat": _get(place, 1, _float), "lon": _get(place, 2, _float), "bearing": _get(place, 3, _float),
            "speed": _get(place, 5, _float), "timestamp": _get(v, 5, _positive), "current_status": _get(v, 4), "stop_id": _get(v, 7, _text), "occupancy": _get(v, 9),
        }


def updates_of(message: bytes) -> Iterator[dict]:
    for e in _entities(message):
        if 3 not in e:
            continue
        u = _all(e[3][-1])
        trip, who = (_all(_get(u, n) or b"") for n in (1, 3))
        stops = []
        for s in map(_all, u.get(2, [])):
            come, go = (_all(_get(s, n) or b"") for n in (2, 3))
            stops.append({"stop_sequence": _get(s, 1), "stop_id": _get(s, 4, _text), "arrival_time": _get(come, 2, _positive), "arrival_delay": _get(come, 1, _signed), "departure_time": _get(go, 2, _positive), "departure_delay": _get(go, 1, _signed), "schedule_relationship": _get(s, 5)})
        yield {"trip_id": _get(trip, 1, _text), "route_id": _get(trip, 5, _text), "vehicle_id": _get(who, 1, _text), "timestamp": _get(u, 4, _positive), "stop_time_updates": stops}


def rows_of(of: Callable[[bytes], Iterator[dict]], data: bytes) -> list[dict] | None:
    """All that a message holds; None if it can't be read, be it in part."""
    try:
        return list(of(data))
    except (IndexError, KeyError, ValueError, TypeError, OverflowError, AttributeError):
        return None


def _number(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(n: int, value: int | float | str | bytes | None) -> bytes:
    """A field of a message: whole numbers as varints, others as 32-bit floats, texts and messages by length; nothing for null."""
    if value is None:
        return b""
    if isinstance(value, int):
        return _number(n << 3) + _number(value & (2**64 - 1))
    if isinstance(value, float):
        return _number(n << 3 | 5) + struct.pack("<f", value)
    data = value.encode() if isinstance(value, str) else value
    return _number(n << 3 | 2) + _number(len(data)) + data


def vehicles_message(rows: list[dict]) -> bytes:
    """A feed message of vehicle positions, the reverse of :func:`vehicles_of`."""
    out = [_field(1, _field(1, "2.0"))]  # joined at the end: bytes that grow by appending are copied each time
    for k, r in enumerate(rows):
        trip = _field(1, r.get("trip_id")) + _field(5, r.get("route_id"))
        place = b"".join(_field(n, r.get(c)) for n, c in ((1, "lat"), (2, "lon"), (3, "bearing"), (5, "speed")))
        vehicle = _field(1, trip) + _field(2, place) + _field(4, r.get("current_status")) + _field(5, r.get("timestamp")) + _field(7, r.get("stop_id")) + _field(8, _field(1, r.get("vehicle_id"))) + _field(9, r.get("occupancy"))
        out.append(_field(2, _field(1, str(k)) + _field(4, vehicle)))
    return b"".join(out)


#: Rows of a message in a batch, at most.
AT_ONCE = 4096


def _read(spark: SparkSession, path: str, of: Callable[[bytes], Iterator[dict]], schema: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        kind = to_arrow_schema(StructType.fromJson(wanted))
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = rows_of(of, data) or []
                for i in range(0, len(rows), AT_ONCE):
                    yield pa.RecordBatch.from_pylist([{"file": name} | r for r in rows[i : i + AT_ONCE]], kind)

    full = f"file string, {schema}"
    wanted = spark.createDataFrame([], full).schema.jsonValue()
    return files.mapInArrow(decode, full)


def vehicle_positions(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, vehicles_of, VEHICLE)


def trip_updates(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, updates_of, UPDATE)

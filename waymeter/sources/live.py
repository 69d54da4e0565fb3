"""Realtime feeds as a Spark data source, for batch reads and for streams.

A fetch lands each snapshot of a feed as one protobuf message, in a file whose name grows with time. ``transit_snapshots`` reads such
a folder: in a batch the newest snapshot that can be read (a slightly old one beats none), as a stream all snapshots after the last
one read, each once.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from . import realtime
from .realtime import rows_of

#: Snapshots that one task of a stream reads, at most.
TASK_FILES = 16
#: What is in a feed, by its name: columns and how a message gives them.
FEEDS = {"vehicles": (realtime.VEHICLE, realtime.vehicles_of), "trips": (realtime.UPDATE, realtime.updates_of)}


def _store(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _snapshots(path: str, after: str = "", until: str | None = None) -> list[str]:
    """Names of a folder's snapshots, in order, after one of them and as far as another. Names that begin with a dot or an underscore are being written; a folder that isn't there has none."""
    from pyarrow.fs import FileSelector

    fs, folder = _store(path)
    names = sorted(f.base_name for f in fs.get_file_info(FileSelector(folder, allow_not_found=True)) if f.is_file)
    return [n for n in names if n[0] not in "._" and n > after and (until is None or n <= until)]


def _message(path: str, name: str) -> bytes:
    fs, folder = _store(path)
    with fs.open_input_stream(f"{folder}/{name}") as data:
        return data.read()


def _rows(feed: str, data: bytes) -> list[dict] | None:
    return rows_of(FEEDS[feed][1], data)


class Snapshots(InputPartition):
    def __init__(self, names: Sequence[str]) -> None:
        self.names = list(names)


def _batches(path: str, feed: str, names: Sequence[str], schema: StructType) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    for name in names:
        got = _rows(feed, _message(path, name)) if feed in FEEDS else None
        for i in range(0, len(got or []), realtime.AT_ONCE):
            yield pa.RecordBatch.from_pylist([{"snapshot": name} | r for r in got[i : i + realtime.AT_ONCE]], to_arrow_schema(schema))


class _Newest(DataSourceReader):
    def __init__(self, path: str, feed: str, schema: StructType) -> None:
        self.path, self.feed, self.schema = path, feed, schema

    def partitions(self) -> list[InputPartition]:
        """The newest snapshot that can be read: the broken ones after it are read in vain, one after another."""
        for name in reversed(_snapshots(self.path)):
            if self.feed in FEEDS and _rows(self.feed, _message(self.path, name)) is not None:
                return [Snapshots([name])]
        return [Snapshots([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from _batches(self.path, self.feed, partition.names, self.schema)


class _After(DataSourceStreamReader):
    """The offset is the name of the last snapshot read: a restart goes on behind it, and repeats no row."""

    def __init__(self, path: str, feed: str, schema: StructType) -> None:
        self.path, self.feed, self.schema = path, feed, schema
        self.seen = ""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        self.seen = max(_snapshots(self.path, self.seen), default=self.seen)
        return {"after": self.seen}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        names = _snapshots(self.path, start["after"], end["after"])
        return [Snapshots(names[i : i + TASK_FILES]) for i in range(0, len(names), TASK_FILES)] or [Snapshots([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        yield from _batches(self.path, self.feed, partition.names, self.schema)

    def commit(self, end: dict) -> None:
        pass


class TransitSnapshots(DataSource):
    """``spark.read.format("transit_snapshots")`` or ``readStream``, with ``path`` and ``feed``: vehicles or trips. Another feed has no rows; a snapshot that can't be read has none in a stream."""

    @classmethod
    def name(cls) -> str:
        return "transit_snapshots"

    def _feed(self) -> str:
        return self.options.get("feed", "vehicles")

    def schema(self) -> str:
        return f"snapshot string, {FEEDS.get(self._feed(), FEEDS['vehicles'])[0]}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Newest(self.options["path"], self._feed(), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _After(self.options["path"], self._feed(), schema)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session. Its modules travel with it: the processes that plan reads need not find this package."""
    for module in (realtime, sys.modules[__name__]):
        cloudpickle.register_pickle_by_value(module)
    try:
        spark.dataSource.register(TransitSnapshots)
    finally:
        for module in (realtime, sys.modules[__name__]):
            cloudpickle.unregister_pickle_by_value(module)


def messages(rows: DataFrame, names: str = "snapshot") -> DataFrame:
    """(snapshot, data): vehicle positions as messages, one for each value of ``names``."""
    cols = [c for c in rows.columns if c != names]

    def message(table: pa.Table) -> pa.Table:
        data = realtime.vehicles_message(table.select(cols).to_pylist())
        return pa.table({"snapshot": table.column(names).slice(0, 1), "data": pa.array([data], pa.binary())})

    return rows.groupBy(names).applyInArrow(message, "snapshot string, data binary")


def land(snapshots: DataFrame, path: str) -> int:
    """Writes (snapshot, data) as files of a folder, each under its name at once, and counts them."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _store(path)
        for batch in batches:
            fs.create_dir(folder, recursive=True)
            for name, data in zip(*(batch.column(c).to_pylist() for c in ("snapshot", "data")), strict=True):
                part = f"{folder}/.{name}-{uuid.uuid4().hex}"
                with fs.open_output_stream(part) as out:
                    out.write(data)
                fs.move(part, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column("snapshot")], ["snapshot"])

    return snapshots.select("snapshot", "data").mapInArrow(put, "snapshot string").count()


def errors(spark: SparkSession, path: str, feed: str = "vehicles") -> DataFrame:
    """(feed, reason, detail) of the snapshots that can't be read, as the summary of feed errors takes them."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "[^/]*$", 0).alias("detail"), "content")

    def broken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = [n for n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if _rows(feed, data) is None]
            yield pa.RecordBatch.from_arrays([pa.array(bad, pa.string())], ["detail"])

    return files.mapInArrow(broken, "detail string").select(F.lit(feed).alias("feed"), F.lit("decode_error").alias("reason"), "detail")

"""A store of snapshots: whole versions of a table below one folder, each published at once or not at all.

A version is written beside the others and counted as it is written. With too few rows it is thrown away, since a truncated answer
must not stand where a whole one was. Otherwise its manifest is written and the folder gets its name, in one rename. Readers take
the newest version that is whole; only the newest few are kept.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Fewer rows than this are not published; versions kept; what a version consists of.
LEAST, KEEP, MANIFEST, DATA = 100, 3, "manifest.json", "data"


@dataclass(frozen=True)
class Version:
    path: str
    name: str
    millis: int


class Store:
    """Snapshots below ``root``, which may be in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str, least: int = LEAST, keep: int = KEEP) -> None:
        self.spark, self.root, self.least, self.keep = spark, root.rstrip("/"), least, keep

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def publish(self, table: str, rows: DataFrame, **facts: str) -> str | None:
        """The path of a new version of ``rows``, or None if they were too few. ``facts`` go to its manifest."""
        fs, stage = self._fs(), f"{self.root}/.{table}-{uuid.uuid4().hex}"
        seen = Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{stage}/{DATA}")
        n = int(seen.get["n"])
        if n < self.least:
            fs.delete(self._path(stage), True)
            return None
        out = fs.create(self._path(f"{stage}/{MANIFEST}"))
        out.write(json.dumps(facts | {"rows": n}).encode())
        out.close()
        last = max((v.name for v in self.versions(table)), default="")
        stamp = max(time.time_ns() // 1_000_000, int(last.rsplit("-", 1)[1]) + 1 if last else 0)
        path = f"{self.root}/{table}-{stamp:015d}"
        if not fs.rename(self._path(stage), self._path(path)):
            raise OSError(f"could not publish {path}")
        self.prune(table)
        return path

    def versions(self, table: str) -> list[Version]:
        """Published versions, the oldest first."""
        fs, root = self._fs(), self._path(self.root)
        if not fs.exists(root):
            return []
        names = {s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()}
        own = sorted(n for n in names if n.startswith(f"{table}-") and n.rsplit("-", 1)[0] == table and n.rsplit("-", 1)[1].isdigit())
        return [Version(f"{self.root}/{n}", n, fs.getFileStatus(self._path(f"{self.root}/{n}")).getModificationTime()) for n in own]

    def manifest(self, version: Version) -> dict | None:
        """What a version's manifest says; None if it can't be read."""
        try:
            said = self.spark.read.text(f"{version.path}/{MANIFEST}", wholetext=True).first()
            got = json.loads(said[0]) if said else None
        except (PySparkException, Py4JJavaError, ValueError):
            return None
        return got if isinstance(got, dict) and isinstance(got.get("rows"), int) else None

    def whole(self, version: Version) -> bool:
        """Whether a version holds what its manifest says. The count comes from the files' footers."""
        said = self.manifest(version)
        try:
            return said is not None and self.spark.read.parquet(f"{version.path}/{DATA}").count() == said["rows"]
        except (PySparkException, Py4JJavaError):
            return False

    def newest(self, table: str) -> Version | None:
        """The newest version that is whole."""
        return next((v for v in reversed(self.versions(table)) if self.whole(v)), None)

    def read(self, table: str) -> DataFrame | None:
        found = self.newest(table)
        return None if found is None else self.spark.read.parquet(f"{found.path}/{DATA}")

    def fresh(self, table: str, seconds: float, now: float | None = None) -> bool:
        """Whether the newest whole version is younger than so many seconds, by the time of its files."""
        found = self.newest(table)
        return found is not None and (time.time() if now is None else now) - found.millis / 1000 < seconds

    def prune(self, table: str) -> list[str]:
        """Deletes all but the newest versions; what it has deleted."""
        old = self.versions(table)[: -self.keep] if self.keep else self.versions(table)
        for v in old:
            self._fs().delete(self._path(v.path), True)
        return [v.name for v in old]


def refreshed(store: Store, table: str, fetch, seconds: float) -> DataFrame | None:
    """The table while it is fresh; else what ``fetch`` gives, published, or what was there before if it fails or gives too little. None where there is neither."""
    if not store.fresh(table, seconds):
        try:
            rows = fetch()
            if rows is not None:
                store.publish(table, rows)
        except (PySparkException, Py4JJavaError, OSError):
            pass
    return store.read(table)

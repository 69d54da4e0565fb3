"""Tables written to the cluster's shared folder, to cut lineage in iterative plans."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
#: Rows of a written table that a join may broadcast.
BROADCAST_ROWS = 100_000


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder named by ``spark.checkpoint.dir``. Where the setting is unset, local mode takes a temporary folder and a cluster run stops."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + _local.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="waymeter-roads-"))
    return f"{base.rstrip('/')}/waymeter-roads-{sc.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in a folder of its own, read again: a lost executor doesn't lose it.

    Packed files tell little of what rows take in the driver's memory: tables of many rows are joined by sorting, however small they are.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    return out.hint("merge") if out.count() > BROADCAST_ROWS else out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`written` that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if f"/waymeter-roads-{sc.applicationId}/" in path:
                p = sc._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)

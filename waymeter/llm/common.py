"""What the operators share: the cluster's shared folder, tables written to cut lineage, and size-checked broadcasts."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ids up to this many may be broadcast (16 bytes each: 16 MB at most); beyond it the join shuffles.
BROADCAST_IDS = 1_000_000

#: Rows that a Python worker gets at a time.
BATCH_ROWS = 1000

_local: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, in local mode only, a temporary one."""
    sc = spark.sparkContext
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return f"{named.rstrip('/')}/waymeter-{sc.applicationId}"
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.applicationId not in _local:
        _local[sc.applicationId] = tempfile.mkdtemp(prefix="waymeter-")
    return f"file://{_local[sc.applicationId]}"


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """From now on in this session Python workers get at most ``rows`` rows at a time: a batch of long texts is large. A smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if not 0 < now <= rows:
        spark.conf.set(key, str(rows))


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back: lost executors don't lose it, and its plan starts anew. ``by``: a column by whose values files are kept apart."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    bound_batches(spark)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark's context cleaner drop shuffle files that no live DataFrame refers to, once their results are in a table.

    Twice: a plan is only unreachable when the listeners have let go of it too. Without the pauses the files of one step still lie
    beside those of the next.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by :func:`materialise` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        base = shared_dir(spark)
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.startswith(base) or path.removeprefix("file://").startswith(base.removeprefix("file://")):
                p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stored_bytes(table: DataFrame) -> int:
    """The size of the files of a table made by :func:`materialise`."""
    sc = table.sparkSession.sparkContext
    paths = [sc._jvm.org.apache.hadoop.fs.Path(f) for f in table.inputFiles()]
    return sum(p.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(p).getLen() for p in paths)


def few(ids: DataFrame, bound: int = BROADCAST_IDS) -> DataFrame:
    """``ids`` with a broadcast hint if it is proven to hold at most ``bound`` rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(ids) if ids.limit(bound + 1).count() <= bound else ids


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` written in the order of ``order``, with ``rank`` from 0: counts inside range partitions plus the partitions before. No task sees more than a range, or one row for each range."""
    spread = materialise(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spread.withColumn("_in", inside).join(sizes.select("_part", before.alias("_base")), "_part").withColumn("rank", (F.col("_base") + F.col("_in")).cast("long")).drop("_part", "_in", "_base")

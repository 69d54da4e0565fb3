"""Runs of streams to their end: what has landed so far goes through, once, into a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import folder


class Run:
    """A stream's place: its checkpoint and the table that it fills. Each :meth:`go` takes up where the last one ended, in this session or another."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or folder(spark, "stream")

    def go(self, rows: DataFrame, mode: str = "append") -> DataFrame:
        """Runs ``rows`` over all that is there and gives the table as it is then.

        In append mode the rows that are final by the watermark. In update mode a row for each time that a key changed, with ``batch``;
        a batch that is tried again replaces itself.
        """
        out = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True)
        if mode == "append":
            out = out.format("parquet").option("path", f"{self.path}/rows")
        else:
            out = out.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{self.path}/rows/batch={n}"))
        query = out.start()
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()
        shape = rows.schema if mode == "append" else rows.schema.add("batch", "long")
        return self.spark.read.schema(shape).parquet(f"{self.path}/rows")


def newest_rows(rows: DataFrame, key: str) -> DataFrame:
    """Of an update-mode table the last row of each key."""
    cols = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), "batch").alias("r")).select(key, "r.*")


def replay(pieces: list[DataFrame], plan: Callable[[DataFrame], DataFrame], mode: str = "append") -> DataFrame:
    """Lands ``pieces`` one after another in a folder and runs the stream ``plan`` over it after each, from one checkpoint: a piece is late as far as the watermark of those before says so."""
    spark = pieces[0].sparkSession
    landed, run = folder(spark, "landed"), Run(spark)
    for piece in pieces:
        piece.write.mode("append").parquet(landed)
        out = run.go(plan(spark.readStream.schema(pieces[0].schema).parquet(landed)), mode)
    return out

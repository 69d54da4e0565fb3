"""A rank over all rows without gathering them: range partitions, and the sizes of those before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import written


def numbered(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``df`` with ``name`` from 0 in the order of ``order``, which should have no ties. Dealt rows are written: dealt again, for their counts, they may be cut elsewhere."""
    spread = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return spread.withColumn("_in", inside).join(sizes.select("_part", before.alias("_base")), "_part").withColumn(name, F.col("_base") + F.col("_in")).drop("_part", "_in", "_base")

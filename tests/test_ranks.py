"""Ranks over rows whose partitions are dealt adaptively."""

from pyspark.sql import functions as F

from waymeter.functions.ranking import numbered


def test_ranks_hold_however_rows_are_dealt(spark):
    """Wide rows and their counts differ in size: dealt twice, adaptive partitions are joined elsewhere."""
    conf = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(40_000).repartition(8).select("id", F.sha2(F.col("id").cast("string"), 512).alias("wide")).groupBy("id").agg(F.max("wide").alias("wide"))
        out = numbered(rows, ["id"])
        assert out.where("rank <> id").count() == 0 and out.where("wide is not null").count() == 40_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)

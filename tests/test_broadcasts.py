"""What the driver has to hold for joins."""

from waymeter.functions import tables
from waymeter.plans import more, registry  # noqa: F401
from waymeter.sources.fixtures import Roads


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_tables_of_many_rows_are_not_broadcast(spark):
    many, few = (tables.written(spark.range(n).withColumnRenamed("id", "k"), "t") for n in (tables.BROADCAST_ROWS + 1, 10))
    rows = spark.range(10**9)
    assert "BroadcastExchange" not in plan(rows.join(many.where("k > 5"), rows.id == many.k))
    assert "BroadcastExchange" in plan(rows.join(few, rows.id == few.k))


def test_parts_that_meet_nothing_are_not_broadcast(spark, sf):
    parts = Roads(spark, sf)["ways_attr"]
    assert "p_partkey" in plan(parts) and "-199" in plan(parts)
    assert parts.count() == spark.read.parquet(f"{sf}/orders.parquet").count()

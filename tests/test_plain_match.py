"""Lists of suspicious one-ways match these alone."""

from pyspark.sql import functions as F

from waymeter.operators import matching
from waymeter.plans import more, registry  # noqa: F401


def test_tasks_match_suspects_alone(spark, sf, monkeypatch):
    """No way of class B or C is matched for lists that can't hold it."""
    asked, match = [], matching.match
    monkeypatch.setattr(matching, "match", lambda ways, *a, **k: asked.append(ways) or match(ways, *a, **k))
    for name in ("flt_14_unverified_ways", "prj_26_tasks"):
        assert registry.QUERIES[name](spark, sf).count() > 0
    cls = registry.QUERIES["agg_2_class_histogram"](spark, sf).where(F.col("defect_class").isin("A", "AB")).agg(F.sum("n")).first()[0]
    assert [df.count() <= cls for df in asked] == [True, True]

"""Answers whose last page is full."""

from waymeter.plans import landing
from waymeter.sources import pages
from waymeter.sources.fixtures import Roads


class Centerlines(Roads):
    """As many centerlines as asked for."""

    def __init__(self, spark, n):
        super().__init__(spark, "")
        self._made["centerlines"] = spark.range(n).selectExpr("id", "'a' label", "1d lat", "2d lon1", "3d lon2")


def test_full_last_page_is_followed_by_an_empty_one(spark):
    for n, full in ((200, 3), (150, 2)):
        x = Centerlines(spark, n)
        said = pages.completeness(pages.landed_pages(spark, landing._fetch(x, "true", ended=True)), 100).first()
        assert (said.pages, said.features, said.problem) == (full, n, None)
    assert pages.completeness(pages.landed_pages(spark, landing._fetch(Centerlines(spark, 200), "true")), 100).first().problem == "no page after page 2"

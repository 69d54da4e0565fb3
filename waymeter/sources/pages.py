"""Answers that come in pages: all of them or none. A partial set of centerlines would make ways look unmatched that are matched, so nothing of it is used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.variants import at, is_object, listed
from . import landed
from .snapshots import Store

#: Features on a full page.
PAGE = 2000


class IncompletePages(ValueError):
    """Pages are missing, broken or not the last ones."""


def landed_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page, n, more, ok) of files named page-<number>.json in a folder: how many features a page has, whether it says that more follow, whether it can be read."""
    raw = spark.read.text(f"{path}/page-*.json", wholetext=True)
    v, features = F.col("v"), listed(at(F.col("v"), "$.features"))
    rows = raw.select(F.regexp_extract("_metadata.file_path", r"page-(\d+)\.json$", 1).try_cast("long").alias("page"), F.try_parse_json("value").alias("v")).where("page is not null")
    more = F.coalesce(F.try_variant_get(v, "$.exceededTransferLimit", "boolean"), F.lit(False))
    return rows.select("page", F.coalesce(F.size(features), F.lit(0)).cast("long").alias("n"), more.alias("more"), is_object(v).alias("ok"))


def completeness(pages: DataFrame, full: int = PAGE, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, pages, features, problem) of pages (by, page, n, more, ok): null if they are all there, else the first thing that is wrong.

    Pages count from 1 without a gap and can all be read. All but the last say that more follow, or are full; the last one is neither.
    """
    key = [*by, "page"]
    on = pages.select(*by, "page", (F.col("more") | (F.col("n") >= full)).alias("goes_on"), "n", "ok")
    after = on.select(*by, (F.col("page") - 1).alias("page"), F.lit(True).alias("followed"))
    before = on.select(*by, (F.col("page") + 1).alias("page"), F.col("goes_on").alias("expected"))
    j = on.join(after, key, "left").join(before, key, "left").withColumns({"followed": F.coalesce("followed", F.lit(False))})
    page = F.col("page").cast("string")
    wrong = (
        F.when(F.col("expected").isNull() & (F.col("page") > 1), F.struct((F.col("page") - 0.5).alias("at"), F.concat(F.lit("no page before page "), page).alias("said")))
        .when(~F.coalesce("expected", F.lit(True)), F.struct((F.col("page") - 0.25).alias("at"), F.concat(F.lit("page "), page, F.lit(" follows the last one")).alias("said")))
        .when(~F.col("ok"), F.struct(F.col("page").cast("double").alias("at"), F.concat(F.lit("page "), page, F.lit(" can't be read")).alias("said")))
        .when(F.col("goes_on") & ~F.col("followed"), F.struct((F.col("page") + 0.25).alias("at"), F.concat(F.lit("no page after page "), page).alias("said")))
    )
    return j.groupBy(*by).agg(F.count("*").alias("pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("features"), F.when(F.count("*") == 0, "no pages").otherwise(F.min(wrong)["said"]).alias("problem"))


def features(spark: SparkSession, path: str, properties: str, full: int = PAGE) -> DataFrame:
    """Line features of all pages in a folder, as :func:`landed.features` gives them; stops with :class:`IncompletePages` if one is missing, and reads nothing then."""
    said = completeness(landed_pages(spark, path), full).first()
    if said is None or said.problem is not None:
        raise IncompletePages(f"{'no pages' if said is None else said.problem}; {0 if said is None else said.features} features in {0 if said is None else said.pages} pages are not used")
    return landed.features(spark, f"{path}/page-*.json", properties)


def publish(store: Store, table: str, path: str, properties: str, full: int = PAGE) -> str | None:
    """Publishes the features of a complete answer; an incomplete one leaves the store as it is, and its problem is raised."""
    return store.publish(table, features(store.spark, path, properties, full))

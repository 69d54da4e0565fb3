"""Column functions on names and tags. An empty string counts as absent, as a missing tag does."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
ONEWAY_TRUTHY = ("yes", "true", "1", "-1")
STREET_CLASSES = ("residential", "unclassified", "tertiary", "secondary", "primary")
ABBREVIATIONS = (
    ("av", "avenue"), ("blvd", "boulevard"), ("cir", "circle"), ("ct", "court"), ("dr", "drive"), ("expy", "expressway"), ("exwy", "expressway"),
    ("fwy", "freeway"), ("hwy", "highway"), ("ln", "lane"), ("pkwy", "parkway"), ("pl", "place"), ("rd", "road"), ("sq", "square"), ("st", "street"),
    ("ter", "terrace"), ("trl", "trail"), ("e", "east"), ("w", "west"), ("n", "north"), ("s", "south"), ("ne", "northeast"), ("nw", "northwest"),
    ("se", "southeast"), ("sw", "southwest"),
)


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def blank(x: Column) -> Column:
    """Null or empty."""
    return F.coalesce(x, F.lit("")) == ""


def norm_name(x: Column) -> Column:
    """Stripped and lower-cased; null where nothing is left."""
    return F.nullif(F.lower(strip(x)), F.lit(""))


def oneway_truthy(x: Column) -> Column:
    return F.coalesce(F.lower(strip(x)).isin(*ONEWAY_TRUTHY), F.lit(False))


def capitalised(x: Column) -> Column:
    return F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substr(x, F.lit(2))))


def unnamed_label(highway: Column, service: Column) -> Column:
    """What a way without a name is called."""
    return (
        F.when((highway == "service") & ~blank(service), capitalised(F.replace(service, F.lit("_"), F.lit(" "))))
        .when(highway == "service", "Service road")
        .when(highway.isin(*STREET_CLASSES), F.concat(F.lit("Unnamed "), highway, F.lit(" street")))
        .when(~blank(highway), F.concat(F.lit("Unnamed "), highway))
        .otherwise("Unnamed way")
    )


def expand_abbrev(x: Column) -> Column:
    """Postal abbreviations spelt out: words between single spaces, each looked up once."""
    known = F.create_map(*(F.lit(w) for pair in ABBREVIATIONS for w in pair))
    return strip(F.array_join(F.transform(F.split(x, " "), lambda w: F.coalesce(F.try_element_at(known, w), w)), " "))


def plain_similarity(a: Column, b: Column) -> Column:
    """1 for names equal as they are or spelt out, 0 where one is absent, null where only :func:`with_similarity` can tell."""
    return F.when(blank(a) | blank(b), 0.0).when((a == b) | (expand_abbrev(a) == expand_abbrev(b)), 1.0)


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def with_similarity(df: DataFrame, a: str, b: str, out: str = "name_similarity") -> DataFrame:
    """``df`` with the similarity of names ``a`` and ``b``, in that order: equal ones by columns, the ratio of matching blocks once for each other pair of names."""
    quick = df.withColumn(out, plain_similarity(F.col(a), F.col(b)))
    pairs = quick.where(F.col(out).isNull()).select(F.col(a).alias("_a"), F.col(b).alias("_b")).distinct()
    rated = pairs.withColumn("_r", ratio(expand_abbrev(F.col("_a")), expand_abbrev(F.col("_b"))))
    return quick.join(rated, (F.col(a) == F.col("_a")) & (F.col(b) == F.col("_b")) & F.col(out).isNull(), "left").withColumn(out, F.coalesce(out, "_r")).drop("_a", "_b", "_r")


def xml_escape(x: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(raw), F.lit(entity))
    return x

"""Landed payloads whose fields come in several shapes: read as variants, field by field, so that one odd field loses that field alone."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo

# Where an issue can be looked at.
ISSUES_URL = "https://osmose.openstreetmap.fr/"
# Words by which the transit network in question is known, in any of its fields.
NETWORK_HINTS = ("sorta", "cincinnatimetro", "cincinnati metro", "southwest ohio regional transit", "go-metro", "gometro", "dngy")
#: JSON of values that count as absent where a field has a stand-in.
NOTHING = ("null", '""', "[]", "{}", "false", "0", "0.0")


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    """STRING, BIGINT, OBJECT<...>, ARRAY<...>, ...; null for null."""
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def listed(v: Column) -> Column:
    """array<variant> of a JSON list; null of anything else."""
    return F.try_variant_get(v, "$", "array<variant>")


def said(v: Column) -> Column:
    """A JSON text; null of anything else."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def words(v: Column) -> Column:
    """A JSON text or number as text."""
    return F.when(kind(v).rlike("^(STRING|BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "string"))


def whole(v: Column) -> Column:
    """A whole number, from a number (cut) or a text."""
    number_ = F.when(kind(v) == "BIGINT", F.try_variant_get(v, "$", "bigint")).when(kind(v).rlike("^(DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double").try_cast("bigint"))
    return F.coalesce(number_, F.trim(said(v)).try_cast("bigint"))


def number(v: Column) -> Column:
    """A number, from a number or a text."""
    return F.coalesce(F.when(kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double")), F.trim(said(v)).try_cast("double"))


def there(v: Column) -> Column:
    """Whether a value is more than nothing: a number but 0, a text, list or object that isn't empty, true."""
    return F.coalesce(~F.to_json(v).isin(*NOTHING), F.lit(False))


def first_there(v: Column, *paths: str) -> Column:
    """The value of the first path that has one; of the last path whatever it has."""
    *before, last = (at(v, p) for p in paths)
    return reduce(lambda out, x: F.when(there(x), x).otherwise(out), reversed(before), last)


# issues


def _ids(v: Column, type_: str) -> Column:
    """Ids of one element type, from a list of objects {type, id} and texts "type/id", or from an object of lists."""
    named = lambda e: F.when(is_object(e) & (F.lower(said(at(e, "$.type"))) == type_), whole(at(e, "$.id")))
    spelt = lambda e: F.when(said(e).contains("/") & (F.lower(F.split_part(said(e), F.lit("/"), F.lit(1))) == type_), F.trim(F.regexp_extract(said(e), r"^[^/]*/([\s\S]*)$", 1)).try_cast("bigint"))
    from_list = F.transform(listed(v), lambda e: F.coalesce(named(e), spelt(e)))
    from_object = F.transform(listed(at(v, f"$.{type_}s")), whole)
    return F.filter(F.coalesce(from_list, from_object, F.array().cast("array<bigint>")), lambda i: i.isNotNull())


def _titled(v: Column) -> Column:
    """A text as it is; of an object of languages the automatic one, English, or the first in the order of their codes that isn't empty."""
    every = F.filter(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), lambda x: said(x) != "")
    one = F.coalesce(_language(v), said(F.get(every, F.lit(0))))
    return F.when(is_object(v), one).otherwise(said(v))


def _language(v: Column) -> Column:
    auto = said(at(v, "$.auto"))
    return F.when(auto != "", auto).otherwise(said(at(v, "$.en")))


def issues(raw: DataFrame) -> DataFrame:
    """(id, item, item_title, subtitle, lat, lon, ways, nodes, relations, url) of issues as JSON texts (value).

    Elements come in three shapes; titles as texts or by language. Issues that have neither an id nor elements are left out, and so
    is what isn't a JSON object. A place of which one coordinate isn't a number has none.
    """
    v, sc = F.col("v"), raw.sparkSession.sparkContext
    # texts are small and dear to read: they are dealt to all cores, whatever few files they come from
    rows = raw.select("value").repartition(4 * sc.defaultParallelism).select(F.try_parse_json("value").alias("v")).where(is_object(v))
    rows = rows.select("v", first_there(v, "$.elems", "$.osm_ids", "$.elements").alias("elements"), first_there(v, "$.uuid", "$.id").alias("_id"))
    rows = rows.select("v", words(F.col("_id")).alias("id"), *(_ids(F.col("elements"), t).alias(f"{t}s") for t in ("way", "node", "relation")))
    rows = rows.where(F.col("id").isNotNull() | (F.size("ways") + F.size("nodes") + F.size("relations") > 0))
    lat, lon = number(at(v, "$.lat")), number(at(v, "$.lon"))
    odd = lambda p, x: at(v, p).isNotNull() & (kind(at(v, p)) != "VOID") & x.isNull()
    placed = ~(odd("$.lat", lat) | odd("$.lon", lon))
    subtitle = at(v, "$.subtitle")
    url = F.when(F.col("id") != "", F.concat(F.lit(f"{ISSUES_URL}issue/"), "id")).otherwise(ISSUES_URL)
    return rows.select(
        "id", words(at(v, "$.item")).alias("item"), _titled(first_there(v, "$.title", "$.subtitle")).alias("item_title"),
        F.when(is_object(subtitle), _language(subtitle)).otherwise(said(subtitle)).alias("subtitle"),
        F.when(placed, lat).alias("lat"), F.when(placed, lon).alias("lon"), "ways", "nodes", "relations", url.alias("url"),
    )


# elements


def vertices(v: Column) -> Column:
    """array<struct<lat, lon>> of a geometry whose vertices are objects {lat, lon} or pairs [lat, lon]; those without two coordinates in range are left out."""
    pair = lambda g: F.when(is_object(g), geo.point(number(at(g, "$.lat")), number(at(g, "$.lon")))).when(F.size(listed(g)) >= 2, geo.point(number(at(g, "$[0]")), number(at(g, "$[1]"))))
    spots = F.transform(listed(v), pair)
    return F.filter(F.coalesce(spots, F.array().cast("array<struct<lat:double,lon:double>>")), lambda p: geo.valid(p["lat"], p["lon"]))


def tags(v: Column) -> Column:
    """map<string, string> of tags; empty where they are no object."""
    pairs = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    kept = F.filter(F.transform(pairs, lambda e: F.struct(e["key"].alias("key"), words(e["value"]).alias("value"))), lambda e: e["value"].isNotNull())
    return F.coalesce(F.when(is_object(v), F.map_from_entries(kept)), F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>")))


def elements(raw: DataFrame) -> DataFrame:
    """(type, id, name, tags, geometry) of elements as JSON texts (value), whatever the shape of their vertices. A name of blanks is none."""
    v = F.col("v")
    rows = raw.select(F.try_parse_json("value").alias("v")).where(is_object(v))
    rows = rows.select(said(at(v, "$.type")).alias("type"), whole(at(v, "$.id")).alias("id"), tags(at(v, "$.tags")).alias("tags"), vertices(at(v, "$.geometry")).alias("geometry"))
    name = F.try_element_at("tags", F.lit("name"))
    return rows.select("type", "id", F.when(F.regexp_replace(name, r"\s", "") != "", name).alias("name"), "tags", "geometry")


# transit


def alerts(raw: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(carry, id, title, description, severity, effect, url) of alerts in payloads (value): of the payload itself or, where it has no list of them, of its networks."""
    v, a = F.col("v"), F.col("a")
    rows = raw.select(*carry, F.try_parse_json("value").alias("v")).where(is_object(v))
    none = F.array().cast("array<variant>")
    nested = F.flatten(F.transform(F.coalesce(listed(at(v, "$.networks")), none), lambda n: F.coalesce(listed(at(n, "$.alerts")), none)))
    rows = rows.select(*carry, F.explode(F.coalesce(listed(at(v, "$.alerts")), nested)).alias("a")).where(is_object(a))
    fields = {"id": ("alert_id", "id", "global_alert_id"), "title": ("title", "header_text", "header"), "description": ("description", "description_text"), "severity": ("severity", "severity_level"), "effect": ("effect",), "url": ("url", "alert_url")}
    return rows.select(*carry, *(words(first_there(a, *(f"$.{p}" for p in paths))).alias(c) for c, paths in fields.items()))


def networks(raw: DataFrame) -> DataFrame:
    """(place, network_id, fields, hinted) of the networks in catalogs (value), in their order: their id, what they are called by, and whether one of that holds a hint."""
    n = F.col("n")
    rows = raw.select(F.posexplode(listed(at(F.try_parse_json("value"), "$.networks"))).alias("place", "n")).where(is_object(n))
    kept = lambda *paths: F.filter(F.array(*(F.trim(said(at(n, f"$.{p}"))) for p in paths)), lambda x: x != "")
    ids = kept("global_network_id", "network_id", "id")
    agencies = F.filter(F.transform(F.coalesce(listed(at(n, "$.agencies")), F.array().cast("array<variant>")), lambda g: F.trim(said(first_there(g, "$.agency_name", "$.name")))), lambda x: x != "")
    fields = F.transform(F.concat(ids, kept("network_name", "name", "network_short_name", "short_name"), agencies), F.lower)
    hinted = F.exists(fields, lambda f: reduce(Column.__or__, [f.contains(h) for h in NETWORK_HINTS]))
    return rows.select("place", F.get(ids, F.lit(0)).alias("network_id"), fields.alias("fields"), hinted.alias("hinted"))


def network_of(raw: DataFrame) -> DataFrame:
    """(network_id): of the catalog's networks with a hint and an id the first; null without one."""
    return networks(raw).where("hinted and network_id is not null").agg(F.min_by("network_id", "place").alias("network_id"))


def stop_places(raw: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(carry, lat, lon) of stops (value) under either spelling of their coordinates; those without two numbers are left out."""
    v = F.try_parse_json("value")
    place = lambda c: F.coalesce(F.when(kind(at(v, f"$.stop_{c}")) != "VOID", at(v, f"$.stop_{c}")), at(v, f"$.{c}"))
    return raw.select(*carry, number(place("lat")).alias("lat"), number(place("lon")).alias("lon")).where("lat is not null and lon is not null")

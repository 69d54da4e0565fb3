"""Whether a zone's fixes may be sent: seventeen checks over what has been landed, each a row.

What a check looks at is landed as files: when each was written, and what is in the small ones. One pass makes one row of facts a
zone; the rules are columns over it, in one more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .variants import at, is_object, said, there, whole

# The drafts that have to be there, the placeholder page's end, the scope that is needed, and ages in days.
DRAFTS = ("01-wiki-page.md", "02-talk-us-post.md", "03-minh-outreach.md", "04-pre-flight-checklist.md")
PLACEHOLDER = "Hamilton_County_TIGER_Audit"
SCOPE = "write_api"
TOKEN_DAYS, POLYGON_DAYS, SCAN_DAYS = 7, 90, 7


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(zone, what, modified, content) of a folder with a folder a zone: scan-results.json, polygon.geojson and baseline manifests in it; token.json and drafts beside them belong to every zone, whose name then is null. Only the two small files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    what = F.when(name == "scan-results.json", "scan").when(name == "token.json", "token").when(name == "polygon.geojson", "polygon").when(name.startswith("cagis_baseline_"), "manifest").when(name.isin(*DRAFTS), name)
    folder = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    shared = name.isin("token.json", *DRAFTS)
    return files.select(F.when(~shared, folder).alias("zone"), what.alias("what"), F.col("modificationTime").alias("modified"), F.when(name.isin("scan-results.json", "token.json"), F.col("content").cast("string")).alias("content")).where("what is not null")


def zone_facts(zones: DataFrame, files: DataFrame, tools: DataFrame, now: Column) -> DataFrame:
    """One row a zone (zone): the ages of its files in days, what its scan says, what the token says, which drafts are missing, and how tools (tool, exit_code: null if they couldn't run) ended. Files without a zone count for all."""
    shared = files.where("zone is null").agg(*_ages(("token",), now), F.max_by("content", F.when(F.col("what") == "token", F.col("modified"))).alias("token"), F.array_except(F.array(*map(F.lit, DRAFTS)), F.collect_set(F.when(F.col("what").isin(*DRAFTS), F.col("what")))).alias("missing"))
    ran = tools.agg(*(F.max(F.when(F.col("tool") == t, F.struct(F.lit(True).alias("known"), "exit_code"))).alias(t) for t in ("lint", "tests")))
    own = files.where("zone is not null").groupBy("zone").agg(*_ages(("scan", "polygon", "manifest"), now), F.max_by("content", F.when(F.col("what") == "scan", F.col("modified"))).alias("scan"))
    one = F.lit(1).alias("_one")
    both = shared.select(one, "*").join(ran.select(one, "*"), "_one")
    return zones.select("zone").distinct().join(own, "zone", "left").withColumn("_one", F.lit(1)).join(F.broadcast(both), "_one").drop("_one")


def _ages(what: tuple[str, ...], now: Column) -> list[Column]:
    """The age of the newest file of each kind."""
    days = lambda w: (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.max(F.when(F.col("what") == w, F.col("modified"))).cast("timestamp"))) / 86_400e6
    return [days(w).alias(f"{w}_days") for w in what]


def checks(facts: DataFrame, wiki_url: str, run_tests: bool = True) -> DataFrame:
    """(zone, n, name, category, status, detail) of the checks in their order: PASS, FAIL, WARN, or MANUAL for what only a person can tell."""
    col = F.col
    token, scan = F.try_parse_json("token"), F.try_parse_json("scan")
    scope, stats = F.lower(said(at(token, "$.scope"))), at(scan, "$.summary_stats")
    matched, impact = F.coalesce(whole(at(stats, "$.cagis_matched")), F.lit(0)), at(stats, "$.route_impact")
    days = lambda c: F.format_string("%.1f days old", c)
    none, unread = lambda c: col(f"{c}_days").isNull(), lambda v: ~is_object(v)
    by_age = lambda c, most: F.when(none(c), F.lit("FAIL")).when(col(f"{c}_days") > most, "WARN").otherwise("PASS")
    tool = lambda t: F.when(col(f"{t}.exit_code").isNull(), "WARN").when(col(f"{t}.exit_code") == 0, "PASS").otherwise("FAIL")
    manual = F.lit("MANUAL")
    rules = [
        ("drafts present", "Community gating", F.when(F.size("missing") > 0, "FAIL").otherwise("PASS"), F.array_join("missing", ", ")),
        ("wiki page set", "Community gating", manual if wiki_url.endswith(PLACEHOLDER) else F.lit("PASS"), F.lit(wiki_url)),
        ("publication attested", "Community gating", manual, F.lit("")),
        ("token present", "Account hygiene", by_age("token", TOKEN_DAYS), days(col("token_days"))),
        ("token scope", "Account hygiene", F.when(none("token") | unread(token) | ~F.coalesce(scope.contains(SCOPE), F.lit(False)), "FAIL").otherwise("PASS"), F.coalesce(scope, F.lit(""))),
        ("account naming", "Account hygiene", manual, F.lit("")),
        ("zone polygon", "Pipeline state", by_age("polygon", POLYGON_DAYS), days(col("polygon_days"))),
        ("lint clean", "Pipeline state", tool("lint"), F.lit("")),
        *([("tests pass", "Pipeline state", tool("tests"), F.lit(""))] if run_tests else []),
        ("scan freshness", "Scan freshness", by_age("scan", SCAN_DAYS), days(col("scan_days"))),
        ("manifest not older than scan", "Scan freshness", F.when(none("scan"), "FAIL").when(none("manifest") | (col("manifest_days") > col("scan_days")), "WARN").otherwise("PASS"), days(col("manifest_days"))),
        ("fixes to send", "Fix-batch readiness", F.when(none("scan") | unread(scan), "FAIL").when(matched == 0, "WARN").otherwise("PASS"), matched.cast("string")),
        ("route impact run", "Fix-batch readiness", F.when(none("scan") | unread(scan) | ~there(impact), "WARN").otherwise("PASS"), F.to_json(impact)),
        ("first batch curated", "Fix-batch readiness", manual, F.lit("")),
        ("dry run inspected", "Fix-batch readiness", manual, F.lit("")),
        ("monitoring subscribed", "Monitoring + post-submission", manual, F.lit("")),
        ("time to watch", "Monitoring + post-submission", manual, F.lit("")),
    ]
    rows = [F.struct(F.lit(i).alias("n"), F.lit(name).alias("name"), F.lit(category).alias("category"), status.alias("status"), F.coalesce(detail, F.lit("")).alias("detail")) for i, (name, category, status, detail) in enumerate(rules, 1)]
    return facts.select("zone", F.inline(F.array(*rows)))


def report(checked: DataFrame, strict: bool = False) -> DataFrame:
    """(zone, n_pass, n_fail, n_warn, n_manual, exit_code): 1 if a check has failed, with ``strict`` 2 if one warns, else 0."""
    n = lambda s: F.count_if(F.col("status") == s)
    code = F.when(n("FAIL") > 0, 1).when(F.lit(strict) & (n("WARN") > 0), 2).otherwise(0)
    return checked.groupBy("zone").agg(n("PASS").alias("n_pass"), n("FAIL").alias("n_fail"), n("WARN").alias("n_warn"), n("MANUAL").alias("n_manual"), code.alias("exit_code"))

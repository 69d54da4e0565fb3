"""Fix proposals: rules over matched ways, in one pass, and the changes that they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import numbered
from ..functions.text import blank, oneway_truthy, strip
from .classify import class_rank
from .matching import HIGH, HIGHWAY_OF_CODE, REVIEW, lookup, new_name

BATCH = 500


def proposals(matched: DataFrame) -> DataFrame:
    """(id, n, kind, tag, value, review) for ``matched`` ways: id, name, highway, oneway, maxspeed, defect_class, confidence, source_name, name_similarity, source_oneway, speed_limit and, of the second source, other_confidence, other_name, other_similarity, other_code. n: the order of rules. Names that are similar enough, as abbreviations spelt out are, are left as they are."""
    c, truthy = F.coalesce("confidence", F.lit(0.0)), oneway_truthy(F.col("oneway"))
    gt = F.coalesce("source_oneway", F.lit(""))
    two_way = gt.isin("", "no")
    one = F.col("defect_class").isin("A", "AB") & truthy
    sure = (c >= HIGH) & two_way
    drop = ~one & truthy & two_way & (c >= REVIEW)
    other = (c < REVIEW) & (F.coalesce("other_confidence", F.lit(0.0)) >= HIGH)
    mapped = lookup(HIGHWAY_OF_CODE, F.col("other_code"))
    rule = lambda when, kind, tag, value, review: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(tag).alias("tag"), value.cast("string").alias("value"), review.alias("review")))
    rules = F.array(
        rule(one, "remove_false_oneway", "oneway", F.lit(None), ~sure),
        rule(drop, "remove_oneway_cagis", "oneway", F.lit(None), c < HIGH),
        rule(~one & ~drop & (c >= REVIEW) & gt.isin("yes", "-1") & (F.coalesce("oneway", F.lit("")) != gt), "set_oneway_cagis", "oneway", gt, c < HIGH),
        rule((c >= REVIEW) & new_name(F.col("name"), F.col("source_name"), F.col("name_similarity")), "set_name_cagis", "name", strip(F.col("source_name")), F.lit(True)),
        rule((c >= REVIEW) & blank(F.col("maxspeed")) & F.col("speed_limit").isNotNull(), "set_maxspeed_cagis", "maxspeed", F.concat(F.col("speed_limit").cast("string"), F.lit(" mph")), c < HIGH),
        rule(other & new_name(F.col("name"), F.col("other_name"), F.col("other_similarity")), "set_name_tiger", "name", strip(F.col("other_name")), F.lit(True)),
        rule((c < REVIEW) & (F.coalesce("other_confidence", F.lit(0.0)) >= REVIEW) & (mapped != F.col("highway")), "reclass_highway_tiger", "highway", mapped, F.lit(True)),
    )
    return matched.select("id", F.posexplode(rules).alias("n", "f")).where("f is not null").select("id", "n", "f.*")


def single(proposed: DataFrame, confidences: DataFrame) -> DataFrame:
    """One fix a way, as the first form of the review asked for: the one-way that is surely false, else the first rule's fix where the match (id, confidence) is sure. Others have none."""
    rows = proposed.join(confidences.select("id", F.col("confidence").alias("_c")), "id", "left")
    false_one = F.col("kind") == "remove_false_oneway"
    may = rows.where(false_one | (F.coalesce("_c", F.lit(0.0)) >= HIGH))
    cols = [c for c in proposed.columns if c != "id"]
    best = may.groupBy("id").agg(F.min_by(F.struct(*cols), F.struct((~false_one).cast("int").alias("o"), "n")).alias("f"))
    return best.select("id", "f.*")


def in_review_order(classified: DataFrame, chosen: DataFrame) -> DataFrame:
    """Ways that have a fix, ranked from 0 by class and name: the order of a review."""
    rows = classified.join(chosen.select("id"), "id", "left_semi").select("id", "defect_class", "name_display", class_rank(F.col("defect_class")).alias("_class"))
    return numbered(rows, ["_class", "name_display", "id"]).drop("_class")


def accepted(proposed: DataFrame, mode: str, choices: DataFrame | None = None) -> DataFrame:
    """What a review takes: all with mode 'accept', none with 'reject', with 'each' those that ``choices`` (id, n, accept) take; what ``choices`` doesn't name isn't reached, as after quitting."""
    if mode == "each":
        if choices is None:
            raise ValueError("mode 'each' needs choices")
        return proposed.join(choices.where("accept").select("id", "n").distinct(), ["id", "n"], "left_semi")
    if mode not in ("accept", "reject"):
        raise ValueError(f"unknown mode {mode}")
    return proposed if mode == "accept" else proposed.limit(0)


def valid_requests(fixes: DataFrame) -> DataFrame:
    """Requested fixes (element_id, action, tag, changes map) with ``ok``: a positive id, an action on tags, and the tag to remove or the changes to make."""
    ok = (F.col("element_id") > 0) & ((F.col("action") == "remove_tag") & F.col("tag").isNotNull() | (F.col("action") == "modify_tag") & F.col("changes").isNotNull())
    return fixes.withColumn("ok", F.coalesce(ok, F.lit(False)))


def valid_zone(zone: Column) -> Column:
    """Whether a zone's key is safe as a part of a path."""
    return F.coalesce(zone.rlike("^[a-z0-9-]+$"), F.lit(False))


def finding_fixes(findings: DataFrame) -> DataFrame:
    """(id, kind, action) for findings (kind, id, decision) that routing has shown to be real."""
    kinds = {"oneway_minus_one": "remove_false_oneway_minus_one", "oneway_conflict": "remove_oneway_conflict", "broken_turn_restriction": "remove_broken_restriction", "barrier_unqualified": "add_access_to_barrier"}
    actions = {"oneway_minus_one": "remove_tag", "oneway_conflict": "remove_tag", "broken_turn_restriction": "remove_relation", "barrier_unqualified": "modify_tag"}
    return findings.where((F.col("decision") == "real") & F.col("kind").isin(*kinds)).select("id", lookup(kinds, F.col("kind")).alias("fix"), lookup(actions, F.col("kind")).alias("action"))


def apply_changes(tags: Column, changes: Column) -> Column:
    """``tags`` with ``changes`` put in; null values take a tag out."""
    kept = F.map_filter(tags, lambda k, v: ~F.array_contains(F.map_keys(changes), k))
    return F.map_concat(kept, F.map_filter(changes, lambda k, v: v.isNotNull()))


def batches(fixes: DataFrame, ranked_by: str = "rank", size: int = BATCH) -> DataFrame:
    """(batch, n) of fixes that carry their rank from 0."""
    return fixes.groupBy(F.expr(f"{ranked_by} div {size}").alias("batch")).agg(F.count("*").alias("n"))

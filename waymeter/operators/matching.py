"""Ways against ground-truth centerlines: one table of measured pairs, in which each geometry of the centerlines comes once, gives the best match, the fallback match and the diagnosis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..functions import lines as lines_
from ..functions.ranking import numbered
from ..functions.tables import written
from ..functions.text import blank, expand_abbrev, norm_name, plain_similarity, with_similarity
from .spatial import nearest_segments, overlapping

# Fixed values.
BUFFER_M, FALLBACK_M, HIGH, REVIEW, NAME_MATCH = 30.0, 100.0, 0.85, 0.60, 0.85
WEIGHTS = (0.5, 0.3, 0.2)
FUNCTIONAL_CLASS = {1: "interstate", 2: "arterial", 3: "collector", 4: "minor_collector", 5: "local", 6: "ramp", 7: "service"}
HIGHWAY_OF_CODE = {"S1100": "motorway", "S1200": "primary", "S1500": "unclassified", "S1640": "service", "S1730": "service", "S1740": "service"}


def lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def travel_direction(code: Column) -> Column:
    return F.when(code == 1, "yes").when(code == -1, "-1").otherwise("no")


def functional_class(code: Column) -> Column:
    return lookup(FUNCTIONAL_CLASS, code.try_cast("int"))


def speed(value: Column) -> Column:
    n = F.round(value.try_cast("double")).cast("int")
    return F.when(n > 0, n)


def centerline_records(raw: DataFrame) -> DataFrame:
    """(id, label, trvl_dir, class, speed, geometry) as centerlines: source_id, source_name, source_oneway, functional_class, speed_limit, geometry."""
    return raw.select(F.col("id").alias("source_id"), F.col("label").alias("source_name"), travel_direction(F.col("trvl_dir")).alias("source_oneway"), functional_class(F.col("class")).alias("functional_class"), speed(F.col("speed")).alias("speed_limit"), "geometry")


def _similar(pairs: DataFrame, fuzzy: bool) -> DataFrame:
    """``pairs`` with name_similarity; with ``fuzzy`` each pair of names is rated once, however many rows have it."""
    said = lambda df: df.withColumns({"_n1": norm_name(F.col("name")), "_n2": norm_name(F.col("source_name"))})
    if not fuzzy:
        return said(pairs).withColumn("name_similarity", F.coalesce(plain_similarity(F.col("_n1"), F.col("_n2")), F.lit(0.0))).drop("_n1", "_n2")
    names = written(pairs.select(F.col("name").alias("_said1"), F.col("source_name").alias("_said2")).distinct(), "said")
    rated = with_similarity(said(names.withColumns({"name": F.col("_said1"), "source_name": F.col("_said2")})), "_n1", "_n2").select("_said1", "_said2", "name_similarity")
    return pairs.join(written(rated, "rated"), F.col("name").eqNullSafe(F.col("_said1")) & F.col("source_name").eqNullSafe(F.col("_said2"))).drop("_said1", "_said2")


def shapes(centerlines: DataFrame) -> DataFrame:
    """(geometry, line, n, first), written: each geometry of the centerlines once, with a number of its own, how many have it and the columns of the one with the smallest id."""
    cols = [c for c in centerlines.columns if c != "geometry"]
    each = centerlines.where(F.size("geometry") > 0).groupBy("geometry").agg(F.count("*").alias("n"), F.min_by(F.struct(*cols), "source_id").alias("first"))
    return written(each.withColumn("line", F.monotonically_increasing_id()), "shapes")


def once(centerlines: DataFrame) -> DataFrame:
    """Centerlines, of those with the same geometry the one with the smallest id."""
    cols = [c for c in centerlines.columns if c != "geometry"]
    return centerlines.groupBy("geometry").agg(F.min_by(F.struct(*cols), "source_id").alias("_c")).select("_c.*", "geometry")


def candidates(own: DataFrame, lines: DataFrame, within_m: float = BUFFER_M, symmetric: bool = False) -> DataFrame:
    """(id, name, line, n, first, hausdorff_m, direction) of every way of two vertices or more and every geometry of :func:`shapes` whose envelopes are near, written: distances are measured once, whoever asks, and geometry goes no further."""
    return written(_near(own.select("id", "name", "geometry"), lines, ["line", "n", "first"], within_m, symmetric), "candidates")


def _near(own: DataFrame, lines: DataFrame, cols: list[str], within_m: float, symmetric: bool, **how) -> DataFrame:
    """Measured pairs of rows whose envelopes are near: the left columns and ``cols``, without geometry; ``how`` goes to :func:`overlapping`."""
    pairs = overlapping(_drawn(own, "_g", "_u"), _drawn(lines, "_s", "_v"), within_m / geo.BUFFER_DEGREE_M, [*cols, "_s", "_v"], **how)
    return _measured(pairs.drop("geometry", "source"), symmetric)


def _drawn(df: DataFrame, flat: str, direction: str) -> DataFrame:
    """``df`` with what pairs of its lines are measured by, made once a line and not once a pair: its coordinates in a row and its direction."""
    g = F.col("geometry")
    return df.withColumns({flat: lines_.flat(g), direction: geo.unit_vector(g)})


def _measured(pairs: DataFrame, symmetric: bool = False) -> DataFrame:
    metric = lines_.hausdorff if symmetric else lines_.directed_hausdorff
    return pairs.withColumns({"hausdorff_m": metric(F.col("_g"), F.col("_s")), "direction": geo.alignment(F.col("_u"), F.col("_v"))}).drop("_g", "_s", "_u", "_v")


def _own(ways: DataFrame, *more: Column) -> DataFrame:
    return written(ways.where(F.size("geometry") >= 2).select("id", "name", "geometry", *more), "lines")


def _members(lines: DataFrame, centerlines: DataFrame) -> DataFrame:
    """Centerlines with the number of their geometry in its place."""
    return centerlines.join(lines.select("line", "geometry"), "geometry").drop("geometry")


def scored_pairs(ways: DataFrame, centerlines: DataFrame, within_m: float = BUFFER_M, symmetric: bool = False, fuzzy: bool = True) -> DataFrame:
    """(id, name, centerlines' columns, hausdorff_m, direction, name_similarity, passes, confidence) of every way and centerline whose envelopes are near; confidence is null if they are too far apart.

    ``fuzzy`` false rates names 1 or 0, without the ratio of unequal names.
    """
    lines = shapes(centerlines)
    if fuzzy:
        pairs = candidates(_own(ways), lines, within_m, symmetric).drop("n", "first").join(_members(lines, centerlines), "line").drop("line")
        return scores(_similar(pairs, fuzzy), within_m)
    # most rows come of the last join: what is of one line or way, or of a way and a geometry, is made before it
    own = _own(ways, _key(F.col("name")).alias("_k"))
    pairs = _near(own, lines.select("line", "geometry"), ["line"], within_m, symmetric)
    members = written(_members(lines, centerlines).withColumn("_said", _key(F.col("source_name"))), "members")
    pairs = pairs.join(members.hint("shuffle_hash"), "line").drop("line")
    same = F.when(F.col("_k") == F.col("_said"), 1.0).otherwise(0.0)
    return scores(pairs.withColumn("name_similarity", same).drop("_k", "_said"), within_m)


def _key(name: Column) -> Column:
    """What names have in common that are equal as they are or spelt out; null without a name."""
    return expand_abbrev(norm_name(name))


def _named(pairs: DataFrame, lines: DataFrame, centerlines: DataFrame, fuzzy: bool) -> DataFrame:
    """:func:`candidates` with, of the centerlines of one geometry, the columns of that whose name is most like the way's, ties to the smaller id, and name_similarity. Another of them would have the same distance and direction, so it can't be a better match."""
    cols = [c for c in centerlines.columns if c != "geometry"]
    members = _members(lines, centerlines)
    if fuzzy:
        said = F.coalesce(norm_name(F.col("name")), F.lit(""))
        names = written(pairs.select("line", said.alias("name")).distinct(), "names")
        labels = members.groupBy("line", "source_name").agg(F.min_by(F.struct(*(c for c in cols if c != "source_name")), "source_id").alias("_m")).select("line", "source_name", "_m.*")
        rated = _similar(names.join(labels, "line"), fuzzy)
        best = rated.groupBy("line", F.col("name").alias("_name")).agg(F.max_by(F.struct(*cols, "name_similarity"), F.struct("name_similarity", (-F.col("source_id")).alias("o"))).alias("_c"))
        return pairs.withColumn("_name", said).join(best, ["line", "_name"]).drop("line", "_name", "n", "first").select("*", "_c.*").drop("_c")
    same = members.withColumn("_k", _key(F.col("source_name"))).where("_k is not null").groupBy("line", "_k").agg(F.min_by(F.struct(*cols), "source_id").alias("_same"))
    out = pairs.withColumn("_k", _key(F.col("name"))).join(same, ["line", "_k"], "left").withColumn("_c", F.coalesce("_same", "first"))
    return out.withColumn("name_similarity", F.when(F.col("_same").isNotNull(), 1.0).otherwise(0.0)).select("*", "_c.*").drop("line", "_k", "_same", "_c", "n", "first")


def _plain_pairs(own: DataFrame, centerlines: DataFrame, symmetric: bool, own_name: bool = False) -> DataFrame:
    """Scored pairs that pass, the best of each way (id, geometry, _k: the key of its name) among them, where names are rated 1 or 0.

    The centerlines of a way's own name are there, of those on one geometry the one with the smallest id, rated 1. Ways that these leave where a centerline of another name can reach them
    meet each geometry once more, rated 0: if it bears their name too, the pair rated 1 outdoes that one. With ``own_name`` they don't.
    """
    cols = [c for c in centerlines.columns if c != "geometry"]
    a = own.select("id", "_k", "geometry").where("_k is not null")
    # dealt to all cores first: the file may be small, its keys are not cheap
    keyed = written(centerlines.repartition("source_id").withColumn("_k", _key(F.col("source_name"))), "keyed")
    b = keyed.where("_k is not null").groupBy("geometry", "_k").agg(F.min_by(F.struct(*cols), "source_id").alias("_c")).select("geometry", "_k", "_c.*")
    same = _near(a, b, cols, BUFFER_M, symmetric, cell=0.032, on=("_k",), inside_m=BUFFER_M, among=(None, keyed)).drop("_k")
    same = written(scores(same.withColumn("name_similarity", F.lit(1.0)), BUFFER_M).where("passes"), "same_name")
    if own_name:
        return same
    unsure = own.select("id", "geometry").join(same.where(F.col("confidence") > WEIGHTS[1] + WEIGHTS[2]).select("id"), "id", "left_anti")
    other = _near(unsure, shapes(keyed.drop("_k")), ["first"], BUFFER_M, symmetric, inside_m=BUFFER_M, among=(own, None)).select("*", "first.*").drop("first")
    return same.unionByName(scores(other.withColumn("name_similarity", F.lit(0.0)), BUFFER_M).where("passes"))


def scores(pairs: DataFrame, within_m: float) -> DataFrame:
    pairs = pairs.withColumn("passes", F.col("hausdorff_m") <= within_m)
    n, g, d = WEIGHTS
    conf = n * F.col("name_similarity") + g * (1 - F.col("hausdorff_m") / within_m) + d * F.col("direction")
    return pairs.withColumn("confidence", F.when(F.col("passes"), conf))


def _best(pairs: DataFrame) -> DataFrame:
    cols = [c for c in pairs.columns if c not in ("id", "name")]
    best = pairs.where("passes").groupBy("id").agg(F.max_by(F.struct(*cols), F.struct("confidence", (-F.col("source_id")).alias("o"))).alias("b"))
    return best.select("id", "b.*")


def sampled_places(line: Column) -> Column:
    """Where a line is looked at: its first, middle and last vertex, each place once."""
    return F.array_distinct(F.array(F.lit(0), F.floor(F.size(line) / 2).cast("int"), F.size(line) - 1))


def _probes(ways: DataFrame, *more: Column | str) -> DataFrame:
    """(id, at, lat, lon, more): the sampled vertices of ways with two or more. A short way's middle vertex may be its first or last: each place is looked at once."""
    at = lambda i: F.struct(i.alias("at"), F.get("geometry", i).alias("p"))
    own = ways.where(F.size("geometry") >= 2)
    return own.select("id", *more, F.inline(F.transform(sampled_places(F.col("geometry")), at))).select("id", "at", "p.lat", "p.lon", *(m if isinstance(m, str) else "_reach" for m in more))


def _sampled(ways: DataFrame, centerlines: DataFrame, reach: Column, cell: float) -> DataFrame:
    """(id, source_id): the centerlines nearest, in degrees, to a way's first, middle and last vertex, as far as ``reach`` degrees; ties to the smaller source_id, each centerline once."""
    away = lines_.planar_distance(F.col("geometry"), F.col("source"))
    probes = _probes(ways, reach.alias("_reach")).withColumn("geometry", F.array(geo.point(F.col("lat"), F.col("lon"))))
    near = overlapping(probes, once(centerlines.select("source_id", "geometry").where(F.size("geometry") >= 2)), F.col("_reach"), ["source_id"], cell).withColumn("away", away).where(F.col("away") <= F.col("_reach"))
    nearest = near.groupBy("id", "at").agg(F.min(F.struct("away", "source_id")).alias("b"))
    return nearest.select("id", F.col("b.source_id").alias("source_id")).distinct()


def _with_lines(chosen: DataFrame, ways: DataFrame, centerlines: DataFrame, *cols: str) -> DataFrame:
    """Chosen pairs (id, source_id) with the way's name and geometry, or ``cols``, and the centerline's columns, its geometry as ``source``."""
    return chosen.join(ways.select("id", "name", *(cols or ("geometry",))), "id").join(centerlines.withColumnRenamed("geometry", "source"), "source_id")


def fallback_pairs(ways: DataFrame, centerlines: DataFrame, fuzzy: bool = True) -> DataFrame:
    """For ways without a pair that passes: the centerlines nearest to the first, middle and last vertex, scored with a wider limit and at most ``REVIEW``.

    Only a line within ``FALLBACK_M`` of every vertex can pass, so no farther one is looked for: that many metres in degrees of the
    way's latitude.
    """
    lat = F.array_max(F.transform("geometry", lambda p: F.abs(p["lat"])))
    chosen = _sampled(ways, centerlines, F.lit(FALLBACK_M / 110_000) / F.cos(F.radians(F.least(lat, F.lit(89.0)))), 0.004)
    pairs = _with_lines(chosen, _drawn(ways, "_g", "_u").drop("geometry"), _drawn(centerlines, "_s", "_v").drop("geometry"), "_g", "_u")
    chosen = written(_measured(pairs), "sampled")
    out = scores(_similar(chosen, fuzzy), FALLBACK_M)
    return out.withColumn("confidence", F.least("confidence", F.lit(REVIEW)))


def nearest_lines(ways: DataFrame, centerlines: DataFrame, rings: tuple[float, ...] = (0.002, 0.0125, 0.08)) -> DataFrame:
    """(id, nearest_distance_m): the least distance of a way's vertices from the centerlines nearest to its first, middle and last one, however far. Rings, in degrees, widen for ways that have found none; beyond the last cells of the whole plane are searched. Ways have two vertices or more."""
    own = written(ways.where(F.size("geometry") >= 2).select("id", "name", "geometry"), "lonely")
    chosen, rest = None, own
    for reach in rings:
        found = written(_sampled(rest, centerlines, F.lit(reach), 2 * reach), "ring")
        chosen = found if chosen is None else chosen.unionByName(found)
        rest = written(rest.join(found.select("id").distinct(), "id", "left_anti"), "rest")
        if rest.isEmpty():
            break
    else:
        far = nearest_segments(_probes(rest), centerlines, ["id", "at"], "source_id").select("id", "source_id").distinct()
        chosen = far if chosen is None else chosen.unionByName(far)
    least = lines_.least_distance(F.col("geometry"), F.col("source"))
    return _with_lines(chosen, own, centerlines).withColumn("_least", least).groupBy("id").agg(F.min("_least").alias("nearest_distance_m"))


def match(ways: DataFrame, centerlines: DataFrame, fallback: bool = True, symmetric: bool = False, fuzzy: bool = True, own_name: bool = False) -> DataFrame:
    """The best centerline of each way that has one: id, source columns, hausdorff_m, name_similarity, direction, confidence, via_fallback. Ties go to the smaller source_id.

    Where names are rated 1 or 0, a way's own name is looked for first; ways that this settles meet no other centerlines. Callers that
    keep no match of another name say ``own_name``: then no way meets them. It goes with neither ``fuzzy`` nor ``fallback``.
    """
    if own_name and (fuzzy or fallback):
        raise ValueError("own_name goes with neither fuzzy nor fallback")
    own = _own(ways) if fuzzy else _own(ways, _key(F.col("name")).alias("_k"))
    if fuzzy:
        lines = shapes(centerlines)
        pairs = candidates(own, lines, BUFFER_M, symmetric).where(F.col("hausdorff_m") <= BUFFER_M)
        pairs = scores(_named(pairs, lines, centerlines, fuzzy), BUFFER_M)
    else:
        pairs = _plain_pairs(own, centerlines, symmetric, own_name)
    best = written(_best(pairs).withColumn("via_fallback", F.lit(False)), "best")
    if not fallback:
        return best
    rest = own.join(best.select("id"), "id", "left_anti")
    return best.unionByName(_best(fallback_pairs(rest, centerlines, fuzzy)).withColumn("via_fallback", F.lit(True)))


def gated(ways: DataFrame, primary: DataFrame, centerlines: DataFrame, everywhere: bool = False, **how: bool) -> DataFrame:
    """Matches in a second source, made as :func:`match` is told to, only of ways that ``primary`` has no match of ``REVIEW`` or more for; of all ways with ``everywhere``."""
    if not everywhere:
        ways = ways.join(primary.where(F.col("confidence") >= REVIEW).select("id"), "id", "left_anti")
    return match(ways, centerlines, **how)


def beside(ways: DataFrame, primary: DataFrame, second: DataFrame) -> DataFrame:
    """``ways`` with what fixes ask for: the primary match's columns and, as other_*, the second source's; null where there is none. The second source's functional_class is other_code."""
    a = primary.select("id", "confidence", "source_name", "name_similarity", "source_oneway", "speed_limit")
    b = second.select("id", F.col("confidence").alias("other_confidence"), F.col("source_name").alias("other_name"), F.col("name_similarity").alias("other_similarity"), F.col("functional_class").alias("other_code"))
    return ways.drop("confidence").join(a, "id", "left").join(b, "id", "left")


def band(confidence: Column) -> Column:
    return F.when(confidence >= HIGH, "HIGH").when(confidence >= REVIEW, "REVIEW").when(confidence.isNotNull(), "LOW").otherwise("NONE")


def investigations(matched: DataFrame) -> DataFrame:
    """``matched`` (confidence) with ``list``: review, unmatched or other."""
    said = F.when(band(F.col("confidence")) == "REVIEW", "review").when(F.col("confidence").isNull(), "unmatched").otherwise("other")
    return matched.withColumn("list", said)


def diagnose(ways: DataFrame, centerlines: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(id, bucket, candidates, hausdorff_m, confidence, nearest_distance_m, length_m) of every way: why it matches or doesn't. The nearest distance is of ways without a candidate."""
    own, lines = _own(ways), shapes(centerlines)
    pairs = candidates(own, lines)
    length = geo.length(F.col("geometry"))
    best = _best(scores(_named(pairs.where(F.col("hausdorff_m") <= BUFFER_M), lines, centerlines, fuzzy), BUFFER_M)).select("id", F.struct("hausdorff_m", "name_similarity", "direction", "confidence").alias("b"))
    found = written(pairs.groupBy("id").agg(F.sum("n").alias("candidates"), F.min("hausdorff_m").alias("least_m")).join(best, "id", "left"), "found")
    lonely = own.join(found.select("id"), "id", "left_anti")
    wide = _best(fallback_pairs(lonely, centerlines, fuzzy)).select("id", F.col("confidence").alias("wide"))
    away = nearest_lines(lonely, centerlines)
    all_ = ways.select("id", "geometry", length.alias("length_m")).join(found, "id", "left").join(wide, "id", "left").join(away, "id", "left")
    n, g, d = F.col("b.name_similarity"), 1 - F.col("b.hausdorff_m") / BUFFER_M, F.col("b.direction")
    short = (F.col("length_m") < 50) & (d < 0.5) & ((0.5 * n + 0.3 * g) / 0.8 >= REVIEW)
    bucket = (
        F.when(F.size("geometry") < 2, "F1_NO_CANDIDATE")
        .when(F.col("candidates").isNull(), F.when(F.col("wide").isNotNull(), "MATCHED_FALLBACK_REVIEW").otherwise("F1_NO_CANDIDATE"))
        .when(F.col("b.confidence").isNull(), "F3_GEOMETRY_FAIL")
        .when(F.col("b.confidence") >= HIGH, "MATCHED_HIGH").when(F.col("b.confidence") >= REVIEW, "MATCHED_REVIEW")
        .when(short, "F4_DIRECTION_DRAG").when((n < 0.5) & (g >= 0.5) & (d >= 0.5), "F2_NAME_FAIL").otherwise("MIXED_LOW")
    )
    return all_.select("id", bucket.alias("bucket"), F.coalesce("candidates", F.lit(0)).alias("candidates"), F.when(F.col("b.confidence").isNull(), F.col("least_m")).otherwise(F.col("b.hausdorff_m")).alias("hausdorff_m"), F.coalesce("b.confidence", "wide").alias("confidence"), "nearest_distance_m", "length_m")


def upper_medians(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, median): of each group's n values, nulls left out, that at place n div 2 from 0. Values are ranked inside range partitions; no group is gathered."""
    known = rows.where(F.col(value).isNotNull()).select(group, value)
    ranks = numbered(known, [group, value])
    sizes = known.groupBy(group).agg(F.count("*").alias("_n"))
    first = F.sum("_n").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1))
    at = sizes.select(group, (F.coalesce(first, F.lit(0)) + F.floor(F.col("_n") / 2)).alias("rank"))
    return ranks.join(at, [group, "rank"]).select(group, F.col(value).alias("median"))


def diagnosis_summary(diagnosed: DataFrame, value: str = "hausdorff_m") -> DataFrame:
    """(bucket, n, least_m, median_m, most_m) of a value: the upper median."""
    counts = diagnosed.groupBy("bucket").agg(F.count("*").alias("n"), F.min(value).alias("least_m"), F.max(value).alias("most_m"))
    return counts.join(upper_medians(diagnosed, "bucket", value), "bucket", "left").select("bucket", "n", "least_m", F.col("median").alias("median_m"), "most_m")


#: What is measured of the ways in a bucket of misses.
MEASURED = {"F1_NO_CANDIDATE": "nearest_distance_m", "F3_GEOMETRY_FAIL": "hausdorff_m", "F4_DIRECTION_DRAG": "length_m"}


def headline(diagnosed: DataFrame) -> DataFrame:
    """(metric, value): totals of matched buckets, and shares in per cent, to two digits; 0 of no ways."""
    of = lambda *b: F.count_if(F.col("bucket").isin(*b))
    high, review, fallback = "MATCHED_HIGH", "MATCHED_REVIEW", "MATCHED_FALLBACK_REVIEW"
    share = lambda n: geo.rounded(F.coalesce(F.try_divide(100.0 * n, F.count("*")), F.lit(0.0)), 2)
    facts = {"total_ways": F.count("*"), "matched_high": of(high), "matched_review": of(review), "matched_fallback_review": of(fallback), "match_rate_pct": share(of(high, review, fallback)), "auto_submit_rate_pct": share(of(high)), "review_queue_pct": share(of(review, fallback))}
    return diagnosed.agg(*(c.cast("double").alias(k) for k, c in facts.items())).unpivot([], list(facts), "metric", "value")


def miss_statistics(diagnosed: DataFrame) -> DataFrame:
    """(bucket, n, least, median, most) of what ``MEASURED`` says of a miss, to two digits; ways without that measure are left out."""
    value = reduce(lambda a, kv: F.when(F.col("bucket") == kv[0], F.col(kv[1])).otherwise(a), MEASURED.items(), F.lit(None).cast("double"))
    rows = diagnosed.select("bucket", value.alias("value")).where("value is not null")
    s = diagnosis_summary(rows, "value")
    return s.select("bucket", "n", *(geo.rounded(F.col(f"{c}_m"), 2).alias(c) for c in ("least", "median", "most")))


def headline_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, a, b, delta) of two diagnoses."""
    j = headline(before).withColumnRenamed("value", "a").join(headline(after).withColumnRenamed("value", "b"), "metric")
    return j.select("metric", "a", "b", (F.col("b") - F.col("a")).alias("delta"))


def alerts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(alert, first, second): what looks wrong between two diagnoses. REGRESSION: sure matches grew while those to review shrank by more than half as much. WARNING: sure matches and misses by geometry both grew. NOTICE: the number of ways moved by more than a tenth; first and second are the two changes, or the two totals."""
    changes = bucket_changes(before, after)
    delta = lambda b: F.coalesce(F.max(F.when(F.col("bucket") == b, F.col("delta"))), F.lit(0))
    one = changes.agg(delta("MATCHED_HIGH").alias("high"), delta("MATCHED_REVIEW").alias("review"), delta("F3_GEOMETRY_FAIL").alias("f3"), F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
    high, review, f3, a, b = (F.col(c) for c in ("high", "review", "f3", "a", "b"))
    row = lambda name, x, y: F.struct(F.lit(name).alias("alert"), x.cast("long").alias("first"), y.cast("long").alias("second"))
    rules = F.array(
        F.when((high > 0) & (review < 0) & (-review > high * 0.5), row("REGRESSION", high, review)),
        F.when((high > 0) & (f3 > 0), row("WARNING", high, f3)),
        F.when((a > 0) & (F.abs(b - a) > 0.1 * a), row("NOTICE", a, b)),
    )
    return one.select(F.inline(F.array_compact(rules)))


def bucket_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(bucket, a, b, delta, delta_pct) of two tables with a bucket column."""
    a, b = before.groupBy("bucket").agg(F.count("*").alias("a")), after.groupBy("bucket").agg(F.count("*").alias("b"))
    j = a.join(b, "bucket", "full_outer").select("bucket", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return j.select("*", (F.col("b") - F.col("a")).alias("delta"), F.when(F.col("a") > 0, 100.0 * (F.col("b") - F.col("a")) / F.col("a")).when(F.col("b") > 0, 100.0).otherwise(0.0).alias("delta_pct"))


def name_match(a: Column, b: Column, similarity: Column) -> Column:
    """Whether two names, both there, are as similar as one name in two spellings."""
    return ~blank(norm_name(a)) & ~blank(norm_name(b)) & (F.coalesce(similarity, F.lit(0.0)) >= NAME_MATCH)


def new_name(own: Column, said: Column, similarity: Column) -> Column:
    """Whether a source names a way otherwise than it is: also where it has no name."""
    return ~blank(norm_name(said)) & ~name_match(own, said, similarity) & ~norm_name(own).eqNullSafe(norm_name(said))

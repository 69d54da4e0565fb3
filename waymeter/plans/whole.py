"""Queries that run a family of rules as a whole: summaries, baselines, route impact, second sources, reviews and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import classify, detectors, feeds, fixes, matching, reports, routes, spatial
from ..functions.tables import folder
from ..sources.fixtures import Roads
from . import audit
from .oracles import TRUTHY, hav, r
from .registry import ORACLES, RINGS, _matched, classified, diagnosed, eight, found, gaps, query, restriction_relations, rings, suspects

_BARRIER = "select id from barrier_nodes where barrier in ('gate','bollard','lift_gate','swing_gate','cycle_barrier') and coalesce(access,'')='' and coalesce(foot,'')=''"


def _sum(kind: str) -> str:
    return f"(select count(*) from found where kind='{kind}')"


def _more(name: str) -> str:
    """The count of what another query's SQL finds."""
    return f"(select count(*) from ({ORACLES[name]}))"


@query(
    f"""select count(*) total_ways, count(*) filter (highway='residential') residential, count(*) filter ({TRUTHY}) oneway_total, count(*) filter (defect_class in ('A','AB')) class_a_count, count(*) filter (defect_class='AB') class_ab_count, count(*) filter (defect_class in ('B','AB')) class_b_way_count, count(*) filter (defect_class='C') class_c_count, count(distinct case when segments>=2 then name_key end) class_b_streets, count(*) filter (n is null) missing_geometry,
 (select count(*) from gaps) gaps_found, {_sum("oneway_minus_one")} findings_oneway_minus_one, {_more("jn_2_conflicts")} findings_oneway_conflicts, {_sum("access_blocked")} findings_access_blocked, (select count(*) from ({_BARRIER})) findings_barriers_unqualified, {_more("flt_10_restrictions")} findings_broken_turn_restrictions, {_sum("arterial_named_residential")} findings_arterial_named_residential, {_sum("missing_maxspeed")} findings_missing_maxspeed, {_more("jn_5_suppressed_stops")} findings_bus_stops_misplaced,
 (select count(*) from found)+(select count(*) from ({_BARRIER}))+{_more("jn_2_conflicts")}+{_more("flt_10_restrictions")}+{_more("jn_5_suppressed_stops")} findings_total from cls left join ends using(id)""",
    "cls", "ends", "gaps", "found", "barrier_nodes",
)
def agg_1_whole_summary(x):
    x = x.kept()
    c = classified(x)
    return classify.whole_summary(c, classify.gap_pairs(c), eight(x))


@query(f"select kind, count(*) n from found group by 1 union all select 'barrier_unqualified', count(*) from ({_BARRIER}) union all select 'oneway_conflict', {_more('jn_2_conflicts')} union all select 'broken_turn_restriction', {_more('flt_10_restrictions')} union all select 'bus_stop_misplaced', {_more('jn_5_suppressed_stops')}", "found", "barrier_nodes")
def set_2_findings_by_kind(x):
    return eight(x.kept()).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"select * from (select 'reversed_oneways' detector, {_sum('oneway_minus_one')} n, false failed union all select 'conflicts', {_more('jn_2_conflicts')}, false union all select 'barriers', (select count(*) from ({_BARRIER})), false union all select 'restrictions', null, true union all select 'bus_stops', {_more('jn_5_suppressed_stops')}, false union all select 'blocked_access', {_sum('access_blocked')}, false union all select 'arterial_names', {_sum('arterial_named_residential')}, false union all select 'missing_maxspeed', {_sum('missing_maxspeed')}, false)", "found", "barrier_nodes")
def isolated_detectors(x):
    """Detectors run apart. The relations hold a row that fails while it is read: their detector leaves its failure, the others their tables."""
    relations = restriction_relations(x)
    torn = relations.withColumn("tags", F.when(F.col("id") == 17, F.map_from_arrays(F.array(F.lit("a"), F.concat(F.lit("a"), F.when(F.col("id") < 0, "b").otherwise(""))), F.array(F.lit("1"), F.lit("2")))).otherwise(F.col("tags")))
    inputs = audit.Inputs(x.ways, nodes=x["barrier_nodes"], relations=torn, bus_stops=x["bus_stops"], transit_stops=x["gtfs_stops"])
    return audit.save_findings(inputs, folder(x.spark, "findings")).select("detector", "n", "failed")


@query(f"select c.id, c.id_other, c.id in (select id from ({ORACLES['jn_6_corridors']})) transit_corridor from ({ORACLES['jn_2_conflicts']}) c", "mid", "route_vertices")
def jn_2_corroborated_conflicts(x):
    return detectors.conflicts(x.ways, route_vertices=x["route_vertices"]).select("id", "id_other", "transit_corridor")


def _ratio_rows(x: Roads):
    k = F.col("o_orderkey")
    run = lambda c, n: F.repeat(F.lit(c), n.cast("int"))
    a = F.when(k % 13 != 0, F.concat(run("k", k % 9 + 5), run("x", k % 4)))
    b = F.when(k % 17 != 0, F.concat(run("k", F.col("o_custkey") % 7 + 4), run("y", k % 3)))
    return x.table("orders").select(k.alias("id"), a.alias("a"), b.alias("b"))


@query(f"select o_orderkey id, {r('case when o_orderkey%13=0 or o_orderkey%17=0 then 0.0 else 2.0*least(o_orderkey%9+5, o_custkey%7+4)/(o_orderkey%9+5+o_orderkey%4+o_custkey%7+4+o_orderkey%3) end', 6)} name_similarity from orders")
def prj_9_name_similarity(x):
    return text.with_similarity(_ratio_rows(x), "a", "b").select("id", geo.rounded(F.col("name_similarity"), 6).alias("name_similarity"))


@query(f"select id, case when conf>=0.85 then 'HIGH' when conf>=0.6 then 'REVIEW' else 'LOW' end band, via via_fallback, {r('conf', 4)} confidence from (select id, conf, false via from kbest union all select id, conf, true from kwide)", "kbest", "kwide")
def flt_17_match_bands(x):
    m = matching.match(x.known_ways, matching.centerline_records(x.known_centerlines))
    return m.select("id", matching.band(F.col("confidence")).alias("band"), "via_fallback", geo.rounded(F.col("confidence"), 4).alias("confidence"))


_BEST = "select * from (select id, source_id, 0.5*sim+0.3*(1-h/30)+0.2*dir conf, row_number() over (partition by id order by 0.5*sim+0.3*(1-h/30)+0.2*dir desc, source_id) k from kscored where passes and {}) where k=1"


@query(f"select id, source_id, {r('conf', 4)} confidence from ({_BEST.format('source_id%3<>0')}) where id not in (select id from ({_BEST.format('source_id%3=0')}) where conf>=0.6)", "kscored")
def jn_12_second_source(x):
    lines = matching.centerline_records(x.known_centerlines)
    primary = matching.match(x.known_ways, lines.where("source_id % 3 = 0"), fallback=False)
    second = matching.gated(x.known_ways, primary, lines.where("source_id % 3 <> 0"), fallback=False)
    return second.select("id", "source_id", geo.rounded(F.col("confidence"), 4).alias("confidence"))


@query(f"select count(*) filter (not k) kept, count(*) filter (k) n_suppressed from (select exists (select 1 from gtfs_stops g where {hav('s.lat', 's.lon', 'g.lat', 'g.lon')}<=50) k from stopd s where d>20)", "stopd", "gtfs_stops")
def jn_16_cross_check(x):
    stops = detectors.misplaced_stops(x["bus_stops"], x.ways)
    kept, gone = detectors.cross_checked(stops, x["gtfs_stops"])
    return kept.agg(F.count("*").alias("kept")).withColumn("_one", F.lit(1)).join(gone.withColumn("_one", F.lit(1)), "_one").drop("_one")


_ASK = """asked as (select id, kind, 'o'||cast(id%50 as varchar) o, 'd'||cast(id%20 as varchar) d, 'n'||cast(id%3 as varchar) g from routes),
answers as (select 'o'||cast(c_custkey%50 as varchar) o, 'd'||cast(c_custkey%40 as varchar) d, case c_custkey%4 when 0 then '' else 'n'||cast(c_custkey%4 as varchar) end g, case when c_custkey%7<>0 then floor(c_acctbal)+2000 end len from customer),
best as (select o, d, g, max(len) len from answers group by all)"""


@query(f", {_ASK}\nselect id, l.len live_m, n.len perturbed_m from asked a left join best l on l.o=a.o and l.d=a.d and l.g='' left join best n on n.o=a.o and n.d=a.d and n.g=a.g", "routes")
def jn_21_two_sided_lookup(x):
    text_of = lambda c, k: F.concat(F.lit(c), k.cast("string"))
    i, k = F.col("id"), F.col("c_custkey")
    asked = x["routes"].select("id", "kind", text_of("o", i % 50).alias("origin"), text_of("d", i % 20).alias("destination"), text_of("n", i % 3).alias("nogo"))
    length = F.when(k % 7 != 0, F.floor("c_acctbal") + 2000).cast("double")
    answers = x.table("customer").select(text_of("o", k % 50).alias("origin"), text_of("d", k % 40).alias("destination"), F.when(k % 4 == 0, "").otherwise(text_of("n", k % 4)).alias("nogo"), length.alias("length_m"), (length / 10).alias("duration_s"))
    return routes.tested(asked, answers).select("id", "live_m", "perturbed_m")


_IMPACT = f"""select f.id, f.kind, case when f.kind in ('set_oneway_cagis','remove_oneway_cagis') then d.decision end decision, case when f.kind in ('set_oneway_cagis','remove_oneway_cagis') then d.delta_pct end delta_pct,
 case when f.kind not in ('set_oneway_cagis','remove_oneway_cagis') then 'kind '''||f.kind||''' does not perturb the routing graph' when d.id is null then 'no route could be asked for' end skipped, (coalesce(d.perturbed_m,0)-coalesce(d.live_m,0))/10 shift
 from ({ORACLES["fix_1_7_proposals"]}) f left join (select d.*, q.live_m, q.perturbed_m from decided d join routed q using(id) where d.kind in ('oneway_minus_one','oneway_conflict')) d on d.id=f.id"""


def _impact(x: Roads):
    asked = x["routes"].where("kind in ('oneway_minus_one', 'oneway_conflict')").withColumns({"live_s": F.col("live_m") / 10, "perturbed_s": F.col("perturbed_m") / 10})
    return routes.fix_impact(fixes.proposals(_matched(x)).select("id", "kind"), routes.decide(asked))


@query(f"select id, kind, decision, skipped from ({_IMPACT})", "routed", "decided")
def fix_11_impact_of_fixes(x):
    return _impact(x).select("id", "kind", "decision", "skipped")


@query(
    f"""select count(*) fixes_total, count(decision) fixes_tested, count(*)-count(decision) fixes_skipped, count(*) filter (decision='real') as real, count(*) filter (decision='inconclusive') inconclusive, count(*) filter (decision='noisy') noisy,
 {r("coalesce(avg(delta_pct) filter (decision='real'),0)", 2)} mean_pct, {r("coalesce(max(delta_pct) filter (decision='real'),0)", 2)} most_pct, {r("coalesce(avg(shift) filter (decision='real'),0)", 1)} mean_shift_s from ({_IMPACT})""",
    "routed", "decided",
)
def agg_7_impact_summary(x):
    s = routes.impact_summary(_impact(x))
    digits = {"mean_pct": 2, "most_pct": 2, "mean_shift_s": 1}
    return s.select(*(geo.rounded(F.col(c).cast("double"), digits[c]).alias(c) if c in digits else c for c in s.columns))


def _two_diagnoses(x: Roads):
    """A diagnosis whose buckets go by customers, and one in which many ways to review became sure ones, and some ways are gone."""
    k, o = F.col("o_orderkey"), x.table("orders")
    names = F.array(*map(F.lit, ("MATCHED_HIGH", "MATCHED_REVIEW", "MATCHED_REVIEW", "MATCHED_FALLBACK_REVIEW", "F1_NO_CANDIDATE", "F3_GEOMETRY_FAIL", "MIXED_LOW")))
    before = o.select(F.get(names, (k % 7).cast("int")).alias("bucket"))
    after = o.where(k % 8 != 0).select(F.when((k % 7 == 1) & (k % 3 == 0), "MATCHED_HIGH").when(k % 7 == 6, "F3_GEOMETRY_FAIL").when((k % 7 == 1) | (k % 7 == 2) & (k % 2 == 0), "MIXED_LOW").otherwise(F.get(names, (k % 7).cast("int"))).alias("bucket"))
    return before, after


_NAMES = "['MATCHED_HIGH','MATCHED_REVIEW','MATCHED_REVIEW','MATCHED_FALLBACK_REVIEW','F1_NO_CANDIDATE','F3_GEOMETRY_FAIL','MIXED_LOW'][cast(o_orderkey%7+1 as int)]"
_TWO = f"""with a as (select {_NAMES} bucket from orders), b as (select case when o_orderkey%7=1 and o_orderkey%3=0 then 'MATCHED_HIGH' when o_orderkey%7=6 then 'F3_GEOMETRY_FAIL' when o_orderkey%7=1 or o_orderkey%7=2 and o_orderkey%2=0 then 'MIXED_LOW' else {_NAMES} end bucket from orders where o_orderkey%8<>0)"""
_COUNTS = "(select count(*) filter (bucket='MATCHED_HIGH') h, count(*) filter (bucket='MATCHED_REVIEW') r, count(*) filter (bucket='MATCHED_FALLBACK_REVIEW') f, count(*) filter (bucket='F3_GEOMETRY_FAIL') g, count(*) n from {})"


@query(
    f"""{_TWO} select metric, cast(va as double) a, cast(vb as double) b, cast(vb as double)-cast(va as double) delta from {_COUNTS.format("a")} x, {_COUNTS.format("b")} y, lateral (values ('total_ways', x.n, y.n), ('matched_high', x.h, y.h), ('matched_review', x.r, y.r), ('matched_fallback_review', x.f, y.f),
 ('match_rate_pct', {r("100.0*(x.h+x.r+x.f)/x.n", 2)}, {r("100.0*(y.h+y.r+y.f)/y.n", 2)}), ('auto_submit_rate_pct', {r("100.0*x.h/x.n", 2)}, {r("100.0*y.h/y.n", 2)}), ('review_queue_pct', {r("100.0*(x.r+x.f)/x.n", 2)}, {r("100.0*(y.r+y.f)/y.n", 2)})) t(metric, va, vb)"""
)
def agg_5_headline_changes(x):
    return matching.headline_changes(*_two_diagnoses(x))


@query(f"""{_TWO}, c as (select x.h h0, y.h h1, x.r r0, y.r r1, x.g g0, y.g g1, x.n n0, y.n n1 from {_COUNTS.format("a")} x, {_COUNTS.format("b")} y)
select 'REGRESSION' alert, h1-h0 as first, r1-r0 as second from c where h1>h0 and r1<r0 and r0-r1>0.5*(h1-h0) union all select 'WARNING', h1-h0, g1-g0 from c where h1>h0 and g1>g0 union all select 'NOTICE', n0, n1 from c where abs(n1-n0)>0.1*n0""")  # fmt: skip
def agg_5_alerts(x):
    return matching.alerts(*_two_diagnoses(x))


# reviews

_FIX_SQL = ORACLES["fix_1_7_proposals"]


@query(f"select id, kind, tag, value from (select f.*, row_number() over (partition by f.id order by case when f.kind='remove_false_oneway' then 0 else 1 end, n) k from ({_FIX_SQL}) f left join kbest b on b.id=f.id where f.kind='remove_false_oneway' or b.conf>=0.85) where k=1", "kbest")
def fix_8_single_fixes(x):
    m = _matched(x)
    return fixes.single(fixes.proposals(m), m).select("id", "kind", "tag", "value")


@query("select row_number() over (order by case defect_class when 'AB' then 0 when 'A' then 1 when 'B' then 2 else 3 end, name_display, id)-1 as rank, id from cls where highway='residential'", "cls")
def top_5_review_order(x):
    c = classified(x)
    return fixes.in_review_order(c, c.where("highway = 'residential'")).select("rank", "id")


@query(f"select 'accept' as mode, count(*) n from ({_FIX_SQL}) union all select 'reject', 0 union all select 'each', count(*) from ({_FIX_SQL}) where id%10=0 and n=0", "cls")
def fix_10_review_modes(x):
    p = fixes.proposals(_matched(x))
    choices = p.where("id % 10 < 2").select("id", "n", ((F.col("id") % 10 == 0) & (F.col("n") == 0)).alias("accept"))
    taken = {"accept": fixes.accepted(p, "accept"), "reject": fixes.accepted(p, "reject"), "each": fixes.accepted(p, "each", choices)}
    parts = [v.agg(F.count("*").alias("n")).select(F.lit(k).alias("mode"), "n") for k, v in taken.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select id, impact from (select w.id, coalesce(max(routing_impact),0) impact from ways_attr w left join found f on f.id=w.id left join kbest b on b.id=w.id where b.id is null or (conf>=0.6 and conf<0.85) group by 1)", "ways_attr", "found", "kbest")
def top_8_investigations(x):
    m = matching.match(x.known_ways, matching.centerline_records(x.known_centerlines), fallback=False).select("id", "confidence")
    return reports.investigations(matching.investigations(x["ways_attr"].select("id").join(m, "id", "left")), found(x)).select("id", "impact")


@query("select o_orderkey id, case when o_orderkey%5=0 then false when o_orderkey%3=0 then o_orderkey%2=0 when o_orderkey%3=1 then o_orderkey%4<2 else false end ok from orders")
def flt_22_fix_requests(x):
    k = F.col("o_orderkey")
    action = F.when(k % 3 == 0, "remove_tag").when(k % 3 == 1, "modify_tag").otherwise("drop_table")
    rows = x.table("orders").select(k.alias("id"), F.when(k % 5 != 0, k).otherwise(-k).alias("element_id"), action.alias("action"), F.when(k % 2 == 0, "oneway").alias("tag"), F.when(k % 4 < 2, F.create_map(F.lit("oneway"), F.lit("no"))).alias("changes"))
    return fixes.valid_requests(rows).select("id", "ok")


# sheets, tasks and exports


@query("select row_number() over (order by name_key, way1_id, way2_id) n, way1_id, way2_id from gaps", "gaps")
def win_5_numbered_gaps(x):
    return reports.ordinals(gaps(x), ["name_key", "way1_id", "way2_id"]).select("n", "way1_id", "way2_id")


@query("select greatest(count(*)-1,0) n from ways_attr", "ways_attr")
def agg_16_row_count(x):
    return reports.row_count(x["ways_attr"])


@query("select uuid, min(item) item from qa_issues group by 1", "qa_issues")
def set_6_issues_once(x):
    return feeds.once(x["qa_issues"].select("uuid", "item"), "uuid", "item")


@query("select id, case when n=2 then '0,1' else '0,'||cast(n//2 as varchar)||','||cast(n-1 as varchar) end places from ends where n>=2", "ends")
def set_7_sampled_places(x):
    places = matching.sampled_places(F.col("geometry"))
    return x.ways.where("size(geometry) >= 2").select("id", F.array_join(F.transform(places, lambda i: i.cast("string")), ",").alias("places"))


@query(
    f"""select c.id, case defect_class when 'AB' then 0 when 'A' then 1 else 2 end priority, 'Way '||cast(c.id as varchar)||': '||name_display||' (Class '||defect_class||')' title, case when b.id is null then 'none' when conf>=0.6 then 'review' else 'weak' end how
 from cls c join ends e on e.id=c.id left join best b on b.id=c.id where e.n>=2 and defect_class in ('A','AB') and coalesce(conf,0)<0.85""",
    "cls", "ends", "best",
)
def prj_26_tasks(x):
    own = suspects(x)
    m = matching.match(own, matching.centerline_records(x.centerline_shapes), fallback=False, fuzzy=False).select("id", "confidence", "source_id", "source_oneway")
    t = reports.tasks(reports.unverified(own.join(m, "id", "left")))
    how = F.when(F.col("instruction").contains("No centerline"), "none").when(F.col("instruction").contains("weak sign"), "weak").otherwise("review")
    return t.select("id", "priority", "title", how.alias("how"))


@query("select cast(id as varchar)||','||case when contains(name_display,',') or contains(name_display,'\"') then '\"'||replace(name_display,'\"','\"\"')||'\"' else name_display end||','||highway||','||coalesce(oneway,'')||','||defect_class||','||case defect_class when 'AB' then 'CRITICAL' when 'A' then 'CRITICAL' when 'B' then 'HIGH' else 'LOW' end||',,,'||cast(version as varchar)||','||coalesce(usr,'')||',' line from (select * replace (case when id%3=0 then name_display||', \"x\"' else name_display end as name_display) from cls)", "cls")
def snk_8_csv_export(x):
    c = classified(x).withColumn("name_display", F.when(F.col("id") % 3 == 0, F.concat("name_display", F.lit(', "x"'))).otherwise(F.col("name_display")))
    return reports.csv_line(reports.exported(c))


@query("select month, remaining, 31-k+1 days_left, remaining//(31-k+1) per_day, remaining>=900 fits, case when remaining=0 then cast('infinity' as double) else floor(90000.0/remaining*100+0.5)/100 end share_pct from (select strftime(ts,'%Y-%m') as month, greatest(4000-count(*),0) remaining, 11 k from events group by 1) where month='2024-01'")
def win_8_budget(x):
    b = feeds.budget(feeds.monthly_quota(x.table("events")), "2024-01-11", 900)
    share = F.col("share_pct")
    return b.withColumn("share_pct", F.when(F.col("remaining") == 0, share).otherwise(geo.rounded(share, 2)))


_IN = " + ".join(f"case when ({a[0]}>lat)<>({b[0]}>lat) and lon<{a[1]}+(lat-{a[0]})*({b[1]}-({a[1]}))/nullif({b[0]}-{a[0]},0) then 1 else 0 end" for ring in RINGS for a, b in zip(ring, ring[1:], strict=False))


@query(f"select coalesce(highway,'') kind, count(*) filter (lat is not null and ({_IN})%2=1) kept, count(*) filter (lat is not null and ({_IN})%2=0) dropped, count(*) filter (lat is null) no_centroid from ways_attr w left join mid m on m.id=w.id group by 1", "ways_attr", "mid")
def agg_13_clip_statistics(x):
    rows = x.ways.select(F.coalesce("highway", F.lit("")).alias("kind"), geo.middle(F.col("geometry")).alias("m")).select("kind", "m.lat", "m.lon")
    return spatial.clip_counts(rows, rings(), "kind")


@query(f"select id, {r('max(d)', 3)} farthest_m from (select v.id, v.i, min(case when v.lon between c.lon1 and c.lon2 then abs(v.lat-c.lat)*111320.0 else sqrt(pow((v.lat-c.lat)*111320.0,2)+pow((v.lon-case when v.lon<c.lon1 then c.lon1 else c.lon2 end)*111320.0*cos(radians(c.lat)),2)) end) d from way_vertices v join orders on o_orderkey=v.id join centerlines c on c.id=o_custkey group by 1,2) group by 1", "way_vertices", "centerlines")
def prj_12_13_every_vertex(x):
    own = x.ways.where("size(geometry) > 0").join(x.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cid")), "id").join(x.centerline_shapes.select(F.col("id").alias("cid"), F.col("geometry").alias("line")), "cid")
    return own.select("id", geo.rounded(geo.directed_hausdorff(F.col("geometry"), F.col("line")), 3).alias("farthest_m"))

"""Further queries of the road audit: harvest filters, feeds' payloads, exports, filters and small projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import feeds, history, matching, payloads, reports, routes, spatial
from ..sources.landed import decode_polyline, issue_elements
from .oracles import TRUTHY, hav, r
from .registry import classified, gaps, query, suspects

# sources


@query(f"select id from ways_attr where (highway='residential' and oneway='yes') or (highway in ('residential','unclassified','tertiary','service') and {TRUTHY}) or highway in ('motorway','trunk','primary','secondary','tertiary','unclassified','residential','service')", "ways_attr")
def src_1_harvest(x):
    return payloads.harvest(x["ways_attr"]).select("id")


@query("select id from (select id, usr, timestamp '2007-01-01' + to_days(cast(id%800 as int)) ts from ways_attr) where usr in ('DaveHansenTiger','bot-mode') and ts>timestamp '2007-08-03' and ts<timestamp '2008-05-04'", "ways_attr")
def src_2_import_only(x):
    w = x["ways_attr"].withColumn("timestamp", F.date_format(F.date_add(F.lit("2007-01-01").cast("date"), (F.col("id") % 800).cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return payloads.imported(w).select("id")


@query("select n_nationkey id, substr(sha1(printf('%.6f,%.6f,%.6f,%.6f', n_nationkey+0.5, -n_nationkey-1.25, n_nationkey+1.0, -n_nationkey+0.125)),1,12) h from nation")
def src_5_bbox_hash(x):
    k = F.col("n_nationkey")
    return x.table("nation").select(k.alias("id"), payloads.bbox_hash(k + 0.5, -k - 1.25, k + 1.0, -k + 0.125).alias("h"))


@query("select coalesce(max(case when s_suppkey=7 then s_name end),'default') url from supplier")
def src_13_feed_url(x):
    return payloads.feed_url(x.table("supplier").select(F.col("s_suppkey").alias("feed_id"), F.col("s_name").alias("url")), 7, "default")


@query("select o_orderkey id, case when o_orderkey%2=0 then 'open' else 'closed' end status, coalesce(case when o_orderkey%3<>0 then o_orderstatus end,'<p>'||o_orderstatus||'</p>') said from orders where o_orderkey%5<>0")
def src_19_notes(x):
    o = x.table("orders")
    k = F.col("o_orderkey")
    props = F.struct(k.alias("id"), F.when(k % 2 == 1, "closed").alias("status"), F.array(F.struct(F.when(k % 3 != 0, F.col("o_orderstatus")).alias("text"), F.concat(F.lit("<p>"), F.col("o_orderstatus"), F.lit("</p>")).alias("html"))).alias("comments"))
    shape = F.struct(F.when(k % 5 != 0, F.array(F.lit(-84.4), F.lit(39.2))).alias("coordinates"))
    raw = o.select(F.to_json(F.struct(F.array(F.struct(props.alias("properties"), shape.alias("geometry"))).alias("features"))).alias("value"))
    return payloads.notes(raw).select("id", "status", F.col("comments")[0]["text"].alias("said"))


@query("select o_orderkey id, 'way' as element, o_orderkey+k way_id from orders, (values (0),(1)) t(k) where k=0 or o_orderkey%2=0")
def src_20_issue_elements(x):
    k = F.col("o_orderkey")
    ids = F.when(k % 2 == 0, F.concat(F.lit('["way/'), k.cast("string"), F.lit('","way/'), (k + 1).cast("string"), F.lit('"]'))).otherwise(F.concat(F.lit('["way/'), k.cast("string"), F.lit('","node/x"]')))
    return x.table("orders").select(k.alias("id"), F.explode(issue_elements(ids)).alias("e")).select("id", F.col("e.type").alias("element"), F.col("e.id").alias("way_id"))


@query("select o_orderkey id, case when o_orderkey%4<>0 then 100.0+o_orderkey%50 else 30.0+o_orderkey%50 end*2 as length_m, case when o_orderkey%2=0 then 60 else 90 end duration_s from orders")
def src_23_agg_14_itineraries(x):
    k = F.col("o_orderkey")
    d = F.when(k % 4 != 0, 100.0 + k % 50).otherwise(30.0 + k % 50)
    legs = F.array(F.struct(d.alias("distance")), F.struct(d.alias("distance")))
    raw = x.table("orders").select(k.alias("id"), F.to_json(F.struct(F.array(F.struct(F.when(k % 2 == 0, 60).alias("duration"), F.lit("2026-01-01T10:00:00Z").alias("startTime"), F.lit("2026-01-01T10:01:30Z").alias("endTime"), legs.alias("legs"))).alias("itineraries"))).alias("value"))
    return payloads.itineraries(raw)


# filters


@query("select count(*) n, count(*)<100 few from nation")
def flt_13_sanity(x):
    return payloads.sanity(x.table("nation"))


@query("select c.id from cls c join ends e on e.id=c.id left join best b on b.id=c.id where defect_class in ('A','AB') and coalesce(conf,0)<0.85", "cls", "ends", "best")
def flt_14_unverified_ways(x):
    own = suspects(x)
    m = matching.match(own, matching.centerline_records(x.centerline_shapes), fallback=False, fuzzy=False).select("id", "confidence")
    return reports.unverified(own.join(m, "id", "left")).select("id")


@query("select way1_id, way2_id, name_key from gaps", "gaps")
def flt_15_gap_tasks(x):
    return reports.gap_tasks(gaps(x)).select("way1_id", "way2_id", "name_key")


@query("select id, kind, decision='real' graduated from decided where decision<>'noisy'", "decided")
def flt_16_graduated(x):
    d = routes.decide(x["routes"]).where("decision <> 'noisy'")
    return d.select("id", "kind", (F.col("decision") == "real").alias("graduated"))


@query("select id, case when conf>=0.6 and conf<0.85 then 'review' when conf is null then 'unmatched' else 'other' end list from cls left join best using(id)", "cls", "best")
def flt_18_investigations(x):
    m = matching.match(x.ways, matching.centerline_records(x.centerline_shapes), fallback=False, fuzzy=False).select("id", "confidence")
    return matching.investigations(x["ways_attr"].select("id").join(m, "id", "left")).select("id", "list")


@query("select id, defect_class from cls where defect_class in ('A','AB','B')", "cls")
def flt_21_layers(x):
    return classified(x).where(F.col("defect_class").isin("A", "AB", "B")).select("id", "defect_class")


# joins


@query("select w.id, min(q.uuid) issue, count(*) matches from ways_attr w join (select uuid, unnest(ways) way_id from qa_issues) q on q.way_id=w.id group by 1", "ways_attr", "qa_issues")
def jn_13_issues(x):
    issues = x["qa_issues"].select("uuid", F.explode("ways").alias("id"))
    return payloads.issues_by_element(issues).join(x["ways_attr"].select("id"), "id", "left_semi").select("id", "issue", "matches")


@query(
    f"""select id, {r("min(d)", 1)} distance_m from (select e.id, {hav("e.lat0", "e.lon0", "v.lat", "v.lon")} d from ends e join way_vertices v on v.id<>e.id and abs(v.lat-e.lat0)<0.0075 and abs(v.lon-e.lon0)<0.0097 join ways_attr w on w.id=v.id and w.highway<>'service' where e.n>=2) group by 1 having min(d)<=800""",
    "ends", "way_vertices", "ways_attr",
)
def jn_15_nearest_other_way(x):
    g = F.col("geometry")
    ways = x.kept().ways
    start = ways.where("size(geometry) >= 2").select("id", geo.first(g)["lat"].alias("lat"), geo.first(g)["lon"].alias("lon"))
    roads = spatial.vertices(ways.where("highway <> 'service'"), "id")
    return payloads.nearest_other(start, roads).select("id", geo.rounded(F.col("distance"), 1).alias("distance_m"))


@query()
def jn_15_route_ends(x):
    o, d = F.col("origin"), F.col("destination")
    return payloads.route_ends(x.ways).select("id", o["lat"].alias("origin_lat"), o["lon"].alias("origin_lon"), d["lat"].alias("destination_lat"), d["lon"].alias("destination_lon"))


# reports


@query(f"select 'ways' metric, count(*) n from cls union all select 'oneway_yes', count(*) filter (oneway='yes') from cls union all select 'A', count(*) filter (defect_class='A') from cls union all select 'AB', count(*) filter (defect_class='AB') from cls union all select 'B', count(*) filter (defect_class='B') from cls union all select 'residential', count(*) filter (highway='residential') from cls", "cls")
def agg_8_executive(x):
    return reports.executive(classified(x))


@query("select name_key, segments, gaps from (select c.name_key, segments, coalesce(g,0) gaps from (select name_key, count(*) segments from cls where segments>=2 group by 1) c left join (select name_key, count(*) g from gaps group by 1) g on g.name_key=c.name_key) order by gaps desc, name_key limit 50", "cls", "gaps")
def top_3_streets_by_gaps(x):
    return reports.gap_counts(classified(x), gaps(x)).orderBy(F.desc("gaps"), "name_key").limit(50)


@query("select name_key, count(*) segments from cls where name_key is not null group by 1 order by 2 desc, 1 limit 25", "cls")
def top_4_streets_by_size(x):
    return reports.largest_streets(classified(x))


@query("select kind, count(*) filter (k) as inside, count(*) filter (not k) as outside from (select case when id%2=0 then 'even' else 'odd' end kind, lat between 39.17 and 39.235 k from mid) group by 1", "mid")
def agg_13_clip_counts(x):
    m = x.ways.where("size(geometry) > 0").withColumn("m", geo.middle(F.col("geometry"))).select("id", "m.lat")
    k = F.col("lat").between(39.17, 39.235)
    return m.groupBy(F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("kind")).agg(F.count_if(k).alias("inside"), F.count_if(~k).alias("outside"))


@query("select id, '<way id=\"'||cast(id as varchar)||'\" version=\"'||cast(version as varchar)||'\">'||case when name is null then '' else '<tag k=\"name\" v=\"'||replace(replace(name,'&','&amp;'),'''','&apos;')||'\"/>' end||'<tag k=\"highway\" v=\"'||highway||'\"/></way>' as xml from ways_attr", "ways_attr")
def snk_9_change_xml(x):
    tags = F.map_filter(F.create_map(F.lit("name"), F.col("name"), F.lit("highway"), F.col("highway")), lambda k, v: v.isNotNull())
    return x["ways_attr"].select("id", payloads.way_xml(F.col("id"), F.col("version"), tags).alias("xml"))


@query("select id, kind from (select id, kind, row_number() over (order by id desc) k from routes) where k<=500", "routes")
def snk_11_edit_ledger(x):
    return reports.ledger(x["routes"].withColumn("seq", F.col("id"))).select("id", "kind")


# projections


@query("select distinct p_size%8 code, case p_size%8 when 0 then 'motorway' when 1 then 'primary' when 2 then 'unclassified' when 3 then 'service' when 4 then 'service' when 5 then 'service' end highway, p_size%8=6 ambiguous from part")
def prj_20_class_codes(x):
    codes = F.array(*map(F.lit, ("S1100", "S1200", "S1500", "S1640", "S1730", "S1740", "S1400", "X")))
    k = (F.col("p_size") % 8).cast("int")
    c = F.get(codes, k)
    return x.table("part").select(k.alias("code"), matching.lookup(matching.HIGHWAY_OF_CODE, c).alias("highway"), (c == "S1400").alias("ambiguous")).distinct()


def prj_22_rows(orders):
    return orders.select(F.col("o_orderkey").alias("id"), feeds.cache_key(F.struct(F.col("o_orderkey").alias("a"), F.lit("x").alias("b"))).alias("k"))


@query("select o_orderkey id, substr(sha256('{\"a\":'||cast(o_orderkey as varchar)||',\"b\":\"x\"}'),1,16) k from orders")
def prj_22_cache_keys(x):
    return prj_22_rows(x.table("orders"))


@query("""select p_partkey id, case when p_size%6 in (1,2) then p_size end n, case p_size%6 when 0 then p_size+0.5 when 1 then p_size when 2 then p_size when 3 then -p_size end f, case p_size%6 when 4 then timestamp '2024-02-29 10:00:00' end t from part""")
def prj_25_tolerant_casts(x):
    """Texts that are whole numbers, numbers, times, or none of these."""
    s, k = F.col("p_size").cast("string"), F.col("p_size") % 6
    said = F.when(k == 0, F.concat(F.lit(" "), s, F.lit(".5 "))).when(k == 1, s).when(k == 2, F.concat(F.lit("  "), s)).when(k == 3, F.concat(F.lit("-"), s)).when(k == 4, F.lit(" 2024-02-29T10:00:00Z ")).otherwise("2024-02-30")
    rows = x.table("part").select(F.col("p_partkey").alias("id"), said.alias("said"))
    return rows.select("id", feeds.positive_int(F.col("said")).alias("n"), feeds.number(F.col("said")).alias("f"), feeds.moment(F.col("said")).cast("timestamp_ntz").alias("t"))


_ALONG = "greatest(0.0, least(1.0, (px*dx+py*dy)/(dx*dx+dy*dy)))"


@query(
    f"""select id, {r(f"min(sqrt(pow(px-{_ALONG}*dx,2)+pow(py-{_ALONG}*dy,2)))", 3)} distance_m from (select id, (b2-b1)*k dx, (a2-a1)*111320.0 dy, (lon-b1)*k px, (lat-a1)*111320.0 py from (
 select v.id, v.lat, v.lon, c.lat+0.003*s a1, case s when 0 then lon1 else lon2 end b1, c.lat+0.003-0.001*s a2, case s when 0 then lon2 else lon1 end b2 from way_vertices v join orders on o_orderkey=v.id join centerlines c on c.id=o_custkey, (select unnest([0,1]) s) where v.i=0), lateral (select cos(radians((a1+a2)/2))*111320.0 k) z) group by 1""",
    "way_vertices", "centerlines",
)
def prj_12_13_line_distance(x):
    """From a way's first vertex to a bent line of two slanted segments."""
    c = x["centerlines"]
    line = F.array(geo.point(F.col("lat"), F.col("lon1")), geo.point(F.col("lat") + 0.003, F.col("lon2")), geo.point(F.col("lat") + 0.002, F.col("lon1")))
    own = x.ways.where("size(geometry) > 0").join(x.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cid")), "id").join(c.select(F.col("id").alias("cid"), line.alias("line")), "cid")
    return own.select("id", geo.rounded(geo.line_distance(geo.first(F.col("geometry")), F.col("line")), 3).alias("distance_m"))


@query("select n_nationkey id, [3,1,0,2][n_nationkey%4+1] n, [38.5,0.00001,null,38.5][n_nationkey%4+1] lat, [-120.2,-0.00001,null,-120.2][n_nationkey%4+1] lon from nation")
def prj_21_polylines(x):
    said = F.array(*map(F.lit, ("_p~iF~ps|U_ulLnnqC_mqNvxq`@", "A@", "", "_p~iF~ps|U_ulLnnqC")))
    line = decode_polyline(5)(F.get(said, (F.col("n_nationkey") % 4).cast("int")))
    p = geo.first(F.col("line"))
    return x.table("nation").select(F.col("n_nationkey").alias("id"), line.alias("line")).select("id", F.size("line").alias("n"), p["lat"].alias("lat"), p["lon"].alias("lon"))


@query("select n_nationkey id, 'alert '||cast(n_nationkey as varchar) said from nation union all select n_nationkey, 'more' from nation where n_nationkey%2=0")
def prj_29_alerts(x):
    k = F.col("n_nationkey")
    raw = x.table("nation").select(k.alias("id"), F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("alert "), k.cast("string")).alias("title"))).alias("alerts"), F.when(k % 2 == 0, F.array(F.struct(F.array(F.struct(F.lit("more").alias("title"))).alias("alerts")))).alias("routes"))).alias("value"))
    return payloads.alerts(raw).select("id", F.col("title").alias("said"))


@query("select s3 tag, count(*) n from (select unnest(case event_id%4 when 0 then ['surface','lanes','tiger:cfcc'] when 1 then ['lit'] else [] end) s3 from events) where s3 in ('surface','lanes','lit') group by 1")
def set_3_7_tag_sets(x):
    k = F.col("event_id") % 4
    now = F.when(k == 0, F.array(*map(F.lit, ("surface", "lanes", "tiger:cfcc", "name")))).when(k == 1, F.array(*map(F.lit, ("lit", "name")))).otherwise(F.array(F.lit("name")))
    added = F.array_intersect(F.array_except(now, F.array(F.lit("name"))), F.array(*map(F.lit, history.REVIEW_TAGS)))
    return x.table("events").select(F.explode(added).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


from . import files, landing, whole  # noqa: E402, F401  their queries register themselves

"""SQL for DuckDB of the road queries, written from their meaning over the same derived tables."""

from __future__ import annotations

from ..functions.text import ABBREVIATIONS
from ..sources.fixtures import with_tables


def hav(a: str, b: str, c: str, d: str) -> str:
    return f"2*6371000.0*asin(least(1.0, sqrt(pow(sin(radians(({c})-({a}))/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians(({d})-({b}))/2),2))))"


def r(x: str, k: int) -> str:
    return f"floor(({x})*{10**k}+0.5)/{float(10**k)}"


TRUTHY = "coalesce(lower(trim(oneway)) in ('yes','true','1','-1'), false)"
LABEL = """case when coalesce(name,'')<>'' then name when highway='service' and coalesce(service,'')<>'' then upper(substr(replace(service,'_',' '),1,1))||lower(substr(replace(service,'_',' '),2))
 when highway='service' then 'Service road' when highway in ('residential','unclassified','tertiary','secondary','primary') then 'Unnamed '||highway||' street' when coalesce(highway,'')<>'' then 'Unnamed '||highway else 'Unnamed way' end"""
IS_A = f"""(highway in ('residential','unclassified','tertiary','service') and {TRUTHY}
 and not (highway='service' and coalesce(service in ('parking_aisle','driveway','alley','emergency_access','drive-through','drive_through'),false))
 and not (highway='service' and name_key is null and coalesce(service,'')=''))"""

#: Common tables over the fixtures, by name.
CTE = {
    "named": f"select *, nullif(lower(trim(name)),'') name_key, {LABEL} name_display from ways_attr",
    "cls": f"""select n.*, coalesce(k,0) segments, case when {IS_A} and coalesce(k,0)>=2 then 'AB' when {IS_A} then 'A' when coalesce(k,0)>=2 then 'B' else 'C' end defect_class
 from named n left join (select name_key nk, count(*) k from named where name_key is not null group by 1) on nk=name_key""",
    "ends": "select id, count(*) n, arg_min(lat,i) lat0, arg_min(lon,i) lon0, arg_max(lat,i) lat1, arg_max(lon,i) lon1 from way_vertices group by id",
    "mid": "select v.id, v.lat, v.lon from way_vertices v join ends e on e.id=v.id and v.i=e.n//2",
    "cand": "select c.name_key, c.name_display, c.id, e.lat0, e.lon0, e.lat1, e.lon1 from cls c join ends e on e.id=c.id where segments>=2 and e.n>=2",
    "gap4": "select a.name_key, a.name_display street, a.id way1_id, b.id way2_id, "
    + ", ".join(f"{hav(f'a.lat{i}', f'a.lon{i}', f'b.lat{j}', f'b.lon{j}')} d{i}{j}" for i in (0, 1) for j in (0, 1))
    + ", a.lat0 a0, a.lon0 o0, a.lat1 a1, a.lon1 o1, b.lat0 b0, b.lon0 p0, b.lat1 b1, b.lon1 p1 from cand a join cand b on a.name_key=b.name_key and a.id<b.id",
    "gaps": """select name_key, street, way1_id, way2_id, least(d00,d01,d10,d11) distance_m,
 (case when least(d00,d01)<=least(d10,d11) then a0 else a1 end + case when least(d00,d01)<=least(d10,d11) then case when d00<=d01 then b0 else b1 end else case when d10<=d11 then b0 else b1 end end)/2 lat
 from gap4 where least(d00,d01,d10,d11)>0.01 and least(d00,d01,d10,d11)<=30""",
    "found": """select 'oneway_minus_one' kind, id, 'HIGH' severity, 4 routing_impact from ways_attr where highway in ('residential','unclassified','tertiary','service') and trim(oneway)='-1'
 union all select 'access_blocked', id, 'HIGH', 4 from ways_attr where highway='residential' and access in ('no','private') and coalesce(motor_vehicle,'')<>'destination'
 union all select 'arterial_named_residential', id, 'MEDIUM', 3 from ways_attr where highway='residential' and regexp_matches(name,'(?i)\\b(Boulevard|Parkway|Expressway|Pike|Highway|Crossing|Memorial)\\s*$')
 union all select 'missing_maxspeed', id, 'LOW', 2 from ways_attr where highway in ('tertiary','unclassified') and coalesce(maxspeed,'')=''""",
    "roadv": "select v.lat, v.lon from way_vertices v join ways_attr w on w.id=v.id where highway in ('motorway','trunk','primary','secondary','tertiary','unclassified','residential','service') and coalesce(service,'')<>'parking_aisle'",
    "stopd": f"select s.id, s.lat, s.lon, min({hav('s.lat', 's.lon', 'v.lat', 'v.lon')}) d from bus_stops s, roadv v group by all",
    # a centerline is one level segment here
    "seg": f"""select w.id, w.name, c.id source_id, c.label, c.trvl_dir, c.speed,
 max(case when v.lon between c.lon1 and c.lon2 then abs(v.lat-c.lat)*111320.0 else sqrt(pow((v.lat-c.lat)*111320.0,2)+pow((v.lon-case when v.lon<c.lon1 then c.lon1 else c.lon2 end)*111320.0*cos(radians(c.lat)),2)) end) h,
 min(v.lat) south, max(v.lat) north, min(v.lon) west, max(v.lon) east, any_value(c.lat) clat, any_value(c.lon1) c1, any_value(c.lon2) c2
 from ways_attr w join way_vertices v on v.id=w.id join centerlines c on abs(c.lat-v.lat)<0.01 and v.lon between c.lon1-0.03 and c.lon2+0.03 group by all""",
    "scored": """select p.*, {dir} dir, case when lower(trim(name))=lower(trim(label)) or {x1}={x2} then 1.0 else 0.0 end sim, h<=30 passes
 from seg p join ends e on e.id=p.id where e.n>=2 and south-30/111000.0<=clat and north+30/111000.0>=clat and west-30/111000.0<=c2 and east+30/111000.0>=c1""",
    "best": """select * from (select *, 0.5*sim+0.3*(1-h/30)+0.2*dir conf, row_number() over (partition by id order by 0.5*sim+0.3*(1-h/30)+0.2*dir desc, source_id) k from scored where passes) where k=1""",
    # names that are runs of k and of other letters: their ratio is twice the shorter run of k over both lengths
    "kscored": """select s.id, s.source_id, s.h, s.dir, s.passes, s.trvl_dir, s.speed, case when s.id%11=0 then 0.0 else 2.0*least(o_custkey%9, s.source_id%9)+10 end/(10+o_custkey%9+s.id%4+s.source_id%9+s.source_id%3) sim,
 case when s.id%11<>0 then repeat('k', cast(o_custkey%9+5 as int))||repeat('x', cast(s.id%4 as int)) end nm, repeat('K', cast(s.source_id%9+5 as int))||repeat('Y', cast(s.source_id%3 as int)) label from scored s join orders on o_orderkey=s.id""",
    "kbest": """select * from (select *, 0.5*sim+0.3*(1-h/30)+0.2*dir conf, row_number() over (partition by id order by 0.5*sim+0.3*(1-h/30)+0.2*dir desc, source_id) k from kscored where passes) where k=1""",
    "probe": """select distinct id, source_id from (select v.id, v.i, c.id source_id, row_number() over (partition by v.id, v.i order by sqrt(pow(greatest(c.lon1-v.lon, v.lon-c.lon2, 0.0),2)+pow(v.lat-c.lat,2)), c.id) k
 from way_vertices v join ends e on e.id=v.id join centerlines c on true where e.n>=2 and v.i in (0, e.n//2, e.n-1) and v.id not in (select id from kbest)) where k=1""",
    "probed": """select p.id, p.source_id, max({d}) h, min({d}) nd from probe p join centerlines c on c.id=p.source_id join way_vertices v on v.id=p.id group by all""",
    "kwide": """select * from (select x.*, row_number() over (partition by id order by conf desc, source_id) k from (select p.id, p.source_id, p.h, least(0.6, 0.5*case when p.id%11=0 then 0.0 else 2.0*(least(o_custkey%9, p.source_id%9)+5)/(10+o_custkey%9+p.id%4+p.source_id%9+p.source_id%3) end+0.3*(1-p.h/100)+0.2*{dir}) conf
 from probed p join ends e on e.id=p.id join orders on o_orderkey=p.id where p.h<=100) x) where k=1""",
    "diag": """select w.id, case when coalesce(e.n,0)<2 then 'F1_NO_CANDIDATE' when s.id is null then case when f.id is not null then 'MATCHED_FALLBACK_REVIEW' else 'F1_NO_CANDIDATE' end when b.id is null then 'F3_GEOMETRY_FAIL'
  when b.conf>=0.85 then 'MATCHED_HIGH' when b.conf>=0.6 then 'MATCHED_REVIEW' when len<50 and b.dir<0.5 and (0.5*b.sim+0.3*(1-b.h/30))/0.8>=0.6 then 'F4_DIRECTION_DRAG' when b.sim<0.5 and 1-b.h/30>=0.5 and b.dir>=0.5 then 'F2_NAME_FAIL' else 'MIXED_LOW' end bucket,
  coalesce(s.n,0) candidates, case when b.id is null then s.h else b.h end h, coalesce(b.conf, f.conf) conf, case when s.id is null then nd end nd, len
 from ways_attr w left join ends e on e.id=w.id left join (select id, count(*) n, min(h) h from kscored group by 1) s on s.id=w.id left join kbest b on b.id=w.id
 left join (select id, conf from kwide where id not in (select id from kscored)) f on f.id=w.id left join (select id, min(nd) nd from probed group by 1) d on d.id=w.id
 left join (select a.id, sum({hav}) len from way_vertices a join way_vertices b on b.id=a.id and b.i=a.i+1 group by 1) l on l.id=w.id""",
    "ver": "select *, lag(surface) over w ps, lag(oneway) over w po, lag(name) over w pn, lag(tiger_reviewed) over w pt, lag(moved) over w pm, lag(version) over w pv from way_versions window w as (partition by way_id order by version)",
    "edit": """select way_id, version, usr, usr not like 'mapper%' bot, case when pv is null or usr not like 'mapper%' then null
 when surface is not null and ps is null then by_||'added review-indicating tags: surface'
 when oneway<>po then by_||'changed ''oneway'': '||po||' → '||oneway when name<>pn then by_||'changed ''name'': '||pn||' → '||name
 when moved<>pm then by_||'modified way geometry (+1/-1 nodes)' end reason from (select *, 'Version '||version||' by '''||usr||''' ' by_ from ver)""",
    "routed": """select *, case when live_m is not null and perturbed_m is not null then abs(perturbed_m-live_m)/greatest(live_m,1)*100 end pct, kind in ('barrier_unqualified','broken_turn_restriction') node from routes""",
    "decided": """select id, kind, case when pct is not null then pct when live_m is null and (perturbed_m is null or node) then 0.0 else 100.0 end delta_pct,
 case when live_m is null and (perturbed_m is null or node) then 'inconclusive' when pct is null then 'real' when pct>15 then 'real' when pct<3 then 'noisy' else 'inconclusive' end decision,
 case when live_m is null and (perturbed_m is null or node) then 0.2 when pct is null then 0.9 else 0.4+least(pct,30)/30*0.45 end confidence from routed""",
}
def expanded(x: str) -> str:
    out = f"' '||{x}||' '"
    for a, b in ABBREVIATIONS * 2:
        out = f"replace({out},' {a} ',' {b} ')"
    return f"trim({out})"


CTE["scored"] = CTE["scored"].format(
    dir="abs((e.lon1-e.lon0)/nullif(sqrt(pow(e.lon1-e.lon0,2)+pow(e.lat1-e.lat0,2)),0))", x1=expanded("lower(trim(name))"), x2=expanded("lower(trim(label))")
)
_FROM_LINE = "case when v.lon between c.lon1 and c.lon2 then abs(v.lat-c.lat)*111320.0 else sqrt(pow((v.lat-c.lat)*111320.0,2)+pow((v.lon-case when v.lon<c.lon1 then c.lon1 else c.lon2 end)*111320.0*cos(radians(c.lat)),2)) end"
CTE["probed"] = CTE["probed"].format(d=_FROM_LINE)
CTE["kwide"] = CTE["kwide"].format(dir="abs((e.lon1-e.lon0)/nullif(sqrt(pow(e.lon1-e.lon0,2)+pow(e.lat1-e.lat0,2)),0))")
CTE["diag"] = CTE["diag"].format(hav=hav("a.lat", "a.lon", "b.lat", "b.lon"))
_OVER = {
    "kscored": ["scored"], "kbest": ["kscored"], "probe": ["kbest", "ends", "centerlines", "way_vertices"], "probed": ["probe"], "kwide": ["probed"], "diag": ["kwide", "kbest"],
    "named": ["ways_attr"], "cls": ["ways_attr", "named"], "ends": ["way_vertices"], "mid": ["way_vertices", "ends"], "cand": ["cls", "ends"], "gap4": ["cand"], "gaps": ["gap4"], "found": ["ways_attr"],
    "roadv": ["way_vertices", "ways_attr"], "stopd": ["bus_stops", "roadv"], "seg": ["ways_attr", "way_vertices", "centerlines"], "scored": ["seg", "ends"], "best": ["scored"], "ver": ["way_versions"], "edit": ["ver"], "routed": ["routes"], "decided": ["routed"],
}


def sql(body: str, *over: str) -> str:
    """``body`` with what it is defined over: names of ``CTE`` or of the fixtures."""
    fixtures, own = {}, {}

    def need(name: str) -> None:
        if name in CTE:
            for x in _OVER[name]:
                need(x)
            own[name] = None
        else:
            fixtures[name] = None

    for name in over:
        need(name)
    head = with_tables(*fixtures) + "".join(f",\n{n} as ({CTE[n]})" for n in own)
    return f"{head}\n{body}"

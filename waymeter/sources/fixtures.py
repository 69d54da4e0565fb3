"""Road tables derived from the test tables, in SQL that Spark and DuckDB read alike.

``SQL`` has each table's definition over the others and the test tables; :class:`Roads` gives them as DataFrames.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import written

_BASE = "cast(39.16 as double) + cast(({0}*37)%800 as double)/10000", "cast(-84.44 as double) + cast(({0}*53)%1100 as double)/10000"


def _lat(key: str, more: str = "") -> str:
    return _BASE[0].format(key) + more


def _lon(key: str, more: str = "") -> str:
    return _BASE[1].format(key) + more


SQL = {
    "ways_attr": """select o_orderkey id,
 case when o_orderkey%11=0 then null else p_name||' '||cast(o_custkey as varchar(20))||' '||
  case o_custkey%8 when 0 then 'Street' when 1 then 'Avenue' when 2 then 'Boulevard' when 3 then 'Pike'
                   when 4 then 'Drive' when 5 then 'Lane' when 6 then 'Road' else 'Parkway' end end name,
 case o_orderpriority when '1-URGENT' then 'residential' when '2-HIGH' then 'tertiary' when '3-MEDIUM' then 'unclassified'
  when '4-NOT SPECIFIED' then 'service' else case when o_orderkey%2=0 then 'residential' else 'primary' end end highway,
 case when o_orderpriority='4-NOT SPECIFIED' then case o_custkey%4 when 0 then 'parking_aisle' when 1 then 'driveway' when 3 then 'alley' end end service,
 case o_orderkey%7 when 0 then 'yes' when 1 then 'yes' when 2 then 'true' when 3 then '-1' when 4 then 'no' end oneway,
 case when o_orderkey%3=0 then '25 mph' end maxspeed,
 case when o_orderkey%13=0 then 'private' when o_orderkey%17=0 then 'no' end access,
 case when o_orderkey%26=0 then 'destination' end motor_vehicle,
 cast(1+o_orderkey%4 as int) version, case o_orderkey%5 when 0 then 'DaveHansenTiger' when 1 then 'bot-mode' when 2 then 'mapper' when 3 then 'import_x' end usr
from orders join part on p_partkey = o_custkey%200""",
    "way_vertices": """select id, cast(case when o_orderkey%5=0 then n-1-i0 else i0 end as int) i,
 cast(39.16 as double) + cast((o_custkey*37)%800 as double)/10000 + cast(o_orderkey%3 as double)/10000 + cast(l_suppkey%3 as double)/100000 lat,
 cast(-84.44 as double) + cast((o_custkey*53)%1100 as double)/10000 + cast(o_orderkey%4 as double)*cast(0.0012 as double) + cast(i0 as double)*cast(0.0003 as double) lon
from (select l_orderkey id, l_suppkey,
   row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_extendedprice)-1 i0,
   count(*) over (partition by l_orderkey) n from lineitem) v join orders on o_orderkey=id""",
    "centerlines": f"""select c_custkey id,
 case when c_custkey%9=0 then 'HARBOR VIEW '||cast(c_custkey as varchar(20))||' CT' else upper(p_name)||' '||cast(c_custkey as varchar(20))||' '||
  case c_custkey%8 when 0 then 'ST' when 1 then 'AV' when 2 then 'BLVD' when 3 then 'PIKE' when 4 then 'DR' when 5 then 'LN' when 6 then 'RD' else 'PKWY' end end label,
 cast(c_custkey%3-1 as int) trvl_dir, cast(1+c_nationkey%7 as int) class, cast(case when c_custkey%4<>0 then 25+5*(c_nationkey%4) end as int) speed,
 {_lat("c_custkey", " + cast(c_custkey%10 as double)*cast(0.00004 as double) + cast(0.000003 as double)")} lat,
 {_lon("c_custkey", " - cast(0.001 as double)")} lon1, {_lon("c_custkey", " + cast(0.009 as double)")} lon2
from customer join part on p_partkey = c_custkey%200 where c_custkey%12<>0""",
    "bus_stops": f"select s_suppkey id, {_lat('s_suppkey', ' + cast(s_suppkey%5 as double)*cast(0.00013 as double) + cast(0.00004 as double)')} lat, {_lon('s_suppkey', ' + cast(0.0001 as double)')} lon from supplier",
    "gtfs_stops": "select id stop_id, lat + cast(id%4 as double)*cast(0.0002 as double) lat, lon from bus_stops where id%2=0",
    "route_vertices": f"select c_nationkey route_id, c_custkey seq, {_lat('c_custkey', ' + cast(0.0001 as double)')} lat, {_lon('c_custkey', ' + cast(0.0002 as double)')} lon from customer where c_custkey%4=1",
    "notes": f"select p_partkey id, case p_size%3 when 0 then 'open' when 1 then 'closed' else 'open' end status, cast(date '2015-01-01' + cast(floor(p_retailprice) as int) as varchar(20)) date_created, {_lat('p_partkey', ' + cast(p_size%4 as double)*cast(0.0001 as double)')} lat, {_lon('p_partkey')} lon from part",
    "barrier_nodes": f"select p_partkey id, case p_size%7 when 0 then 'gate' when 1 then 'bollard' when 2 then 'lift_gate' when 3 then 'swing_gate' when 4 then 'cycle_barrier' when 5 then 'kerb' else 'wall' end barrier, case when p_partkey%3=0 then 'yes' end access, case when p_partkey%10=0 then 'no' end foot, {_lat('p_partkey')} lat, {_lon('p_partkey')} lon from part",
    "restrictions": "select event_id id, event_id%2=0 has_from, event_id%3<>0 has_via, event_id%5<>0 has_to, case event_type when 'error' then '' when 'view' then null else 'no_left_turn' end restriction, case when event_id%11=0 then 'no_u_turn' end restriction_hgv, event_id%19=0 ref_null from events",
    "way_versions": """select user_id way_id, cast(row_number() over (partition by user_id order by ts, event_id) as int) version,
 case event_type when 'error' then 'bot-mode' when 'signup' then 'DaveHansenTiger' when 'view' then 'woodpeck_fixbot' else 'mapper_'||cast(event_id%17 as varchar(20)) end usr,
 case when event_id%8=1 then 'asphalt' end surface, case when event_id%8=2 then 'yes' else 'no' end oneway, case when event_id%8=3 then 'B' else 'A' end name,
 case when event_id%8=0 then 'no' else 'yes' end tiger_reviewed, cast(event_id%8=4 as int) moved from events""",
    "qa_issues": "select 'u'||cast(o_orderkey%1000 as varchar(20)) uuid, o_orderkey item, array_agg(o_orderkey) ways from orders where o_orderkey%37=0 group by o_orderkey",
    "routes": "select o_orderkey id, case o_orderkey%4 when 0 then 'oneway_minus_one' when 1 then 'oneway_conflict' when 2 then 'barrier_unqualified' else 'broken_turn_restriction' end kind, case when o_orderkey%5<>0 then floor(o_totalprice/100) end live_m, case when o_orderkey%9<>0 then floor(o_totalprice/100) * (1 + cast(o_orderkey%40 as double)/100) end perturbed_m from orders",
    "route_calls": "select event_id, user_id, epoch_of(ts) t from events",
}


def definition(name: str, known: tuple[str, ...] = tuple(SQL)) -> list[str]:
    """``name`` and the tables of ``SQL`` that it is defined over, the latter first."""
    below = [x for x in known if x != name and re.search(rf"\b(?:from|join) {x}\b", SQL[name])]
    return [*dict.fromkeys(y for x in below for y in definition(x)), name]


def with_tables(*names: str) -> str:
    """A WITH clause that defines ``names``, for other engines."""
    order = dict.fromkeys(x for name in names for x in definition(name))
    return "with " + ",\n".join(f"{x} as ({SQL[x]})" for x in order)


class Roads:
    """The road tables as DataFrames over the test tables in a folder; each is planned when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            tables = dict.fromkeys(re.findall(r"\b(?:from|join) ([a-z_]+)\b", SQL[name]))
            frames = {t: self[t] if t in SQL else self.table(t) for t in tables}
            if " join part on p_partkey = " in SQL[name]:
                # joined with a remainder of 200: other keys meet nothing, and the whole table is much to broadcast
                frames["part"] = F.broadcast(frames["part"].where("p_partkey between -199 and 199"))
            sql = re.sub(r"\b(from|join) ([a-z_]+)\b", lambda m: f"{m[1]} {{{m[2]}}}", SQL[name])
            self._made[name] = self.spark.sql(sql, **frames)
        return self._made[name]

    def kept(self) -> Roads:
        """These tables with ``ways`` written, for plans that read them several times; their attributes are read from there too."""
        out = Roads(self.spark, self.sf_dir)
        out.ways = written(self.ways, "ways")
        out._made = self._made | {"ways_attr": out.ways.drop("geometry")}
        return out

    @cached_property
    def lines(self) -> DataFrame:
        """(id, geometry): vertices in order."""
        v = self["way_vertices"]
        return v.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("geometry"))

    @cached_property
    def ways(self) -> DataFrame:
        """Ways with their geometry; empty where there is none."""
        empty = F.array().cast("array<struct<lat:double,lon:double>>")
        return self["ways_attr"].join(self.lines, "id", "left").withColumn("geometry", F.coalesce("geometry", empty))

    @cached_property
    def centerline_shapes(self) -> DataFrame:
        c = self["centerlines"]
        ends = F.array(*(F.struct(F.col("lat").alias("lat"), F.col(x).alias("lon")) for x in ("lon1", "lon2")))
        return c.withColumn("geometry", ends).drop("lat", "lon1", "lon2")

    @cached_property
    def known_ways(self) -> DataFrame:
        """``ways`` with names whose similarity to those of :attr:`known_centerlines` is known: a run of k, then one of x; of two such the ratio is twice the shorter run of k over both lengths."""
        key = self.table("orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 9 + 5).cast("int").alias("_k"))
        name = F.when(F.col("id") % 11 != 0, F.concat(F.repeat(F.lit("k"), F.col("_k")), F.repeat(F.lit("x"), (F.col("id") % 4).cast("int"))))
        return self.ways.join(key.hint("merge"), "id").withColumn("name", name).drop("_k")

    @cached_property
    def known_centerlines(self) -> DataFrame:
        label = F.concat(F.repeat(F.lit("K"), (F.col("id") % 9 + 5).cast("int")), F.repeat(F.lit("Y"), (F.col("id") % 3).cast("int")))
        return self.centerline_shapes.withColumn("label", label)

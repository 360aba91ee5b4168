"""The plans and column functions as queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import geo, measures, rules, text
from fieldloom.operators import banded, graph, keyed, spatial
from fieldloom.plans import ask, network, schools, sites, summary, transport
from fieldloom.plans.bridge import ctes, view
from fieldloom.runtime import table
from fieldloom.sources import landed
from fieldloom.streaming import incremental

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- transit ----------------------------------------------------------------

_TRIPS = "trips AS (SELECT o_orderkey AS trip_id, o_custkey AS service_id, 1 + o_orderkey % 10 AS route_id, o_orderkey % 40 AS shape_id FROM orders)"
_ROUTES = "routes AS (SELECT s_suppkey AS route_id, s_name AS route_short_name, CASE s_suppkey % 3 WHEN 0 THEN '2' ELSE '3' END AS route_type, CASE WHEN s_suppkey % 2 = 0 THEN 'North ' || (s_suppkey % 4) || ' - South' ELSE 'South - North ' || (s_suppkey % 4) END AS route_long_name FROM supplier)"
_RUNNING = "live AS (SELECT c_custkey AS service_id FROM customer WHERE c_mktsegment <> 'MACHINERY')"


def _transit(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trips, routes, running services)."""
    o, s = table(spark, sf, "orders"), table(spark, sf, "supplier")
    trips = o.select(F.col("o_orderkey").alias("trip_id"), F.col("o_custkey").alias("service_id"), (1 + F.col("o_orderkey") % 10).alias("route_id"), (F.col("o_orderkey") % 40).alias("shape_id"))
    side = F.concat(F.lit("North "), (F.col("s_suppkey") % 4).cast("string"))
    name = F.when(F.col("s_suppkey") % 2 == 0, F.concat(side, F.lit(" - South"))).otherwise(F.concat(F.lit("South - "), side))
    routes = s.select(F.col("s_suppkey").alias("route_id"), F.col("s_name").alias("route_short_name"), F.when(F.col("s_suppkey") % 3 == 0, "2").otherwise("3").alias("route_type"), name.alias("route_long_name"))
    return trips, routes, table(spark, sf, "customer").where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("service_id"))


@query(ctes("b_stop", "b_stop_time") + f", {_TRIPS}, {_ROUTES}, {_RUNNING}," + """ st AS (SELECT t.stop_id, t.departure_time, r.route_type AS kind, r.route_short_name AS short FROM b_stop_time t JOIN trips USING (trip_id) JOIN routes r ON r.route_id = trips.route_id
  WHERE trips.service_id IN (SELECT service_id FROM live) AND t.stop_id IN (SELECT stop_id FROM b_stop))
SELECT stop_id, round(sum(CASE WHEN departure_time >= '07:00:00' AND departure_time < '10:00:00' THEN 1 ELSE 0 END) / 3.0, 6) AS peak_per_hr, round(sum(CASE WHEN departure_time >= '07:00:00' AND departure_time < '10:00:00' AND kind = '3' THEN 1 ELSE 0 END) / 3.0, 6) AS peak_buses_per_hr,
  CAST(sum(CASE WHEN kind = '3' THEN 1 ELSE 0 END) AS BIGINT) AS bus_any, CAST(sum(CASE WHEN kind <> '3' THEN 1 ELSE 0 END) AS BIGINT) AS rail_any, string_agg(DISTINCT short, ',' ORDER BY short) AS routes FROM st GROUP BY stop_id""")
def stop_departures(spark: SparkSession, sf: str) -> DataFrame:
    """Stops with their departures by running services."""
    trips, routes, live = _transit(spark, sf)
    out = transport.stop_table(view(spark, sf, "b_stop"), view(spark, sf, "b_stop_time").select("trip_id", "stop_id", "departure_time"), trips, routes, live)
    return out.select("stop_id", F.round("peak_per_hr", 6).alias("peak_per_hr"), F.round("peak_buses_per_hr", 6).alias("peak_buses_per_hr"), "bus_any", "rail_any", F.array_join("routes", ",").alias("routes"))


@query(ctes("b_service") + """, cal AS (SELECT c_custkey AS service_id FROM customer WHERE c_nationkey % 2 = 1 AND c_acctbal <= 5000)
SELECT service_id FROM (SELECT service_id FROM cal UNION SELECT service_id FROM b_service WHERE exception_type = 1 AND day = DATE '1996-01-02') EXCEPT SELECT service_id FROM b_service WHERE exception_type = 2 AND day = DATE '1996-01-02'""")
def services_running(spark: SparkSession, sf: str) -> DataFrame:
    """Services of a calendar on a day, with those added and without those removed."""
    c = table(spark, sf, "customer")
    cal = c.select(F.col("c_custkey").alias("service_id"), (F.col("c_nationkey") % 2).cast("string").alias("tuesday"), F.lit("19950101").alias("start_date"), F.when(F.col("c_acctbal") <= 5000, "19961231").otherwise("19951231").alias("end_date"))
    dates = view(spark, sf, "b_service").select("service_id", F.date_format("day", "yyyyMMdd").alias("date"), F.col("exception_type").cast("string").alias("exception_type"))
    return transport.services_on(cal, dates, "19960102")


@query(f"WITH {_TRIPS}, {_ROUTES}," + """ n AS (SELECT route_id, shape_id, count(*) AS n FROM trips GROUP BY 1, 2), top AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY n DESC, shape_id DESC) AS k FROM n),
one AS (SELECT t.route_id, t.shape_id, t.n, route_type, route_long_name, row_number() OVER (PARTITION BY route_type, list_sort(string_split(route_long_name, ' - ')) ORDER BY t.n, t.route_id) AS d FROM top t JOIN routes r ON r.route_id = t.route_id WHERE k = 1)
SELECT o.route_id, o.route_type, o.route_long_name, count(*) AS points, min(p_partkey) AS first, max(p_partkey) AS last FROM one o JOIN part ON p_partkey % 40 = o.shape_id WHERE d = 1 GROUP BY ALL""")
def one_line_each(spark: SparkSession, sf: str) -> DataFrame:
    """For each pair of ends one line, of the commonest shape."""
    trips, routes, _ = _transit(spark, sf)
    shapes = table(spark, sf, "part").select((F.col("p_partkey") % 40).alias("shape_id"), F.col("p_partkey").alias("seq"), F.col("p_partkey").cast("double").alias("x"), F.lit(0.0).alias("y"))
    at = lambda i: F.element_at("line", i).x.cast("long")
    return transport.rail_lines(shapes, trips, routes).select("route_id", "route_type", "route_long_name", F.size("line").cast("long").alias("points"), at(1).alias("first"), at(-1).alias("last"))


@query(ctes("b_dev", "b_stop") + """, s AS (SELECT stop_id, x, y, CAST(stop_id % 13 AS DOUBLE) AS f, stop_id % 5 AS r FROM b_stop),
m AS (SELECT dev_id, min(sqrt((d.x-s.x)*(d.x-s.x)+(d.y-s.y)*(d.y-s.y))) AS a, min(CASE WHEN f >= 6 THEN sqrt((d.x-s.x)*(d.x-s.x)+(d.y-s.y)*(d.y-s.y)) END) AS b, min(CASE WHEN r > 0 THEN sqrt((d.x-s.x)*(d.x-s.x)+(d.y-s.y)*(d.y-s.y)) END) AS c FROM b_dev d, s GROUP BY dev_id)
SELECT dev_id AS app_id, round(a, 5) AS any_m, round(b, 5) AS frequent_m, round(c, 5) AS rail_m, CASE WHEN b <= 400 THEN 'served' WHEN a <= 400 THEN 'weak' ELSE 'unserved' END AS access FROM m""")
def stop_access(spark: SparkSession, sf: str) -> DataFrame:
    """Distances to the nearest stop, frequent stop and station, and the class of access."""
    s = view(spark, sf, "b_stop").select("stop_id", "x", "y", (F.col("stop_id") % 13).cast("double").alias("peak_per_hr"), (F.col("stop_id") % 5).alias("rail_any"))
    out = transport.access(view(spark, sf, "b_dev").withColumnRenamed("dev_id", "app_id"), s)
    r = lambda c: F.round(c, 5).alias(c)
    return out.select("app_id", r("any_m"), r("frequent_m"), r("rail_m"), "access")


@query(ctes("b_dev", "b_stop") + """, k AS (SELECT dev_id, stop_id, row_number() OVER (PARTITION BY dev_id ORDER BY (d.x-s.x)*(d.x-s.x)+(d.y-s.y)*(d.y-s.y), stop_id) AS k FROM b_dev d, b_stop s)
SELECT s.stop_id, coalesce(string_agg(CAST(dev_id AS VARCHAR), ',' ORDER BY dev_id), '') AS apps, count(dev_id) > 0 AS used FROM b_stop s LEFT JOIN k ON k.stop_id = s.stop_id AND k.k = 1 GROUP BY s.stop_id""")
def stops_used(spark: SparkSession, sf: str) -> DataFrame:
    """Which developments have each stop as their nearest."""
    stops = view(spark, sf, "b_stop")
    near = spatial.nearest(view(spark, sf, "b_dev"), stops, "dev_id", "stop_id").withColumn("app_id", F.col("dev_id"))
    apps = near.where("stop_id IS NOT NULL").groupBy("stop_id").agg(F.array_sort(F.collect_set("app_id")).alias("a"))
    used = summary.apps_of_stops(stops, near.withColumn("app_id", F.col("app_id").cast("string"))).select("stop_id", "used")
    return used.join(apps, "stop_id", "left").select("stop_id", "used", F.coalesce(F.array_join(F.transform("a", lambda x: x.cast("string")), ","), F.lit("")).alias("apps"))


# ---- schools ----------------------------------------------------------------


@query(ctes("b_dev", "b_school") + """, lev AS (SELECT * FROM (VALUES ('primary', 2000.0, 0.3), ('post-primary', 3000.0, 0.2)) v(level, reach, rate)),
hit AS (SELECT dev_id, s.level, enrolment FROM b_dev d JOIN b_school s ON true JOIN lev l ON l.level = s.level WHERE (d.x-s.x)*(d.x-s.x)+(d.y-s.y)*(d.y-s.y) <= reach * reach),
r AS (SELECT d.dev_id, l.level, num_units * rate / nullif(coalesce((SELECT sum(enrolment) FROM hit h WHERE h.dev_id = d.dev_id AND h.level = l.level), 0), 0) AS ratio FROM b_dev d, lev l)
SELECT dev_id AS app_id, round(CASE WHEN count(*) = count(ratio) THEN max(ratio) END, 6) AS pressure_ratio, coalesce(CASE WHEN count(*) = count(ratio) THEN max(ratio) END >= 0.1, true) AS pressure_flag FROM r GROUP BY dev_id""")
def pressure_by_development(spark: SparkSession, sf: str) -> DataFrame:
    """Pupils against places of the schools in reach, by the worse level; null and flagged without places."""
    d = view(spark, sf, "b_dev").select(F.col("dev_id").alias("app_id"), "x", "y", F.col("num_units").alias("units"))
    dev, _ = schools.pressure(d, view(spark, sf, "b_school"), {"primary": 2000.0, "post-primary": 3000.0}, {"primary": 0.3, "post-primary": 0.2})
    return dev.select("app_id", F.round("pressure_ratio", 6).alias("pressure_ratio"), "pressure_flag")


@query(ctes("b_dev", "b_school") + """, lev AS (SELECT * FROM (VALUES ('primary', 2000.0, 0.3), ('post-primary', 3000.0, 0.2)) v(level, reach, rate)),
hit AS (SELECT dev_id, school_id, num_units * rate / count(*) OVER (PARTITION BY dev_id, s.level) AS p FROM b_dev d JOIN b_school s ON true JOIN lev l ON l.level = s.level WHERE (d.x-s.x)*(d.x-s.x)+(d.y-s.y)*(d.y-s.y) <= reach * reach),
g AS (SELECT s.school_id, x, y, enrolment, coalesce(sum(p), 0.0) AS p FROM b_school s LEFT JOIN hit h ON h.school_id = s.school_id GROUP BY ALL)
SELECT school_id, round(p, 6) AS projected_pupils, round(p / enrolment, 6) AS pressure_ratio FROM g WHERE p > 0 OR (x BETWEEN 700000 AND 712000 AND y BETWEEN 720000 AND 735000)""")
def schools_shown(spark: SparkSession, sf: str) -> DataFrame:
    """Schools with what falls on them: those in a box and those with any pupils."""
    d = view(spark, sf, "b_dev").select(F.col("dev_id").alias("app_id"), "x", "y", F.col("num_units").alias("units"))
    _, s = schools.pressure(d, view(spark, sf, "b_school"), {"primary": 2000.0, "post-primary": 3000.0}, {"primary": 0.3, "post-primary": 0.2})
    return schools.worth_showing(s, (700000.0, 720000.0, 712000.0, 735000.0)).select("school_id", F.round("projected_pupils", 6).alias("projected_pupils"), F.round("pressure_ratio", 6).alias("pressure_ratio"))


@query("""WITH e AS (SELECT school_id, max(TRY_CAST(CASE WHEN enrolment % 7 = 0 THEN 'n/a' ELSE CAST(enrolment AS VARCHAR) END AS INTEGER)) AS enrolment FROM schools GROUP BY 1)
SELECT DISTINCT s.school_id, round(s.lng, 6) AS x, e.enrolment, 'primary' AS level FROM schools s LEFT JOIN e USING (school_id) WHERE regexp_full_match(s.school_id, '.*[02468]$')""")
def schools_read(spark: SparkSession, sf: str) -> DataFrame:
    """School rows by the form of their number, with enrolments where those are numbers."""
    s = table(spark, sf, "schools")
    e = s.select("school_id", F.when(F.col("enrolment") % 7 == 0, "n/a").otherwise(F.col("enrolment").cast("string")).alias("enrolment"))
    out = schools.schools_of(s.select("school_id", F.col("lng").cast("string").alias("x"), F.col("lat").cast("string").alias("y")), e, "primary", r".*[02468]$")
    return out.select("school_id", F.round("x", 6).alias("x"), "enrolment", "level").distinct()


@query("SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS located, CASE WHEN bool_and(n > 0) THEN 'ok' ELSE 'partial' END AS status FROM (SELECT level, count(CASE WHEN lng IS NOT NULL AND lat IS NOT NULL THEN 1 END) AS n FROM schools GROUP BY level)")
def schools_state(spark: SparkSession, sf: str) -> DataFrame:
    return schools.state_of(table(spark, sf, "schools").select("level", F.col("lng").alias("x"), F.col("lat").alias("y")))


# ---- totals -----------------------------------------------------------------

_EXT = "ext AS (SELECT CAST(edge_id AS VARCHAR) AS edge_id, max(length_m) AS length, min(ord) AS ord, list_sort(list(DISTINCT CAST(dev_id AS VARCHAR))) AS apps FROM b_ext GROUP BY 1)"
_DEVS = "dev AS (SELECT CAST(dev_id AS VARCHAR) AS app_id, num_units AS units, num_units * 2.5 AS residents, status <> 'refused' AS connected, CAST(num_units AS DOUBLE) AS route_m, status AS area FROM b_dev)"


def _ext(spark: SparkSession, sf: str) -> DataFrame:
    e = view(spark, sf, "b_ext").groupBy(F.col("edge_id").cast("string").alias("edge_id"))
    return e.agg(F.max("length_m").alias("length"), F.min("ord").alias("ord"), F.array_sort(F.collect_set(F.col("dev_id").cast("string"))).alias("serves_app_ids"))


def _devs(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("num_units")
    return view(spark, sf, "b_dev").select(F.col("dev_id").cast("string").alias("app_id"), u.alias("units"), (u * 2.5).alias("residents"), (F.col("status") != "refused").alias("connected"), u.cast("double").alias("route_m"), F.col("status").alias("area"))


@query(ctes("b_dev", "b_ext") + f", {_DEVS}, {_EXT} " + """SELECT count(*) AS developments, CAST(sum(units) AS BIGINT) AS units, CAST(sum(residents) AS DOUBLE) AS residents, CAST(sum(CASE WHEN NOT connected THEN units END) AS BIGINT) AS unconnected_units,
(SELECT round(sum(length) / 1000.0, 3) FROM ext) AS new_km, coalesce(sum(CASE WHEN NOT connected AND app_id NOT IN (SELECT unnest(apps) FROM ext) THEN route_m END), 0.0) AS laterals_m FROM dev""")
def totals(spark: SparkSession, sf: str) -> DataFrame:
    return summary.totals(_devs(spark, sf), _ext(spark, sf))


@query(ctes("b_dev") + ", z AS (SELECT count(*) AS n, sum(num_units) AS u FROM b_dev) SELECT n AS developments, CAST(round(u * 2.7) AS DOUBLE) AS residents FROM z")
def totals_without_residents(spark: SparkSession, sf: str) -> DataFrame:
    """Where no residents are known they come from units."""
    return summary.totals(_devs(spark, sf).withColumn("residents", F.lit(None).cast("double")), _ext(spark, sf)).select("developments", "residents")


@query(ctes("b_dev", "b_ext") + f", {_DEVS}, {_EXT} " + """, km AS (SELECT d.area, sum(length / 1000.0 / len(apps)) AS km FROM (SELECT unnest(apps) AS app_id, length, apps FROM ext) e JOIN dev d USING (app_id) GROUP BY 1)
SELECT area, CAST(sum(units) AS BIGINT) AS units, round(coalesce(max(km), 0.0), 6) AS new_km FROM dev LEFT JOIN km USING (area) GROUP BY area""")
def totals_by_area(spark: SparkSession, sf: str) -> DataFrame:
    return summary.by_area(_devs(spark, sf), _ext(spark, sf)).select("area", "units", F.round("new_km", 6).alias("new_km"))


@query(ctes("b_ext") + f", {_EXT}, b AS (SELECT ord * 50 AS bore, round(sum(length) / 1000.0, 3) AS km FROM ext GROUP BY 1) SELECT string_agg(bore || '=' || km, ',' ORDER BY bore) AS lengths, max(bore) AS widest FROM b")
def lengths_by_bore(spark: SparkSession, sf: str) -> DataFrame:
    k = summary.by_bore(_ext(spark, sf).withColumn("bore", F.col("ord") * 50))
    pairs = F.array_sort(F.map_entries("lengths"))
    return k.select(F.array_join(F.transform(pairs, lambda e: F.concat(e.key.cast("string"), F.lit("="), e.value.cast("string"))), ",").alias("lengths"), "widest")


@query("SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def asset_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return summary.kinds(table(spark, sf, "events").withColumnRenamed("event_type", "kind"))


@query(ctes("b_dev", "b_ext") + f", {_DEVS}, {_EXT} SELECT d.app_id, (SELECT sum(length) FROM (SELECT unnest(apps) AS a, length FROM ext) e WHERE e.a = d.app_id) AS route_m FROM dev d")
def line_lengths_served(spark: SparkSession, sf: str) -> DataFrame:
    """How much new line each development depends on."""
    return network.served_totals(_ext(spark, sf), _devs(spark, sf))


@query(ctes("b_dev") + f", {_DEVS}" + """, w AS (SELECT *, CASE WHEN area = 'refused' THEN 0.0 WHEN area = 'granted' THEN 0.5 ELSE 1.0 END AS weight FROM dev)
SELECT count(*) AS developments, CAST(sum(units * weight) AS DOUBLE) AS units, CAST(sum(route_m * weight) AS DOUBLE) AS route_m FROM w WHERE weight > 0""")
def weighted_scenario(spark: SparkSession, sf: str) -> DataFrame:
    w = F.when(F.col("area") == "refused", 0.0).when(F.col("area") == "granted", 0.5)
    return summary.scenario(_devs(spark, sf).withColumn("weight", w))


@query(ctes("b_dev") + f", {_DEVS} SELECT app_id, units FROM dev ORDER BY units DESC, app_id LIMIT 45")
def largest_developments(spark: SparkSession, sf: str) -> DataFrame:
    return summary.largest(_devs(spark, sf), 45).select("app_id", "units")


@query(ctes("b_dev", "b_ext") + f", {_DEVS}, {_EXT} SELECT edge_id, string_agg(a, ',' ORDER BY a) AS apps FROM (SELECT edge_id, unnest(apps) AS a FROM ext) WHERE a IN (SELECT app_id FROM dev WHERE area = 'granted') GROUP BY edge_id")
def extensions_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Extensions with those of their developments that were granted; without any they fall out."""
    kept = keyed.surviving(_ext(spark, sf), "serves_app_ids", _devs(spark, sf).where("area = 'granted'"), "app_id", "edge_id")
    return summary.in_order(kept).select("edge_id", F.array_join("serves_app_ids", ",").alias("apps"))


# ---- network ----------------------------------------------------------------

_SEGS = ctes("b_edge") + """, seg AS (SELECT u * 100000 + v AS edge_id, u, v, length, CASE WHEN length < 70 THEN 'none' WHEN length < 110 THEN 'low' ELSE 'high' END AS confidence,
  (u % 50) * 100.0 AS x1, floor(u / 50) * 100.0 AS y1, (v % 50) * 100.0 AS x2, floor(v / 50) * 100.0 AS y2 FROM b_edge),
site AS (SELECT s_suppkey AS id, CAST((s_suppkey * 7919) % 4900 AS DOUBLE) AS x, CAST((s_suppkey * 104729) % 3000 AS DOUBLE) AS y FROM supplier),
d AS (SELECT id, edge_id, confidence, greatest(least(x1, x2) - x, x - greatest(x1, x2), 0.0) AS dx, greatest(least(y1, y2) - y, y - greatest(y1, y2), 0.0) AS dy FROM site, seg)
"""


def _grid(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, their segments, sites) of the street grid with corners 100 metres apart."""
    at = lambda n: ((F.col(n) % 50) * 100.0, F.floor(F.col(n) / 50) * 100.0)
    level = F.when(F.col("length") < 70, "none").when(F.col("length") < 110, "low").otherwise("high")
    e = view(spark, sf, "b_edge").select((F.col("u") * 100000 + F.col("v")).alias("edge_id"), "u", "v", "length", level.alias("confidence"))
    segs = e.select("edge_id", F.lit(0).alias("k"), *(c.cast("double").alias(n) for c, n in zip((*at("u"), *at("v")), ("x1", "y1", "x2", "y2"))))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("app_id"), ((F.col("s_suppkey") * 7919) % 4900).cast("double").alias("x"), ((F.col("s_suppkey") * 104729) % 3000).cast("double").alias("y"))
    return e, segs, s


@query(_SEGS + """, near AS (SELECT id, edge_id, row_number() OVER (PARTITION BY id ORDER BY dx*dx+dy*dy, edge_id) AS k FROM d),
served AS (SELECT id, edge_id, sqrt(dx*dx+dy*dy) AS m, row_number() OVER (PARTITION BY id ORDER BY dx*dx+dy*dy, edge_id) AS k FROM d WHERE confidence <> 'none')
SELECT n.id AS app_id, n.edge_id AS nearest_edge, s.edge_id AS attached_to, round(s.m, 6) AS distance_m, coalesce(s.m <= 50, false) AS connected FROM near n LEFT JOIN served s ON s.id = n.id AND s.k = 1 WHERE n.k = 1""")
def connections(spark: SparkSession, sf: str) -> DataFrame:
    """For each site its nearest street, its nearest served street however far, and whether that is near enough."""
    e, segs, s = _grid(spark, sf)
    return network.attached(s, e, segs).select("app_id", "nearest_edge", "attached_to", F.round("distance_m", 6).alias("distance_m"), "connected")


@query(_SEGS + """, snap AS (SELECT id, edge_id, row_number() OVER (PARTITION BY id ORDER BY dx*dx+dy*dy, edge_id) AS k FROM d WHERE dx*dx+dy*dy <= 900.0),
b AS (SELECT edge_id, max(1 + id % 3) AS r, count(*) AS n FROM snap WHERE k = 1 GROUP BY edge_id)
SELECT e.edge_id, CASE r WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'none' END AS confidence, coalesce(n, 0) AS notes FROM seg e LEFT JOIN b USING (edge_id)""")
def inferred_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Streets with the best level of the assets snapped to them."""
    e, segs, s = _grid(spark, sf)
    level = F.when(F.col("app_id") % 3 == 0, "low").when(F.col("app_id") % 3 == 1, "medium").otherwise("high")
    out = network.infer(e.drop("confidence"), segs, s.select(F.col("app_id").alias("asset_id"), "x", "y", level.alias("level"), F.col("app_id").cast("string").alias("note")))
    return out.select("edge_id", "confidence", F.size("evidence").cast("long").alias("notes"))


@query(_SEGS + """, ends AS (SELECT u AS node, edge_id, confidence FROM seg WHERE confidence <> 'none' UNION ALL SELECT v, edge_id, confidence FROM seg WHERE confidence <> 'none')
SELECT node, edge_id FROM (SELECT node, edge_id, row_number() OVER (PARTITION BY node ORDER BY CASE confidence WHEN 'high' THEN 3 ELSE 1 END DESC, edge_id DESC) AS k FROM ends) WHERE k = 1""")
def best_served_edges(spark: SparkSession, sf: str) -> DataFrame:
    return network.best_served(_grid(spark, sf)[0])


@query(None)
def extended_network(spark: SparkSession, sf: str) -> DataFrame:
    """The edges that would connect every site not yet served."""
    e, segs, s = _grid(spark, sf)
    nodes = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct().select("node", ((F.col("node") % 50) * 100.0).cast("double").alias("x"), (F.floor(F.col("node") / 50) * 100.0).cast("double").alias("y"))
    dry = e.withColumn("confidence", F.when(F.col("u") % 50 < 25, F.col("confidence")).otherwise(F.lit("none")))
    return network.extend(s, nodes, dry, segs)["extensions"].select("edge_id", "length", "ord", F.size("serves_app_ids").alias("n_served"))


@query(_SEGS + """, hit AS (SELECT edge_id FROM seg JOIN (SELECT id, x AS a0, y AS b0, x + 30 AS a1, y + 20 AS b1 FROM site) ON true
WHERE pow(greatest(a0 - greatest(x1, x2), least(x1, x2) - a1, 0.0), 2) + pow(greatest(b0 - greatest(y1, y2), least(y1, y2) - b1, 0.0), 2) <= 625.0) SELECT edge_id, count(*) AS n FROM hit GROUP BY edge_id""")
def buildings_near_streets(spark: SparkSession, sf: str) -> DataFrame:
    """How many buildings, as polygons, stand within 25 metres of each street."""
    _, segs, s = _grid(spark, sf)
    p = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    b = s.select(F.col("app_id").alias("building"), F.array(p(0.0, 0.0), p(30.0, 0.0), p(30.0, 20.0), p(0.0, 20.0), p(0.0, 0.0)).alias("ring"))
    return spatial.lines_near_regions(segs, b, 25.0, "edge_id", "building").groupBy("edge_id").agg(F.count("*").alias("n"))


@query("SELECT street, count(*) AS visits, CAST(sum(n) AS BIGINT) AS inspections FROM (SELECT upper(split_part(p_name, ' ', 1)) AS street, coalesce(TRY_CAST(CASE WHEN p_size % 5 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS INTEGER), 0) AS n FROM part) GROUP BY street")
def returns_by_street(spark: SparkSession, sf: str) -> DataFrame:
    """Returns added up by the capitals that open their street."""
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    r = table(spark, sf, "part").select(F.concat(F.upper(first), F.lit(" near side")).alias("street"), F.when(F.col("p_size") % 5 == 0, "n/a").otherwise(F.col("p_size").cast("string")).alias("n"))
    return sites.returns_by_street(r, "street", "n")


# ---- rows that do and don't meet --------------------------------------------


@query(ctes("b_dev") + "SELECT dev_id, CASE status WHEN 'granted' THEN 'granted' ELSE 'pending' END AS status FROM b_dev WHERE status IN ('granted', 'pending', 'appealed')")
def mapped_status(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.mapped(view(spark, sf, "b_dev"), "status", {"granted": "granted", "pending": "pending", "appealed": "pending"})[0].select("dev_id", "status")


@query(ctes("b_dev") + "SELECT count(*) AS excluded FROM b_dev WHERE status NOT IN ('granted', 'pending', 'appealed')")
def excluded_status(spark: SparkSession, sf: str) -> DataFrame:
    return keyed.mapped(view(spark, sf, "b_dev"), "status", {"granted": "granted", "pending": "pending", "appealed": "pending"})[1]


@query("SELECT c_custkey, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN -1.0 ELSE m END AS most FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS m FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def orders_or_default(spark: SparkSession, sf: str) -> DataFrame:
    """What didn't meet takes defaults; a null that was joined stays one."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("most"))
    return keyed.or_default(table(spark, sf, "customer").select("c_custkey"), o, ["c_custkey"], {"n": F.lit(0).cast("long"), "most": F.lit(-1.0)})


@query("SELECT c_custkey, CASE WHEN s_suppkey IS NOT NULL THEN s_name ELSE c_name END AS name, CASE WHEN s_suppkey IS NOT NULL THEN nullif(s_acctbal, s_acctbal) ELSE c_acctbal END AS balance FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def whole_row_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """A row that is there gives all its values, its nulls too; else the row's own hold."""
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("name"), F.lit(None).cast("double").alias("balance"))
    return keyed.row_fallback(c, s, "c_custkey", ["name", "balance"])


@query("SELECT d.app_id, count(*) AS n FROM developments d JOIN (SELECT DISTINCT app_id FROM developments WHERE num_units > 20) k USING (app_id) GROUP BY d.app_id")
def known_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Only what has a reading goes on."""
    d = table(spark, sf, "developments").select("app_id", "num_units")
    return sites.served_first(d, d.where("num_units > 20").select("app_id").distinct()).groupBy("app_id").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT edge_id, [CASE WHEN street_name IS NULL THEN 'street_name is required' END, CASE WHEN length_m IS NULL OR isnan(length_m) OR isinf(length_m) THEN 'length_m is finite' END, CASE WHEN coalesce(confidence NOT IN ('high', 'low'), true) THEN 'confidence is one of 2' END] AS rules FROM network)
SELECT edge_id AS key, rule, count(*) AS n FROM (SELECT edge_id, unnest(rules) AS rule FROM r) WHERE rule IS NOT NULL GROUP BY 1, 2""")
def contract_report(spark: SparkSession, sf: str) -> DataFrame:
    """What the network's rows break of their contract."""
    return keyed.contract(table(spark, sf, "network"), "network", "edge_id", ["street_name"], ["length_m"], {"confidence": ["high", "low"]}).groupBy("key", "rule").agg(F.count("*").alias("n"))


@query("SELECT school_id, count(*) AS broken FROM schools WHERE coalesce(NOT (lng BETWEEN -11 AND -5 AND lat BETWEEN 51 AND 56), true) GROUP BY 1")
def outside_box(spark: SparkSession, sf: str) -> DataFrame:
    """Schools whose position is missing or beyond the country's box."""
    s = table(spark, sf, "schools").select("school_id", F.struct(F.col("lng").alias("x"), F.col("lat").alias("y")).alias("at"))
    return keyed.contract(s, "schools", "school_id", [], boxes={"at": (-11, 51, -5, 56)}).groupBy(F.col("key").alias("school_id")).agg(F.count("*").alias("broken"))


@query("SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'points' ELSE 'others' END AS shape, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def shapes_split(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.when(F.col("c_mktsegment") == "BUILDING", "Point").otherwise("LineString").alias("kind"), F.when(F.col("c_acctbal") > 0, 1).alias("level"))
    a, b = landed.by_shape(c)
    return a.select(F.lit("points").alias("shape")).unionByName(b.select(F.lit("others").alias("shape"))).groupBy("shape").agg(F.count("*").alias("n"))


@query("SELECT received_date, count(*) AS n FROM developments WHERE received_date >= '2021-06-02' GROUP BY 1")
def received_since(spark: SparkSession, sf: str) -> DataFrame:
    """Applications of the last three years before a day."""
    return landed.since(table(spark, sf, "developments"), "received_date", "2024-06-01", 3).groupBy("received_date").agg(F.count("*").alias("n"))


# ---- columns ----------------------------------------------------------------


@query("""SELECT DISTINCT street_name, array_to_string(list_filter(w, lambda x, i: i <= coalesce(list_position(list_transform(w, lambda t: regexp_matches(t, '\\p{Ll}')), true), len(w) + 1) - 1), ' ') AS capitals FROM (SELECT street_name, string_split_regex(trim(street_name), '\\s+') AS w FROM network WHERE street_name IS NOT NULL AND trim(street_name) <> '')""")
def capital_names(spark: SparkSession, sf: str) -> DataFrame:
    """The words of a name before the first with a small letter."""
    n = table(spark, sf, "network").where("street_name IS NOT NULL AND trim(street_name) <> ''").select("street_name").distinct()
    return n.select("street_name", text.leading_capitals(F.col("street_name")).alias("capitals"))


@query("SELECT small_area_id, population, households, CASE WHEN households > 0 THEN round(population / households, 2) END AS size, CAST(round_even(100 * coalesce(CASE WHEN households > 0 THEN nullif(round(population / households, 2), 0) END, 2.7), 0) AS DOUBLE) AS residents, count(*) AS n FROM areas GROUP BY ALL")
def households(spark: SparkSession, sf: str) -> DataFrame:
    """People to a household, and what a hundred dwellings would house."""
    size = measures.household_size(F.col("population"), F.col("households"))
    a = table(spark, sf, "areas").groupBy("small_area_id", "population", "households").agg(F.count("*").alias("n"))
    return a.select("small_area_id", "population", "households", size.alias("size"), measures.residents(F.lit(100), size, 2.7).alias("residents"), "n")


@query("SELECT p_partkey, round((p_size / 10.0) / 1000.0 / (pi() * pow((50.0 + p_size) / 2000.0, 2)), 6) AS metres_a_second, round(0.6 * greatest(p_size, p_retailprice / 100) + 0.4 * (p_size + p_retailprice / 100) / 2, 6) AS blend FROM part")
def speeds_and_blends(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    v = measures.velocity(F.col("p_size") / 10.0, 50.0 + F.col("p_size"))
    return p.select("p_partkey", F.round(v, 6).alias("metres_a_second"), F.round(measures.blended([F.col("p_size").cast("double"), F.col("p_retailprice") / 100, F.lit(None).cast("double")]), 6).alias("blend"))


@query("SELECT app_id, count(*) AS n, max(TRY_CAST(trim(address) AS DOUBLE)) AS number, CAST(sum(coalesce(TRY_CAST(num_units AS INTEGER), 0)) AS BIGINT) AS whole, max('<' || left(coalesce(description, ''), 12) || '|' || coalesce(dev_type, '') || '>') AS prompt FROM developments GROUP BY app_id")
def numbers_and_prompts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "developments")
    p = rules.prompt("<%s|%s>", rules.cut(F.col("description"), 12), F.col("dev_type"))
    return d.groupBy("app_id").agg(F.count("*").alias("n"), F.max(text.number(F.trim("address"))).alias("number"), F.sum(text.whole(F.col("num_units").cast("string"))).alias("whole"), F.max(p).alias("prompt"))


@query("SELECT DISTINCT address, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split_regex(address, '[;,]'), lambda x: trim(x)), lambda x: x <> ''))), ' / ') AS parts FROM developments WHERE address IS NOT NULL")
def address_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct trimmed parts of a list, sorted."""
    d = table(spark, sf, "developments").where("address IS NOT NULL").select("address").distinct()
    return d.select("address", F.array_join(text.split_list(F.col("address")), " / ").alias("parts"))


@query("SELECT edge_id, count(*) AS n, max(nullif(concat_ws(' / ', nullif(street_name, ''), CASE WHEN highway IS DISTINCT FROM street_name THEN nullif(highway, '') END), '')) AS label FROM network GROUP BY edge_id HAVING max(street_name) IS NOT NULL OR max(highway) IS NOT NULL")
def edge_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct names in their order."""
    n = table(spark, sf, "network").withColumn("label", text.label(F.array("street_name", "highway", "street_name")))
    return n.groupBy("edge_id").agg(F.count("*").alias("n"), F.max("label").alias("label"), F.max(F.coalesce("street_name", "highway")).alias("any")).where("any IS NOT NULL").drop("any")


@query(ctes("b_edge") + "SELECT u || '-' || v || '-0' AS id, least(u, v) AS a, greatest(u, v) AS b FROM b_edge")
def edge_ids(spark: SparkSession, sf: str) -> DataFrame:
    """One id for both directions; here every edge is given the other way round."""
    e = view(spark, sf, "b_edge")
    return e.select(text.edge_id(F.col("v"), F.col("u"), F.lit(0)).alias("id"), F.col("u").alias("a"), F.col("v").alias("b"))


@query("SELECT app_id, count(*) AS n, max(CASE WHEN connected THEN 0.0 ELSE coalesce(nullif(CASE WHEN isnan(distance_to_network_m) THEN NULL ELSE distance_to_network_m END, 0.0), nullif(CAST(num_units AS DOUBLE), 0.0), 0.0) END) AS route_m FROM developments GROUP BY app_id")
def way_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """0 where connected, else the first of two lengths that is neither missing nor 0."""
    d = table(spark, sf, "developments")
    m = F.when(F.col("connected"), 0.0).otherwise(F.coalesce(measures.missing_if_falsy(F.col("distance_to_network_m"), F.col("num_units")), F.lit(0.0)))
    return d.groupBy("app_id").agg(F.count("*").alias("n"), F.max(m).alias("route_m"))


@query("SELECT school_id, count(*) AS n FROM schools WHERE lng BETWEEN -6.5 - 5000.0 / 111320.0 / cos(radians(53.3)) AND -6.1 + 5000.0 / 111320.0 / cos(radians(53.3)) AND lat BETWEEN 53.2 - 5000.0 / 111320.0 AND 53.4 + 5000.0 / 111320.0 GROUP BY 1")
def in_padded_box(spark: SparkSession, sf: str) -> DataFrame:
    """Schools in a box grown by five kilometres."""
    box = geo.padded_box(-6.5, 53.2, -6.1, 53.4, 5000.0)
    return table(spark, sf, "schools").where(geo.in_box(F.col("lng"), F.col("lat"), box)).groupBy("school_id").agg(F.count("*").alias("n"))


@query("SELECT school_id, max(CASE WHEN lng <> 0 AND lat <> 0 THEN lng ELSE projected_new_pupils END) AS x, count(*) AS n FROM schools WHERE (lng <> 0 AND lat <> 0) OR (projected_new_pupils <> 0 AND pressure_ratio <> 0) GROUP BY 1")
def located_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Positions from the first pair of columns that holds one."""
    s = table(spark, sf, "schools").select("school_id", "lng", "lat", "projected_new_pupils", "pressure_ratio")
    return landed.located(s, [("lng", "lat"), ("projected_new_pupils", "pressure_ratio")]).groupBy("school_id").agg(F.max("x").alias("x"), F.count("*").alias("n"))


@query("SELECT app_id, max(round_even(centroid[1], 3)) AS lng FROM developments WHERE centroid[1] IS NOT NULL GROUP BY app_id")
def rounded_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Coordinates rounded half-even."""
    d = table(spark, sf, "developments").where("get(centroid, 0) IS NOT NULL")
    p = geo.rounded(F.array(F.struct(F.get("centroid", F.lit(0)).alias("x"), F.get("centroid", F.lit(1)).alias("y"))), 3)
    return d.groupBy("app_id").agg(F.max(F.get(p, F.lit(0)).x).alias("lng"))


@query(ctes("b_school") + """, c AS (SELECT school_id, greatest(x, 710000.0) AS a, least(x + 800.0, 740000.0) AS b, x, y FROM b_school)
SELECT school_id, round((CASE WHEN y BETWEEN 725000.0 AND 755000.0 THEN greatest(b - a, 0.0) ELSE 0.0 END) + (CASE WHEN x + 800.0 BETWEEN 710000.0 AND 740000.0 THEN greatest(least(y + 600.0, 755000.0) - greatest(y, 725000.0), 0.0) ELSE 0.0 END), 6) AS metres FROM c""")
def lines_within_box(spark: SparkSession, sf: str) -> DataFrame:
    """How much of each bent line lies in a box, its runs put together again."""
    p = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    runs = geo.clip_line(F.array(p(0.0, 0.0), p(800.0, 0.0), p(800.0, 600.0)), (710000.0, 725000.0, 740000.0, 755000.0))
    return view(spark, sf, "b_school").select("school_id", F.round(F.aggregate(F.transform(runs, geo.length), F.lit(0.0), lambda s, m: s + m), 6).alias("metres"))


@query("""SELECT small_area_id, bool_or(ring IS NOT NULL AND len(ring) >= 4 AND ring[1] = ring[len(ring)]) AS valid, max(round(abs(list_sum(list_transform(range(1, len(ring)), lambda i: (ring[i].lng - ring[1].lng) * (ring[i + 1].lat - ring[1].lat) - (ring[i + 1].lng - ring[1].lng) * (ring[i].lat - ring[1].lat)))) / 2, 9)) AS area FROM areas GROUP BY 1""")
def area_rings(spark: SparkSession, sf: str) -> DataFrame:
    """Validity and area of the areas' rings, in square degrees."""
    ring = F.transform("ring", lambda p: F.struct(p.lng.alias("x"), p.lat.alias("y")))
    return table(spark, sf, "areas").groupBy("small_area_id").agg(F.bool_or(geo.valid_ring(ring)).alias("valid"), F.max(F.round(geo.area(ring), 9)).alias("area"))


@query("SELECT app_id, count(*) AS n, count(CASE WHEN dev_type IN ('residential', 'mixed') AND coalesce(num_units >= 10, true) THEN 1 END) AS valid FROM developments GROUP BY app_id")
def valid_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Readings whose kind is known and whose units, less ten, aren't negative."""
    r = F.struct("dev_type", (F.col("num_units") - 10).alias("units"))
    return table(spark, sf, "developments").groupBy("app_id").agg(F.count("*").alias("n"), F.count_if(rules.valid_reading(r, {"dev_type": ["residential", "mixed"]}, ["units"])).alias("valid"))


@query(ctes("b_edge") + """, z AS (SELECT count(*) AS n FROM part), nodes AS (SELECT u AS node FROM b_edge UNION SELECT v FROM b_edge), leg AS (SELECT DISTINCT node, node * 7 % n AS t FROM nodes JOIN part ON p_partkey = node, z WHERE p_size = 1),
far AS (SELECT node, t, abs(node % 50 - t % 50) + abs(floor(node / 50) - floor(t / 50)) AS d FROM leg WHERE t IN (SELECT node FROM nodes)) SELECT node, t AS goal, CAST(d AS DOUBLE) AS dist, CAST(d + 1 AS INTEGER) AS passed FROM far""")
def grid_ways(spark: SparkSession, sf: str) -> DataFrame:
    """Ways over the street grid, counted in streets, from each marked corner to another."""
    e = view(spark, sf, "b_edge").select("u", "v", F.lit(1.0).alias("length"))
    n = table(spark, sf, "part").count()
    ends = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct()
    legs = ends.join(table(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("node")), "node", "left_semi").select("node", (F.col("node") * 7 % n).alias("to"))
    return banded.pair_lengths(e, legs).select("node", F.col("to").alias("goal"), "dist", "passed")


@query(None)
def chains_contracted(spark: SparkSession, sf: str) -> DataFrame:
    """The short streets of the grid, with chains as one street each."""
    return graph.contracted(view(spark, sf, "b_edge").where("length <= 90"))


@query(ctes("b_dev") + """, r AS (SELECT dev_id, status, num_units, row_number() OVER (PARTITION BY status = 'granted' ORDER BY num_units DESC, CAST(dev_id AS VARCHAR)) AS g, row_number() OVER (ORDER BY num_units * 0.25 DESC, CAST(dev_id AS VARCHAR)) AS w FROM b_dev)
SELECT 'top 7 by water' AS question, CAST(w AS INTEGER) AS place, CAST(dev_id AS VARCHAR) AS app_id FROM r WHERE w <= 7 UNION ALL SELECT 'which granted ones', CAST(g AS INTEGER), CAST(dev_id AS VARCHAR) FROM r WHERE status = 'granted' AND g <= 5""")
def answered(spark: SparkSession, sf: str) -> DataFrame:
    """The applications that answers to two questions name, in their order."""
    u = F.col("num_units").cast("double")
    d = view(spark, sf, "b_dev").select(F.col("dev_id").cast("string").alias("app_id"), F.col("num_units").alias("units"), "status", (u * 0.25).alias("water"), u.alias("transport"), u.alias("schools"), u.alias("overall"))
    routes = spark.createDataFrame([], "route_id string, length_km double, serves_app_ids array<string>")
    rows = [(q, i, a) for q in ("top 7 by water", "which granted ones") for i, a in enumerate(ask.answer(q, d, routes).ids, 1)]
    return spark.createDataFrame(rows, "question string, place int, app_id string")


@query("SELECT date_trunc('hour', CAST(ts AS TIMESTAMP)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_events(spark: SparkSession, sf: str) -> DataFrame:
    """Counts in tumbling windows, as a stream would give them."""
    return incremental.windowed_counts(table(spark, sf, "events"), "ts", "event_type")


@query("SELECT app_id, max(length(coalesce(description, ''))) AS n_chars FROM developments WHERE app_id IS NOT NULL AND app_id NOT IN (SELECT app_id FROM developments WHERE num_units > 20 AND app_id IS NOT NULL) GROUP BY app_id HAVING max(length(coalesce(description, ''))) > 0")
def extracted_once(spark: SparkSession, sf: str) -> DataFrame:
    """An outside reader asked only for what isn't known; answers of the wrong form don't count."""
    d = table(spark, sf, "developments").select("app_id", F.coalesce("description", F.lit("")).alias("description"), "num_units")
    new = incremental.todo(d, d.where("num_units > 20").select("app_id").distinct(), "app_id")
    return incremental.extract(new, "app_id", lambda b: b.assign(n_chars=b.description.str.len()), "app_id string, n_chars long", "n_chars > 0")

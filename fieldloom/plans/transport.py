"""Stops, lines and routes from transit tables; access of developments; routes for those without."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import measures
from fieldloom.operators import cluster, graph, keyed, spatial
from fieldloom.runtime import materialise


def services_on(calendar: DataFrame, dates: DataFrame, day: str, weekday: str = "tuesday") -> DataFrame:
    """Services that run on a day (yyyymmdd): by calendar, with days added, then days removed."""
    base = calendar.where((F.col(weekday) == "1") & (F.col("start_date") <= day) & (F.col("end_date") >= day)).select("service_id")
    on = lambda k: dates.where((F.col("date") == day) & (F.col("exception_type") == k)).select("service_id")
    return keyed.active(base, on("1"), on("2"))


def stop_table(stops: DataFrame, stop_times: DataFrame, trips: DataFrame, routes: DataFrame, services: DataFrame, peak: tuple[str, str] = ("07:00:00", "10:00:00"), hours: float = 3.0) -> DataFrame:
    """Stops with departures: how many in the peak, on which routes. Times are compared as text."""
    live = trips.join(services, "service_id", "left_semi").join(routes.select("route_id", "route_short_name", "route_type"), "route_id").select("trip_id", "route_short_name", "route_type")
    st = stop_times.join(stops.select("stop_id"), "stop_id", "left_semi").join(live, "trip_id")
    in_peak = (F.col("departure_time") >= peak[0]) & (F.col("departure_time") < peak[1])
    bus = F.col("route_type") == "3"
    n = st.groupBy("stop_id").agg((F.count_if(in_peak) / hours).alias("peak_per_hr"), (F.count_if(in_peak & bus) / hours).alias("peak_buses_per_hr"), F.count_if(bus).alias("bus_any"), F.count_if(~bus).alias("rail_any"), F.array_sort(F.collect_set("route_short_name")).alias("routes"), F.mode("route_type", deterministic=True).alias("mode"))
    return stops.join(n, "stop_id")


def rail_lines(shapes: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """One line for each pair of ends: a route's commonest shape, and of both directions the one with fewer trips.

    shapes: (shape_id, seq, x, y). Route names read "A - B".
    """
    n = trips.groupBy("route_id", "shape_id").agg(F.count("*").alias("n"))
    top = n.groupBy("route_id").agg(F.max(F.struct("n", "shape_id")).alias("m")).select("route_id", "m.n", "m.shape_id").join(routes, "route_id")
    ends = F.array_sort(F.array_distinct(F.transform(F.split("route_long_name", " - "), lambda x: F.trim(x))))
    one = keyed.first_per(top.withColumn("ends", ends), [F.col("route_type"), F.col("ends")], [F.col("n"), F.col("route_id")])
    line = shapes.groupBy("shape_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))).alias("line"))
    return one.join(line, "shape_id").select("route_id", "route_type", "route_long_name", "line")


def access(developments: DataFrame, stops: DataFrame, frequent: float = 6.0, served: float = 400.0) -> DataFrame:
    """(app_id, any_m, frequent_m, rail_m, access): distances to the nearest stop, frequent stop and station."""
    out = developments.select("app_id")
    for name, some in (("any_m", stops), ("frequent_m", stops.where(F.col("peak_per_hr") >= frequent)), ("rail_m", stops.where("rail_any > 0"))):
        d = spatial.nearest(developments, some, "app_id", "stop_id").select("app_id", F.sqrt("d2").alias(name))
        out = out.join(d, "app_id", "left")
    return out.withColumn("access", F.when(F.col("frequent_m") <= served, "served").when(F.col("any_m") <= served, "weak").otherwise("unserved"))


def routes_for(developments: DataFrame, targets: DataFrame, nodes: DataFrame, edges: DataFrame, eps: float = 600.0, least_units: float = 150.0, capacity: float = 72.0) -> DataFrame:
    """A route for each cluster of developments (app_id, x, y, units, demand): clusters by size, tours by nearest next, over the graph.

    Clusters are numbered before routing, so one without a way leaves a gap.
    """
    label = cluster.dbscan(developments, eps, 2, "app_id").where("cluster IS NOT NULL")
    d = materialise(developments.join(label, "app_id"), "clustered")
    sums = d.groupBy("cluster").agg(F.sum("units").alias("units"), F.sum("demand").alias("demand"), F.count("*").alias("size"), F.avg("x").alias("x"), F.avg("y").alias("y")).where(F.col("units") >= least_units)
    # As many rows as routes, which the window orders in one task.
    num = materialise(sums.withColumn("n", F.row_number().over(Window.orderBy(F.desc("units"), "cluster"))), "numbered")
    goal = spatial.nearest(num, targets, "cluster", "stop_id").join(targets.select("stop_id", "x", "y"), "stop_id")
    tour = cluster.greedy_tours(d.join(num.select("cluster"), "cluster", "left_semi"), "cluster", "app_id").join(d.select("app_id", "x", "y"), "app_id")
    calls = tour.select("cluster", "stop", "x", "y").unionByName(num.select("cluster", F.lit(-1).alias("stop"), "x", "y")).unionByName(goal.select("cluster", F.lit(1 << 30).alias("stop"), "x", "y"))
    calls = calls.withColumn("call", F.concat_ws("/", "cluster", "stop"))
    at = materialise(spatial.nearest(calls, nodes, "call", "node").join(calls, "call").select("cluster", "stop", "node"), "calls")
    legs = materialise(at.withColumn("to", F.lead("node").over(Window.partitionBy("cluster").orderBy("stop"))).where("to IS NOT NULL AND node <> to"), "legs")
    ways = materialise(graph.pair_paths(edges, legs.select("node", "to")), "ways")
    total = legs.join(ways, ["node", "to"], "left").groupBy("cluster").agg(F.sum("dist").alias("m"), F.count_if(F.col("dist").isNull()).alias("gaps"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("stop", "path"))), lambda x: x.path)).alias("path")).where("gaps = 0")
    line = route_lines(total.select("cluster", "path"), nodes)
    serves = d.groupBy("cluster").agg(F.array_sort(F.collect_list("app_id")).alias("serves_app_ids"))
    out = num.join(total, "cluster").join(serves, "cluster").join(line, "cluster")
    trip = 2 * F.col("m") / 1000.0 / 15.0 * 60.0 + 10.0
    wait = measures.headway(F.col("demand") / 3.0, capacity, 5.0, 20.0)
    return out.select(F.format_string("R%03d", "n").alias("route_id"), (F.col("m") / 1000.0).alias("length_km"), trip.alias("round_trip_min"), wait.alias("headway_min"), F.ceil(trip / wait).cast("int").alias("buses_required"), F.col("demand").alias("peak_demand"), "serves_app_ids", "line")


def route_lines(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(cluster, line): paths of nodes as lines; a node met twice in a row, where two legs join, is one point."""
    p = paths.select("cluster", F.posexplode("path").alias("k", "node")).join(nodes.select("node", "x", "y"), "node")
    w = p.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("k", "node", "x", "y"))).alias("w"))
    once = F.filter("w", lambda s, i: (i == 0) | (s.node != F.get(F.col("w"), i - 1).node))
    return w.select("cluster", F.transform(once, lambda s: F.struct(s.x.alias("x"), s.y.alias("y"))).alias("line"))


def straight_routes(lost: DataFrame, detour: float = 1.3, km_h: float = 15.0, layover: float = 10.0) -> DataFrame:
    """(cluster, length_km, round_trip_min, line, path_source) where the graph has no way: the straight line between (x, y) and (to_x, to_y), lengthened by a factor."""
    km = F.hypot(F.col("to_x") - F.col("x"), F.col("to_y") - F.col("y")) / 1000.0 * detour
    line = F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y")), F.struct(F.col("to_x").alias("x"), F.col("to_y").alias("y")))
    return lost.select("cluster", km.alias("length_km"), (2 * km / km_h * 60.0 + layover).alias("round_trip_min"), line.alias("line"), F.lit(f"straight-line x {detour}").alias("path_source"))

"""From a street graph with evidence of service to extensions that reach what isn't served."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import graph, keyed, spatial
from fieldloom.runtime import materialise

LEVELS = {"none": 0, "low": 1, "medium": 2, "high": 3}


def infer(edges: DataFrame, segs: DataFrame, assets: DataFrame, reach: float = 30.0) -> DataFrame:
    """Edges with their best evidence: each asset (asset_id, x, y, level, note) is snapped to its nearest edge within reach."""
    hit = spatial.snap(assets, segs, reach, "asset_id", "edge_id").join(assets.select("asset_id", "level", "note"), "asset_id")
    rank = F.create_map(*(F.lit(v) for kv in LEVELS.items() for v in kv))
    part = hit.select("edge_id", F.sqrt("d2").alias("dist"), rank[F.col("level")].alias("rank"), "note")
    best = keyed.evidence([part], "edge_id")
    names = F.array(*(F.lit(k) for k in LEVELS))
    return edges.join(best, "edge_id", "left").select(*edges.columns, F.get(names, F.coalesce("level", F.lit(0))).alias("confidence"), F.coalesce("notes", F.array().cast("array<string>")).alias("evidence"))


def attached(developments: DataFrame, edges: DataFrame, segs: DataFrame, near: float = 50.0) -> DataFrame:
    """(app_id, nearest_edge, attached_to, distance_m, connected): the nearest edge of all, the nearest served one however far, and whether it is within `near`."""
    served = edges.where("confidence <> 'none'").select("edge_id")
    to = spatial.nearest_line(developments, segs.join(served, "edge_id", "left_semi"), "app_id", "edge_id").select("app_id", F.col("edge_id").alias("attached_to"), F.sqrt("d2").alias("distance_m"))
    any_edge = spatial.nearest_line(developments, segs, "app_id", "edge_id").select("app_id", F.col("edge_id").alias("nearest_edge"))
    return any_edge.join(to, "app_id").withColumn("connected", F.coalesce(F.col("distance_m") <= near, F.lit(False)))


def best_served(short: DataFrame) -> DataFrame:
    """(node, edge_id): at each node the served edge of the highest level, the greatest id of equals. short: (u, v, edge_id, confidence)."""
    rank = F.create_map(*(F.lit(v) for kv in LEVELS.items() for v in kv))[F.col("confidence")]
    on = short.where("confidence <> 'none'")
    ends = on.select(F.col("u").alias("node"), rank.alias("rank"), "edge_id").unionByName(on.select(F.col("v").alias("node"), rank.alias("rank"), "edge_id"))
    return ends.groupBy("node").agg(F.max(F.struct("rank", "edge_id")).alias("m")).select("node", "m.edge_id")


def extend(developments: DataFrame, nodes: DataFrame, edges: DataFrame, segs: DataFrame, near: float = 50.0) -> dict[str, DataFrame]:
    """Which developments are connected, and the edges that would connect the rest.

    developments (app_id, x, y, and units and residents if known), nodes (node, x, y), edges
    (edge_id, u, v, length, confidence), segs (edge_id, k, x1, y1, x2, y2). All served nodes are
    joined to one source at no cost; a Steiner tree over the source and the nodes of
    unconnected developments is walked from the source; edges that aren't served yet
    are extensions, with whom they serve and their place in the order of building.
    Of the unconnected, those whose node is served already need no new line and those
    whose node the source can't reach are listed as unreachable. `loads` adds up
    what falls on each served edge by the developments that hang on it.
    """
    near_by = materialise(attached(developments, edges, segs, near), "connected")
    todo = developments.join(near_by.where("NOT connected"), "app_id", "left_semi")
    terminal = materialise(spatial.nearest(todo, nodes, "app_id", "node").where("node IS NOT NULL").select("app_id", "node"), "terminals")
    short = materialise(graph.parallel_min(edges, ("edge_id", "confidence")), "short")
    on = short.where("confidence <> 'none'")
    kind = dict(short.dtypes)["u"]
    source = F.lit(-1).cast(kind)
    wet = materialise(on.select(F.col("u").alias("node")).unionByName(on.select(F.col("v").alias("node"))).distinct(), "served")
    virtual = wet.select(source.alias("u"), F.col("node").alias("v"), F.lit(0.0).alias("length"))
    g = materialise(short.select("u", "v", "length").unionByName(virtual), "graph")
    comp = graph.components(g)
    home = comp.where(F.col("node") == source).select("component")
    reachable = materialise(comp.join(home, "component", "left_semi").select("node"), "reachable")
    # Three ways: the node can't be reached, is served already, or is to be connected.
    lost = terminal.join(reachable, "node", "left_anti").select("app_id")
    there = terminal.join(wet, "node", "left_semi")
    goal = materialise(terminal.join(reachable, "node", "left_semi").join(wet, "node", "left_anti"), "goals")
    root = virtual.select(F.col("u").alias("node")).limit(1)
    tree = graph.steiner(g, goal.select("node").unionByName(root).distinct())
    walk = materialise(graph.bfs(tree, root), "walk")
    load = materialise(graph.path_accumulate(walk.select("node", "parent"), goal.select("node", "app_id")), "loads")
    up = walk.where("parent IS NOT NULL").select("node", "depth", F.least("node", "parent").alias("u"), F.greatest("node", "parent").alias("v"))
    new = up.join(short.where("confidence = 'none'"), ["u", "v"]).join(load, "node")
    size = developments.select("app_id", *((F.col(c) if c in developments.columns else F.lit(0).alias(c)) for c in ("units", "residents")))
    rows = new.select("edge_id", "length", "depth", "app_id").distinct().join(size, "app_id")
    ext = rows.groupBy("edge_id", "length").agg(F.min(F.col("depth") - 1).alias("ord"), F.array_sort(F.collect_set("app_id")).alias("serves_app_ids"), F.sum("units").alias("units_served"), F.sum("residents").alias("residents_served"))
    # A new line hangs on the served node its way to the source passes last; what it carries lands on that node's best served edge.
    best = best_served(short)
    ends = load.join(walk.where("depth = 1").select("node"), "node", "left_semi").select("app_id", "node").unionByName(there.select("app_id", "node")).join(best, "node").select("app_id", "edge_id")
    hung = near_by.where("connected").select("app_id", F.col("attached_to").alias("edge_id")).unionByName(ends).distinct()
    loads = hung.where("edge_id IS NOT NULL").join(size, "app_id").groupBy("edge_id").agg(F.sum("units").alias("new_units"), F.sum("residents").alias("new_residents"), F.array_sort(F.collect_set("app_id")).alias("new_app_ids"))
    return {"developments": near_by, "extensions": keyed.dense_order(ext, "ord"), "unreachable": lost, "served_already": there.select("app_id"), "loads": loads}


def served_totals(extensions: DataFrame, developments: DataFrame) -> DataFrame:
    """(app_id, route_m): how much new line each development depends on."""
    e = extensions.select("length", F.explode("serves_app_ids").alias("app_id"))
    return developments.select("app_id").join(e.groupBy("app_id").agg(F.sum("length").alias("route_m")), "app_id", "left")

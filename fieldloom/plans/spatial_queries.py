"""Planar joins, geometry, graphs and clusters as queries, with SQL where whole tables allow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import geo, measures
from fieldloom.operators import cluster, graph, spatial
from fieldloom.plans.bridge import ctes, view
from fieldloom.runtime import materialise, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def access(spark: SparkSession, sf: str) -> DataFrame:
    d = view(spark, sf, "b_dev")
    busy = view(spark, sf, "b_stop_time").where("departure_time >= '07:00:00' AND departure_time < '10:00:00'").groupBy("stop_id").agg(F.count("*").alias("n")).where("n >= 6")
    stops = view(spark, sf, "b_stop").select("stop_id", "x", "y").join(busy, "stop_id", "left_semi")
    n = spatial.nearest(d, stops, "dev_id", "stop_id")
    m = F.sqrt("d2")
    kind = F.when(m <= 400, "served").when(m <= 1000, "weak").otherwise("unserved")
    return n.select("dev_id", "stop_id", F.round(m, 6).alias("metres"), kind.alias("access"), measures.clipped(m / 10.0).alias("score"))


@query(ctes("b_dev", "b_stop", "b_stop_time") + """, busy AS (SELECT s.* FROM b_stop s JOIN (SELECT stop_id FROM b_stop_time WHERE departure_time >= '07:00:00' AND departure_time < '10:00:00' GROUP BY 1 HAVING count(*) >= 6) USING (stop_id)),
near AS (SELECT dev_id, s.stop_id, sqrt((d.x-s.x)*(d.x-s.x)+(d.y-s.y)*(d.y-s.y)) AS m, row_number() OVER (PARTITION BY dev_id ORDER BY (d.x-s.x)*(d.x-s.x)+(d.y-s.y)*(d.y-s.y), s.stop_id) AS k FROM b_dev d, busy s)
SELECT dev_id, stop_id, round(m, 6) AS metres, CASE WHEN m <= 400 THEN 'served' WHEN m <= 1000 THEN 'weak' ELSE 'unserved' END AS access, greatest(0.0, least(100.0, round(m / 10.0, 1))) AS score FROM near WHERE k = 1""")
def access_class(spark: SparkSession, sf: str) -> DataFrame:
    """For each development the nearest frequent stop, its class and score."""
    return access(spark, sf)


@query(ctes("b_dev", "b_school") + """SELECT dev_id, level, count(*) AS n, CAST(sum(enrolment) AS BIGINT) AS enrolment, string_agg(CAST(school_id AS VARCHAR), ',' ORDER BY school_id) AS schools
FROM b_dev d JOIN b_school s ON (d.x-s.x)*(d.x-s.x)+(d.y-s.y)*(d.y-s.y) <= 4000000.0 GROUP BY 1, 2""")
def school_catchment(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "b_school")
    hit = spatial.radius_join(view(spark, sf, "b_dev"), s, 2000.0, "dev_id", "school_id").join(s.select("school_id", "level", "enrolment"), "school_id")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("school_id")), lambda i: i.cast("string")), ",")
    return hit.groupBy("dev_id", "level").agg(F.count("*").alias("n"), F.sum("enrolment").alias("enrolment"), ids.alias("schools"))


@query(ctes("b_dev", "b_school") + """, hit AS (SELECT dev_id, school_id, num_units * 0.5 / count(*) OVER (PARTITION BY dev_id, level) AS share, enrolment FROM b_dev d JOIN b_school s ON (d.x-s.x)*(d.x-s.x)+(d.y-s.y)*(d.y-s.y) <= 4000000.0)
SELECT school_id, round(sum(share), 6) AS pupils, round(sum(share) / max(enrolment), 6) AS ratio FROM hit GROUP BY school_id""")
def school_pressure(spark: SparkSession, sf: str) -> DataFrame:
    """Each development's pupils split over the schools of a level in reach."""
    s, d = view(spark, sf, "b_school"), view(spark, sf, "b_dev")
    hit = spatial.radius_join(d, s, 2000.0, "dev_id", "school_id").join(s.select("school_id", "level", "enrolment"), "school_id").join(d.select("dev_id", "num_units"), "dev_id")
    n = hit.groupBy("dev_id", "level").agg(F.count("*").alias("n"))
    out = hit.join(n, ["dev_id", "level"]).groupBy("school_id").agg(F.sum(F.col("num_units") * 0.5 / F.col("n")).alias("p"), F.max("enrolment").alias("e"))
    return out.select("school_id", F.round("p", 6).alias("pupils"), F.round(F.try_divide(F.col("p"), F.col("e")), 6).alias("ratio"))


@query(ctes("b_dev", "b_school") + """SELECT dev_id, school_id, d2 FROM (SELECT dev_id, school_id, (d.x-s.x)*(d.x-s.x)+(d.y-s.y)*(d.y-s.y) AS d2,
row_number() OVER (PARTITION BY dev_id ORDER BY (d.x-s.x)*(d.x-s.x)+(d.y-s.y)*(d.y-s.y), school_id) AS k FROM b_dev d, b_school s) WHERE k = 1""")
def nearest_school(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.nearest(view(spark, sf, "b_dev"), view(spark, sf, "b_school"), "dev_id", "school_id")


@query(ctes("b_dev", "b_school") + """, m AS (SELECT dev_id, school_id, (d.x-s.x)*(d.x-s.x)+(d.y-s.y)*(d.y-s.y) AS d2 FROM b_dev d, b_school s WHERE (d.x-s.x)*(d.x-s.x)+(d.y-s.y)*(d.y-s.y) <= 1000000.0),
b AS (SELECT dev_id, school_id, d2, row_number() OVER (PARTITION BY dev_id ORDER BY d2, school_id) AS k FROM m) SELECT d.dev_id, b.school_id, b.d2 FROM b_dev d LEFT JOIN b ON b.dev_id = d.dev_id AND b.k = 1""")
def nearest_within(spark: SparkSession, sf: str) -> DataFrame:
    """With a largest distance; without a hit the row stays, with nulls."""
    return spatial.nearest(view(spark, sf, "b_dev"), view(spark, sf, "b_school"), "dev_id", "school_id", most=1000.0)


@query(ctes("b_stop", "b_dev") + "SELECT stop_id FROM b_stop s WHERE EXISTS (SELECT 1 FROM b_dev d WHERE (d.x-s.x)*(d.x-s.x)+(d.y-s.y)*(d.y-s.y) <= 250000.0)")
def distance_semi(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.within_of_any(view(spark, sf, "b_stop"), view(spark, sf, "b_dev"), 500.0, "stop_id").select("stop_id")


def _rings(spark: SparkSession, sf: str) -> DataFrame:
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return view(spark, sf, "b_area").select("area_id", F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1"), p("x0", "y0")).alias("ring"))


@query(ctes("b_dev", "b_area") + "SELECT dev_id, area_id FROM b_dev JOIN b_area ON x >= x0 AND x < x1 AND y >= y0 AND y < y1")
def pip_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Points in polygons by cells and crossings; a side belongs to one of its neighbours."""
    return spatial.in_regions(view(spark, sf, "b_dev"), _rings(spark, sf), "dev_id", "area_id", 4000.0)


@query(ctes("b_dev", "b_area") + """, far AS (SELECT dev_id, x + 7000.0 AS x, y + 3000.0 AS y FROM b_dev), d AS (SELECT dev_id, area_id, greatest(x0 - x, 0.0, x - x1) AS dx, greatest(y0 - y, 0.0, y - y1) AS dy,
x >= x0 AND x < x1 AND y >= y0 AND y < y1 AS held FROM far, b_area),
k AS (SELECT dev_id, area_id, CASE WHEN held THEN 0.0 ELSE dx*dx+dy*dy END AS d2, row_number() OVER (PARTITION BY dev_id ORDER BY held DESC, dx*dx+dy*dy, area_id) AS k FROM d)
SELECT dev_id, area_id, round(d2, 6) AS d2 FROM k WHERE k = 1""")
def nearest_area(spark: SparkSession, sf: str) -> DataFrame:
    """The area a point is in, else the one with the nearest side."""
    far = view(spark, sf, "b_dev").select("dev_id", (F.col("x") + 7000.0).alias("x"), (F.col("y") + 3000.0).alias("y"))
    return spatial.nearest_region(far, _rings(spark, sf), "dev_id", "area_id", 4000.0).select("dev_id", "area_id", F.round("d2", 6).alias("d2"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """A bent line at each school."""
    p = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    return view(spark, sf, "b_school").select("school_id", F.array(p(0.0, 0.0), p(800.0, 0.0), p(800.0, 600.0)).alias("line"))


_SEG = """, seg AS (SELECT school_id, x AS x1, y AS y1, x + 800.0 AS x2, y AS y2 FROM b_school UNION ALL SELECT school_id, x + 800.0, y, x + 800.0, y + 600.0 FROM b_school),
pd AS (SELECT dev_id, school_id, greatest(0.0, least(1.0, ((x-x1)*(x2-x1)+(y-y1)*(y2-y1)) / ((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)))) AS t, x, y, x1, y1, x2, y2 FROM b_dev, seg),
dd AS (SELECT dev_id, school_id, min((x-(x1+t*(x2-x1)))*(x-(x1+t*(x2-x1)))+(y-(y1+t*(y2-y1)))*(y-(y1+t*(y2-y1)))) AS d2 FROM pd GROUP BY 1, 2)
"""


@query(ctes("b_dev", "b_school") + _SEG + "SELECT dev_id, school_id, round(d2, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY dev_id ORDER BY d2, school_id) AS k FROM dd WHERE d2 <= 640000.0) WHERE k = 1")
def snap_to_line(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest line within 800 m of each point."""
    return spatial.snap(view(spark, sf, "b_dev"), spatial.segments(_lines(spark, sf), "school_id"), 800.0, "dev_id", "school_id").select("dev_id", "school_id", F.round("d2", 6).alias("d2"))


@query(ctes("b_dev", "b_school") + _SEG + "SELECT dev_id, school_id, round(sqrt(d2), 6) AS metres FROM (SELECT *, row_number() OVER (PARTITION BY dev_id ORDER BY d2, school_id) AS k FROM dd) WHERE k = 1")
def nearest_line(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest line of each point, however far, with its distance."""
    out = spatial.nearest_line(view(spark, sf, "b_dev"), spatial.segments(_lines(spark, sf), "school_id"), "dev_id", "school_id")
    return out.select("dev_id", "school_id", F.round(F.sqrt("d2"), 6).alias("metres"))


@query(ctes("b_dev", "b_school") + _SEG + "SELECT school_id, count(*) AS n FROM dd WHERE d2 <= 360000.0 GROUP BY school_id")
def near_line_counts(spark: SparkSession, sf: str) -> DataFrame:
    hit = spatial.points_near_segments(view(spark, sf, "b_dev"), spatial.segments(_lines(spark, sf), "school_id"), 600.0, "dev_id", "school_id")
    return hit.groupBy("school_id").agg(F.count("*").alias("n"))


@query(None)
def overlap_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Which part of each line runs along another."""
    a = spatial.segments(_lines(spark, sf), "school_id")
    b = a.select(F.col("school_id").alias("other_id"), "k", (F.col("x1") + 5).alias("x1"), (F.col("y1") + 9).alias("y1"), (F.col("x2") + 5).alias("x2"), (F.col("y2") + 9).alias("y2"))
    return spatial.overlap_share(a, b, 15.0, "school_id", "other_id").select("school_id", "other_id", F.round("share", 6).alias("share"))


@query(ctes("b_school") + """, seg AS (SELECT school_id, x AS x1, y AS y1, x + 800.0 AS x2, y AS y2 FROM b_school UNION ALL SELECT school_id, x + 800.0, y, x + 800.0, y + 600.0 FROM b_school)
SELECT DISTINCT a.school_id, b.school_id AS other_id FROM seg a JOIN seg b ON a.school_id < b.school_id
WHERE pow(greatest(a.x1 - b.x2, b.x1 - a.x2, 0.0), 2) + pow(greatest(a.y1 - b.y2, b.y1 - a.y2, 0.0), 2) <= 2250000.0""")
def lines_near_lines(spark: SparkSession, sf: str) -> DataFrame:
    a = spatial.segments(_lines(spark, sf), "school_id")
    return spatial.near_segments(a, a.withColumnRenamed("school_id", "other_id"), 1500.0, "school_id", "other_id").where("school_id < other_id")


@query(ctes("b_school") + "SELECT school_id, CAST(1400.0 AS DOUBLE) AS metres, round(x + 700.0, 6) AS x, round(y, 6) AS y, round(x + 800.0, 6) AS tx, round(y + 250.0, 6) AS ty FROM b_school")
def line_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Length and points along a line."""
    at = lambda f: geo.interpolate(F.col("line"), F.lit(f))
    s = _lines(spark, sf).select("school_id", F.round(geo.length(F.col("line")), 6).alias("metres"), at(0.5).alias("m"), at(1050.0 / 1400.0).alias("t"))
    r = lambda c, a: F.round(c, 6).alias(a)
    return s.select("school_id", "metres", r("m.x", "x"), r("m.y", "y"), r("t.x", "tx"), r("t.y", "ty"))


@query(ctes("b_dev") + "SELECT dev_id, round(x + num_units * 5.0 / 12.0, 6) AS cx, round(y + num_units / 4.0, 6) AS cy, CAST(num_units * num_units / 4.0 AS DOUBLE) AS area FROM b_dev")
def ring_measures(spark: SparkSession, sf: str) -> DataFrame:
    """Area of a triangle above each point as large as its units, and a point inside it."""
    u = F.col("num_units").cast("double")
    p = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    ring = F.array(p(F.lit(0.0), F.lit(0.0)), p(u, F.lit(0.0)), p(u / 3.0, u / 2.0), p(F.lit(0.0), F.lit(0.0)))
    # A small file is read in one task, however many rows it has: they are spread over the cores first.
    r = view(spark, sf, "b_dev").repartition("dev_id").select("dev_id", geo.area(ring).alias("area"), geo.inner_point(ring).alias("p"))
    # Half-way up, the triangle reaches from a sixth to two thirds of its foot.
    return r.select("dev_id", F.round(F.col("p.x"), 6).alias("cx"), F.round("p.y", 6).alias("cy"), F.round("area", 3).alias("area"))


@query(ctes("b_school") + """SELECT school_id, greatest(x, 710000.0) AS x1, least(x + 800.0, 740000.0) AS x2, y AS y1 FROM b_school WHERE x + 800.0 >= 710000.0 AND x <= 740000.0 AND y BETWEEN 725000.0 AND 755000.0""")
def clipped_lines(spark: SparkSession, sf: str) -> DataFrame:
    """First stretches cut to a box."""
    s = spatial.segments(_lines(spark, sf), "school_id").where("k = 0")
    c = s.select("school_id", geo.clip_step(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), (710000.0, 725000.0, 740000.0, 755000.0)).alias("c")).where("c IS NOT NULL")
    return c.select("school_id", F.round("c.x1", 6).alias("x1"), F.round("c.x2", 6).alias("x2"), F.col("c.y1").alias("y1"))


def _itm_sql() -> str:
    """Krüger's series over a table g (lng, lat, ...), as DuckDB computes it."""
    wave = lambda f, g: " + ".join(f"{a!r} * {f}({2 * j} * xi) * {g}({2 * j} * eta)" for j, a in enumerate(geo._ALPHA, 1))
    return f"""t AS (SELECT *, sinh(atanh(sin(radians(lat))) - {geo._E!r} * atanh({geo._E!r} * sin(radians(lat)))) AS t, radians(lng) - ({geo._LNG0!r}) AS d FROM g),
k AS (SELECT *, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM t),
m AS (SELECT *, {geo._FE!r} + {geo._K0 * geo._RADIUS!r} * (eta + {wave("cos", "sinh")}) AS x, {geo._FN!r} + {geo._K0 * geo._RADIUS!r} * (xi + {wave("sin", "cosh")} - ({geo._XI0!r})) AS y FROM k)"""


@query("WITH g AS (SELECT app_id, CAST(ingested_at AS VARCHAR) AS ingested_at, centroid[1] AS lng, centroid[2] AS lat FROM developments WHERE centroid[1] < 0 AND centroid[2] > 0), " + _itm_sql() + " SELECT app_id, ingested_at, round(x, 4) AS x, round(y, 4) AS y, round(lng, 6) AS lng, round(lat, 6) AS lat FROM m")
def itm_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Degrees to metres, and back."""
    d = table(spark, sf, "developments").where("get(centroid, 0) < 0 AND get(centroid, 1) > 0").select("app_id", F.col("ingested_at").cast("string").alias("ingested_at"), geo.to_itm(F.get("centroid", F.lit(0)), F.get("centroid", F.lit(1))).alias("m"))
    back = d.select("app_id", "ingested_at", "m", geo.from_itm(F.col("m.x"), F.col("m.y")).alias("g"))
    return back.select("app_id", "ingested_at", F.round("m.x", 4).alias("x"), F.round("m.y", 4).alias("y"), F.round("g.x", 6).alias("lng"), F.round("g.y", 6).alias("lat"))


_SUM = "list_sum(list_transform(range(1, len(ring)), lambda i: {}))"
_SHOE = _SUM.format("(ring[i].lng - ring[1].lng) * (ring[i + 1].lat - ring[1].lat) - (ring[i + 1].lng - ring[1].lng) * (ring[i].lat - ring[1].lat)")
_ROUND = _SUM.format("sqrt(pow(ring[i + 1].lng - ring[i].lng, 2) + pow(ring[i + 1].lat - ring[i].lat, 2))")


@query(f"SELECT small_area_id, count(*) AS n, max(CAST(len(ring) AS INTEGER)) AS corners, max(round(abs({_SHOE}) / 2, 9)) AS area, max(round({_ROUND}, 7)) AS metres FROM areas WHERE ring IS NOT NULL GROUP BY small_area_id")
def wkt_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Rings written as text and read again: corners, area and length."""
    ring = F.transform("ring", lambda p: F.struct(p.lng.alias("x"), p.lat.alias("y")))
    r = table(spark, sf, "areas").where("ring IS NOT NULL").select("small_area_id", geo.from_wkt(geo.to_wkt(ring)).alias("r"))
    return r.groupBy("small_area_id").agg(F.count("*").alias("n"), F.max(F.size("r")).alias("corners"), F.max(F.round(geo.area(F.col("r")), 9)).alias("area"), F.max(F.round(geo.length(F.col("r")), 7)).alias("metres"))


@query(ctes("b_dev") + "SELECT dev_id, round(x - 20, 6) AS west, CAST(1600.0 AS DOUBLE) AS area, CAST(num_units * 2 AS DOUBLE) AS turned, round(x - (abs(cos(num_units / 100.0)) * num_units / 2 + abs(sin(num_units / 100.0))), 6) AS turned_west FROM b_dev")
def footprints(spark: SparkSession, sf: str) -> DataFrame:
    """Squares and turned rectangles around points."""
    x, y, u = F.col("x"), F.col("y"), F.col("num_units")
    turned = geo.rectangle(x, y, u.cast("double"), F.lit(2.0), u / 100.0)
    west = lambda r: F.round(geo.box_of(r).x0, 6)
    return view(spark, sf, "b_dev").select("dev_id", west(geo.square(x, y)).alias("west"), F.round(geo.area(geo.square(x, y)), 3).alias("area"), F.round(geo.area(turned), 3).alias("turned"), west(turned).alias("turned_west"))


@query(ctes("b_edge") + "SELECT least(u, v) AS u, greatest(u, v) AS v, min(length) AS length FROM (SELECT * FROM b_edge UNION ALL SELECT v, u, length - (u % 3) FROM b_edge) GROUP BY 1, 2")
def parallel_edge_min(spark: SparkSession, sf: str) -> DataFrame:
    e = view(spark, sf, "b_edge")
    return graph.parallel_min(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), (F.col("length") - F.col("u") % 3).alias("length"))))


_NODES = "nodes AS (SELECT u AS node FROM b_edge UNION SELECT v FROM b_edge), "
_BOTH = "e AS (SELECT u, v, length FROM b_edge UNION ALL SELECT v, u, length FROM b_edge), "


def _marked(spark: SparkSession, sf: str, which: str) -> DataFrame:
    """Nodes of the street grid whose part has the wanted size."""
    e = view(spark, sf, "b_edge")
    nodes = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct()
    return nodes.join(table(spark, sf, "part").where(which).select(F.col("p_partkey").alias("node")), "node", "left_semi")


@query(ctes("b_edge").replace("WITH", "WITH RECURSIVE", 1) + """, e AS (SELECT u, v FROM b_edge WHERE length <= 90 UNION SELECT v, u FROM b_edge WHERE length <= 90),
reach(node, seen) AS (SELECT u, u FROM e UNION SELECT r.node, e.v FROM reach r JOIN e ON e.u = r.seen) SELECT node, min(seen) AS component FROM reach GROUP BY node""")
def graph_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components of the streets of at most 90 metres."""
    return graph.components(view(spark, sf, "b_edge").where("length <= 90"))


# On the whole grid of 50 columns hops are differences of rows and columns.
_HOPS = ctes("b_edge") + ", " + _NODES + """src AS (SELECT node AS s FROM nodes JOIN part ON p_partkey = node WHERE p_size = 1),
hop AS (SELECT node, s, abs(node % 50 - s % 50) + abs(floor(node / 50) - floor(s / 50)) AS d FROM nodes, src),
best AS (SELECT node, min(struct_pack(d := d, s := s)) AS m FROM hop GROUP BY node),
lab AS (SELECT node, CAST(m.d AS INTEGER) AS depth, m.s AS root FROM best),
ways AS (SELECT u, v FROM b_edge UNION SELECT v, u FROM b_edge),
up1 AS (SELECT a.node, min(b.node) AS parent FROM lab a JOIN ways w ON w.u = a.node JOIN lab b ON b.node = w.v AND b.depth = a.depth - 1 AND b.root = a.root GROUP BY a.node),
tree AS (SELECT a.node, a.depth, p.parent FROM lab a LEFT JOIN up1 p ON p.node = a.node)
"""


@query(_HOPS + "SELECT node, depth, parent FROM tree")
def bfs_depth(spark: SparkSession, sf: str) -> DataFrame:
    """Hops over the whole grid from the marked nodes."""
    return graph.bfs(view(spark, sf, "b_edge"), _marked(spark, sf, "p_size = 1"))


@query(ctes("b_edge").replace("WITH", "WITH RECURSIVE", 1) + ", " + _NODES + _BOTH + """way(k, node, dist, root) AS (SELECT 0, node, 0.0::DOUBLE, node FROM nodes JOIN part ON p_partkey = node WHERE p_size = 1
UNION ALL SELECT k + 1, node, dist, root FROM (SELECT k, node, dist, root, row_number() OVER (PARTITION BY node ORDER BY dist, root) AS n FROM
  (SELECT k, node, dist, root FROM way UNION ALL SELECT k, e.v, dist + length, root FROM way JOIN e ON e.u = way.node)) WHERE n = 1 AND k < 120)
SELECT node, round(dist, 6) AS dist, root FROM way WHERE k = 120""")
def sssp(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest marked node of every node, over the whole grid."""
    return graph.shortest_paths(view(spark, sf, "b_edge"), _marked(spark, sf, "p_size = 1")).select("node", F.round("dist", 6).alias("dist"), "root")


@query(_HOPS.replace("WITH", "WITH RECURSIVE", 1).rstrip() + """,
climb(node, load) AS (SELECT node, 1 FROM nodes JOIN part ON p_partkey = node WHERE p_size <= 8 UNION ALL SELECT t.parent, c.load FROM climb c JOIN tree t ON t.node = c.node WHERE t.parent IS NOT NULL)
SELECT node, CAST(sum(load) AS BIGINT) AS n_loads FROM climb GROUP BY node""")
def path_loads(spark: SparkSession, sf: str) -> DataFrame:
    """How many loads pass each node on their way to the root."""
    t = materialise(bfs_depth(spark, sf), "tree")
    loads = _marked(spark, sf, "p_size <= 8").withColumn("load", F.lit(1.0))
    return graph.path_sums(t.select("node", "parent"), loads).select("node", F.col("load").cast("long").alias("n_loads"))


@query(_HOPS.replace("WITH", "WITH RECURSIVE", 1).rstrip() + """,
climb(node, app_id) AS (SELECT node, node FROM nodes JOIN part ON p_partkey = node WHERE p_size = 2 UNION ALL SELECT t.parent, c.app_id FROM climb c JOIN tree t ON t.node = c.node WHERE t.parent IS NOT NULL)
SELECT DISTINCT node, app_id FROM climb""")
def path_members(spark: SparkSession, sf: str) -> DataFrame:
    """Which loads pass each node."""
    t = materialise(bfs_depth(spark, sf), "tree")
    return graph.path_accumulate(t.select("node", "parent"), _marked(spark, sf, "p_size = 2").withColumn("app_id", F.col("node")))


@query(None)
def steiner_tree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.steiner(view(spark, sf, "b_edge"), _marked(spark, sf, "p_size = 1"))


@query(ctes("b_site").replace("WITH", "WITH RECURSIVE", 1) + """, near AS (SELECT a.dev_id AS u, b.dev_id AS v FROM b_site a JOIN b_site b ON (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 160000.0),
core AS (SELECT u AS c FROM near GROUP BY u HAVING count(*) >= 3), dense AS (SELECT u, v FROM near WHERE u IN (SELECT c FROM core) AND v IN (SELECT c FROM core)),
reach(node, seen) AS (SELECT c, c FROM core UNION SELECT r.node, d.v FROM reach r JOIN dense d ON d.u = r.seen), lab AS (SELECT node, min(seen) AS cluster FROM reach GROUP BY node),
side AS (SELECT u, min(v) AS w FROM near WHERE v IN (SELECT c FROM core) GROUP BY u)
SELECT s.dev_id, coalesce(l.cluster, b.cluster) AS cluster FROM b_site s LEFT JOIN lab l ON l.node = s.dev_id LEFT JOIN side ON side.u = s.dev_id LEFT JOIN lab b ON b.node = side.w""")
def dbscan_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of sites with three within 400 metres, with their border sites; others are noise."""
    return cluster.dbscan(view(spark, sf, "b_site"), 400.0, 3, "dev_id")


@query(None)
def greedy_tour(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "b_school").select("school_id", "x", "y", F.floor(F.col("x") / 5000).alias("strip"))
    return cluster.greedy_tours(s, "strip", "school_id")


@query(ctes("b_area") + "SELECT area_id FROM b_area WHERE x1 >= 712000.0 AND x0 <= 731000.0 AND y1 >= 729000.0 AND y0 <= 741000.0")
def areas_in_box(spark: SparkSession, sf: str) -> DataFrame:
    return _rings(spark, sf).where(spatial.meets_box(F.col("ring"), (712000.0, 729000.0, 731000.0, 741000.0))).select("area_id")


@query(ctes("b_school", "b_area") + """SELECT DISTINCT school_id, area_id FROM (SELECT school_id, x AS sx0, y AS sy0, x + 800.0 AS sx1, y AS sy1 FROM b_school UNION ALL SELECT school_id, x + 800.0, y, x + 800.0, y + 600.0 FROM b_school) s
JOIN b_area ON sx1 >= x0 AND sx0 <= x1 AND sy1 >= y0 AND sy0 <= y1""")
def lines_in_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Lines against polygons they cross or lie in, touching included."""
    return spatial.lines_in_regions(spatial.segments(_lines(spark, sf), "school_id"), _rings(spark, sf), "school_id", "area_id", 2000.0)


@query(ctes("b_stop") + "SELECT split_part(stop_name, ' ', 1) AS word, count(*) AS n, max(x) - min(x) AS width FROM b_stop GROUP BY 1 HAVING sqrt((max(x)-min(x))*(max(x)-min(x)) + (max(y)-min(y))*(max(y)-min(y))) <= 64000.0")
def name_extents(spark: SparkSession, sf: str) -> DataFrame:
    """Names whose places lie close enough together to be one."""
    s = view(spark, sf, "b_stop").withColumn("word", F.split_part("stop_name", F.lit(" "), F.lit(1)))
    return spatial.extents(s, "word", 64000.0).select("word", "n", (F.col("x1") - F.col("x0")).alias("width"))

import math

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import geo, measures, text

PTS = "array<struct<x:double,y:double>>"


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def ring(spark, pts, extra=None):
    return spark.createDataFrame([([{"x": float(x), "y": float(y)} for x, y in pts],)], f"r {PTS}")


def test_itm_known_points(spark):
    # The projection's own origin, and a published control point of the national grid.
    o = one(spark, geo.to_itm(F.lit(-8.0), F.lit(53.5)))
    assert abs(o.x - 600000) < 1e-6 and abs(o.y - 750000) < 1e-6
    p = one(spark, geo.to_itm(F.lit(-6.2603), F.lit(53.3498)))
    assert abs(p.x - 715830) < 60 and abs(p.y - 734697) < 60
    b = one(spark, geo.from_itm(F.lit(p.x), F.lit(p.y)))
    assert abs(b.x + 6.2603) < 1e-9 and abs(b.y - 53.3498) < 1e-9


def test_rings(spark):
    d = ring(spark, [(0, 0), (10, 0), (10, 10), (5, 2), (0, 10), (0, 0)])
    r = d.select(geo.area(F.col("r")).alias("a"), geo.contains(F.col("r"), F.lit(5.0), F.lit(1.0)).alias("i"), geo.contains(F.col("r"), F.lit(5.0), F.lit(5.0)).alias("o"), geo.inner_point(F.col("r")).alias("p"), geo.from_wkt(geo.to_wkt(F.col("r"))).alias("w"), geo.box_of(F.col("r")).alias("b")).first()
    assert r.a == 60 and r.i and not r.o and len(r.w) == 6 and (r.b.x0, r.b.y1) == (0, 10)
    assert d.select(geo.contains(F.col("r"), F.lit(r.p.x), F.lit(r.p.y)).alias("v")).first().v


def test_lines(spark):
    d = ring(spark, [(0, 0), (3, 4), (3, 10)])
    r = d.select(geo.length(F.col("r")).alias("n"), geo.interpolate(F.col("r"), F.lit(8 / 11)).alias("p"), geo.interpolate(F.col("r"), F.lit(0.0)).alias("s"), geo.interpolate(F.col("r"), F.lit(1.0)).alias("e")).first()
    assert r.n == 11 and (round(r.p.x, 9), round(r.p.y, 9)) == (3, 7) and (r.s.x, r.s.y) == (0, 0) and (r.e.x, r.e.y) == (3, 10)
    assert ring(spark, [(1, 1)]).select(geo.length(F.col("r")).alias("n")).first().n == 0
    assert geo.peucker([(0, 0), (1, 0.1), (2, -0.1), (3, 5), (4, 6)], 1.0) == [(0, 0), (2, -0.1), (4, 6)]


def test_clip(spark):
    box = (0.0, 0.0, 10.0, 10.0)
    clip = lambda *v: one(spark, geo.clip_step(*(F.lit(float(x)) for x in v), box))
    assert tuple(clip(-5, 5, 15, 5)) == (0, 5, 10, 5)
    assert clip(-5, 11, 15, 11) is None and tuple(clip(2, 2, 2, 2)) == (2, 2, 2, 2) and clip(20, 0, 20, 5) is None


def test_parts_and_box(spark):
    d = spark.createDataFrame([([[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}, {"x": 0.0, "y": 0.0}], [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 4.0, "y": 4.0}, {"x": 0.0, "y": 0.0}]],)], f"p array<{PTS}>")
    assert d.select(geo.largest_part(F.col("p")).alias("v")).first().v.area == 8
    w, s, e, n = geo.padded_box(-8, 53, -7, 54, 1000)
    assert math.isclose(s, 53 - 1000 / 111320) and w < -8.01


@pytest.mark.parametrize("a,n,want", [("North Vale County Council", " 12/3 ", "NVCC-12/3"), (None, "9", "X-9"), ("  ", "9", "X-9"), ("4th Élan", "1", "É-1")])
def test_initials(spark, a, n, want):
    d = spark.createDataFrame([(a, n)], "a string, n string")
    assert d.select(text.initials_id(F.col("a"), F.col("n")).alias("v")).first().v == want


def test_street_text(spark):
    d = spark.createDataFrame([("St. Mary's Rd",), ("Main St Upr",), (None,), ("",)], "s string")
    r = [x.v for x in d.select(text.norm_street(F.col("s")).alias("v")).collect()]
    assert r == ["SAINT MARYS ROAD", "MAIN STREET UPPER", None, None]
    k = d.where("s = 'Main St Upr'").select(text.street_keys(F.col("s")).alias("v")).first().v
    assert k == ["MAIN STREET UPPER", "MAIN STREET UPPER", "MAIN STREET", "MAIN"]
    assert one(spark, text.label(F.array(F.lit("b"), F.lit(""), F.lit(None), F.lit("a"), F.lit("b")))) == "b / a"
    assert one(spark, text.leading_capitals(F.lit("MAIN STREET Oldtown 2"))) == "MAIN STREET"
    assert one(spark, text.split_list(F.lit("7; 4,7 ,"))) == ["4", "7"]
    assert one(spark, text.any_match(F.lit("4 ÉTAGE units"), [r"\b\w+ units"])) and not one(spark, text.any_match(F.lit(None).cast("string"), ["x"]))


def test_html(spark):
    page = "<table><tr><th>Name<th></th></tr></table>"
    page = "<p><TABLE a=b><tr><th>Name</th><th>N</th></tr><tr><td> </td><td></td></tr><tr><td>A &amp; <i>B</i></td><td>7</td></tr></TABLE>"
    assert one(spark, text.html_records(F.lit(page))) == [{"Name": "A & B", "N": "7"}]
    assert one(spark, text.html_rows(F.lit("no table"))) == []


def test_measures(spark):
    d = spark.createDataFrame([(10, 2.5, None), (10, None, None), (10, float("nan"), 0.0), (3, 0.0, 5.0)], "u int, h double, z double")
    assert [r.v for r in d.select(measures.residents(F.col("u"), F.col("h"), 2.7).alias("v")).collect()] == [25, 27, 27, 8]
    assert [r.v for r in d.select(measures.clipped(F.col("z") * 30).alias("v")).collect()] == [100, 100, 0, 100]
    assert [r.v for r in d.select(measures.blended([F.col("z"), F.col("u") * 1.0]).alias("v")).collect()][0] == 10
    assert one(spark, measures.step(F.lit(41), [(5, 50.0), (40, 80.0), (100, 100.0)], F.lit(9.0))) == 100
    assert one(spark, measures.least_not_below(F.lit(151.0), [100, 150, 200])) == 200
    assert one(spark, measures.headway(F.lit(300.0), 72.0, 5.0, 20.0)) == 12
    assert one(spark, measures.growth(F.lit(5.0), F.lit(0))) is None
    assert abs(one(spark, measures.velocity(F.lit(10.0), F.lit(150.0))) - 0.01 / (math.pi * 0.075**2)) < 1e-12


def test_ring_functions_name_their_ring_once(spark):
    # Within lambdas Spark computes an expression as often as it is named.
    r = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("a", "a"), ("b", "a"), ("b", "b"), ("a", "b"), ("a", "a"))))
    d = spark.createDataFrame([(0.0, 6.0), (None, 6.0), (2.0, 2.0)], "a double, b double")
    for f in (geo.area, geo.inner_point):
        assert d.select(f(r).alias("v"))._jdf.queryExecution().optimizedPlan().toString().count("array(struct(") <= 1
        assert d.select(f(F.lit(None).cast(geo.LINE)).alias("v")).first().v is None
    assert [tuple(x.p) if x.p else None for x in d.select(geo.inner_point(r).alias("p")).collect()] == [(3.0, 3.0), None, None]

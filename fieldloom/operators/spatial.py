"""Planar joins in metres on a grid: radius, nearest, segments, regions, overlap.

Each join turns a distance predicate into an equi-join on grid cells plus an
exact residual, so Catalyst shuffles by cell and nothing is compared with
everything. Cells are as wide as the reach, and the side that is copied to the
neighbouring cells is the one with fewer rows by the caller's choice (the right).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import geo
from fieldloom.operators import boxtree
from fieldloom.runtime import materialise, unsent


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def _around(size: float) -> list[Column]:
    near = F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long"))
    return [F.explode(F.transform(near, lambda d: _cell(F.col("x2"), size) + d)).alias("gx"), F.explode(F.transform(near, lambda d: _cell(F.col("y2"), size) + d)).alias("gy")]


def radius_join(left: DataFrame, right: DataFrame, radius: float, left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id, d2): all pairs at most `radius` apart, inclusive. Both sides need x and y; rows without a position pair with nothing."""
    a = left.where("x IS NOT NULL AND y IS NOT NULL").select(F.col(left_id), F.col("x").alias("x1"), F.col("y").alias("y1"), _cell(F.col("x"), radius).alias("gx"), _cell(F.col("y"), radius).alias("gy"))
    gx, gy = _around(radius)
    b = right.where("x IS NOT NULL AND y IS NOT NULL").select(F.col(right_id), F.col("x").alias("x2"), F.col("y").alias("y2")).select("*", gx).select("*", gy)
    d = geo.d2(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return a.join(b, ["gx", "gy"]).select(left_id, right_id, d.alias("d2")).where(F.col("d2") <= float(radius) * float(radius))


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, most: float | None = None) -> DataFrame:
    """(left_id, right_id, d2): for each left row the nearest right row, the smallest id of equals; nulls if it has no position or none is within `most`.

    By trees of boxes over blocks of the right side, whatever the distances are; see `boxtree`.
    """
    items = right.select(right_id, F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return left.select(left_id).join(boxtree.nearest(left, items, left_id, right_id, most), left_id, "left")


def nearest_line(points: DataFrame, segs: DataFrame, point_id: str, line_id: str, most: float | None = None) -> DataFrame:
    """(point_id, line_id, d2): as `nearest`, for lines given as segments: the nearest line however far, with its distance."""
    return points.select(point_id).join(boxtree.nearest(points, segs.select(line_id, "x1", "y1", "x2", "y2"), point_id, line_id, most), point_id, "left")


def within_of_any(left: DataFrame, right: DataFrame, radius: float, left_id: str) -> DataFrame:
    """The left rows with any right row within `radius`: a semi-join, where buffers would be merged elsewhere."""
    r = right.withColumn("_r", F.monotonically_increasing_id())
    hit = radius_join(left, r, radius, left_id, "_r").select(left_id).distinct()
    return left.join(hit, left_id, "left_semi")


def segments(lines: DataFrame, line_id: str, line: str = "line") -> DataFrame:
    """(line_id, k, x1, y1, x2, y2) of lines given as arrays of points."""
    return lines.select(line_id, F.posexplode(geo.steps(F.col(line))).alias("k", "s")).select(line_id, "k", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))


def _along(x1: Column, y1: Column, x2: Column, y2: Column, grow: float, size: float) -> Column:
    """The cells (gx, gy) within `grow` of a segment, each once. The segment is followed in steps of a cell, so their number is in proportion to its length."""
    n = F.greatest(F.ceil(F.hypot(x2 - x1, y2 - y1) / size), F.lit(1)).cast("int")

    def step(i: Column) -> Column:
        u, v = i / n, (i + 1) / n
        ax, bx, ay, by = x1 + (x2 - x1) * u, x1 + (x2 - x1) * v, y1 + (y2 - y1) * u, y1 + (y2 - y1) * v
        # A millionth of a cell more covers what rounding of the steps' ends may lose.
        g = grow + size * 1e-6
        gx = F.sequence(_cell(F.least(ax, bx) - g, size), _cell(F.greatest(ax, bx) + g, size))
        gy = F.sequence(_cell(F.least(ay, by) - g, size), _cell(F.greatest(ay, by) + g, size))
        return F.flatten(F.transform(gx, lambda p: F.transform(gy, lambda q: F.struct(p.alias("gx"), q.alias("gy")))))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), step)))


def _in_cells(segs: DataFrame, names: tuple[str, str, str, str], grow: float, size: float) -> DataFrame:
    """The segments with a row for each of their cells; those with a null end have none."""
    ends = [F.col(c) for c in names]
    some = segs.where(" AND ".join(f"{c} IS NOT NULL" for c in names))
    return some.select("*", F.explode(_along(*ends, grow, size)).alias("_g")).select("*", "_g.gx", "_g.gy").drop("_g")


def _cell_size(segs: DataFrame, reach: float) -> float:
    """A width of cells that makes no more rows than a few for most segments: the reach, or if that is larger a quarter of their median length."""
    n = segs.agg(F.percentile_approx(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), 0.5)).first()[0]
    return max(reach, (n or 0.0) / 4) if (n or 0.0) < float("inf") else reach


def _boxes_within(r: float) -> Column:
    """Whether the boxes of segments x1 .. y2 and ox1 .. oy2 are at most `r` apart on either axis: what is cheap to rule out first."""
    apart = lambda a, b: F.greatest(F.least(f"o{a}", f"o{b}") - F.greatest(a, b), F.least(a, b) - F.greatest(f"o{a}", f"o{b}"))
    # Rounding of what is decided exactly afterwards may not lose a pair here.
    return (apart("x1", "x2") <= r * (1 + 1e-9) + 1e-6) & (apart("y1", "y2") <= r * (1 + 1e-9) + 1e-6)


def points_near_segments(points: DataFrame, segs: DataFrame, radius: float, point_id: str, line_id: str) -> DataFrame:
    """(point_id, line_id, d2): points at most `radius` from a line, with the least distance over the line's segments."""
    r = float(radius)
    s = _in_cells(segs, ("x1", "y1", "x2", "y2"), r, r)
    p = points.where("x IS NOT NULL AND y IS NOT NULL").select(point_id, F.col("x").alias("px"), F.col("y").alias("py"), _cell(F.col("x"), r).alias("gx"), _cell(F.col("y"), r).alias("gy"))
    d = geo.segment_d2(*(F.col(c) for c in ("px", "py", "x1", "y1", "x2", "y2")))
    return p.join(s, ["gx", "gy"]).withColumn("d2", d).where(F.col("d2") <= r * r).groupBy(point_id, line_id).agg(F.min("d2").alias("d2"))


def snap(points: DataFrame, segs: DataFrame, radius: float, point_id: str, line_id: str) -> DataFrame:
    """(point_id, line_id, d2): the nearest line within `radius`, the smallest id of equals; points without one are left out."""
    return boxtree.nearest(points, segs.select(line_id, "x1", "y1", "x2", "y2"), point_id, line_id, radius)


def in_regions(points: DataFrame, regions: DataFrame, point_id: str, region_id: str, cell: float, ring: str = "ring") -> DataFrame:
    """(point_id, region_id): points inside closed rings, by cells of the rings' boxes and then crossings."""
    b = geo.box_of(F.col(ring))
    r = regions.where(F.size(ring) >= 4).select(region_id, F.col(ring).alias("ring"), b.alias("b"))
    span = lambda lo, hi: F.explode(F.sequence(_cell(F.col(f"b.{lo}"), cell), _cell(F.col(f"b.{hi}"), cell)))
    r = r.select(region_id, "ring", span("x0", "x1").alias("gx"), "b").select(region_id, "ring", "gx", span("y0", "y1").alias("gy"))
    p = points.where("x IS NOT NULL AND y IS NOT NULL").select(point_id, "x", "y", _cell(F.col("x"), cell).alias("gx"), _cell(F.col("y"), cell).alias("gy"))
    return p.join(r, ["gx", "gy"]).where(geo.contains(F.col("ring"), F.col("x"), F.col("y"))).select(point_id, region_id).distinct()


def nearest_region(points: DataFrame, regions: DataFrame, point_id: str, region_id: str, cell: float, ring: str = "ring") -> DataFrame:
    """(point_id, region_id, d2): the region a point is in (distance 0), else the one with the nearest side."""
    inside = in_regions(points, regions, point_id, region_id, cell, ring).groupBy(point_id).agg(F.min(region_id).alias(region_id)).withColumn("d2", F.lit(0.0))
    inside = materialise(inside, "inside")
    todo = materialise(points.where("x IS NOT NULL AND y IS NOT NULL").join(inside, point_id, "left_anti").select(point_id, "x", "y"), "outside")
    sides = boxtree.nearest(todo, segments(regions, region_id, ring), point_id, region_id)
    return inside.unionByName(sides.select(inside.columns))


def overlap_share(lines: DataFrame, others: DataFrame, radius: float, line_id: str, other_id: str) -> DataFrame:
    """(line_id, other_id, share): which part of each line's length is within `radius` of each other line.

    Both sides are segments. A stretch within a segment's capsule is an interval of
    the segment's parameter, found exactly: the distance to a segment is convex
    along a line, so the stretch is bounded by where it meets the band's edges and
    the two end circles. Overlapping stretches are merged before they are summed.
    """
    r = float(radius)
    a = lines.select(F.col(line_id), F.col("k").alias("k"), *(F.col(c).alias(c) for c in ("x1", "y1", "x2", "y2")))
    b = others.select(F.col(other_id), F.col("k").alias("ok"), *(F.col(c).alias("o" + c) for c in ("x1", "y1", "x2", "y2")))
    cell = _cell_size(a, r)
    ga = _in_cells(a, ("x1", "y1", "x2", "y2"), 0.0, cell)
    gb = _in_cells(b, ("ox1", "oy1", "ox2", "oy2"), r, cell)
    met = ga.join(unsent(gb), ["gx", "gy"]).where(_boxes_within(r)).drop("gx", "gy").distinct()
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    ex, ey = F.col("ox2") - F.col("ox1"), F.col("oy2") - F.col("oy1")
    e2 = ex * ex + ey * ey
    # In the band: along the other segment between its ends, and across within r. Both are linear in t.
    along0, along1 = ((F.col("x1") - F.col("ox1")) * ex + (F.col("y1") - F.col("oy1")) * ey), (dx * ex + dy * ey)
    across0, across1 = ((F.col("x1") - F.col("ox1")) * ey - (F.col("y1") - F.col("oy1")) * ex), (dx * ey - dy * ex)
    wide = F.sqrt(e2) * r

    def strip(c0: Column, c1: Column, low: Column, high: Column) -> tuple[Column, Column]:
        u, v = F.try_divide(low - c0, c1), F.try_divide(high - c0, c1)
        inside = (c0 >= low) & (c0 <= high)
        lo = F.when(c1 == 0, F.when(inside, F.lit(0.0)).otherwise(F.lit(2.0))).otherwise(F.least(u, v))
        hi = F.when(c1 == 0, F.when(inside, F.lit(1.0)).otherwise(F.lit(-1.0))).otherwise(F.greatest(u, v))
        return lo, hi

    (l1, h1), (l2, h2) = strip(along0, along1, F.lit(0.0), e2), strip(across0, across1, -wide, wide)
    band = F.struct(F.greatest(l1, l2, F.lit(0.0)).alias("lo"), F.least(h1, h2, F.lit(1.0)).alias("hi"))

    def circle(cx: str, cy: str) -> Column:
        fx, fy = F.col("x1") - F.col(cx), F.col("y1") - F.col(cy)
        qa, qb, qc = dx * dx + dy * dy, 2.0 * (fx * dx + fy * dy), fx * fx + fy * fy - r * r
        disc = qb * qb - 4.0 * qa * qc
        root = F.sqrt(F.greatest(disc, F.lit(0.0)))
        lo = F.when((disc < 0) | (qa == 0), F.lit(2.0)).otherwise(F.greatest(F.try_divide(-qb - root, 2.0 * qa), F.lit(0.0)))
        hi = F.when((disc < 0) | (qa == 0), F.lit(-1.0)).otherwise(F.least(F.try_divide(-qb + root, 2.0 * qa), F.lit(1.0)))
        return F.struct(lo.alias("lo"), hi.alias("hi"))

    parts = F.filter(F.array(band, circle("ox1", "oy1"), circle("ox2", "oy2")), lambda p: p.lo <= p.hi)
    # The capsule is convex, so its parts along a line are one stretch.
    stretch = F.struct(F.array_min(F.transform(parts, lambda p: p.lo)).alias("lo"), F.array_max(F.transform(parts, lambda p: p.hi)).alias("hi"))
    got = met.where(F.size(parts) > 0).groupBy(line_id, other_id, "k", F.sqrt(dx * dx + dy * dy).alias("len")).agg(F.array_sort(F.collect_list(stretch)).alias("s"))
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(-1.0).alias("end"))
    merged = F.aggregate("s", zero, lambda acc, p: F.struct((acc.sum + F.greatest(F.lit(0.0), p.hi - F.greatest(p.lo, acc.end))).alias("sum"), F.greatest(acc.end, p.hi).alias("end"))).sum
    total = a.groupBy(line_id).agg(F.sum(F.sqrt(dx * dx + dy * dy)).alias("total"))
    return got.groupBy(line_id, other_id).agg(F.sum(F.col("len") * merged).alias("near")).join(total, line_id).where("total > 0").select(line_id, other_id, (F.col("near") / F.col("total")).alias("share"))


def near_segments(lines: DataFrame, others: DataFrame, radius: float, line_id: str, other_id: str) -> DataFrame:
    """(line_id, other_id) of lines (as segments) that come within `radius` of each other, crossings included."""
    r = float(radius)
    a = lines.select(F.col(line_id), *(F.col(c).alias(c) for c in ("x1", "y1", "x2", "y2")))
    b = others.select(F.col(other_id), *(F.col(c).alias("o" + c) for c in ("x1", "y1", "x2", "y2")))
    ga = _in_cells(a, ("x1", "y1", "x2", "y2"), 0.0, r)
    gb = _in_cells(b, ("ox1", "oy1", "ox2", "oy2"), r, r)
    c = {k: F.col(k) for k in ("x1", "y1", "x2", "y2", "ox1", "oy1", "ox2", "oy2")}
    side = lambda px, py, qx, qy, sx, sy: (c[qx] - c[px]) * (c[sy] - c[py]) - (c[qy] - c[py]) * (c[sx] - c[px])
    cross = (side("x1", "y1", "x2", "y2", "ox1", "oy1") * side("x1", "y1", "x2", "y2", "ox2", "oy2") < 0) & (side("ox1", "oy1", "ox2", "oy2", "x1", "y1") * side("ox1", "oy1", "ox2", "oy2", "x2", "y2") < 0)
    near = [geo.segment_d2(*(c[k] for k in ks)) <= r * r for ks in (("x1", "y1", "ox1", "oy1", "ox2", "oy2"), ("x2", "y2", "ox1", "oy1", "ox2", "oy2"), ("ox1", "oy1", "x1", "y1", "x2", "y2"), ("ox2", "oy2", "x1", "y1", "x2", "y2"))]
    # Most that are near have a near end: the first found settles a pair.
    close = reduce(or_, [F.coalesce(x, F.lit(False)) for x in near]) | cross
    return ga.join(unsent(gb), ["gx", "gy"]).where(_boxes_within(r)).where(close).select(line_id, other_id).distinct()


def meets_box(ring: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a closed ring and a box have a point in common: a side enters the box, or the box lies within the ring."""
    enters = F.exists(geo.steps(ring), lambda s: geo.clip_step(s.a.x, s.a.y, s.b.x, s.b.y, box).isNotNull())
    return enters | geo.contains(ring, F.lit(float(box[0])), F.lit(float(box[1])))


def lines_in_regions(lines: DataFrame, regions: DataFrame, line_id: str, region_id: str, cell: float, ring: str = "ring") -> DataFrame:
    """(line_id, region_id) of lines (as segments) that touch a region: a side crossed, or an end inside."""
    sides = segments(regions, region_id, ring).select(F.col(region_id), *(F.col(c).alias("o" + c) for c in ("x1", "y1", "x2", "y2")))
    ga = _in_cells(lines.select(line_id, "x1", "y1", "x2", "y2"), ("x1", "y1", "x2", "y2"), 0.0, float(cell))
    gb = _in_cells(sides, ("ox1", "oy1", "ox2", "oy2"), 0.0, float(cell))
    c = {k: F.col(k) for k in ("x1", "y1", "x2", "y2", "ox1", "oy1", "ox2", "oy2")}
    side = lambda px, py, qx, qy, sx, sy: (c[qx] - c[px]) * (c[sy] - c[py]) - (c[qy] - c[py]) * (c[sx] - c[px])
    cross = (side("x1", "y1", "x2", "y2", "ox1", "oy1") * side("x1", "y1", "x2", "y2", "ox2", "oy2") <= 0) & (side("ox1", "oy1", "ox2", "oy2", "x1", "y1") * side("ox1", "oy1", "ox2", "oy2", "x2", "y2") <= 0)
    boxes = (F.greatest("x1", "x2") >= F.least("ox1", "ox2")) & (F.greatest("ox1", "ox2") >= F.least("x1", "x2")) & (F.greatest("y1", "y2") >= F.least("oy1", "oy2")) & (F.greatest("oy1", "oy2") >= F.least("y1", "y2"))
    crossed = ga.join(gb, ["gx", "gy"]).where(cross & boxes).select(line_id, region_id)
    a = lines.select(line_id, F.col("x1").alias("x"), F.col("y1").alias("y")).unionByName(lines.select(line_id, F.col("x2").alias("x"), F.col("y2").alias("y")))
    return crossed.union(in_regions(a, regions, line_id, region_id, cell, ring).select(line_id, region_id)).distinct()


def lines_near_regions(lines: DataFrame, regions: DataFrame, radius: float, line_id: str, region_id: str, ring: str = "ring") -> DataFrame:
    """(line_id, region_id) of lines (as segments) within `radius` of a region: of its side, or inside it."""
    sides = near_segments(lines, segments(regions, region_id, ring), radius, line_id, region_id)
    ends = lines.select(line_id, F.col("x1").alias("x"), F.col("y1").alias("y"))
    return sides.union(in_regions(ends, regions, line_id, region_id, max(float(radius), 1.0), ring).select(line_id, region_id)).distinct()


def extents(points: DataFrame, key: str, most: float | None = None) -> DataFrame:
    """(key, n, x0, y0, x1, y1, diagonal) of each key's points; with `most`, keys spread wider are left out."""
    out = points.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    out = out.withColumn("diagonal", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    return out if most is None else out.where(F.col("diagonal") <= most)

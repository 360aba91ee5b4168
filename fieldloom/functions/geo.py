"""Geometry as Column expressions: projection, distances, lines, rings, text forms.

A point is struct(x, y); a line or ring an array of points. All functions are
null in, null out, and stay in the JVM except `simplify`.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
LINE = f"array<{POINT}>"

# Irish Transverse Mercator on GRS80: published, fixed values.
_A, _INV_F = 6378137.0, 298.257222101
_LAT0, _LNG0, _K0, _FE, _FN = math.radians(53.5), math.radians(-8.0), 0.99982, 600000.0, 750000.0
_N = 1 / (2 * _INV_F - 1)
_E = math.sqrt(4 * _N) / (1 + _N)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)


def _series() -> tuple[list[float], list[float]]:
    """Krüger's forward and inverse coefficients to the fourth power of the third flattening."""
    n = _N
    alpha = [n / 2 - 2 / 3 * n**2 + 5 / 16 * n**3 + 41 / 180 * n**4, 13 / 48 * n**2 - 3 / 5 * n**3 + 557 / 1440 * n**4, 61 / 240 * n**3 - 103 / 140 * n**4, 49561 / 161280 * n**4]
    beta = [n / 2 - 2 / 3 * n**2 + 37 / 96 * n**3 - 1 / 360 * n**4, 1 / 48 * n**2 + 1 / 15 * n**3 - 437 / 1440 * n**4, 17 / 480 * n**3 - 37 / 840 * n**4, 4397 / 161280 * n**4]
    return alpha, beta


_ALPHA, _BETA = _series()


def _xi0() -> float:
    t = math.sinh(math.atanh(math.sin(_LAT0)) - _E * math.atanh(_E * math.sin(_LAT0)))
    xi = math.atan(t)
    return xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(_ALPHA))


_XI0 = _xi0()


def to_itm(lng: Column, lat: Column) -> Column:
    """Degrees on WGS84 to struct(x, y) in metres."""
    p, d = F.radians(lat), F.radians(lng) - _LNG0
    t = F.sinh(F.atanh(F.sin(p)) - _E * F.atanh(_E * F.sin(p)))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((_FE + _K0 * _RADIUS * x).alias("x"), (_FN + _K0 * _RADIUS * (y - _XI0)).alias("y"))


def from_itm(x: Column, y: Column) -> Column:
    """Metres to struct(x: longitude, y: latitude) in degrees."""
    xi, eta = (y - _FN) / (_K0 * _RADIUS) + _XI0, (x - _FE) / (_K0 * _RADIUS)
    u, v = xi, eta
    for j, b in enumerate(_BETA, 1):
        u = u - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    # Conformal to geodetic latitude by fixed-point steps; each gains two digits or more.
    lat = chi
    for _ in range(5):
        lat = F.atan(F.sinh(F.asinh(F.tan(chi)) + _E * F.atanh(_E * F.sin(lat))))
    return F.struct(F.degrees(_LNG0 + F.atan2(F.sinh(v), F.cos(u))).alias("x"), F.degrees(lat).alias("y"))


def padded_box(w: float, s: float, e: float, n: float, metres: float) -> tuple[float, float, float, float]:
    """A box in degrees grown by metres on every side."""
    dy = metres / 111_320.0
    dx = dy / math.cos(math.radians((s + n) / 2))
    return w - dx, s - dy, e + dx, n + dy


def in_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Inclusive on all sides."""
    w, s, e, n = box
    return x.between(w, e) & y.between(s, n)


def d2(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def segment_d2(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared distance of a point to a segment; a segment without length is its point."""
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((px - x1) * dx + (py - y1) * dy, n))), F.lit(0.0))
    return d2(px, py, x1 + t * dx, y1 + t * dy)


def closest_on_segment(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide((px - x1) * dx + (py - y1) * dy, dx * dx + dy * dy))), F.lit(0.0))
    return F.struct((x1 + t * dx).alias("x"), (y1 + t * dy).alias("y"))


def steps(line: Column) -> Column:
    """Consecutive pairs of a line's points: array<struct<a, b>>."""
    n = F.size(line)
    return F.when(n < 2, F.array().cast(f"array<struct<a:{POINT},b:{POINT}>>")).otherwise(F.zip_with(F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(line, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def _hyp(s: Column) -> Column:
    return F.sqrt(d2(s.a.x, s.a.y, s.b.x, s.b.y))


def length(line: Column) -> Column:
    """0 for fewer than two points."""
    return F.aggregate(steps(line), F.lit(0.0), lambda s, p: s + _hyp(p))


def interpolate(line: Column, fraction: Column) -> Column:
    """The point at a fraction (0 to 1) of a line's length."""
    want = length(line) * fraction
    start = F.struct(F.lit(0.0).alias("done"), F.element_at(line, 1).alias("at"))

    def walk(s: Column, p: Column) -> Column:
        h = _hyp(p)
        t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(want - s.done, h))), F.lit(0.0))
        at = F.struct((p.a.x + t * (p.b.x - p.a.x)).alias("x"), (p.a.y + t * (p.b.y - p.a.y)).alias("y"))
        return F.struct((s.done + h).alias("done"), F.when((want > s.done) | (s.done == 0), at).otherwise(s.at).alias("at"))

    return F.when(F.size(line) > 0, F.aggregate(steps(line), start, walk).at)


def _let(value: Column, of) -> Column:
    """`of(value)` with the value computed once, however often `of` names it. Within lambdas Spark shares nothing."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def area(ring: Column) -> Column:
    """Of a closed ring, by the shoelace sum about its first point (large coordinates cost no digits); orientation doesn't matter."""

    def about(r: Column, o: Column) -> Column:
        return F.abs(F.aggregate(steps(r), F.lit(0.0), lambda s, p: s + (p.a.x - o.x) * (p.b.y - o.y) - (p.b.x - o.x) * (p.a.y - o.y))) / 2

    return _let(ring, lambda r: _let(F.get(r, F.lit(0)), lambda o: about(r, o)))


def contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside a closed ring, by crossings; half-open, so neighbours share no point."""

    def crosses(p: Column) -> Column:
        up = p.a.y <= p.b.y
        lx, ly, hx, hy = F.when(up, p.a.x).otherwise(p.b.x), F.least(p.a.y, p.b.y), F.when(up, p.b.x).otherwise(p.a.x), F.greatest(p.a.y, p.b.y)
        return ((ly <= y) & (y < hy) & (x < lx + F.try_divide((y - ly) * (hx - lx), hy - ly))).cast("int")

    return F.aggregate(steps(ring), F.lit(0), lambda s, p: s + F.coalesce(crosses(p), F.lit(0))) % 2 == 1


def box_of(line: Column) -> Column:
    """struct(x0, y0, x1, y1)."""
    xs, ys = F.transform(line, lambda p: p.x), F.transform(line, lambda p: p.y)
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def clip_step(x1: Column, y1: Column, x2: Column, y2: Column, box: tuple[float, float, float, float]) -> Column:
    """The part of a segment inside a box as struct(x1, y1, x2, y2), null if none (Liang and Barsky)."""
    w, s, e, n = (F.lit(float(v)) for v in box)
    dx, dy = x2 - x1, y2 - y1
    lo, hi, ok = F.lit(0.0), F.lit(1.0), F.lit(True)
    for p, q in ((-dx, x1 - w), (dx, e - x1), (-dy, y1 - s), (dy, n - y1)):
        r = F.try_divide(q, p)
        ok = ok & ~((p == 0) & (q < 0))
        lo = F.when(p < 0, F.greatest(lo, r)).otherwise(lo)
        hi = F.when(p > 0, F.least(hi, r)).otherwise(hi)
    part = F.struct((x1 + lo * dx).alias("x1"), (y1 + lo * dy).alias("y1"), (x1 + hi * dx).alias("x2"), (y1 + hi * dy).alias("y2"))
    return F.when(ok & (lo <= hi), part)


def clip_line(line: Column, box: tuple[float, float, float, float]) -> Column:
    """The runs of a line inside a box, as an array of lines: stretches that follow one another are one run."""
    start = F.array().cast(f"array<{LINE}>")

    def add(runs: Column, p: Column) -> Column:
        c = clip_step(p.a.x, p.a.y, p.b.x, p.b.y, box)
        one, two = F.struct(c.x1.alias("x"), c.y1.alias("y")), F.struct(c.x2.alias("x"), c.y2.alias("y"))
        last = F.get(runs, F.size(runs) - 1)
        # A run goes on where the next stretch begins at its end.
        goes_on = F.coalesce(F.get(last, F.size(last) - 1) == one, F.lit(False))
        on = F.concat(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))), F.array(F.concat(last, F.array(two))))
        return F.when(c.isNull() | (one == two), runs).when(goes_on, on).otherwise(F.concat(runs, F.array(F.array(one, two))))

    return F.aggregate(steps(line), start, add)


def published(line: Column, tolerance: float, digits: int = 5) -> Column:
    """A line in metres as it is put out: simplified, turned to degrees, rounded."""
    return rounded(F.transform(simplify(line, tolerance), lambda p: from_itm(p.x, p.y)), digits)


def valid_ring(ring: Column) -> Column:
    """Whether a ring is closed, has four corners or more, and holds an area; null is none."""
    n = F.size(ring)
    return F.coalesce((n >= 4) & (F.get(ring, F.lit(0)) == F.get(ring, n - 1)) & (area(ring) > 0), F.lit(False))


def straight_if_missing(line: Column, u: Column, v: Column) -> Column:
    """A line, or where it is null or has no stretch the straight one between its ends."""
    return F.when(F.size(line) >= 2, line).otherwise(F.array(u, v))


def rounded(line: Column, digits: int = 5) -> Column:
    """Half-even."""
    return F.transform(line, lambda p: F.struct(F.bround(p.x, digits).alias("x"), F.bround(p.y, digits).alias("y")))


def square(x: Column, y: Column, half: float = 20.0) -> Column:
    """A closed square around a point."""
    corner = lambda sx, sy: F.struct((x + sx * half).alias("x"), (y + sy * half).alias("y"))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))


def rectangle(x: Column, y: Column, long: Column, wide: Column, angle: Column) -> Column:
    """A closed rectangle of given sides around a point, turned by an angle in radians."""

    def corner(a: float, b: float) -> Column:
        u, v = long * a / 2, wide * b / 2
        return F.struct((x + u * F.cos(angle) - v * F.sin(angle)).alias("x"), (y + u * F.sin(angle) + v * F.cos(angle)).alias("y"))

    return F.array(*(corner(a, b) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))))


def to_wkt(ring: Column) -> Column:
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", p.x.cast("string"), p.y.cast("string"))), ", "), F.lit("))"))


def from_wkt(text: Column) -> Column:
    """The points of a single-ring polygon, a line or a point in WKT; null for anything without number pairs."""
    pairs = F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?\s+-?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)"), 1)
    pts = F.transform(pairs, lambda s: F.struct(F.split(s, r"\s+")[0].cast("double").alias("x"), F.split(s, r"\s+")[1].cast("double").alias("y")))
    return F.when(F.size(pairs) > 0, pts)


def largest_part(parts: Column) -> Column:
    """struct(area, ring) of the largest ring of a multi-part polygon, the first of equals."""
    sized = F.transform(parts, lambda r, i: F.struct(area(r).alias("area"), (-i).alias("order"), r.alias("ring")))
    best = F.array_max(sized)
    return F.struct(best.area.alias("area"), best.ring.alias("ring"))


def simplify(line: Column, tolerance: float) -> Column:
    """Douglas and Peucker, within `tolerance`; ends are kept."""

    @F.pandas_udf(LINE)
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda pts: None if pts is None else [{"x": x, "y": y} for x, y in peucker([(p["x"], p["y"]) for p in pts], tolerance)])

    return run(line)


def peucker(pts: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    if len(pts) < 3:
        return pts
    keep = {0, len(pts) - 1}
    stack = [(0, len(pts) - 1)]
    while stack:
        a, b = stack.pop()
        (x1, y1), (x2, y2) = pts[a], pts[b]
        dx, dy = x2 - x1, y2 - y1
        n = dx * dx + dy * dy
        far, at = -1.0, a
        for k in range(a + 1, b):
            px, py = pts[k]
            t = max(0.0, min(1.0, ((px - x1) * dx + (py - y1) * dy) / n)) if n else 0.0
            d = math.hypot(px - x1 - t * dx, py - y1 - t * dy)
            if d > far:
                far, at = d, k
        if far > tolerance:
            keep.add(at)
            stack += [(a, at), (at, b)]
    return [pts[k] for k in sorted(keep)]


def inner_point(ring: Column) -> Column:
    """A point surely inside a closed ring: the middle of the widest stretch of a line half-way up its box; null for what holds no area."""

    def height(ys: Column) -> Column:
        n = F.size(ys)
        mid = (F.get(ys, F.lit(0)) + F.get(ys, n - 1)) / 2
        # Off every corner, or a crossing would count twice.
        between = lambda k: (F.get(ys, F.greatest(k - 1, F.lit(0))) + F.get(ys, F.least(k, n - 1))) / 2
        return _let(mid, lambda m: _let(F.size(F.filter(ys, lambda v: v <= m)), between))

    def widest(xs: Column, y: Column) -> Column:
        pairs = F.floor(F.size(xs) / 2).cast("int")
        spans = F.transform(F.sequence(F.lit(0), F.greatest(pairs - 1, F.lit(0))), lambda i: F.struct((F.get(xs, 2 * i + 1) - F.get(xs, 2 * i)).alias("w"), ((F.get(xs, 2 * i) + F.get(xs, 2 * i + 1)) / 2).alias("x")))
        return F.when(pairs > 0, F.struct(F.array_max(spans).x.alias("x"), y.alias("y")))

    def at(r: Column, y: Column) -> Column:
        cut = lambda s: F.when(((s.a.y <= y) & (y < s.b.y)) | ((s.b.y <= y) & (y < s.a.y)), s.a.x + F.try_divide((y - s.a.y) * (s.b.x - s.a.x), s.b.y - s.a.y))
        return _let(F.array_sort(F.filter(F.transform(steps(r), cut), lambda x: x.isNotNull())), lambda xs: widest(xs, y))

    def point(r: Column) -> Column:
        ys = F.array_sort(F.array_distinct(F.transform(r, lambda p: p.y)))
        return _let(ys, lambda v: F.when((F.size(r) >= 4) & (F.size(v) >= 2), _let(height(v), lambda y: at(r, y))))

    return _let(ring, point)

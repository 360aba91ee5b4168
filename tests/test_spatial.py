import math

import numpy as np
import pytest

from fieldloom.operators import cluster, spatial

XY = "id long, x double, y double"


def pts(spark, n, seed, name, span=1000):
    g = np.random.default_rng(seed)
    rows = [(i, float(g.integers(0, span)), float(g.integers(0, span))) for i in range(n)]
    return rows, spark.createDataFrame(rows + [(n + 1, None, 3.0)], XY).withColumnRenamed("id", name)


@pytest.mark.parametrize("r", [15.0, 90.0])
def test_radius(spark, r):
    a, da = pts(spark, 120, 1, "a")
    b, db = pts(spark, 80, 2, "b")
    want = {(i, j) for i, x, y in a for j, u, v in b if (x - u) ** 2 + (y - v) ** 2 <= r * r}
    got = [(q.a, q.b) for q in spatial.radius_join(da, db, r, "a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_nearest(spark):
    a, da = pts(spark, 60, 3, "a")
    b, db = pts(spark, 25, 4, "b")
    want = {i: min(((x - u) ** 2 + (y - v) ** 2, j) for j, u, v in b) for i, x, y in a}
    got = {r.a: (r.d2, r.b) for r in spatial.nearest(da, db, "a", "b").collect()}
    assert got.pop(61) == (None, None) and got == want
    capped = {r.a: r.b for r in spatial.nearest(da, db, "a", "b", most=50.0).collect()}
    assert all(capped[i] == (j if d <= 2500 else None) for i, (d, j) in want.items())
    assert all(r.b is None for r in spatial.nearest(da, db.where("false"), "a", "b").collect())


def brute_seg(px, py, x1, y1, x2, y2):
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((px - x1) * dx + (py - y1) * dy) / n)) if n else 0.0
    return math.hypot(px - x1 - t * dx, py - y1 - t * dy)


def segs(spark, n, seed):
    g = np.random.default_rng(seed)
    rows = [(i, k, *map(float, g.integers(0, 400, 4))) for i in range(n) for k in range(2)]
    return rows, spark.createDataFrame(rows, "line long, k int, x1 double, y1 double, x2 double, y2 double")


def test_segments(spark):
    a, da = pts(spark, 60, 5, "a", 400)
    s, ds = segs(spark, 12, 6)
    want = {(i, m) for i, x, y in a for m, k, *q in s if brute_seg(x, y, *q) <= 30}
    assert {(r.a, r.line) for r in spatial.points_near_segments(da, ds, 30.0, "a", "line").collect()} == want
    best = {r.a: r.line for r in spatial.snap(da, ds, 30.0, "a", "line").collect()}
    assert set(best) == {i for i, _ in want}
    for i, x, y in a:
        if i in best:
            assert math.isclose(min(brute_seg(x, y, *q) for m, k, *q in s), min(brute_seg(x, y, *q) for m, k, *q in s if m == best[i]))


def test_overlap_share(spark):
    s, ds = segs(spark, 6, 7)
    o, do = segs(spark, 4, 8)
    got = {(r.line, r.other): r.share for r in spatial.overlap_share(ds, do.withColumnRenamed("line", "other"), 25.0, "line", "other").collect()}
    for line in range(6):
        mine = [q for m, k, *q in s if m == line]
        total = sum(math.hypot(q[2] - q[0], q[3] - q[1]) for q in mine)
        for other in range(4):
            near = 0.0
            for x1, y1, x2, y2 in mine:
                n = math.hypot(x2 - x1, y2 - y1)
                ts = (np.arange(4000) + 0.5) / 4000
                near += n * np.mean([min(brute_seg(x1 + t * (x2 - x1), y1 + t * (y2 - y1), *q) for m, k, *q in o if m == other) <= 25 for t in ts])
            assert abs(got.get((line, other), 0.0) - near / total) < 2e-3


def test_near_segments(spark):
    s, ds = segs(spark, 8, 9)
    got = {(r.line, r.other) for r in spatial.near_segments(ds, ds.withColumnRenamed("line", "other"), 20.0, "line", "other").collect()}

    def cross(p, q):
        f = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        a, b, c, d = p[:2], p[2:], q[:2], q[2:]
        return f(a, b, c) * f(a, b, d) < 0 and f(c, d, a) * f(c, d, b) < 0

    def dist(p, q):
        return 0.0 if cross(p, q) else min(brute_seg(*p[:2], *q), brute_seg(*p[2:], *q), brute_seg(*q[:2], *p), brute_seg(*q[2:], *p))

    want = {(m, n) for m, _, *p in s for n, _, *q in s if dist(p, q) <= 20}
    assert got == want


def test_dbscan_general(spark):
    a, da = pts(spark, 150, 10, "a", 600)
    for least in (1, 2, 4):
        near = {i: [j for j, u, v in a if (x - u) ** 2 + (y - v) ** 2 <= 1600] for i, x, y in a}
        core = {i for i in near if len(near[i]) >= least}
        lab: dict = {}
        for i in sorted(core):
            if i not in lab:
                todo = [i]
                while todo:
                    k = todo.pop()
                    if k not in lab:
                        lab[k] = i
                        todo += [j for j in near[k] if j in core and j not in lab]
        want = {i: lab[i] if i in core else lab[min(j for j in near[i] if j in core)] if any(j in core for j in near[i]) else None for i in near}
        got = {r.a: r.cluster for r in cluster.dbscan(da, 40.0, least, "a").collect()}
        assert got.pop(151) is None and got == want


def test_tour(spark):
    d = spark.createDataFrame([("g", 1, 0.0, 0.0), ("g", 2, 10.0, 0.0), ("g", 3, 4.0, 0.0), ("h", 9, 1.0, 1.0), (None, 5, 0.0, 0.0)], "g string, id long, x double, y double")
    got = [(r.g, r.id) for r in cluster.greedy_tours(d, "g", "id").orderBy("g", "stop").collect()]
    assert got == [("g", 3), ("g", 1), ("g", 2), ("h", 9)]


def test_segments_are_not_sent_to_all(spark, tmp_path):
    # Segments with a row for each cell are many times what Spark takes them for.
    p = [(i, 0, 100.0 * i, 0.0, 100.0 * i + 900.0, 0.0) for i in range(40)]
    spark.createDataFrame(p, "line long, k int, x1 double, y1 double, x2 double, y2 double").write.parquet(f"{tmp_path}/lines")
    a = spark.read.parquet(f"{tmp_path}/lines")
    b = a.withColumnRenamed("line", "other")
    for out in (spatial.overlap_share(a, b, 5.0, "line", "other"), spatial.near_segments(a, b, 5.0, "line", "other")):
        plan = out._jdf.queryExecution().sparkPlan().toString()
        assert "SortMergeJoin [gx" in plan
        assert {(r.line, r.other) for r in out.collect()} == {(i, j) for i in range(40) for j in range(40) if abs(i - j) <= 9}


def test_long_segments_have_few_cells(spark):
    s = spark.createDataFrame([(1, 0.0, 0.0, 800.0, 0.0)], "id long, x1 double, y1 double, x2 double, y2 double")
    assert spatial._cell_size(s, 15.0) == 200.0 and spatial._cell_size(s, 300.0) == 300.0 and spatial._cell_size(s.where("false"), 15.0) == 15.0

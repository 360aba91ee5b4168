import numpy as np
import pytest

from fieldloom.operators import proximity as P
from fieldloom.operators.vptree import VantageTree, arc_m, haversine_m, unit


@pytest.mark.parametrize("n", [0, 1, 70, 900])
def test_tree_finds_all(n):
    g = np.random.default_rng(n)
    lng, lat = -8 + g.normal(0, 0.01, n), 53 + g.normal(0, 0.01, n)
    if n > 100:
        lng[:90], lat[:90] = -8.0, 53.0  # many at one spot
    xyz = unit(lng, lat)
    r = g.uniform(0, 900, n)
    q, p = VantageTree(xyz, leaf=16).within(xyz, r)
    got = set(zip(q.tolist(), p.tolist()))
    assert len(got) == len(q)
    if n:
        d = arc_m(xyz[:, None], xyz[None])
        assert {(i, j) for i, j in zip(*np.nonzero(d <= r[:, None]))} <= got
        assert all(d[i, j] <= r[i] + 0.01 for i, j in got)


def test_arc_is_haversine():
    g = np.random.default_rng(3)
    a, b = g.uniform(-180, 180, (2, 200)), g.uniform(-89, 89, (2, 200))
    assert np.allclose(arc_m(unit(a[0], b[0]), unit(a[1], b[1])), haversine_m(a[0], b[0], a[1], b[1]), atol=1e-3)


def _dev(spark, rows):
    return spark.createDataFrame(rows, "app_id string, centroid array<double>, lng double, ring string")


AREAS = f"small_area_id string, ring {P.RING}"
SCHOOLS = "school_id string, lng double, lat double, app_id string"


def _brute(devs, areas, schools):
    def pos(a, b):
        if a is None or b is None:
            return None
        return (a, b) if a < 0 < b else (b, a) if b < 0 < a else None

    at = [(i, pos(*c)) for i, c, *_ in devs if i and c and len(c) == 2]
    at = sorted({(i, p) for i, p in at if p})
    out = set()
    for i, (x, y) in at:
        for j, (u, v) in at:
            if i < j and haversine_m(x, y, u, v) <= 40:
                out.add(("development", i, j))
        for s, a, b, _ in schools:
            p = pos(a, b)
            if s and p and haversine_m(x, y, *p) <= 250:
                out.add(("school", i, s))
        for k, ring in areas:
            if ring and P.inside(np.array([x]), np.array([y]), np.array([q[0] for q in ring]), np.array([q[1] for q in ring]))[0]:
                out.add(("area", i, k))
    return out


@pytest.mark.parametrize("block,most", [(7, 4096), (20_000, 4096), (20_000, 3)])
def test_against_brute_force(spark, block, most, monkeypatch):
    # With three pivots every cell is crowded and has its own.
    monkeypatch.setattr(P, "CELL", 20)
    monkeypatch.setattr(P, "MAX_PIVOTS", most)
    monkeypatch.setattr(P, "CROWDED", 1)
    g = np.random.default_rng(1)
    devs = [(f"a{i}", [float(-8 + g.normal(0, 0.003)), float(53 + g.normal(0, 0.003))], 1.0, "r") for i in range(300)]
    devs += [(f"s{i}", [-8.0, 53.0], None, None) for i in range(12)] + [("w", [53.0, -8.0001], None, None), ("z", [0.0, 0.0], None, None), ("e", [], None, None), ("n", None, None, None), ("h", [None, 53.0], None, None), (None, [-8.0, 53.0], None, None), ("nan", [float("nan"), 53.0], None, None)]
    devs += devs[:5]
    sq = lambda x, y, d: [(x, y), (x + d, y), (x + d, y + d), (x + d / 2, y + d / 3), (x, y + d), (x, y)]
    areas = [(f"t{i}{j}", sq(-8.01 + i * 0.004, 52.99 + j * 0.004, 0.004)) for i in range(5) for j in range(5)]
    areas += [("t00", areas[0][1][::-1]), ("none", None), ("thin", [(-8.0, 53.0), (-8.0, 53.1)]), (None, areas[0][1])]
    schools = [("p", -8.0, 53.0, "x"), ("q", 53.001, -8.001, "x"), ("q", 53.001, -8.001, "x"), ("u", None, 53.0, None), (None, -8.0, 53.0, None)]
    got = P.development_surroundings(_dev(spark, devs), spark.createDataFrame(areas, AREAS), spark.createDataFrame(schools, SCHOOLS), block=block)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == _brute(devs, [a for a in areas if a[0] and a[1] and len(a[1]) > 3], schools)


def test_counts_by_place(spark):
    devs = [("a", [-8.0, 53.0], None, None), ("b", [-8.0, 53.0], None, None), ("c", [-8.0001, 53.0], None, None), ("d", [-8.1, 53.0], None, None), ("a", [-8.0, 53.0], None, None)]
    ring = [(-8.01, 52.99), (-7.99, 52.99), (-7.99, 53.01), (-8.01, 53.01), (-8.01, 52.99)]
    got = P.surroundings_count(_dev(spark, devs), spark.createDataFrame([("t", ring), ("t", ring[::-1])], AREAS), spark.createDataFrame([("s", -8.0, 53.0, None)], SCHOOLS)).collect()
    assert {r.app_id: (r.n_area, r.n_school, r.n_development) for r in got} == {"a": (1, 1, 2), "b": (1, 1, 2), "c": (1, 1, 2), "d": (0, 0, 0)}
    assert len(got) == 4 and len({r.place_id for r in got}) == 3


def test_no_places(spark):
    got = P.development_surroundings(_dev(spark, [("a", None, None, None)]), spark.createDataFrame([], AREAS), spark.createDataFrame([("s", -8.0, 53.0, None)], SCHOOLS))
    assert got.count() == 0

import heapq
import random
from collections import defaultdict
from functools import lru_cache

import pytest

from fieldloom.operators import graph as G

E = "u long, v long, length double"


def random_graph(seed, n=60, m=90):
    g = random.Random(seed)
    return [(g.randrange(n), g.randrange(n), float(g.randint(1, 20))) for _ in range(m)]


def adj(edges):
    a = defaultdict(list)
    for u, v, w in edges:
        if u != v:
            a[u].append((v, w))
            a[v].append((u, w))
    return a


def dijkstra(edges, sources):
    a, best, heap = adj(edges), {}, [(0.0, s, s) for s in sources]
    heapq.heapify(heap)
    while heap:
        d, r, n = heapq.heappop(heap)
        if n not in best:
            best[n] = (d, r)
            for v, w in a[n]:
                heapq.heappush(heap, (d + w, r, v))
    return best


def find(edges):
    up = {}

    def f(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for u, v, _ in edges:
        a, b = f(u), f(v)
        up[max(a, b)] = min(a, b)
    return {x: f(x) for x in up}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    e = random_graph(seed, 80, 60)
    d = spark.createDataFrame(e + [(None, 3, 1.0)], E).repartition(3)
    for chunk in (G.CHUNK, 0):
        got = {r.node: r.component for r in G.components(d, chunk=chunk).collect()}
        assert got == {**find(e), 3: find(e).get(3, 3)}


def test_long_chain(spark):
    e = [(i, i + 1, 1.0) for i in range(200)]
    for chunk in (G.CHUNK, 0):
        assert {r.component for r in G.components(spark.createDataFrame(e, E).repartition(4, "v"), chunk=chunk).collect()} == {0}


def test_empty(spark):
    assert G.components(spark.createDataFrame([], E)).count() == 0
    assert G.parallel_min(spark.createDataFrame([], E)).count() == 0


def test_parallel(spark):
    d = spark.createDataFrame([(1, 2, 5.0, "b"), (2, 1, 5.0, "a"), (1, 2, 9.0, "c"), (3, 3, 1.0, "x")], E + ", edge_id string")
    assert [tuple(r) for r in G.parallel_min(d, ("edge_id",)).collect()] == [(1, 2, 5.0, "a")]


def test_paths(spark):
    e = random_graph(5)
    src = [0, 7, 33]
    have = {n for u, v, _ in e for n in (u, v)}
    d, s = spark.createDataFrame(e, E), spark.createDataFrame([(x,) for x in src], "node long")
    want = {n: x for n, x in dijkstra(e, [x for x in src if x in have]).items()}
    got = {r.node: (r.dist, r.root) for r in G.shortest_paths(d, s).collect()}
    connected = {n: x for n, x in want.items() if n in got or n in have}
    assert {n: x[0] for n, x in got.items()} == {n: x[0] for n, x in connected.items() if n in got}
    assert set(got) == {n for n in want if any(u != v and n in (u, v) for u, v, _ in e)}
    small = {tuple(r) for r in G.shortest_paths(d, s, size=7).collect()}
    assert small == {tuple(r) for r in G.shortest_paths(d, s).collect()}


def test_parts_agree_with_one(spark):
    # A connected grid cut into parts that ways cross again and again, with ties everywhere.
    e = [(i, i + 1, 1.0) for i in range(119) if i % 10 != 9] + [(i, i + 10, 1.0 + i % 2) for i in range(110)]
    d, s = spark.createDataFrame(e, E), spark.createDataFrame([(5,), (114,)], "node long")
    want = dijkstra(e, [5, 114])
    rows = {r.node: r for r in G.shortest_paths(d, s, size=9).collect()}
    assert {n: (r.dist, r.root) for n, r in rows.items()} == want
    length = {frozenset((u, v)): w for u, v, w in e}

    @lru_cache(None)
    def hops(n):
        return 0 if n in (5, 114) else 1 + min(hops(p) for p, w in adj(e)[n] if want[p][0] + w == want[n][0] and want[p][1] == want[n][1])

    for n, r in rows.items():
        before = [(hops(p), p) for p, w in adj(e)[n] if want[p][0] + w == r.dist and want[p][1] == r.root]
        assert r.pred == (min(before)[1] if n not in (5, 114) else None)
        assert r.pred is None or length[frozenset((n, r.pred))] > 0
    tree = spark.createDataFrame([(n, r.pred) for n, r in rows.items()], "node long, parent long")
    up = {n: r.pred for n, r in rows.items()}

    def way(n):
        while n is not None:
            yield n
            n = up[n]

    loads = spark.createDataFrame([(n, float(n % 5)) for n in range(0, 120, 3)], "node long, load double")
    sums = defaultdict(float)
    for n in range(0, 120, 3):
        for x in way(n):
            sums[x] += n % 5
    for size in (11, 10_000):
        assert {r.node: r.load for r in G.path_sums(tree, loads, size).collect()} == sums
        apps = spark.createDataFrame([(n, f"a{n}") for n in (0, 60, 119)], "node long, app_id string")
        assert {tuple(r) for r in G.path_accumulate(tree, apps, size).collect()} == {(x, f"a{n}") for n in (0, 60, 119) for x in way(n)}


def test_spanning_forest_by_rounds(spark):
    e = [(min(u, v), max(u, v), w) for u, v, w in random_graph(9, 40, 90) if u != v]
    d = G.parallel_min(spark.createDataFrame(e, E))
    one, many = ({tuple(r) for r in G.spanning_forest(d, most).collect()} for most in (10_000, 5))
    assert one == many and len(one) == len(find(e)) - len(set(find(e).values()))


def test_bfs_and_loads(spark):
    e = [(0, 1, 1.0), (0, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0), (3, 4, 1.0), (8, 9, 1.0)]
    g, s = spark.createDataFrame(e, E), spark.createDataFrame([(0,)], "node long")
    b = {r.node: (r.depth, r.parent) for r in G.bfs(g, s).collect()}
    assert {r.node: (r.depth, r.parent) for r in G.bfs_rounds(g, s, 99).collect()} == b
    assert {r.node for r in G.bfs_rounds(g, s, 1).collect()} == {0, 1, 2}
    assert b == {0: (0, None), 1: (1, 0), 2: (1, 0), 3: (2, 1), 4: (3, 3)}
    t = spark.createDataFrame([(n, p) for n, (_, p) in b.items()], "node long, parent long")
    w = spark.createDataFrame([(4, "a"), (2, "b"), (4, "a")], "node long, app_id string")
    assert {tuple(r) for r in G.path_accumulate(t, w).collect()} == {(4, "a"), (3, "a"), (1, "a"), (0, "a"), (2, "b"), (0, "b")}


@pytest.mark.parametrize("seed", [3, 4])
def test_steiner(spark, seed):
    e = random_graph(seed, 40, 80)
    comp = find([x for x in e if x[0] != x[1]])
    terms = sorted(comp)[::5]
    tree = [tuple(r) for r in G.steiner(spark.createDataFrame(e, E), spark.createDataFrame([(t,) for t in terms], "node long"), *((7, 3) if seed == 4 else ())).collect()]
    assert all(any({u, v} == {a, b} and w == c for a, b, c in e) for u, v, w in tree)
    nodes = {n for u, v, _ in tree for n in (u, v)}
    tc = find(tree)
    assert len(tree) == len(nodes) - len(set(tc.values()))  # a forest
    groups = defaultdict(list)
    for t in terms:
        groups[comp[t]].append(t)
    bound = 0.0
    for g in groups.values():
        if len(g) > 1:
            assert len({tc[t] for t in g}) == 1
            closure = sorted((dijkstra(e, [a])[b][0], a, b) for a in g for b in g if a < b)
            up = {t: t for t in g}
            for w, a, b in closure:
                while up[a] != a:
                    a = up[a]
                while up[b] != b:
                    b = up[b]
                if a != b:
                    up[a] = b
                    bound += w
    assert sum(w for *_, w in tree) <= bound + 1e-9
    leaves = [n for n in nodes if sum(n in (u, v) for u, v, _ in tree) == 1]
    assert set(leaves) <= set(terms)


def test_lengths_by_blocks_agree_with_search(spark, monkeypatch):
    from fieldloom.operators import banded as B

    monkeypatch.setattr(B, "NARROWEST", 4)
    g = random.Random(5)
    pairs = lambda n: [(g.randrange(n), g.randrange(n)) for _ in range(150)] + [(3, 3), (0, 10**6), (7, 8), (8, 7)]
    for whole in (True, False):
        # Edges that span up to seven places, some missing, so that ways wind and parts fall apart; ids with gaps.
        e = [(3 * a, 3 * (a + d), float(g.randint(1, 9)) if whole else g.choice([0.1, 0.7, 0.25])) for a in range(200) for d in (1, 2, 7) if g.random() < 0.45 and a + d < 200]
        legs = [(3 * a, 3 * b) for a, b in pairs(200)]
        d, want = spark.createDataFrame(e, E), {}
        links = adj(e)
        for s in {a for a, _ in legs}:
            heap, best = [(0.0, 0, s)], {}
            while heap:
                x, h, n = heapq.heappop(heap)
                if n not in best:
                    best[n] = (x, h)
                    for v, w in links[n]:
                        heapq.heappush(heap, (round(x + w, 9), h + 1, v))
            want |= {(a, b): (best[b][0], best[b][1] + 1) for a, b in legs if a == s and a in links and b in best}
        for size in (20, 33, 1000):
            got = {(r.node, r.to): (r.dist, r.passed) for r in B.pair_lengths(d, spark.createDataFrame(legs, "node long, to long"), size).collect()}
            assert got.keys() == want.keys() and all(abs(x - want[k][0]) < 1e-9 for k, (x, _) in got.items())
            assert not whole or got == want
        # Wider graphs are searched.
        if whole:
            few = spark.createDataFrame(legs[:9], "node long, to long")
            assert {(r.node, r.to, r.dist, r.passed) for r in B.pair_lengths(d, few, 1000, 3).collect()} == {(*k, *want[k]) for k in legs[:9] if k in want}
    assert B.pair_lengths(d.where("false"), few).count() == 0 and B.pair_lengths(d, few.where("false"), 20).count() == 0


def test_ways_of_a_long_grid_are_not_searched(spark, monkeypatch, tmp_path):
    from fieldloom.operators import banded as B
    from fieldloom.plans import plan_queries

    def no(*_):
        raise AssertionError("every start was searched")

    monkeypatch.setattr(G, "pair_paths", no)
    monkeypatch.setattr(B, "pair_paths", no)
    # 45,000 corners, 50 abreast, in three parts; every 75th goes to another.
    n = 45_000
    spark.range(n).selectExpr("id AS p_partkey", "cast(1 + id % 75 AS int) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    got = plan_queries.grid_ways(spark, str(tmp_path)).collect()
    assert sorted(r.node for r in got) == list(range(0, n, 75)) and all(r.goal == r.node * 7 % n for r in got)
    assert all(r.dist == abs(r.node % 50 - r.goal % 50) + abs(r.node // 50 - r.goal // 50) == r.passed - 1 for r in got)

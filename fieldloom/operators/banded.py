"""Lengths of ways over graphs whose nodes, in their order, only have near neighbours (street grids, lines).

If no edge spans more than w places of the order, w nodes in a row part those before from
those after. The order is cut into blocks of w nodes, each with edges to the next block only, and
blocks into parts. Distances are matrices over a block's nodes, brought together by
least sums; no start searches the graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.operators.graph import PART, pair_paths, parallel_min, parts
from fieldloom.runtime import materialise

#: The most places an edge may span here; graphs with longer edges are searched.
WIDEST = 64
#: Blocks are no smaller.
NARROWEST = 32
#: Parts, whose matrices (some 65 MB at most) the driver brings together. Beyond so many they grow.
MOST_PARTS = 500
#: Ways that one task follows through a part.
WAYS = 20_000
#: Whole numbers are exact up to here.
EXACT = 1 << 53


def _least_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a[:, :1] + b[0]
    for k in range(1, len(b)):
        np.minimum(out, a[:, k, None] + b[k], out=out)
    return out


def _closed(m: np.ndarray) -> np.ndarray:
    """Least sums over any number of steps of m."""
    m = m.copy()
    for k in range(len(m)):
        np.minimum(m, m[:, k, None] + m[k], out=m)
    return m


class _Step:
    """The edges from a block to the next, in layers with each end once."""

    def __init__(self, x: np.ndarray, y: np.ndarray, key: np.ndarray, w: int):
        self.w = w
        nth = lambda z: pd.Series(z).groupby(z).cumcount().to_numpy() if len(z) else z
        self.on = [(x[m], y[m], key[m]) for n in [nth(y)] for r in range(int(n.max(initial=-1)) + 1) for m in [n == r]]
        self.back = [(y[m], x[m], key[m]) for n in [nth(x)] for r in range(int(n.max(initial=-1)) + 1) for m in [n == r]]

    def take(self, a: np.ndarray, back: bool = False) -> np.ndarray:
        out = np.full((len(a), self.w), np.inf, a.dtype)
        for x, y, key in self.back if back else self.on:
            out[:, y] = np.minimum(out[:, y], a[:, x] + key)
        return out

    def lifted(self, m: np.ndarray, back: bool = False) -> np.ndarray:
        """Distances between the other block's nodes that go over this one, with distances m."""
        return self.take(self.take(m, back).T, back)


def _keys(length: np.ndarray, scale: int) -> np.ndarray:
    """Length and edges in one number each: whole ones below EXACT, or complex ones, which numpy compares by the real part first."""
    return length * scale + 1.0 if scale else length + 1j


def _blocks(a: np.ndarray, b: np.ndarray, key: np.ndarray, n: int, w: int) -> tuple[list[np.ndarray], list[_Step]]:
    """Of a part's n blocks the edges within each, and the steps from each to the next."""
    own = np.full((n, w, w), np.inf, key.dtype)
    own[:, np.arange(w), np.arange(w)] = 0
    same = a // w == b // w
    p, q = a[same], b[same]
    own[p // w, p % w, q % w] = key[same]
    own[p // w, q % w, p % w] = key[same]
    a, b, key = a[~same], b[~same], key[~same]
    order = np.argsort(a // w, kind="stable")
    a, b, key = a[order], b[order], key[order]
    cut = np.searchsorted(a // w, np.arange(n))
    return list(own), [_Step(a[i:j] % w, b[i:j] % w, key[i:j], w) for i, j in zip(cut[:-1], cut[1:])]


def _sweeps(own: list[np.ndarray], steps: list[_Step]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distances within each block over it and those before; over it and those after."""
    before, after = [_closed(own[0])], [_closed(own[-1])]
    for m, s in zip(own[1:], steps):
        before.append(_closed(np.minimum(m, s.lifted(before[-1]))))
    for m, s in zip(own[-2::-1], steps[::-1]):
        after.append(_closed(np.minimum(m, s.lifted(after[-1], True))))
    return before, after[::-1]


def _around(ends: list[tuple], cross: list[_Step]) -> tuple[list, list, list]:
    """Of each part, from its ends' distances (first block, last, across): what lies left of it and right of it, and the distances across in the whole graph."""
    none = np.full_like(ends[0][0], np.inf)
    left, right = [none], [none]
    for (first, last, over), s in zip(ends, cross):
        q = _closed(np.minimum(first, left[-1]))
        left.append(s.lifted(np.minimum(last, _least_sums(_least_sums(over.T, q), over))))
    for (first, last, over), s in zip(ends[::-1], cross[::-1]):
        q = _closed(np.minimum(last, right[-1]))
        right.append(s.lifted(np.minimum(first, _least_sums(_least_sums(over, q), over.T)), True))
    right.reverse()
    w = len(none)
    whole = [_closed(np.block([[np.minimum(f, x), o], [o.T, np.minimum(g, y)]]))[:w, w:] for (f, g, o), x, y in zip(ends, left, right)]
    return left, right, whole


def _followed(own: list[np.ndarray], steps: list[_Step], a: np.ndarray, b: np.ndarray, kind: np.ndarray, w: int) -> list[np.ndarray]:
    """For each way its length, if both its ends are here (kind 0); from its lower end to all of the last block (1); from its upper end to all of the first (2)."""
    before, after = _sweeps(own, steps)
    both = [_closed(np.minimum(x, y)) for x, y in zip(before, after)]
    n, out = len(own), [None] * len(a)
    rows, v = np.zeros(0, np.int64), np.zeros((0, w), own[0].dtype)
    for k in range(n):
        if len(rows):
            v = _least_sums(steps[k - 1].take(v), after[k])
        new = np.nonzero((kind < 2) & (a // w == k))[0]
        rows, v = np.concatenate([rows, new]), np.concatenate([v, both[k][a[new] % w]])
        there = (kind[rows] == 0) & (b[rows] // w == k)
        for r, x in zip(rows[there], v[there, b[rows[there]] % w]):
            out[r] = x.reshape(1)
        rows, v = rows[~there], v[~there]
    for r, x in zip(rows, v):
        out[r] = x
    rows, v = np.zeros(0, np.int64), np.zeros((0, w), own[0].dtype)
    for k in range(n - 1, -1, -1):
        if len(rows):
            v = _least_sums(steps[k].take(v, True), before[k])
        new = np.nonzero((kind == 2) & (b // w == k))[0]
        rows, v = np.concatenate([rows, new]), np.concatenate([v, both[k][b[new] % w]])
    for r, x in zip(rows, v):
        out[r] = x
    return out


def _joined(cross: list[_Step], whole: list[np.ndarray], dtype: type):
    """Over ways between parts: from the lower end's part on, part by part, to the upper end's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            x = x.sort_values("p").reset_index(drop=True)
            p, q = x.p.to_numpy(), x.q.to_numpy()
            out: list = [None] * len(x)
            if len(x):
                rows, v = np.zeros(0, np.int64), np.zeros((0, cross[0].w), dtype)
                for k in range(p.min(), q.max()):
                    if len(rows):
                        v = _least_sums(v, whole[k])
                    new = np.nonzero(p == k)[0]
                    if len(new):
                        rows, v = np.concatenate([rows, new]), np.concatenate([v, np.stack(x.v[new].tolist()).view(dtype)])
                    v = cross[k].take(v)
                    there = q[rows] == k + 1
                    for r, y in zip(rows[there], v[there]):
                        out[r] = np.min(y + np.asarray(x.u[r]).view(dtype)).reshape(1).view(np.float64)
                    rows, v = rows[~there], v[~there]
            yield x[["a", "b"]].assign(v=out)

    return run


def pair_lengths(edges: DataFrame, legs: DataFrame, size: int = PART, widest: int = WIDEST) -> DataFrame:
    """(node, to, dist, passed): for each distinct leg the length of the shortest way and how many nodes it passes, ends included; legs without a way are left out.

    As `pair_paths` without the paths, ties to fewer edges; lengths that aren't whole may differ from it by rounding. Graphs with an
    edge that spans more than `widest` places of the nodes' order are left to `pair_paths`. Lengths aren't negative.
    """
    e = materialise(parallel_min(edges), "edges")
    legs = materialise(legs.select("node", "to").dropna().distinct(), "legs")
    nodes = materialise(e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))).distinct(), "nodes")
    n = nodes.count()
    if not n:
        return legs.select("node", "to", F.lit(0.0).alias("dist"), F.lit(1).alias("passed")).where("false")
    size = max(size, -(-n // MOST_PARTS))
    part = parts(nodes, size)
    counts = dict(sorted(tuple(r) for r in part.groupBy("part").count().collect()))
    first = F.create_map(*(F.lit(x) for k, x in zip(counts, np.cumsum([0, *counts.values()]).tolist()) for x in (k, x)))
    rank = part.select("node", (F.row_number().over(Window.partitionBy("part").orderBy("node")) - 1 + F.element_at(first, F.col("part"))).cast("long").alias("rank"))
    rank = materialise(rank, "ranks")
    ru, rv = rank.select(F.col("node").alias("u"), F.col("rank").alias("ru")), rank.select(F.col("node").alias("v"), F.col("rank").alias("rv"))
    e = e.join(ru, "u").join(rv, "v").select(F.least("ru", "rv").alias("a"), F.greatest("ru", "rv").alias("b"), F.col("length").cast("double").alias("length"))
    e = materialise(e, "ranked")
    about = e.agg(F.max(F.col("b") - F.col("a")).alias("band"), F.bool_and(F.col("length") == F.floor("length")).alias("whole"), F.sum("length").alias("sum")).first()
    if about.band > widest:
        return pair_paths(edges, legs, size).select("node", "to", "dist", F.size("path").alias("passed"))
    # A way has fewer edges than there are nodes, and is no longer than all edges.
    scale = 1 << int(n).bit_length()
    scale = scale if about.whole and (about["sum"] + 1) * scale < EXACT else 0
    dtype = np.float64 if scale else np.complex128
    w = max(about.band, NARROWEST)
    per = max(2, size // w)
    span = w * per
    n_parts = -(-n // span)
    n_blocks = lambda k: per if k < n_parts - 1 else -(-(n - k * span) // w)
    e = e.withColumn("part", F.floor(F.col("a") / span).cast("int"))
    inner = materialise(e.where(F.floor(F.col("b") / span) == F.col("part")), "inner")
    over = e.where(F.floor(F.col("b") / span) > F.col("part")).toPandas()
    steps = [over[over.part == k] for k in range(n_parts - 1)]
    cross = [_Step(x.a.to_numpy() % w, x.b.to_numpy() % w, _keys(x.length.to_numpy(), scale), w) for x in steps]

    def blocks(k: int, es: pd.DataFrame) -> tuple[list[np.ndarray], list[_Step]]:
        return _blocks(es.a.to_numpy(np.int64) - k * span, es.b.to_numpy(np.int64) - k * span, _keys(es.length.to_numpy(np.float64), scale), n_blocks(k), w)

    def across(key: tuple, es: pd.DataFrame) -> pd.DataFrame:
        own, on = blocks(key[0], es)
        before, after = _sweeps(own, on)
        m = after[0]
        for s, x in zip(on, after[1:]):
            m = _least_sums(s.take(m), x)
        return pd.DataFrame({"part": [key[0]], "m": [np.stack([after[0], before[-1], m]).ravel().view(np.float64)]})

    alone = np.full((w, w), np.inf, dtype)
    alone[np.arange(w), np.arange(w)] = 0
    ends = [(alone, alone, np.full_like(alone, np.inf) if n_blocks(k) > 1 else alone) for k in range(n_parts)]
    if n_parts > 1:
        got = inner.groupBy("part").applyInPandas(across, "part int, m array<double>").toArrow()
        for k, m in zip(got.column("part").to_pylist(), got.column("m")):
            ends[k] = tuple(m.values.to_numpy().view(dtype).reshape(3, w, w))
    left, right, whole = _around(ends, cross)

    ways = legs.join(rank.withColumnRenamed("rank", "r"), "node").join(rank.select(F.col("node").alias("to"), F.col("rank").alias("s")), "to")
    ways = materialise(ways.select("node", "to", F.least("r", "s").alias("a"), F.greatest("r", "s").alias("b")), "ways")
    pairs = ways.select("a", "b").distinct().select("a", "b", F.floor(F.col("a") / span).cast("int").alias("p"), F.floor(F.col("b") / span).cast("int").alias("q"))
    both = F.array(F.struct(F.col("p").alias("part"), F.when(F.col("p") == F.col("q"), 0).otherwise(1).alias("kind")), F.when(F.col("p") < F.col("q"), F.struct(F.col("q").alias("part"), F.lit(2).alias("kind"))))
    met = materialise(pairs.select("a", "b", F.explode(both).alias("m")).where("m IS NOT NULL").select("a", "b", "m.*"), "met")
    most = met.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    chunks = max(1, -(-most // WAYS))
    met = met.withColumn("chunk", F.pmod(F.xxhash64("a", "b"), F.lit(chunks)).cast("int"))
    parted = inner.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def follow(key: tuple, x: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        k = int(key[0])
        own, on = blocks(k, es)
        own[0] = np.minimum(own[0], left[k])
        own[-1] = np.minimum(own[-1], right[k])
        got = _followed(own, on, x.a.to_numpy(np.int64) - k * span, x.b.to_numpy(np.int64) - k * span, x.kind.to_numpy(), w)
        return x[["a", "b", "kind", "part"]].assign(v=[y.view(np.float64) for y in got])

    # A part without edges of its own has no row among the edges; ways may end in it.
    got = met.groupBy("part", "chunk").cogroup(parted.groupBy("part", "chunk")).applyInPandas(lambda k, x, es: follow(k, x, es) if len(x) else pd.DataFrame(columns=["a", "b", "kind", "part", "v"]), "a long, b long, kind int, part int, v array<double>")
    got = materialise(got, "followed")
    found = got.where("kind = 0").select("a", "b", "v")
    if n_parts > 1:
        far = got.where("kind = 1").select("a", "b", F.col("part").alias("p"), "v").join(got.where("kind = 2").select("a", "b", F.col("part").alias("q"), F.col("v").alias("u")), ["a", "b"])
        found = found.unionByName(far.mapInPandas(_joined(cross, whole, dtype), "a long, b long, v array<double>"))
    one = F.get("v", F.lit(0))
    dist, hops = (F.floor(one / scale).cast("double"), one - F.floor(one / scale) * scale) if scale else (one, F.get("v", F.lit(1)))
    found = found.where(one < float("inf")).select("a", "b", dist.alias("dist"), (hops + 1).cast("int").alias("passed"))
    return ways.join(found, ["a", "b"]).select("node", "to", "dist", "passed")

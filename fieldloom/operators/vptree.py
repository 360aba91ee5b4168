"""A static vantage-point tree over points on the sphere, queried in batches."""

from __future__ import annotations

import numpy as np

EARTH_M = 6_371_000.0


def unit(lng: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Degrees to unit vectors, one row each."""
    a, b = np.radians(np.asarray(lng, float)), np.radians(np.asarray(lat, float))
    return np.stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b)], axis=-1)


def arc_m(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Great-circle metres between unit vectors, row by row (stable for small and large distances)."""
    chord = np.sqrt(((p - q) ** 2).sum(axis=-1))
    return 2 * EARTH_M * np.arcsin(np.minimum(1.0, chord / 2))


def haversine_m(lng1, lat1, lng2, lat2) -> np.ndarray:
    """Great-circle metres between positions in degrees; what results are decided by."""
    a1, b1, a2, b2 = (np.radians(np.asarray(v, float)) for v in (lng1, lat1, lng2, lat2))
    h = np.sin((b2 - b1) / 2) ** 2 + np.cos(b1) * np.cos(b2) * np.sin((a2 - a1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(1.0, h)))


class VantageTree:
    """Splits each node at the median distance to a vantage point; children keep their distance ranges."""

    def __init__(self, xyz: np.ndarray, leaf: int = 64):
        self.xyz = xyz
        self.nodes: list[tuple] = []
        todo = [(np.arange(len(xyz)), -1, 0)]
        while todo:
            idx, parent, side = todo.pop()
            me = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][3][side] = me
            if len(idx) <= leaf:
                self.nodes.append((None, idx, None, None))
                continue
            # A far point makes a better vantage than a central one.
            v = idx[int(np.argmax(arc_m(xyz[idx], xyz[idx[0]])))]
            d = arc_m(xyz[idx], xyz[v])
            mid = np.median(d)
            near = d <= mid
            if near.all():  # more than half of the points coincide in distance: split by rank
                near = np.zeros(len(d), bool)
                near[np.argsort(d, kind="stable")[: len(d) // 2]] = True
            sides = (idx[near], idx[~near])
            spans = tuple((d[m].min(), d[m].max()) for m in (near, ~near))
            self.nodes.append((v, None, spans, [-1, -1]))
            todo += [(sides[0], me, 0), (sides[1], me, 1)]

    def within(self, q: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (query, point) at most radius[query] metres apart, by a slack of a millimetre; callers decide exactly."""
        out_q, out_p = [np.zeros(0, int)], [np.zeros(0, int)]
        if not len(self.xyz) or not len(q):
            return out_q[0], out_p[0]
        r = np.asarray(radius, float) + 1e-3
        stack = [(0, np.arange(len(q)))]
        while stack:
            k, act = stack.pop()
            v, idx, spans, kids = self.nodes[k]
            if v is None:
                for s in range(0, len(act), 4096):
                    a = act[s : s + 4096]
                    d = arc_m(q[a][:, None, :], self.xyz[idx][None, :, :])
                    i, j = np.nonzero(d <= r[a][:, None])
                    out_q.append(a[i])
                    out_p.append(idx[j])
                continue
            d = arc_m(q[act], self.xyz[v])
            for (lo, hi), kid in zip(spans, kids):
                # Triangle inequality: a point at distance t from the vantage is at least |d - t| away.
                m = (d - r[act] <= hi) & (d + r[act] >= lo)
                if m.any():
                    stack.append((kid, act[m]))
        return np.concatenate(out_q), np.concatenate(out_p)

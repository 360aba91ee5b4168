"""A bounding-box tree over points and segments in the plane, and the nearest item of every point by it.

Items are put in the order of a space-filling curve and cut into blocks of about
BLOCK. A point goes to each block whose box may hold its nearest item: those no
farther than the nearest far corner of any box. Within a block a tree of boxes
rules out what is farther than the best item yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.runtime import materialise

#: Items of a block, and points that meet it in one task.
BLOCK = 20_000
POINTS = 100_000
#: Rows of the table of blocks that is sent to all executors at a time (some 10 MB); with more blocks they go in turns.
MOST_BOXES = 200_000


def _box_d2(x, y, x0, y0, x1, y1):
    """Squared distances of points to boxes."""
    return np.maximum(np.maximum(x0 - x, x - x1), 0.0) ** 2 + np.maximum(np.maximum(y0 - y, y - y1), 0.0) ** 2


def segment_d2(x, y, x1, y1, x2, y2):
    """Squared distances of points to segments, which may be points."""
    dx, dy = x2 - x1, y2 - y1
    e2 = dx * dx + dy * dy
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(e2 > 0, np.clip(((x - x1) * dx + (y - y1) * dy) / e2, 0.0, 1.0), 0.0)
    return (x - (x1 + t * dx)) ** 2 + (y - (y1 + t * dy)) ** 2


class BoxTree:
    """Items (n x 4: both ends) split at the median of the wider axis; each node keeps the box of its items."""

    def __init__(self, items: np.ndarray, leaf: int = 32):
        self.items = items
        self.lo, self.hi = np.minimum(items[:, :2], items[:, 2:]), np.maximum(items[:, :2], items[:, 2:])
        mid = (self.lo + self.hi) / 2
        self.nodes: list[tuple] = []
        todo = [(np.arange(len(items)), -1, 0)]
        while todo:
            idx, parent, side = todo.pop()
            if parent >= 0:
                self.nodes[parent][2][side] = len(self.nodes)
            box = (*self.lo[idx].min(axis=0), *self.hi[idx].max(axis=0)) if len(idx) else (np.inf, np.inf, -np.inf, -np.inf)
            if len(idx) <= leaf:
                self.nodes.append((box, idx, None))
                continue
            m = mid[idx]
            by = m[:, int(np.argmax(m.max(axis=0) - m.min(axis=0)))]
            order = idx[np.argsort(by, kind="stable")]
            me = len(self.nodes)
            self.nodes.append((box, None, [-1, -1]))
            todo += [(order[: len(order) // 2], me, 0), (order[len(order) // 2 :], me, 1)]

    def nearest(self, x: np.ndarray, y: np.ndarray, most: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(item, squared distance) for each point; of equals the first item; -1 where none is within `most`."""
        best, item = np.full(len(x), float(most) ** 2), np.full(len(x), len(self.items), np.int64)
        stack = [(0, np.arange(len(x)))] if len(self.items) else []
        while stack:
            k, act = stack.pop()
            box, idx, kids = self.nodes[k]
            act = act[_box_d2(x[act], y[act], *box) <= best[act]]
            if not len(act):
                continue
            if idx is not None:
                for s in range(0, len(act), 4096):
                    a = act[s : s + 4096]
                    it = self.items[np.sort(idx)]
                    d = segment_d2(x[a, None], y[a, None], it[None, :, 0], it[None, :, 1], it[None, :, 2], it[None, :, 3])
                    j = d.argmin(axis=1)
                    got, which = d[np.arange(len(a)), j], np.sort(idx)[j]
                    better = (got < best[a]) | ((got == best[a]) & (which < item[a]))
                    best[a[better]], item[a[better]] = got[better], which[better]
                continue
            # Each point's nearer child is searched before its farther one.
            d0, d1 = (_box_d2(x[act], y[act], *self.nodes[c][0]) for c in kids)
            first = d0 <= d1
            stack += [(kids[1], act[first]), (kids[0], act[~first]), (kids[0], act[first]), (kids[1], act[~first])]
        return np.where(item < len(self.items), item, -1), best


def _curve(x: Column, y: Column, box) -> Column:
    """Position on a Morton curve of 16 bits a side over the box."""
    out = F.lit(0).cast("long")
    for v, lo, hi, shift in ((x, box[0], box[2], 0), (y, box[1], box[3], 1)):
        n = F.least(F.floor((v - F.lit(float(lo))) / F.lit(max(float(hi) - float(lo), 1e-9)) * 65535.0), F.lit(65535)).cast("long")
        for s, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            n = n.bitwiseOR(F.shiftleft(n, s)).bitwiseAND(F.lit(mask).cast("long"))
        out = out.bitwiseOR(F.shiftleft(n, shift))
    return out


def nearest(points: DataFrame, items: DataFrame, point_id: str, item_id: str, most: float | None = None, block: int = BLOCK) -> DataFrame:
    """(point_id, item_id, d2): for each point the nearest item, the smallest id of equals; points without one are left out.

    points: (point_id, x, y); items: (item_id, x1, y1, x2, y2), segments or points.
    Rows with a null among these take no part. Items in one place count once, with
    their smallest id, so no crowded spot is compared point by point.
    """
    ends = ["x1", "y1", "x2", "y2"]
    kinds = dict(points.dtypes)[point_id], dict(items.dtypes)[item_id]
    it = materialise(items.select(item_id, *(F.col(c).cast("double").alias(c) for c in ends)).dropna().groupBy(*ends).agg(F.min(item_id).alias(item_id)), "items")
    box = it.agg(F.count("*"), F.min(F.least("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("x1", "x2")), F.max(F.greatest("y1", "y2"))).first()
    p = points.select(point_id, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    if not box[0]:
        return p.where("false").select(point_id, F.lit(None).cast(kinds[1]).alias(item_id), F.col("x").alias("d2"))
    n = -(-box[0] // block)
    order = _curve((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, box[1:])
    if n > 1:
        it = materialise(it.withColumn("_at", order).repartitionByRange(int(n), "_at", *ends).drop("_at").withColumn("block", F.spark_partition_id()), "blocks")
    else:
        it = it.withColumn("block", F.lit(0))
    boxes = it.groupBy("block").agg(F.min(F.least("x1", "x2")).alias("x0"), F.min(F.least("y1", "y2")).alias("y0"), F.max(F.greatest("x1", "x2")).alias("x1"), F.max(F.greatest("y1", "y2")).alias("y1"))
    # One row for each BLOCK items, at most MOST_BOXES rows here; coarser blocks keep that bound.
    table = boxes.limit(MOST_BOXES + 1).toPandas()
    if len(table) > MOST_BOXES:
        return nearest(points, items, point_id, item_id, most, block * 8)
    reach = np.inf if most is None else float(most)
    bb, ids = table[["x0", "y0", "x1", "y1"]].to_numpy(float), table.block.to_numpy()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Boxes come before points: a tree of their middles would do no better for a table this small.
        for b in batches:
            for s in range(0, len(b), max(1, 2_000_000 // len(bb))):
                c = b.iloc[s : s + max(1, 2_000_000 // len(bb))]
                x, y = c.x.to_numpy()[:, None], c.y.to_numpy()[:, None]
                far = np.maximum(np.abs(x - bb[:, 0]), np.abs(x - bb[:, 2])) ** 2 + np.maximum(np.abs(y - bb[:, 1]), np.abs(y - bb[:, 3])) ** 2
                bound = np.minimum(far.min(axis=1) * (1 + 1e-12), reach**2)
                i, j = np.nonzero(_box_d2(x, y, *bb.T) <= bound[:, None])
                yield c.iloc[i].assign(block=ids[j].astype("int32"))

    at = p.mapInPandas(assign, f"{point_id} {kinds[0]}, x double, y double, block int")
    many = materialise(at, "assigned") if n > 1 else at.withColumn("block", F.lit(0))
    size = many.groupBy("block").agg(F.ceil(F.count("*") / F.lit(POINTS)).cast("int").alias("parts"))
    q = many.join(F.broadcast(size), "block").withColumn("part", F.pmod(F.xxhash64(point_id), F.col("parts")).cast("int")).drop("parts")
    i = it.join(F.broadcast(size), "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def local(_key, ps: pd.DataFrame, xs: pd.DataFrame) -> pd.DataFrame:
        xs = xs.sort_values(item_id, kind="stable")
        k, d = BoxTree(xs[ends].to_numpy(float)).nearest(ps.x.to_numpy(float), ps.y.to_numpy(float), reach)
        ok = k >= 0
        return pd.DataFrame({point_id: ps[point_id].to_numpy()[ok], item_id: xs[item_id].to_numpy()[k[ok]], "d2": d[ok]})

    found = q.groupBy("block", "part").cogroup(i.groupBy("block", "part")).applyInPandas(local, f"{point_id} {kinds[0]}, {item_id} {kinds[1]}, d2 double")
    return found.groupBy(point_id).agg(F.min(F.struct("d2", item_id)).alias("m")).select(point_id, f"m.{item_id}", "m.d2")

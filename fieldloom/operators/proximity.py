"""Complete radius joins and region look-up on the sphere, by Voronoi cells around pivots.

Every location goes to the cell of its nearest pivot. A query of radius r also
goes to each other cell whose pivot is at most 2 r farther away than its own:
by the triangle inequality no cell beyond can hold a location within r. In each
cell a vantage-point tree over the cell's locations answers the cell's queries.
A crowded cell has pivots of its own, by which its locations and queries are parted
again in the same way; what is still crowded is cut into blocks, so no task grows with
the most crowded spot. Pivots are fitted on a bounded sample; they only affect
balance, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.vptree import EARTH_M, VantageTree, haversine_m, unit
from fieldloom.runtime import materialise

#: At most so many pivots, whatever the data: what is sent to the executors is at most 96 KB.
MAX_PIVOTS = 4096
#: Locations a cell should hold, while the number of pivots allows.
CELL = 1500
#: A cell of more than CROWDED times CELL locations has pivots of its own, at most so many: all cells' together take 25 MB.
CROWDED = 4
MAX_INNER = 256
#: A cell's block of locations, or of queries, holds about so many.
BLOCK = 20_000
#: Metres added wherever rounding could lose a cell.
SLACK_M = 1.0

RING = "array<struct<lng:double,lat:double>>"
QUERY = f"kind string, qid string, lng double, lat double, radius_m double, ring {RING}"


def position(c: Column) -> Column:
    """struct(lng, lat) of an array [lng, lat]; null where it is no position.

    The two numbers may be swapped: lng < 0 < lat holds the right way round. Null,
    short and non-finite arrays and those whose numbers don't fit either way
    ([0, 0] among them) are no position.
    """
    a, b = F.get(c, F.lit(0)), F.get(c, F.lit(1))
    return lng_lat(a, b)


def lng_lat(a: Column, b: Column) -> Column:
    """As `position`, for two columns."""
    ok = a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b) & (F.abs(a) <= 180) & (F.abs(b) <= 180)
    straight = F.struct(a.alias("lng"), b.alias("lat"))
    turned = F.struct(b.alias("lng"), a.alias("lat"))
    return F.when(ok & (a < 0) & (b > 0) & (b <= 90), straight).when(ok & (a > 0) & (b < 0) & (a <= 90), turned)


def fit_pivots(places: DataFrame, cell: int = CELL, most: int = MAX_PIVOTS) -> np.ndarray:
    """Unit vectors of at most `most` pivots: distinct places with the least hashes, about one for `cell` places."""
    n = places.count()
    k = int(min(most, max(1, n // cell)))
    rows = places.select("lng", "lat").orderBy(F.xxhash64("lng", "lat"), "lng", "lat").limit(k).collect()
    xy = np.array([(r.lng, r.lat) for r in rows], float).reshape(-1, 2)
    return unit(xy[:, 0], xy[:, 1])


def _cells(pivots: np.ndarray, xyz: np.ndarray, reach: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): of each row the nearest pivot's cell, and with `reach` all cells up to 2 * reach farther."""
    rows, cells = [np.zeros(0, int)], [np.zeros(0, int)]
    for s in range(0, len(xyz), 2048):
        dot = xyz[s : s + 2048] @ pivots.T
        if reach is None:
            rows.append(np.arange(s, s + len(dot)))
            cells.append(dot.argmax(axis=1))
            continue
        arc = 2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(np.maximum(0.0, 2 - 2 * dot)) / 2))
        i, j = np.nonzero(arc <= (arc.min(axis=1) + 2 * reach[s : s + len(dot)] + SLACK_M)[:, None])
        rows.append(i + s)
        cells.append(j)
    return np.concatenate(rows), np.concatenate(cells)


def inner_pivots(places: DataFrame, pivots: np.ndarray, cell: int = CELL) -> dict[int, np.ndarray]:
    """Pivots of the crowded cells by cell. Which places become one is drawn by their hashes, at a rate that bounds their number."""
    at = places.select("lng", "lat").mapInPandas(_assign(pivots, False), "lng double, lat double, cell int")
    # A row for each of at most MAX_PIVOTS cells.
    n = at.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED * cell)
    rate = n.select("cell", (F.least(F.col("n") / cell, F.lit(float(MAX_INNER))) / F.col("n")).alias("rate"))
    draw = F.pmod(F.xxhash64(F.lit(1), "lng", "lat"), F.lit(1 << 30)) / float(1 << 30)
    rows = at.join(F.broadcast(rate), "cell").where(draw < F.col("rate")).select("cell", "lng", "lat").toPandas()
    return {int(c): unit(g.lng.to_numpy(), g.lat.to_numpy()) for c, g in rows.groupby("cell") if len(g) > 1}


def _assign(pivots: np.ndarray, with_reach: bool, inner: dict[int, np.ndarray] | None = None):
    """Rows with their cell; with `inner`, cells are numbered by (cell, place of the inner pivot)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            xyz, reach = unit(b.lng.to_numpy(), b.lat.to_numpy()), b.radius_m.to_numpy(float) if with_reach else None
            row, cell = _cells(pivots, xyz, reach)
            if inner is not None:
                sub = np.zeros(len(row), int)
                rows, cells, subs = [row], [cell], [sub]
                for c in np.intersect1d(cell, list(inner)):
                    m = cell == c
                    # The same rule holds within a cell: a location within r is with a pivot at most 2 r farther than the nearest.
                    i, k = _cells(inner[int(c)], xyz[row[m]], None if reach is None else reach[row[m]])
                    rows.append(row[m][i])
                    cells.append(np.full(len(i), c))
                    subs.append(k)
                plain = ~np.isin(cell, list(inner))
                rows[0], cells[0], subs[0] = row[plain], cell[plain], sub[plain]
                row, cell = np.concatenate(rows), np.concatenate(cells) * MAX_INNER * 4 + np.concatenate(subs)
            yield b.iloc[row].assign(cell=cell.astype("int32"))

    return run


def inside(px: np.ndarray, py: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points lie in a closed ring, in degrees; a side shared by two rings counts a point for one of them.

    Each side is walked from its lower to its upper end, so neighbours that turn
    the other way compute the very same crossing.
    """
    x1, y1, x2, y2 = x[:-1], y[:-1], x[1:], y[1:]
    up = y1 <= y2
    lx, ly, hx, hy = np.where(up, x1, x2), np.where(up, y1, y2), np.where(up, x2, x1), np.where(up, y2, y1)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = lx + (py[:, None] - ly) * (hx - lx) / (hy - ly)
        cross = (ly <= py[:, None]) & (py[:, None] < hy) & (px[:, None] < at)
    return cross.sum(axis=1) % 2 == 1


def _local(_key, places: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    cols = ["kind", "qid", "q_lng", "q_lat", "lng", "lat", "distance_m"]
    if not len(places) or not len(queries):
        return pd.DataFrame({c: pd.Series(dtype=object if c in ("kind", "qid") else float) for c in cols})
    plng, plat = places.lng.to_numpy(float), places.lat.to_numpy(float)
    qlng, qlat, rad = queries.lng.to_numpy(float), queries.lat.to_numpy(float), queries.radius_m.to_numpy(float)
    qi, pi = VantageTree(unit(plng, plat)).within(unit(qlng, qlat), rad)
    d = haversine_m(qlng[qi], qlat[qi], plng[pi], plat[pi])
    rings = queries.ring.to_numpy()
    region = np.array([r is not None for r in rings])
    keep = region[qi] | (d <= rad[qi])
    in_ring = np.nonzero(region[qi])[0]
    in_ring = in_ring[np.argsort(qi[in_ring], kind="stable")]
    for m in np.split(in_ring, np.nonzero(np.diff(qi[in_ring]))[0] + 1) if len(in_ring) else []:
        ring = rings[qi[m[0]]]
        x, y = np.array([v["lng"] for v in ring], float), np.array([v["lat"] for v in ring], float)
        keep[m] = inside(plng[pi[m]], plat[pi[m]], x, y)
    qi, pi, d = qi[keep], pi[keep], d[keep]
    return pd.DataFrame({"kind": queries.kind.to_numpy()[qi], "qid": queries.qid.to_numpy()[qi], "q_lng": qlng[qi], "q_lat": qlat[qi], "lng": plng[pi], "lat": plat[pi], "distance_m": d})[cols]


def near(places: DataFrame, queries: DataFrame, pivots: np.ndarray | None = None, block: int = BLOCK, cell: int | None = None, most: int | None = None) -> DataFrame:
    """(kind, qid, q_lng, q_lat, lng, lat, distance_m) for each query and each place it reaches.

    places: distinct (lng, lat) without nulls. queries: columns of QUERY; a row
    with a ring reaches the places inside the ring (its lng, lat and radius_m must
    bound the ring, see `regions`), any other the places at most radius_m away.
    Ties, repeated queries and queries at one spot are all answered.
    """
    cell, most = cell or CELL, most or MAX_PIVOTS
    if pivots is None:
        pivots = fit_pivots(places, cell, most)
    if not len(pivots):
        return queries.where("false").select("kind", "qid", F.col("lng").alias("q_lng"), F.col("lat").alias("q_lat"), "lng", "lat", F.col("radius_m").alias("distance_m"))
    # Fewer places than MAX_PIVOTS cells hold crowd no cell.
    inner = inner_pivots(places, pivots, cell) if places.count() > most * cell else {}
    p = places.select("lng", "lat").mapInPandas(_assign(pivots, False, inner), "lng double, lat double, cell int")
    q = queries.select("kind", "qid", "lng", "lat", "radius_m", "ring").mapInPandas(_assign(pivots, True, inner), QUERY + ", cell int")
    # A row for each cell, inner ones told apart (a million at most): the number of blocks it is cut into, on either side.
    size = (
        p.select("cell", F.lit(1).alias("a"), F.lit(0).alias("b"))
        .unionByName(q.select("cell", F.lit(0).alias("a"), F.lit(1).alias("b")))
        .groupBy("cell")
        .agg(F.ceil(F.sum("a") / block).cast("int").alias("pb"), F.ceil(F.sum("b") / block).cast("int").alias("qb"))
        .where("pb > 0 AND qb > 0")
    )
    part = lambda n, *on: F.pmod(F.xxhash64(*on), F.col(n)).cast("int")
    pp = p.join(F.broadcast(size), "cell").select("cell", part("pb", "lng", "lat").alias("i"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("j"), "lng", "lat")
    qq = q.join(F.broadcast(size), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("pb") - 1)).alias("i"), part("qb", "kind", "qid", "lng", "lat").alias("j"), "kind", "qid", "lng", "lat", "radius_m", "ring")
    return pp.groupBy("cell", "i", "j").cogroup(qq.groupBy("cell", "i", "j")).applyInPandas(_local, "kind string, qid string, q_lng double, q_lat double, lng double, lat double, distance_m double")


def circles(df: DataFrame, kind: str, radius_m: float) -> DataFrame:
    """Queries of one radius around (qid, lng, lat)."""
    return df.select(F.lit(kind).alias("kind"), F.col("qid").cast("string").alias("qid"), "lng", "lat", F.lit(float(radius_m)).alias("radius_m"), F.lit(None).cast(RING).alias("ring"))


def regions(df: DataFrame, kind: str) -> DataFrame:
    """Queries for the places inside each (qid, ring); the circle around the middle of the ring's box bounds it.

    Null rings and those with under four corners are left out. An open ring is closed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for qid, ring in zip(b.qid, b.ring):
                pts = [] if ring is None else [v for v in ring if v is not None and v["lng"] is not None and v["lat"] is not None]
                if pts and (pts[0]["lng"], pts[0]["lat"]) != (pts[-1]["lng"], pts[-1]["lat"]):
                    pts = [*pts, pts[0]]
                if len(pts) < 4:
                    continue
                x, y = np.array([v["lng"] for v in pts]), np.array([v["lat"] for v in pts])
                cx, cy = (x.min() + x.max()) / 2, (y.min() + y.max()) / 2
                # A hundredth more than the farthest corner also bounds what straight lines in degrees add to an arc at this size.
                out.append((kind, qid, cx, cy, float(haversine_m(cx, cy, x, y).max()) * 1.01 + 1.0, [{"lng": float(u), "lat": float(v)} for u, v in zip(x, y)]))
            yield pd.DataFrame(out, columns=["kind", "qid", "lng", "lat", "radius_m", "ring"])

    return df.select(F.col("qid").cast("string").alias("qid"), "ring").where("ring IS NOT NULL").mapInPandas(run, QUERY)


def _met(developments: DataFrame, areas: DataFrame, schools: DataFrame, school_m: float, pair_m: float, block: int) -> tuple[DataFrame, DataFrame]:
    """(developments with their place, what each place meets): developments at one spot are one place."""
    apps = materialise(developments.select("app_id", position(F.col("centroid")).alias("p")).where("p IS NOT NULL AND app_id IS NOT NULL").select("app_id", "p.lng", "p.lat").distinct(), "apps")
    places = materialise(apps.select("lng", "lat").distinct(), "places")
    s = schools.select(F.col("school_id").alias("qid"), lng_lat(F.col("lng"), F.col("lat")).alias("p")).where("p IS NOT NULL AND qid IS NOT NULL").select("qid", "p.lng", "p.lat").distinct()
    a = areas.where("small_area_id IS NOT NULL").select(F.col("small_area_id").alias("qid"), "ring")
    own = places.select(F.lit(None).cast("string").alias("qid"), "lng", "lat")
    hits = near(places, circles(own, "development", pair_m).unionByName(circles(s, "school", school_m)).unionByName(regions(a, "area")), block=block)
    return apps, materialise(hits, "near")


def development_surroundings(developments: DataFrame, areas: DataFrame, schools: DataFrame, school_m: float = 250.0, pair_m: float = 40.0, block: int = BLOCK) -> DataFrame:
    """(relation, app_id, other_id): the area holding each development, schools and other developments close by.

    Developments without a position, and null ids, take no part; repeated rows count once.
    """
    apps, hits = _met(developments, areas, schools, school_m, pair_m, block)
    one = hits.where("kind <> 'development'").join(apps, ["lng", "lat"]).select(F.col("kind").alias("relation"), "app_id", F.col("qid").alias("other_id"))
    # Each pair of places is met from both ends; one is kept. A place met with itself pairs its own applications.
    two = hits.where("kind = 'development' AND (q_lng < lng OR (q_lng = lng AND q_lat <= lat))").select("q_lng", "q_lat", "lng", "lat")
    x = apps.select(F.col("lng").alias("q_lng"), F.col("lat").alias("q_lat"), F.col("app_id").alias("a"))
    y = apps.select("lng", "lat", F.col("app_id").alias("b"))
    pair = two.join(x, ["q_lng", "q_lat"]).join(y, ["lng", "lat"])
    same = (F.col("q_lng") == F.col("lng")) & (F.col("q_lat") == F.col("lat"))
    pair = pair.where((F.col("a") < F.col("b")) | (~same & (F.col("a") > F.col("b"))))
    pair = pair.select(F.lit("development").alias("relation"), F.least("a", "b").alias("app_id"), F.greatest("a", "b").alias("other_id"))
    return one.unionByName(pair).distinct()


def surroundings_count(developments: DataFrame, areas: DataFrame, schools: DataFrame, school_m: float = 250.0, pair_m: float = 40.0, block: int = BLOCK) -> DataFrame:
    """(app_id, place_id, n_area, n_school, n_development): one row for each development and position: its place, which those at the same spot share, and how much is about it.

    Places are counted first, with how many developments each has, so no pair of developments is made.
    """
    apps, hits = _met(developments, areas, schools, school_m, pair_m, block)
    size = apps.groupBy("lng", "lat").agg(F.count_distinct("app_id").alias("n"))
    fixed = hits.where("kind <> 'development'").groupBy("lng", "lat").agg(F.count_distinct(F.when(F.col("kind") == "area", F.col("qid"))).alias("n_area"), F.count_distinct(F.when(F.col("kind") == "school", F.col("qid"))).alias("n_school"))
    close = hits.where("kind = 'development'").select("q_lng", "q_lat", "lng", "lat").distinct().join(size, ["lng", "lat"]).groupBy(F.col("q_lng").alias("lng"), F.col("q_lat").alias("lat")).agg((F.sum("n") - 1).alias("n_development"))
    per = size.select("lng", "lat").join(fixed, ["lng", "lat"], "left").join(close, ["lng", "lat"], "left")
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return apps.join(per, ["lng", "lat"]).select("app_id", F.xxhash64("lng", "lat").alias("place_id"), z("n_area"), z("n_school"), z("n_development"))

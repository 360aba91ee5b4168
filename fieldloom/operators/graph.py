"""Graphs as edge tables (u, v, length): reduction, components, paths, trees.

Loops over rounds keep their state in the shared folder (`materialise`), so plans
stay short and lost executors cost one round at most. No task holds more than a
part of a graph, however large its components are.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.runtime import materialise


def parallel_min(edges: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One edge for each unordered pair of nodes: the shortest, ties to the least of the extra columns. Loops and nulls are left out."""
    e = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v AND length IS NOT NULL").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "length", *extra)
    best = e.groupBy("u", "v").agg(F.min(F.struct("length", *extra)).alias("m"))
    return best.select("u", "v", "m.length", *(f"m.{c}" for c in extra))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v", "length").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "length"))


#: Edges of a partition whose stars are found together.
CHUNK = 500_000


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each CHUNK edges (u, v) of a partition the stars of their components: every other node with the least."""

    def star(u: np.ndarray, v: np.ndarray) -> pd.DataFrame:
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        root = np.arange(len(nodes))
        while len(a):
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, root[a], low)
            np.minimum.at(root, root[b], low)
            while (root[root] != root).any():
                root = root[root]
            apart = root[a] != root[b]
            a, b = a[apart], b[apart]
        m = root != np.arange(len(nodes))
        return pd.DataFrame({"u": nodes[m], "v": nodes[root[m]]})

    held: list[pd.DataFrame] = []
    for b in batches:
        held.append(b)
        if sum(map(len, held)) >= CHUNK:
            yield star(np.concatenate([h.u.to_numpy() for h in held]), np.concatenate([h.v.to_numpy() for h in held]))
            held = []
    if sum(map(len, held)):
        yield star(np.concatenate([h.u.to_numpy() for h in held]), np.concatenate([h.v.to_numpy() for h in held]))


def components(edges: DataFrame, nodes: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """(node, component): the least node of each connected component.

    Every partition's edges are first brought down to the stars of their own components.
    Stars of at most `chunk` edges in all are then brought together in one task; more are joined in rounds, with the same result:
    big-star hooks each node's larger neighbours to its least, small-star the smaller ones; the edge
    set shrinks to stars in a number of rounds that grows with the logarithm of the longest path.
    """
    kind = dict(edges.dtypes)["u"]
    e = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = materialise(e.mapInPandas(_stars, f"u {kind}, v {kind}"), "star")
    before = None
    if e.count() <= chunk:
        e = e.coalesce(1).mapInPandas(_stars, f"u {kind}, v {kind}")
    else:
        while True:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            big = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            # A node hooked to its least neighbour stays hooked.
            big = big.unionByName(low.where("u <> m").select("u", F.col("m").alias("v"))).distinct()
            # Small star on the result: every node's smaller neighbours, and itself, to the least of them.
            least = big.groupBy("u").agg(F.min("v").alias("m"))
            e = materialise(big.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "star")
            now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == before:
                break
            before = now
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node")))
    if nodes is not None:
        roots = roots.unionByName(nodes.select("node"))
    roots = roots.where("node IS NOT NULL").distinct()
    return roots.join(out, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def contracted(edges: DataFrame) -> DataFrame:
    """(u, v, length, n): chains of edges through nodes with just two neighbours as one edge each, of n edges; rings of such nodes come out as a loop at their least node."""
    e = materialise(parallel_min(edges), "edges")
    ends = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node")))
    mid = materialise(ends.groupBy("node").agg(F.count("*").alias("k")).where("k = 2").select("node"), "middle")
    mu, mv = mid.select(F.col("node").alias("u"), F.lit(True).alias("mu")), mid.select(F.col("node").alias("v"), F.lit(True).alias("mv"))
    e = e.join(mu, "u", "left").join(mv, "v", "left")
    chain = components(e.where("mu AND mv").select("u", "v"), mid)
    cu, cv = (chain.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "uv")
    e = materialise(e.join(cu, "u", "left").join(cv, "v", "left").withColumn("chain", F.coalesce("cu", "cv")), "chains")
    plain = e.where("chain IS NULL").select("u", "v", "length", F.lit(1).cast("long").alias("n"))
    out = F.array_sort(F.flatten(F.collect_list(F.filter(F.array(F.when(F.col("mu").isNull(), F.col("u")), F.when(F.col("mv").isNull(), F.col("v"))), lambda x: x.isNotNull()))))
    one = e.where("chain IS NOT NULL").groupBy("chain").agg(out.alias("o"), F.sum("length").alias("length"), F.count("*").alias("n"))
    return plain.unionByName(one.select(F.coalesce(F.get("o", F.lit(0)), "chain").alias("u"), F.coalesce(F.get("o", F.lit(1)), F.get("o", F.lit(0)), "chain").alias("v"), "length", "n"))


#: Nodes of a part that one task searches at a time.
PART = 20_000


def parts(nodes: DataFrame, size: int = PART) -> DataFrame:
    """(node, part): the distinct nodes in ranges of their order, about `size` in each. Ids near each other are taken to lie near each other; others only cost rounds."""
    n = materialise(nodes.select("node").where("node IS NOT NULL").distinct(), "nodes")
    k = -(-n.count() // size)
    if k <= 1:
        return n.withColumn("part", F.lit(0))
    return materialise(n.repartitionByRange(int(k), "node").withColumn("part", F.spark_partition_id()), "parts")


def bfs(edges: DataFrame, sources: DataFrame, size: int = PART) -> DataFrame:
    """(node, depth, parent): hops from the nearest source; parents lie on ways to the least of equally near sources, the least of several."""
    out = shortest_paths(edges.select("u", "v", F.lit(1.0).alias("length")), sources, size)
    return out.select("node", F.col("dist").cast("int").alias("depth"), F.col("pred").alias("parent"))


def bfs_rounds(edges: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(node, depth, parent) within `most` hops, one join a hop: for shallow searches. Of several parents the least."""
    step = both_ways(edges.select("u", "v", F.lit(1.0).alias("length"))).select("u", "v").distinct()
    front = materialise(sources.select("node").where("node IS NOT NULL").distinct().select("node", F.lit(0).alias("depth"), F.lit(None).cast(dict(sources.dtypes)["node"]).alias("parent")), "front")
    seen, depth = front, 0
    while depth < most:
        depth += 1
        new = front.join(step, F.col("node") == F.col("u")).groupBy("v").agg(F.min("u").alias("parent")).join(seen.select(F.col("node").alias("v")), "v", "left_anti")
        front = materialise(new.select(F.col("v").alias("node"), F.lit(depth).alias("depth"), "parent"), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def _local_paths():
    """One part's search: labels that reach it are followed as far as they improve what its nodes have. A root is its own predecessor."""

    def run(_key, labels: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        near = defaultdict(list)
        for u, v, w in zip(es.u.tolist(), es.v.tolist(), es.length.tolist()):
            near[u].append((v, w))
            near[v].append((u, w))
        best: dict = {}
        heap = []
        # A label is (distance, root, edges, predecessor); the least is best. Counting edges keeps those without length from leading in circles.
        for d, r, h, p, n, new in zip(*(labels[c].tolist() for c in ("dist", "root", "hops", "pred", "node", "new"))):
            if new:
                heap.append((d, r, h, p, n))
            else:
                best[n] = (d, r, h, p)
        heapq.heapify(heap)
        moved = set()
        while heap:
            d, r, h, p, n = heapq.heappop(heap)
            if n in best and best[n] <= (d, r, h, p):
                continue
            best[n] = (d, r, h, p)
            moved.add(n)
            for v, w in near[n]:
                label = (d + w, r, h + 1, n)
                if v not in best or label < best[v]:
                    heapq.heappush(heap, (*label, v))
        return pd.DataFrame([(n, *x, n in moved) for n, x in best.items()], columns=["node", "dist", "root", "hops", "pred", "new"])

    return run


def shortest_paths(edges: DataFrame, sources: DataFrame, size: int = PART) -> DataFrame:
    """(node, dist, root, pred): the nearest source of every node it can be reached from, by total length.

    The graph is cut into parts of about `size` nodes. In each round the labels that
    reached a part are followed within it by a heap search, then over the edges between
    parts, until none improves: as many rounds as a way crosses parts, and no
    task holds more than a part. Ties go to the smaller root, then
    fewer edges, then the smaller predecessor.
    """
    e = materialise(parallel_min(edges), "edges")
    kind = dict(e.dtypes)["u"]
    ends = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node")))
    part = parts(ends, size)
    starts = sources.select("node").where("node IS NOT NULL").distinct().join(part, "node").select("part", "node", F.lit(0.0).alias("dist"), F.col("node").alias("root"), F.lit(0).alias("hops"), F.col("node").alias("pred"))
    label = ["dist", "root", "hops", "pred"]
    run = _local_paths()
    if part.agg(F.max("part")).first()[0] in (None, 0):
        # One part holds it all: one search, and nothing to carry on.
        one = starts.withColumn("new", F.lit(True)).groupBy("part").cogroup(e.withColumn("part", F.lit(0)).groupBy("part"))
        found = one.applyInPandas(lambda a, b: run(None, a, b).drop(columns="new"), f"node {kind}, dist double, root {kind}, hops int, pred {kind}")
        return found.select("node", "dist", "root", F.nullif("pred", "node").alias("pred"))
    pu, pv = part.select(F.col("node").alias("u"), F.col("part").alias("pu")), part.select(F.col("node").alias("v"), F.col("part").alias("pv"))
    e = materialise(e.join(pu, "u").join(pv, "v"), "parted")
    inner = e.where("pu = pv").select(F.col("pu").alias("part"), "u", "v", "length")
    across = e.where("pu <> pv")
    across = materialise(across.select("u", "v", "length", F.col("pv").alias("part")).unionByName(across.select(F.col("v").alias("u"), F.col("u").alias("v"), "length", F.col("pu").alias("part"))), "across")
    news = materialise(starts, "labels")
    state = news.where("false")
    while not news.isEmpty():
        # Only parts that something reaches are searched; the others keep what they have.
        live = F.broadcast(news.select("part").distinct())
        rows = state.join(live, "part", "left_semi").withColumn("new", F.lit(False)).unionByName(news.withColumn("new", F.lit(True)))
        es = inner.join(live, "part", "left_semi")
        got = rows.groupBy("part").cogroup(es.groupBy("part")).applyInPandas(lambda k, a, b: run(k, a, b).assign(part=k[0]), f"node {kind}, dist double, root {kind}, hops int, pred {kind}, new boolean, part int")
        got = materialise(got.select("part", "node", *label, "new"), "labels")
        state = materialise(state.join(live, "part", "left_anti").unionByName(got.drop("new")), "state")
        on = got.where("new").select(F.col("node").alias("u"), "dist", "root", "hops").join(across, "u").select("part", F.col("v").alias("node"), (F.col("dist") + F.col("length")).alias("dist"), "root", (F.col("hops") + 1).alias("hops"), F.col("u").alias("pred"))
        best = on.groupBy("part", "node").agg(F.min(F.struct(*label)).alias("m")).select("part", "node", "m.*")
        have = state.select("node", *(F.col(c).alias(f"h_{c}") for c in label))
        worse = F.struct(*label) < F.struct(*(F.col(f"h_{c}") for c in label))
        news = materialise(best.join(have, "node", "left").where(F.col("h_dist").isNull() | worse).select("part", "node", *label), "labels")
    return state.select("node", "dist", "root", F.nullif("pred", "node").alias("pred"))


#: Starts whose searches meet a part in one task.
STARTS = 2_000


def pair_paths(edges: DataFrame, legs: DataFrame, size: int = PART, starts: int = STARTS) -> DataFrame:
    """(node, to, dist, path): the shortest way from `node` to `to` for each distinct leg, with the nodes it passes; legs without a way are left out.

    Searches go from part to part as in `shortest_paths`, each start's on its own; once all of
    a start's goals are reached, labels beyond the farthest are dropped. Ties go to fewer edges, then the smaller predecessor.
    """
    e = materialise(parallel_min(edges), "edges")
    kind = dict(e.dtypes)["u"]
    part = parts(e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node"))), size)
    pu, pv = part.select(F.col("node").alias("u"), F.col("part").alias("pu")), part.select(F.col("node").alias("v"), F.col("part").alias("pv"))
    e = materialise(e.join(pu, "u").join(pv, "v"), "parted")
    inner = e.where("pu = pv").select(F.col("pu").alias("part"), "u", "v", "length")
    across = e.where("pu <> pv")
    across = materialise(across.select("u", "v", "length", F.col("pv").alias("part")).unionByName(across.select(F.col("v").alias("u"), F.col("u").alias("v"), "length", F.col("pu").alias("part"))), "across")
    want = materialise(legs.select("node", "to").dropna().distinct(), "legs")
    roots = want.select("node").distinct().join(part, "node")
    chunks = max(1, -(-roots.count() // starts))
    goals = want.groupBy(F.col("node").alias("root")).agg(F.count("*").alias("goals"))
    news = materialise(roots.select("part", F.pmod(F.xxhash64("node"), F.lit(chunks)).alias("chunk"), "node", F.lit(0.0).alias("dist"), F.col("node").alias("root"), F.lit(0).alias("hops"), F.col("node").alias("pred")), "labels")
    keys, label = ["part", "chunk"], ["dist", "hops", "pred"]
    cols = [*keys, "root", "node", *label]
    state = news.where("false").select(cols)
    one = _local_paths()

    def run(key, labels: pd.DataFrame, es: pd.DataFrame) -> pd.DataFrame:
        done = [one(None, some, es) for _, some in labels.groupby("root", sort=True)]
        return pd.concat(done, ignore_index=True).assign(part=key[0], chunk=key[1])

    while not news.isEmpty():
        live = materialise(news.select(*keys).distinct(), "live")
        rows = state.join(live, keys, "left_semi").withColumn("new", F.lit(False)).unionByName(news.select(cols).withColumn("new", F.lit(True)))
        es = inner.join(live, "part")
        got = rows.groupBy(*keys).cogroup(es.groupBy(*keys)).applyInPandas(run, f"node {kind}, dist double, root {kind}, hops int, pred {kind}, new boolean, part int, chunk long")
        got = materialise(got.select(*cols, "new"), "labels")
        state = materialise(state.join(live, keys, "left_anti").unionByName(got.drop("new")), "state")
        met = state.join(want.select(F.col("node").alias("root"), F.col("to").alias("node")), ["root", "node"]).groupBy("root").agg(F.count("*").alias("n"), F.max("dist").alias("far"))
        bound = goals.join(met, "root").where("n = goals").select("root", "far")
        on = got.where("new").select(F.col("node").alias("u"), "dist", "root", "hops", "chunk").join(across, "u").select("part", "chunk", "root", F.col("v").alias("node"), (F.col("dist") + F.col("length")).alias("dist"), (F.col("hops") + 1).alias("hops"), F.col("u").alias("pred"))
        best = on.groupBy(*keys, "root", "node").agg(F.min(F.struct(*label)).alias("m")).select(*keys, "root", "node", "m.*").join(bound, "root", "left").where("far IS NULL OR dist <= far").drop("far")
        have = state.select("root", "node", *(F.col(c).alias(f"h_{c}") for c in label))
        news = materialise(best.join(have, ["root", "node"], "left").where(F.col("h_dist").isNull() | (F.struct(*label) < F.struct(*(F.col(f"h_{c}") for c in label)))).select(cols), "labels")
    # Each start has its own tree, its nodes told apart by it; the ways are climbed from the goals.
    at = lambda n: F.concat_ws(" ", F.col("root").cast("string"), F.col(n).cast("string"))
    tree = state.select(at("node").alias("key"), F.when(F.col("pred") != F.col("node"), at("pred")).alias("parent"), "root", "node", "dist", "hops")
    ends = want.select(F.col("node").alias("root"), F.col("to").alias("node")).join(state.select("root", "node"), ["root", "node"]).select(at("node").alias("node"), at("node").alias("app_id"))
    passed = path_accumulate(tree.select(F.col("key").alias("node"), "parent"), ends, size)
    way = passed.withColumnRenamed("node", "key").join(tree.select("key", "root", "node", "dist", "hops"), "key")
    way = way.groupBy("app_id").agg(F.array_sort(F.collect_list(F.struct("hops", "node"))).alias("w"), F.max("dist").alias("dist"), F.first("root").alias("node"))
    return way.select("node", F.element_at("w", -1).node.alias("to"), "dist", F.transform("w", lambda x: x.node).alias("path"))


def _climb(sums: bool):
    """One part's loads carried up its tree: a row for each node passed, and those that leave for another part."""

    def run(_key, loads: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        up = dict(zip(tree.node.tolist(), tree.parent.tolist()))
        out = []
        if sums:
            total: dict = defaultdict(float)
            depth: dict = {}
            for n, x in zip(loads.node.tolist(), loads.load.tolist()):
                total[n] += x
            # Nodes are taken from the deepest up, so each is passed on once.
            for n in list(total):
                path = []
                while n not in depth and n in up:
                    path.append(n)
                    n = up[n]
                d = depth.get(n, 0)
                for m in reversed(path):
                    d += 1
                    depth[m] = d
            for n in sorted(depth, key=depth.get, reverse=True):
                total[up[n]] += total[n]
            out = [(n, x, n not in up) for n, x in total.items()]
        else:
            seen = set()
            for n, x in zip(loads.node.tolist(), loads.load.tolist()):
                while (n, x) not in seen:
                    seen.add((n, x))
                    out.append((n, x, n not in up))
                    if n not in up:
                        break
                    n = up[n]
        return pd.DataFrame(out, columns=["node", "load", "left"])

    return run


def _carried(tree: DataFrame, loads: DataFrame, sums: bool, size: int) -> DataFrame:
    """(node, load): loads with every node on their way to the root, or their sums; part by part, in as many rounds as a way crosses parts."""
    t = materialise(tree.select("node", "parent"), "tree")
    part = parts(t.select("node").unionByName(t.select(F.col("parent").alias("node"))), size)
    up = t.where("parent IS NOT NULL").join(part, "node").join(part.select(F.col("node").alias("parent"), F.col("part").alias("parent_part")), "parent")
    up = materialise(up.select("node", "parent", "part", "parent_part"), "up")
    inner, over = up.where("part = parent_part").select("part", "node", "parent"), up.where("part <> parent_part").select("node", "parent", "parent_part")
    kind, app = dict(t.dtypes)["node"], "double" if sums else dict(loads.dtypes)["load"]
    run = _climb(sums)
    # Loads of nodes the tree doesn't have stay where they are.
    outside = loads.join(part, "node", "left_anti").select("node", "load")
    news, done = materialise(loads.join(part, "node").select("part", "node", "load"), "loads"), []
    while not news.isEmpty():
        live = F.broadcast(news.select("part").distinct())
        got = news.groupBy("part").cogroup(inner.join(live, "part", "left_semi").groupBy("part")).applyInPandas(run, f"node {kind}, load {app}, left boolean")
        got = materialise(got, "carried")
        done.append(got.select("node", "load"))
        on = got.where("left").join(over, "node").select(F.col("parent_part").alias("part"), F.col("parent").alias("node"), "load")
        news = materialise(on.groupBy("part", "node").agg(F.sum("load").alias("load")) if sums else on.distinct(), "loads")
    out = outside
    for d in done:
        out = out.unionByName(d)
    return out.groupBy("node").agg(F.sum("load").alias("load")) if sums else out.distinct()


def path_accumulate(tree: DataFrame, loads: DataFrame, size: int = PART) -> DataFrame:
    """(node, app_id): each load of a node with every node on its way to the root, itself included.

    tree: (node, parent), null parent at roots; loads: (node, app_id). The result has as
    many rows as the loaded ways have nodes, and nothing larger is made; where only sums are wanted, `path_sums` needs no such rows.
    """
    return _carried(tree, loads.select("node", F.col("app_id").alias("load")).dropna(), False, size).withColumnRenamed("load", "app_id")


def path_sums(tree: DataFrame, loads: DataFrame, size: int = PART) -> DataFrame:
    """(node, load): the sum of the loads whose way to the root passes each node. loads: (node, load); null loads count 0."""
    own = loads.where("node IS NOT NULL").groupBy("node").agg(F.sum(F.coalesce(F.col("load").cast("double"), F.lit(0.0))).alias("load"))
    return _carried(tree, own, True, size)


def kruskal(edges: pd.DataFrame) -> pd.DataFrame:
    """A minimum spanning forest; ties by ends."""
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    keep = []
    for row in edges.sort_values(["length", "u", "v"], kind="stable").itertuples(index=False):
        a, b = find(row.u), find(row.v)
        if a != b:
            up[a] = b
            keep.append(row)
    return pd.DataFrame(keep, columns=edges.columns)


#: Edges of a graph of terminals that one task spans; larger ones are spanned by rounds, with the same result.
SPANNED = 200_000


def spanning_forest(edges: DataFrame, most: int = SPANNED) -> DataFrame:
    """The rows of `edges` (u, v, length, ...) that make a minimum spanning forest, ties by ends.

    Up to `most` edges in one task; beyond, each tree takes its least edge to another
    tree in rounds that at least halve the number of trees.
    """
    e = materialise(edges, "bridges")
    cols = e.columns
    if e.count() <= most:
        return e.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(lambda x: kruskal(x.drop(columns="_all")), e.schema)
    tree = None
    kept: list[DataFrame] = []
    left = e
    while True:
        if tree is not None:
            ru, rv = tree.select(F.col("node").alias("u"), F.col("component").alias("tu")), tree.select(F.col("node").alias("v"), F.col("component").alias("tv"))
            left = materialise(left.drop("tu", "tv").join(ru, "u").join(rv, "v").where("tu <> tv"), "between")
        else:
            left = left.withColumn("tu", F.col("u")).withColumn("tv", F.col("v")).where("u <> v")
        row = F.struct("length", "u", "v", *(c for c in cols if c not in ("length", "u", "v")))
        least = left.select(F.explode(F.array("tu", "tv")).alias("t"), row.alias("r")).groupBy("t").agg(F.min("r").alias("r"))
        new = materialise(least.select("r.*").distinct().select(cols), "least")
        if new.isEmpty():
            break
        kept.append(new)
        all_kept = kept[0]
        for k in kept[1:]:
            all_kept = all_kept.unionByName(k)
        nodes = e.select(F.col("u").alias("node")).unionByName(e.select(F.col("v").alias("node")))
        tree = materialise(components(all_kept.select("u", "v"), nodes), "trees")
    if not kept:
        return e.where("false")
    return all_kept


def steiner(edges: DataFrame, terminals: DataFrame, size: int = PART, most: int = SPANNED) -> DataFrame:
    """(u, v, length): a tree over the terminals of each component, at most twice the shortest (Mehlhorn's construction).

    Every node goes to its nearest terminal; edges between two terminals' regions
    give the terminal graph, whose spanning forest is expanded along the shortest
    paths. All ends are terminals, as every bridge is led to a terminal on both sides.
    """
    e = materialise(parallel_min(edges), "reduced")
    near = materialise(shortest_paths(e, terminals, size), "regions")
    a = near.select(F.col("node").alias("u"), F.col("dist").alias("du"), F.col("root").alias("ru"))
    b = near.select(F.col("node").alias("v"), F.col("dist").alias("dv"), F.col("root").alias("rv"))
    cross = e.join(a, "u").join(b, "v").where("ru <> rv").select(F.least("ru", "rv").alias("a"), F.greatest("ru", "rv").alias("b"), "u", "v", "length", (F.col("du") + F.col("length") + F.col("dv")).alias("cost"))
    bridge = cross.groupBy("a", "b").agg(F.min(F.struct("cost", "u", "v", "length")).alias("m")).select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("m.cost").alias("length"), F.col("m.u").alias("x"), F.col("m.v").alias("y"), F.col("m.length").alias("w"))
    spans = materialise(spanning_forest(bridge, most).select(F.col("x").alias("u"), F.col("y").alias("v"), F.col("w").alias("length")), "spans")
    ends = spans.select(F.col("u").alias("node"), F.lit(0.0).alias("load")).unionByName(spans.select(F.col("v").alias("node"), F.lit(0.0).alias("load")))
    on_way = path_sums(near.select("node", F.col("pred").alias("parent")), ends, size).select("node")
    legs = near.join(on_way, "node", "left_semi").where("pred IS NOT NULL").select(F.least("node", "pred").alias("u"), F.greatest("node", "pred").alias("v")).distinct().join(e, ["u", "v"])
    return materialise(spans.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "length").unionByName(legs.select("u", "v", "length")).distinct(), "tree")

"""Density clusters and tours over planar points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.graph import components
from fieldloom.operators.spatial import radius_join
from fieldloom.runtime import materialise


def dbscan(points: DataFrame, eps: float, least: int, point_id: str) -> DataFrame:
    """(point_id, cluster): the least core point's id of each density cluster; null for noise.

    A point with `least` points within eps (itself counted) is core; clusters are
    components of core points within eps of each other; a border point joins the
    cluster of its smallest core neighbour. Points without a position are noise.
    """
    # Points at one spot are one place, named by the least of them, so crowded spots make no pairs.
    at = points.where("x IS NOT NULL AND y IS NOT NULL").select(point_id, "x", "y")
    places = materialise(at.groupBy("x", "y").agg(F.min(point_id).alias("u"), F.count("*").alias("n")), "places")
    other = places.select(F.col("u").alias("v"), "x", "y", F.col("n").alias("m"))
    link = materialise(radius_join(places, other.select("v", "x", "y"), eps, "u", "v").where("u <> v").select("u", "v"), "near")
    around = link.join(other.select("v", "m"), "v").groupBy("u").agg(F.sum("m").alias("m"))
    core = materialise(places.join(around, "u", "left").where((F.col("n") + F.coalesce("m", F.lit(0))) >= least).select(F.col("u").alias("node")), "core")
    c1, c2 = core.withColumnRenamed("node", "u"), core.withColumnRenamed("node", "v")
    dense = link.join(c1, "u", "left_semi").join(c2, "v", "left_semi")
    label = materialise(components(dense, core).join(core, "node", "left_semi"), "labels")
    border = link.join(c2, "v", "left_semi").join(c1, "u", "left_anti").groupBy("u").agg(F.min("v").alias("v"))
    border = border.join(label.withColumnRenamed("node", "v"), "v").select(F.col("u").alias("node"), "component")
    of = label.unionByName(border).select(F.col("node").alias("u"), F.col("component").alias("cluster"))
    found = at.join(places.select("x", "y", "u"), ["x", "y"]).join(of, "u").select(point_id, "cluster")
    return points.select(point_id).join(found, point_id, "left")


def greedy_tours(points: DataFrame, group: str, point_id: str) -> DataFrame:
    """(group, point_id, stop): in each group, always on to the nearest point not visited, from the centre; ties to the smaller id."""
    kinds = dict(points.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(point_id, kind="stable").reset_index(drop=True)
        xy = pdf[["x", "y"]].to_numpy(float)
        at, left, out = xy.mean(axis=0), list(range(len(pdf))), []
        while left:
            d = ((xy[left] - at) ** 2).sum(axis=1)
            k = left.pop(int(np.argmin(d)))
            out.append(k)
            at = xy[k]
        return pd.DataFrame({group: pdf[group].to_numpy()[out], point_id: pdf[point_id].to_numpy()[out], "stop": np.arange(len(out), dtype="int32")})

    return points.where("x IS NOT NULL AND y IS NOT NULL").select(group, point_id, "x", "y").where(F.col(group).isNotNull()).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {point_id} {kinds[point_id]}, stop int")

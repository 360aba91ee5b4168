"""Site polygons by application, the ground each development takes, and returns added up by street."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import geo, text


def polygons(features: DataFrame, owner: str, number: str) -> DataFrame:
    """(app_id, parts, area): the valid outer rings of each application's features, as one site of several parts; others are left out.

    features has rings as `paged_features` gives them. Parts that are delivered again count once.
    """
    one = features.select(text.initials_id(F.col(owner), F.col(number)).alias("app_id"), F.explode("rings").alias("ring")).where("app_id IS NOT NULL").where(geo.valid_ring(F.col("ring"))).distinct()
    return one.groupBy("app_id").agg(F.array_sort(F.collect_list("ring")).alias("parts"), F.sum(geo.area(F.col("ring"))).alias("area"))


def footprints(developments: DataFrame, sites: DataFrame, half: float = 20.0) -> DataFrame:
    """Developments (app_id, x, y) with the ground they take: their site's parts, else a square about their point; and a point surely on it."""
    d = developments.join(sites.select("app_id", "parts"), "app_id", "left")
    has = F.size("parts") > 0
    d = d.withColumn("footprint_source", F.when(has, "polygon").otherwise("buffered_point"))
    d = d.withColumn("parts", F.when(has, F.col("parts")).otherwise(F.array(geo.square(F.col("x"), F.col("y"), half))))
    # The middle of a square is its point.
    return d.withColumn("at", geo.inner_point(geo.largest_part(F.col("parts")).ring))


def returns_by_street(returns: DataFrame, street: str, number: str) -> DataFrame:
    """(street, visits, inspections): returns added up by the normal form of the capitals that open their street; what is no number counts 0."""
    name = text.norm_street(text.leading_capitals(F.col(street)))
    r = returns.select(name.alias("street"), text.whole(F.trim(number)).alias("n")).where("street IS NOT NULL")
    return r.groupBy("street").agg(F.count("*").alias("visits"), F.sum("n").alias("inspections"))


def served_first(planned: DataFrame, known: DataFrame) -> DataFrame:
    """Planned rows whose reading is known, with it: what isn't known yet is left out."""
    return planned.join(known, "app_id")

"""Totals over developments, extensions and areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.keyed import counts_map


def totals(developments: DataFrame, extensions: DataFrame, per_unit: float = 2.7) -> DataFrame:
    """One row: developments, units, residents, those not connected, kilometres of new line (each edge once), metres of laterals.

    Nulls count 0; where no residents are known they are units times `per_unit`. Laterals are
    the ways of unconnected developments that no extension serves.
    """
    z = lambda c, v: F.coalesce(F.sum(c), F.lit(v))
    units = z(F.col("units"), 0)
    residents = F.coalesce(F.nullif(z(F.col("residents"), 0.0), F.lit(0.0)), F.round(units * per_unit))
    d = developments.agg(F.count("*").alias("developments"), units.alias("units"), residents.alias("residents"), z(F.when(~F.col("connected"), F.col("units")), 0).alias("unconnected_units"))
    e = extensions.groupBy("edge_id").agg(F.max("length").alias("m")).agg(F.round(F.coalesce(F.sum("m"), F.lit(0.0)) / 1000.0, 3).alias("new_km"))
    on = extensions.select(F.explode("serves_app_ids").alias("app_id")).distinct()
    l = developments.where("connected = false").join(on, "app_id", "left_anti").agg(F.coalesce(F.sum(F.coalesce(F.col("route_m").cast("double"), F.lit(0.0))), F.lit(0.0)).alias("laterals_m")) if "route_m" in developments.columns else e.select(F.lit(0.0).alias("laterals_m"))
    return d.join(F.broadcast(e), F.lit(True)).join(F.broadcast(l), F.lit(True))  # one row each


def largest(developments: DataFrame, n: int, by: str = "units") -> DataFrame:
    """The n rows with the most of a measure, ties by id; nulls come last."""
    return developments.orderBy(F.col(by).desc_nulls_last(), "app_id").limit(n)


def in_order(extensions: DataFrame) -> DataFrame:
    """Extensions in the order of building, ties by edge."""
    return extensions.orderBy("ord", "edge_id")


def apps_of_stops(stops: DataFrame, nearest: DataFrame) -> DataFrame:
    """Stops with whether any development's nearest stop they are, and whose: nearest has (app_id, stop_id)."""
    apps = nearest.where("stop_id IS NOT NULL").groupBy("stop_id").agg(F.array_sort(F.collect_set("app_id")).alias("app_ids"))
    return stops.join(apps, "stop_id", "left").withColumn("app_ids", F.coalesce("app_ids", F.array().cast("array<string>"))).withColumn("used", F.size("app_ids") > 0)


def by_area(developments: DataFrame, extensions: DataFrame) -> DataFrame:
    """(area, units, residents, new_km): lengths are split evenly over the developments an edge serves."""
    d = developments.groupBy("area").agg(F.sum("units").alias("units"), F.sum("residents").alias("residents"))
    each = F.col("length") / 1000.0 / F.greatest(F.size("serves_app_ids"), F.lit(1))
    km = extensions.select(F.explode("serves_app_ids").alias("app_id"), each.alias("km")).join(developments.select("app_id", "area"), "app_id").groupBy("area").agg(F.sum("km").alias("new_km"))
    return d.join(km, "area", "left").withColumn("new_km", F.coalesce("new_km", F.lit(0.0)))


def by_bore(extensions: DataFrame) -> DataFrame:
    """(lengths, widest): kilometres by bore as a map in the order of bores, and the widest bore."""
    k = extensions.groupBy("bore").agg(F.round(F.sum("length") / 1000.0, 3).alias("km"))
    return k.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("bore", "km")))).alias("lengths"), F.max("bore").alias("widest"))


def kinds(assets: DataFrame) -> DataFrame:
    """(kind, n), commonest first, ties by name."""
    return assets.groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def evidence_kinds(notes: DataFrame) -> DataFrame:
    """(edge_id, counts) of notes by what stands before their first colon or parenthesis."""
    n = notes.select("edge_id", F.explode("evidence").alias("e")).select("edge_id", F.trim(F.regexp_extract("e", r"^([^:(]*)", 1)).alias("kind"))
    return counts_map(n, "edge_id", "kind")


def scenario(developments: DataFrame) -> DataFrame:
    """Totals under weights per development (null is 1); a weight of 0 takes one out."""
    w = F.coalesce("weight", F.lit(1.0))
    return developments.where(w > 0).agg(F.count("*").alias("developments"), F.sum(F.col("units") * w).alias("units"), F.sum(F.col("route_m") * w).alias("route_m"))

"""Queries and SQL of the general training-data problems: 2 (points near points or regions) and 4 (missing references)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import proximity, references
from fieldloom.runtime import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return proximity.development_surroundings(table(spark, sf, "developments"), table(spark, sf, "areas"), table(spark, sf, "schools"))


def p2_surroundings_count(spark: SparkSession, sf: str) -> DataFrame:
    """How many areas, schools and other developments each development has about it."""
    return proximity.surroundings_count(table(spark, sf, "developments"), table(spark, sf, "areas"), table(spark, sf, "schools")).drop("place_id")


def _refs(spark: SparkSession, sf: str) -> DataFrame:
    return references.all_references({"extensions": (table(spark, sf, "extensions"), "edge_id"), "transport_routes": (table(spark, sf, "transport_routes"), "route_id")})


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return references.orphans(_refs(spark, sf), references.facts(table(spark, sf, "developments"))).select("ref_table", "ref_id", "app_id").distinct()


def p4_orphans_by_period(spark: SparkSession, sf: str) -> DataFrame:
    return references.orphans_by_period(_refs(spark, sf), references.facts(table(spark, sf, "developments")))


_POS = "SELECT DISTINCT {id} AS id, CASE WHEN {a} < 0 AND {b} > 0 THEN {a} ELSE {b} END AS lng, CASE WHEN {a} < 0 AND {b} > 0 THEN {b} ELSE {a} END AS lat FROM {t} WHERE {id} IS NOT NULL AND ((({a}) < 0 AND ({b}) > 0) OR (({a}) > 0 AND ({b}) < 0))"
_DIST = "2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians({q}.lat - {p}.lat) / 2), 2) + cos(radians({p}.lat)) * cos(radians({q}.lat)) * pow(sin(radians({q}.lng - {p}.lng) / 2), 2))))"
_P2 = f"""
WITH dev AS ({_POS.format(id="app_id", a="centroid[1]", b="centroid[2]", t="developments")}),
sch AS ({_POS.format(id="school_id", a="lng", b="lat", t="schools")}),
corner AS (SELECT small_area_id, row_number() OVER () AS rid, ring FROM areas WHERE small_area_id IS NOT NULL AND ring IS NOT NULL),
side AS (SELECT small_area_id, rid, ring[i] AS u, ring[i + 1] AS v FROM corner, LATERAL (SELECT unnest(range(1, len(ring))) AS i)),
flat AS (SELECT small_area_id, rid, CASE WHEN u.lat <= v.lat THEN u.lng ELSE v.lng END AS lx, least(u.lat, v.lat) AS ly,
                CASE WHEN u.lat <= v.lat THEN v.lng ELSE u.lng END AS hx, greatest(u.lat, v.lat) AS hy FROM side),
held AS (SELECT d.id, f.small_area_id, f.rid FROM dev d JOIN flat f ON f.ly <= d.lat AND d.lat < f.hy
         WHERE d.lng < f.lx + (d.lat - f.ly) * (f.hx - f.lx) / (f.hy - f.ly)
         GROUP BY d.id, d.lng, d.lat, f.small_area_id, f.rid HAVING count(*) % 2 = 1),
found AS (
  SELECT 'area' AS relation, id AS app_id, small_area_id AS other_id FROM held
  UNION SELECT 'school', d.id, s.id FROM dev d JOIN sch s ON abs(d.lat - s.lat) < 0.01 AND {_DIST.format(p="d", q="s")} <= 250.0
  UNION SELECT 'development', a.id, b.id FROM dev a JOIN dev b ON a.id < b.id AND abs(a.lat - b.lat) < 0.001 AND {_DIST.format(p="a", q="b")} <= 40.0)
"""
_TIDY = r"upper(regexp_replace({c}, '^[\s\x{{00a0}}\x{{200b}}\x{{feff}}]+|[\s\x{{00a0}}\x{{200b}}\x{{feff}}]+$', '', 'g'))"
_P4 = f"""
WITH raw AS (
  SELECT 'extensions' AS ref_table, edge_id AS ref_id, published_at AS moment, unnest(serves_app_ids) AS k FROM extensions
  UNION ALL SELECT 'transport_routes', route_id, published_at, unnest(serves_app_ids) FROM transport_routes),
refs AS (SELECT DISTINCT ref_table, ref_id, moment, {_TIDY.format(c="k")} AS app_id FROM raw WHERE {_TIDY.format(c="k")} <> ''),
own AS (SELECT {_TIDY.format(c="app_id")} AS app_id, min(ingested_at) AS first_seen, min(deleted_at) AS gone_at FROM developments WHERE {_TIDY.format(c="app_id")} <> '' GROUP BY 1),
judged AS (SELECT r.*, (o.app_id IS NULL OR coalesce(o.first_seen > r.moment, false) OR coalesce(o.gone_at <= r.moment, false)) AS orphan FROM refs r LEFT JOIN own o ON r.app_id = o.app_id)
"""

QUERIES = {"p2_found": p2_found, "p2_surroundings_count": p2_surroundings_count, "p4_found": p4_found, "p4_orphans_by_period": p4_orphans_by_period}
SQL = {
    "p2_found": _P2 + "SELECT relation, app_id, other_id FROM found",
    "p2_surroundings_count": _P2
    + """, ways AS (SELECT relation, app_id, other_id FROM found UNION ALL SELECT relation, other_id, app_id FROM found WHERE relation = 'development')
SELECT d.id AS app_id, count(CASE WHEN relation = 'area' THEN 1 END) AS n_area, count(CASE WHEN relation = 'school' THEN 1 END) AS n_school, count(CASE WHEN relation = 'development' THEN 1 END) AS n_development
FROM dev d LEFT JOIN ways w ON w.app_id = d.id GROUP BY d.id, d.lng, d.lat""",
    "p4_found": _P4 + "SELECT DISTINCT ref_table, ref_id, app_id FROM judged WHERE orphan",
    "p4_orphans_by_period": _P4 + "SELECT ref_table, strftime(date_trunc('month', moment), '%Y-%m-%d') AS period, count(*) AS n_references, CAST(sum(CASE WHEN orphan THEN 1 ELSE 0 END) AS BIGINT) AS n_orphans FROM judged GROUP BY 1, 2",
}

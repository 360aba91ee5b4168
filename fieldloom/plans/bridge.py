"""Planning-shaped views over the driver's tables; the same SQL text runs in Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "b_dev": """SELECT c_custkey AS dev_id, CAST(700000+(c_custkey*7919)%50000 AS DOUBLE) AS x, CAST(720000+(c_custkey*104729)%40000 AS DOUBLE) AS y,
        CAST(1+(c_custkey*31)%400 AS INT) AS num_units,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'granted' WHEN 'HOUSEHOLD' THEN 'pending' WHEN 'MACHINERY' THEN 'appealed' ELSE 'refused' END AS status FROM customer""",
    "b_site": """SELECT c_custkey AS dev_id, CAST(700000+(c_custkey*c_custkey*31+c_custkey*7919)%50000 AS DOUBLE) AS x,
        CAST(720000+(c_custkey*c_custkey*17+c_custkey*104729)%40000 AS DOUBLE) AS y FROM customer""",
    "b_school": """SELECT s_suppkey AS school_id, CASE WHEN s_suppkey%2=0 THEN 'primary' ELSE 'post-primary' END AS level,
        CAST(700000+(s_suppkey*15485863)%50000 AS DOUBLE) AS x, CAST(720000+(s_suppkey*32452843)%40000 AS DOUBLE) AS y, CAST(100+(s_suppkey*37)%900 AS INT) AS enrolment FROM supplier""",
    "b_stop": """SELECT p_partkey AS stop_id, p_name AS stop_name, CAST(700000+(p_partkey*6700417)%50000 AS DOUBLE) AS x, CAST(720000+(p_partkey*2097593)%40000 AS DOUBLE) AS y FROM part""",
    "b_stop_time": """SELECT l_orderkey AS trip_id, l_partkey AS stop_id, l_suppkey AS route_id, CASE l_suppkey%4 WHEN 0 THEN '0' WHEN 1 THEN '2' ELSE '3' END AS route_type,
        LPAD(CAST((l_orderkey*13+l_linenumber*7)%27 AS VARCHAR(2)),2,'0') || ':' || LPAD(CAST((l_orderkey*11+l_linenumber)%60 AS VARCHAR(2)),2,'0') || ':00' AS departure_time FROM lineitem""",
    "b_edge": """SELECT p_partkey AS u, p_partkey+1 AS v, CAST(50+(p_partkey*17)%100 AS DOUBLE) AS length FROM part WHERE p_partkey%50<>49 AND p_partkey+1<(SELECT COUNT(*) FROM part)
        UNION ALL SELECT p_partkey AS u, p_partkey+50 AS v, CAST(50+(p_partkey*29)%100 AS DOUBLE) AS length FROM part WHERE p_partkey+50<(SELECT COUNT(*) FROM part)""",
    "b_area": """SELECT n_nationkey AS area_id, CAST(700000+(n_nationkey%5)*10000 AS DOUBLE) AS x0, CAST(720000+FLOOR(n_nationkey/5)*8000 AS DOUBLE) AS y0,
        CAST(700000+(n_nationkey%5)*10000+10000 AS DOUBLE) AS x1, CAST(720000+FLOOR(n_nationkey/5)*8000+8000 AS DOUBLE) AS y1, 100+n_nationkey*10 AS households FROM nation""",
    "b_ext": """SELECT l_orderkey AS edge_id, CAST(l_linenumber*2 AS INT) AS ord, CAST(10+(l_partkey*7)%300 AS DOUBLE) AS length_m, l_suppkey AS dev_id FROM lineitem""",
    "b_service": """SELECT DISTINCT o_custkey AS service_id, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderstatus='F' THEN 2 WHEN o_orderstatus='O' THEN 1 ELSE 0 END AS exception_type FROM orders""",
}
TABLES = ("customer", "supplier", "part", "orders", "lineitem", "nation", "region", "events")


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    sql = re.sub(rf"\b(FROM)\s+({'|'.join(TABLES)})\b", lambda m: f"{m.group(1)} parquet.`{sf}/{m.group(2)}.parquet`", VIEWS[name])
    return spark.sql(sql)


def ctes(*names: str) -> str:
    """WITH clause that defines the named views, for DuckDB."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)

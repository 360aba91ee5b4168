"""Keyed and relational operators as queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import measures, rules, text
from fieldloom.operators import keyed
from fieldloom.plans.bridge import ctes, view
from fieldloom.runtime import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(ctes("b_stop_time") + """
SELECT stop_id, CAST(sum(CASE WHEN peak THEN 1 ELSE 0 END) AS BIGINT) AS peak_all, CAST(sum(CASE WHEN peak AND route_type='3' THEN 1 ELSE 0 END) AS BIGINT) AS peak_bus,
  CAST(sum(CASE WHEN route_type='3' THEN 1 ELSE 0 END) AS BIGINT) AS any_bus, CAST(sum(CASE WHEN route_type IN ('0','2') THEN 1 ELSE 0 END) AS BIGINT) AS any_rail,
  round(CAST(sum(CASE WHEN peak THEN 1 ELSE 0 END) AS DOUBLE) / 3.0, 6) AS per_hour
FROM (SELECT *, departure_time >= '07:00:00' AND departure_time < '10:00:00' AS peak FROM b_stop_time) GROUP BY stop_id""")
def stop_peak_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """Four conditional counts in one pass; times are strings and compared as such, 24:xx included."""
    t = view(spark, sf, "b_stop_time")
    peak = (F.col("departure_time") >= "07:00:00") & (F.col("departure_time") < "10:00:00")
    bus, rail = F.col("route_type") == "3", F.col("route_type").isin("0", "2")
    n = lambda c, a: F.count_if(c).alias(a)
    out = t.groupBy("stop_id").agg(n(peak, "peak_all"), n(peak & bus, "peak_bus"), n(bus, "any_bus"), n(rail, "any_rail"))
    return out.withColumn("per_hour", F.round(F.col("peak_all") / 3.0, 6))


@query(ctes("b_stop_time") + "SELECT stop_id, string_agg(r, ',' ORDER BY r) AS routes FROM (SELECT DISTINCT stop_id, CAST(route_id AS VARCHAR) AS r FROM b_stop_time) GROUP BY stop_id")
def stop_route_list(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "b_stop_time").groupBy("stop_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("route_id").cast("string"))), ",").alias("routes"))


@query(ctes("b_stop_time") + """SELECT stop_id, route_type AS mode FROM (SELECT stop_id, route_type, row_number() OVER (PARTITION BY stop_id ORDER BY count(*) DESC, route_type) AS k
FROM b_stop_time GROUP BY stop_id, route_type) WHERE k = 1""")
def stop_mode(spark: SparkSession, sf: str) -> DataFrame:
    """The commonest value, the smallest of equals."""
    return view(spark, sf, "b_stop_time").groupBy("stop_id").agg(F.mode("route_type", deterministic=True).alias("mode"))


@query(ctes("b_stop_time") + "SELECT st.stop_id, count(*) AS n FROM b_stop_time st WHERE st.stop_id IN (SELECT p_partkey FROM part WHERE p_size < 20) AND st.trip_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1")
def pruned_stop_times(spark: SparkSession, sf: str) -> DataFrame:
    """Two semi-joins before the aggregate; the other tables' columns never reach it."""
    st = view(spark, sf, "b_stop_time").select("stop_id", "trip_id")
    stops = table(spark, sf, "part").where("p_size < 20").select(F.col("p_partkey").alias("stop_id"))
    trips = table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("trip_id"))
    return st.join(stops, "stop_id", "left_semi").join(trips, "trip_id", "left_semi").groupBy("stop_id").agg(F.count("*").alias("n"))


@query(ctes("b_service") + """SELECT service_id, CAST(day AS VARCHAR) AS day FROM (SELECT service_id, day FROM b_service WHERE exception_type IN (0, 1) UNION SELECT service_id, day FROM b_service WHERE exception_type = 1)
EXCEPT SELECT service_id, day FROM b_service WHERE exception_type = 2""")
def service_calendar(spark: SparkSession, sf: str) -> DataFrame:
    s = view(spark, sf, "b_service")
    part = lambda k: s.where(F.col("exception_type") == k).select("service_id", "day")
    return keyed.active(part(0), part(1), part(2)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + CAST((2 - isodow(o_orderdate) + 7) % 7 AS INTEGER) AS VARCHAR) AS tuesday FROM orders")
def first_tuesday(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(keyed.weekday_on_or_after(F.to_date("o_orderdate"), 1), "yyyy-MM-dd").alias("tuesday"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def dedupe_last(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts")
    return keyed.last_per(e, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT user_id, slot, event_id FROM (SELECT user_id, floor(value / 10) AS slot, event_id, row_number() OVER (PARTITION BY user_id, floor(value / 10) ORDER BY ts DESC, event_id) AS k FROM events) WHERE k = 1")
def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    """The newest row of each rounded place."""
    e = table(spark, sf, "events").select("user_id", F.floor(F.col("value") / 10).cast("double").alias("slot"), "event_id", "ts")
    return keyed.first_per(e, [F.col("user_id"), F.col("slot")], [F.col("ts").desc(), F.col("event_id")]).select("user_id", "slot", "event_id")


@query("""SELECT l_suppkey, l_partkey, n FROM (SELECT l_suppkey, l_partkey, count(*) AS n, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_partkey) AS k
FROM lineitem GROUP BY 1, 2) WHERE k = 1""")
def argmax_shape(spark: SparkSession, sf: str) -> DataFrame:
    """The commonest partner of each key, the smallest of equals."""
    n = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    return n.groupBy("l_suppkey").agg(F.max(F.struct("n", (-F.col("l_partkey")).alias("m"))).alias("t")).select("l_suppkey", (-F.col("t.m")).alias("l_partkey"), "t.n")


@query("SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, min(l_orderkey) AS first_order, count(*) AS n FROM lineitem GROUP BY 1, 2")
def unordered_pairs(spark: SparkSession, sf: str) -> DataFrame:
    k = keyed.unordered(F.col("l_partkey"), F.col("l_suppkey"))
    out = table(spark, sf, "lineitem").groupBy(k.alias("k")).agg(F.min("l_orderkey").alias("first_order"), F.count("*").alias("n"))
    return out.select(F.col("k.col1").alias("a"), F.col("k.col2").alias("b"), "first_order", "n")


@query(ctes("b_ext", "b_dev") + "SELECT edge_id, CAST(dense_rank() OVER (ORDER BY ord) - 1 AS INTEGER) AS ord, dev_id FROM b_ext WHERE dev_id IN (SELECT dev_id FROM b_dev WHERE status = 'granted')")
def extension_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Orders renumbered without gaps after rows fell out: what serves no granted development."""
    granted = view(spark, sf, "b_dev").where("status = 'granted'").select("dev_id")
    return keyed.dense_order(view(spark, sf, "b_ext").join(granted, "dev_id", "left_semi"), "ord").select("edge_id", F.col("ord").cast("int").alias("ord"), "dev_id")


@query(ctes("b_ext") + "SELECT dev_id, round(sum(length_m / 1000.0 / n), 6) AS share_km FROM b_ext JOIN (SELECT edge_id, count(DISTINCT dev_id) AS n FROM b_ext GROUP BY 1) USING (edge_id) GROUP BY dev_id")
def length_share(spark: SparkSession, sf: str) -> DataFrame:
    """Each edge's length split evenly over those it serves."""
    e = view(spark, sf, "b_ext")
    n = e.groupBy("edge_id").agg(F.count_distinct("dev_id").alias("n"))
    return e.join(n, "edge_id").groupBy("dev_id").agg(F.round(F.sum(F.col("length_m") / 1000.0 / F.col("n")), 6).alias("share_km"))


@query(ctes("b_ext", "b_dev") + """SELECT round(sum(m) / 1000.0, 6) AS km, count(*) AS edges, (SELECT count(*) FROM b_dev WHERE dev_id NOT IN (SELECT dev_id FROM b_ext)) AS unserved
FROM (SELECT edge_id, max(length_m) AS m FROM b_ext GROUP BY edge_id)""")
def network_length_once(spark: SparkSession, sf: str) -> DataFrame:
    """Shared edges count once in the network's length; those on no edge are counted by an anti-join."""
    e = view(spark, sf, "b_ext")
    total = e.groupBy("edge_id").agg(F.max("length_m").alias("m")).agg(F.round(F.sum("m") / 1000.0, 6).alias("km"), F.count("*").alias("edges"))
    lost = view(spark, sf, "b_dev").join(e.select("dev_id").distinct(), "dev_id", "left_anti").agg(F.count("*").alias("unserved"))
    return total.join(F.broadcast(lost), F.lit(True))  # one row each


@query(ctes("b_dev") + """SELECT s.status, count(d.dev_id) AS developments, CAST(coalesce(sum(d.num_units), 0) AS BIGINT) AS units
FROM (VALUES ('granted'), ('pending'), ('withdrawn')) s(status) LEFT JOIN b_dev d ON d.status = s.status GROUP BY s.status""")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A fixed set of states; those without rows are kept at zero."""
    d = view(spark, sf, "b_dev").groupBy("status").agg(F.count("*").alias("n"), F.sum("num_units").alias("u"))
    keys = spark.createDataFrame([("granted",), ("pending",), ("withdrawn",)], "status string")
    return keys.join(d, "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("developments"), F.coalesce("u", F.lit(0)).cast("long").alias("units"))


@query(ctes("b_dev") + "SELECT CAST(sum(CASE WHEN status='granted' THEN num_units END) AS BIGINT) AS granted, CAST(sum(CASE WHEN status='pending' THEN num_units END) AS BIGINT) AS pending FROM b_dev")
def status_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "b_dev").groupBy().pivot("status", ["granted", "pending"]).agg(F.sum("num_units"))


@query(ctes("b_dev", "b_area") + """SELECT area_id, CAST(sum(num_units) AS BIGINT) AS units, round(100.0 * CAST(sum(num_units) AS DOUBLE) / max(households), 6) AS growth_pct
FROM b_dev JOIN b_area ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY area_id ORDER BY units DESC, area_id LIMIT 5""")
def top_areas(spark: SparkSession, sf: str) -> DataFrame:
    """The five areas with the most units; ties to the smaller id. The limit is the report."""
    a = view(spark, sf, "b_area")
    d = view(spark, sf, "b_dev")
    on = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    # The tiles lie on a lattice, so the region look-up is an equi-join.
    d = d.withColumn("area_id", (F.floor((F.col("x") - 700000) / 10000) + 5 * F.floor((F.col("y") - 720000) / 8000)).cast("int"))
    out = d.join(a, "area_id").where(on).groupBy("area_id").agg(F.sum("num_units").alias("units"), F.max("households").alias("h"))
    return out.select("area_id", "units", F.round(measures.growth(F.col("units").cast("double"), F.col("h")), 6).alias("growth_pct")).orderBy(F.desc("units"), "area_id").limit(5)


@query("""SELECT c_custkey, CAST(max(r) AS INTEGER) AS level, string_agg(note, ' | ' ORDER BY src, dist, note) AS notes FROM (
  SELECT o_custkey AS c_custkey, 2 AS r, o_totalprice AS dist, 'order ' || CAST(o_orderkey AS VARCHAR) AS note, 0 AS src FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT c_custkey, 1, c_acctbal, 'segment ' || c_mktsegment, 1 FROM customer WHERE c_acctbal < 0) GROUP BY c_custkey""")
def best_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Sources put together by name; the best level and all notes in order."""
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("dist"), F.lit(2).alias("rank"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("note"))
    c = table(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey", F.col("c_acctbal").alias("dist"), F.lit(1).alias("rank"), F.concat(F.lit("segment "), F.col("c_mktsegment")).alias("note"))
    return keyed.evidence([o, c], "c_custkey").select("c_custkey", "level", F.array_join("notes", " | ").alias("notes"))


@query("SELECT o_custkey, string_agg(s || ':' || CAST(n AS VARCHAR), ',' ORDER BY s) AS counts FROM (SELECT o_custkey, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY o_custkey")
def status_map(spark: SparkSession, sf: str) -> DataFrame:
    m = keyed.counts_map(table(spark, sf, "orders").select("o_custkey", "o_orderstatus"), "o_custkey", "o_orderstatus")
    return m.select("o_custkey", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws(":", e.key, e.value.cast("string"))), ",").alias("counts"))


@query("SELECT 'orders' AS \"table\", CAST(o_orderkey AS VARCHAR) AS key, r AS rule FROM orders, LATERAL (SELECT unnest(['price', 'status']) AS r) WHERE (r = 'price' AND NOT o_totalprice < 300000) OR (r = 'status' AND NOT o_orderstatus IN ('O', 'F'))")
def validate_report(spark: SparkSession, sf: str) -> DataFrame:
    """A row for each rule a row breaks."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return keyed.violations(o, "orders", "o_orderkey", {"price": F.col("o_totalprice") < 300000, "status": F.col("o_orderstatus").isin("O", "F")})


@query("SELECT 'lineitem' AS \"table\", CAST(l_orderkey AS VARCHAR) AS key, 'l_suppkey has no owner' AS rule FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def dangling_report(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    return keyed.dangling(li, "lineitem", "l_orderkey", "l_suppkey", table(spark, sf, "supplier").where("s_acctbal > 0"), "s_suppkey")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    """A sparse tag column read as a map; a bad document is an empty one."""
    tags = F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>"))
    return table(spark, sf, "events").select("event_id", F.try_element_at(tags, F.lit("k")).try_cast("int").alias("k"))


@query("SELECT c_custkey, round(CAST(('0x' || substr(md5(c_name), 1, 8)) AS BIGINT) / 4294967295.0, 6) AS h FROM customer")
def md5_hash01(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", F.round(text.hash01(F.col("c_name")), 6).alias("h"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(upper(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g')), ' '))), ' ') AS words FROM part")
def name_words(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(F.array_distinct(text.tokens(F.col("p_name")))), " ").alias("words"))


# Words of a street name, and its match keys, as DuckDB lists.
_WORDS = "list_filter(string_split(regexp_replace(replace(replace(upper(coalesce({c}, '')), chr(39), ''), '.', ' '), '[^A-Z0-9 ]', '', 'g'), ' '), lambda t: t <> '')"
_KNOWN = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in text.STREET_WORDS.items()) + "}"
_NORM = "list_transform(" + _WORDS + ", lambda t, i: CASE WHEN t IN ('ST', 'SAINT') THEN CASE WHEN i = 1 THEN 'SAINT' ELSE 'STREET' END ELSE coalesce(" + _KNOWN.replace("{", "{{").replace("}", "}}") + "[t], t) END)"
_QUAL = "[" + ", ".join(f"'{q}'" for q in text.QUALIFIERS) + "]"
_TYPE = "[" + ", ".join(f"'{t}'" for t in text.STREET_TYPES) + "]"
_KEYS = f"""core AS (SELECT *, list_filter(w, lambda t: NOT list_contains({_QUAL}, t)) AS core FROM n),
keyed AS (SELECT *, array_to_string(w, ' ') AS k0, array_to_string(list_sort(w), ' ') AS k1, array_to_string(list_sort(core), ' ') AS k2,
  CASE WHEN len(core) > 1 AND list_contains({_TYPE}, core[len(core)]) THEN array_to_string(list_sort(core[1:len(core) - 1]), ' ') ELSE '' END AS k3 FROM core)"""


@query(f"WITH n AS (SELECT DISTINCT street_name, {_NORM.format(c='street_name')} AS w FROM network WHERE street_name IS NOT NULL), {_KEYS} SELECT street_name, nullif(k0, '') AS norm, k0 || ' | ' || k1 || ' | ' || k2 || ' | ' || k3 AS keys FROM keyed")
def street_norm(spark: SparkSession, sf: str) -> DataFrame:
    """All typed street names with their normal form and match keys."""
    n = table(spark, sf, "network").select("street_name").where("street_name IS NOT NULL").distinct()
    return n.select("street_name", text.norm_street(F.col("street_name")).alias("norm"), F.array_join(text.street_keys(F.col("street_name")), " | ").alias("keys"))


@query(f"""WITH n AS (SELECT DISTINCT street_name, {_NORM.format(c='street_name')} AS w FROM network WHERE street_name IS NOT NULL), {_KEYS},
lft AS (SELECT street_name, unnest([0, 1, 2, 3]) AS tier, unnest([k0, k1, k2, k3]) AS k FROM keyed),
l AS (SELECT DISTINCT street_name AS listed_name, {_NORM.format(c='street_name')} AS w FROM streets),
rgt AS (SELECT listed_name, 0 AS tier, array_to_string(w, ' ') AS k FROM l UNION ALL SELECT listed_name, 1, array_to_string(list_sort(w), ' ') FROM l
  UNION ALL SELECT listed_name, t, array_to_string(list_sort(w), ' ') FROM l, (VALUES (2), (3)) v(t) WHERE NOT list_has_any(w, {_QUAL})),
hit AS (SELECT street_name, listed_name, tier FROM lft JOIN rgt USING (tier, k) WHERE k <> '')
SELECT DISTINCT street_name, listed_name, tier FROM hit WHERE tier = (SELECT min(h.tier) FROM hit h WHERE h.street_name = hit.street_name)""")
def fuzzy_tier_join(spark: SparkSession, sf: str) -> DataFrame:
    """Typed street names against the list, first tier with a hit."""
    return keyed.tiered_join(table(spark, sf, "network").select("street_name"), table(spark, sf, "streets").select(F.col("street_name").alias("listed_name")), "street_name", "listed_name")


@query("SELECT app_id, CAST(ingested_at AS VARCHAR) AS ingested_at, (regexp_matches(coalesce(description, ''), '(?i)\\b\\d+\\s+(no\\.?\\s+)?[a-z-]*\\s*(houses?|dwellings?|apartments?|units?)\\b') OR regexp_matches(coalesce(description, ''), '(?i)residential')) AS candidate FROM developments")
def candidate_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a description names dwellings in number."""
    p = [r"\b\d+\s+(no\.?\s+)?[a-z-]*\s*(houses?|dwellings?|apartments?|units?)\b", "residential"]
    return table(spark, sf, "developments").select("app_id", F.col("ingested_at").cast("string").alias("ingested_at"), text.any_match(F.col("description"), p).alias("candidate"))


@query("SELECT app_id, CAST(ingested_at AS VARCHAR) AS ingested_at, upper(array_to_string(list_transform(string_split_regex(trim(authority), '\\s+'), lambda w: w[1]), '')) || '-' || trim(application_number) AS made FROM developments WHERE authority IS NOT NULL AND application_number IS NOT NULL AND trim(authority) <> ''")
def initials_id(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "developments").where("authority IS NOT NULL AND application_number IS NOT NULL AND trim(authority) <> ''")
    return d.select("app_id", F.col("ingested_at").cast("string").alias("ingested_at"), text.initials_id(F.col("authority"), F.col("application_number")).alias("made"))


@query("SELECT n_nationkey, 'A' || CAST(n_nationkey AS VARCHAR) AS code, n_name AS name FROM nation")
def html_table(spark: SparkSession, sf: str) -> DataFrame:
    """A page with a table, taken apart again: tags, entities and empty rows go."""
    n = table(spark, sf, "nation")
    page = F.concat(F.lit("<p>x</p><table class=t><tr><th>code</th><th> name </th></tr><tr><td></td><td>&nbsp;</td></tr><tr><td><b>A"), F.col("n_nationkey").cast("string"), F.lit("</b></td>\n<td>"), F.col("n_name"), F.lit("</td></tr></table>"))
    rec = n.select("n_nationkey", F.explode(text.html_records(page)).alias("r"))
    return rec.select("n_nationkey", F.col("r")["code"].alias("code"), F.col("r")["name"].alias("name"))


@query("SELECT o_orderkey, CAST(to_timestamp(o_orderkey * 86400) AT TIME ZONE 'UTC' AS DATE)::VARCHAR AS day FROM orders")
def epoch_date(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", text.epoch_date(F.col("o_orderkey") * 86400000).alias("day"))


@query(ctes("b_dev") + """SELECT dev_id, CAST(CASE WHEN num_units <= 5 THEN 50.0 WHEN num_units <= 40 THEN 80.0 WHEN num_units <= 100 THEN 100.0 WHEN num_units <= 300 THEN 150.0 ELSE 400.0 END AS DOUBLE) AS band,
round(num_units * CAST(0.02 AS DOUBLE), 6) AS flow FROM b_dev""")
def step_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """A step function over bands, and a rate per unit."""
    u = F.col("num_units")
    return view(spark, sf, "b_dev").select("dev_id", measures.step(u, [(5, 50.0), (40, 80.0), (100, 100.0), (300, 150.0)], F.lit(400.0)).alias("band"), F.round(measures.peak_flow(u, 2.0, 864.0), 6).alias("flow"))


@query(ctes("b_dev") + "SELECT dev_id, greatest(5.0, least(20.0, 60.0 / greatest(1.0, ceil(num_units / 24.0)))) AS headway FROM b_dev")
def headway(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "b_dev").select("dev_id", measures.headway(F.col("num_units"), 24.0, 5.0, 20.0).alias("headway"))


@query("SELECT c_custkey, round((0.4 * a + 0.35 * b + 0.25 * c), 6) AS overall FROM (SELECT c_custkey, greatest(0.0, least(100.0, round(c_acctbal / 50.0, 1))) AS a, round(CAST(c_custkey % 101 AS DOUBLE), 1) AS b, CASE WHEN c_nationkey % 3 = 0 THEN 100.0 ELSE CAST(c_nationkey AS DOUBLE) END AS c FROM customer)")
def weighted_score(spark: SparkSession, sf: str) -> DataFrame:
    """Clipped parts, null as the worst, and their weighted mean."""
    c = table(spark, sf, "customer")
    parts = [(measures.clipped(F.col("c_acctbal") / 50.0), 0.4), (measures.clipped((F.col("c_custkey") % 101).cast("double")), 0.35), (measures.clipped(F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey").cast("double"))), 0.25)]
    return c.select("c_custkey", F.round(measures.weighted(parts), 6).alias("overall"))


@query("SELECT user_id AS key, max_by(event_type, event_id) AS v FROM events GROUP BY user_id")
def ledger_upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("v"), F.col("event_id").alias("at"))
    return keyed.upsert(e.where("at % 2 = 0"), e.where("at % 2 = 1"), "key", "at").select("key", "v")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def incremental_todo(spark: SparkSession, sf: str) -> DataFrame:
    """Keys still to be worked on: those the store doesn't have."""
    done = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("SELECT id FROM (SELECT c_custkey AS id FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 40) UNION SELECT id FROM (SELECT c_custkey AS id FROM customer ORDER BY c_nationkey DESC, c_custkey LIMIT 15)")
def top_union(spark: SparkSession, sf: str) -> DataFrame:
    """Two top lists put together; the limits are the lists."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal", "c_nationkey")
    return c.orderBy(F.desc("c_acctbal"), "id").limit(40).select("id").union(c.orderBy(F.desc("c_nationkey"), "id").limit(15).select("id")).distinct()


@query("""SELECT p_partkey, CASE WHEN p_size > 40 THEN 'large' WHEN p_type LIKE '%BRASS' THEN 'brass' WHEN p_retailprice < 1000 THEN 'cheap' END AS kind,
CASE WHEN p_size > 40 THEN 'high' WHEN p_type LIKE '%BRASS' THEN 'medium' WHEN p_retailprice < 1000 THEN 'low' END AS level FROM part""")
def ordered_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule that holds gives kind and level."""
    r = rules.first_rule([(F.col("p_size") > 40, {"kind": "large", "level": "high"}), (F.col("p_type").endswith("BRASS"), {"kind": "brass", "level": "medium"}), (F.col("p_retailprice") < 1000, {"kind": "cheap", "level": "low"})])
    return table(spark, sf, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.kind", "r.level")


@query(r"""SELECT app_id, CAST(ingested_at AS VARCHAR) AS ingested_at, CASE WHEN TRY_CAST(n AS INTEGER) BETWEEN 80 AND 1200 AND NOT regexp_matches(t, '(?i)pre-?\s*' || n) THEN TRY_CAST(n AS INTEGER) END AS dwellings FROM (
SELECT app_id, ingested_at, coalesce(description, '') AS t, regexp_extract(coalesce(description, ''), '(?i)(?:^|[^\d-])(\d{2,4})\s*(?:no\.?\s*)?(?:new\s+)?(?:residential\s+)?(?:apartments?|dwellings?|units|houses|homes|bedspaces)', 1) AS n FROM developments)""")
def dwelling_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The number of dwellings a description names."""
    return table(spark, sf, "developments").select("app_id", F.col("ingested_at").cast("string").alias("ingested_at"), rules.dwelling_count(F.col("description")).alias("dwellings"))


@query("SELECT edge_id, CAST(ingested_at AS VARCHAR) AS ingested_at, array_to_string(list_transform(coalesce(evidence, []), lambda e: CASE WHEN starts_with(e, 'osm_buildings_within_') THEN 'osm_buildings:' || list_last(string_split(split_part(e, ' (', 1), ':')) WHEN starts_with(e, 'dcc_gullies:') THEN 'dcc_gullies' ELSE split_part(e, ' (', 1) END), ' | ') AS notes FROM network")
def short_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence notes without their details."""
    n = table(spark, sf, "network")
    return n.select("edge_id", F.col("ingested_at").cast("string").alias("ingested_at"), F.array_join(F.transform(F.coalesce("evidence", F.array().cast("array<string>")), lambda e: rules.short_evidence(e)), " | ").alias("notes"))

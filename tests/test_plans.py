import json

import pytest

import pandas as pd
from pyspark.sql import functions as F

from fieldloom.operators import keyed
from fieldloom.plans import ask, network, transport
from fieldloom.sources import landed, sinks
from fieldloom.streaming import incremental


def grid(spark):
    """A street along x with a side street: served at its west end."""
    edges = [("e0", 0, 1, 100.0, "high"), ("e1", 1, 2, 100.0, "none"), ("e2", 2, 3, 100.0, "none"), ("e3", 2, 4, 80.0, "none"), ("e4", 2, 4, 90.0, "high"), ("e9", 8, 9, 50.0, "none")]
    xy = {0: (0, 0), 1: (100, 0), 2: (200, 0), 3: (300, 0), 4: (200, 80), 8: (5000, 0), 9: (5050, 0)}
    e = spark.createDataFrame(edges, "edge_id string, u long, v long, length double, confidence string")
    s = spark.createDataFrame([(i, 0, *map(float, xy[u]), *map(float, xy[v])) for i, u, v, *_ in edges if i != "e4"], "edge_id string, k int, x1 double, y1 double, x2 double, y2 double")
    n = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in xy.items()], "node long, x double, y double")
    return e, s, n


def test_extend(spark):
    e, s, n = grid(spark)
    d = spark.createDataFrame([("a", 20.0, 10.0), ("b", 290.0, 5.0), ("c", 205.0, 85.0), ("far", 5049.0, 1.0)], "app_id string, x double, y double")
    out = network.extend(d, n, e, s)
    assert {r.app_id: r.connected for r in out["developments"].collect()} == {"a": True, "b": False, "c": False, "far": False}
    ext = {r.edge_id: (r.ord, list(r.serves_app_ids)) for r in out["extensions"].collect()}
    assert ext == {"e1": (0, ["b", "c"]), "e2": (1, ["b"]), "e3": (1, ["c"])}
    assert [r.app_id for r in out["unreachable"].collect()] == ["far"]
    assert {r.app_id: r.route_m for r in network.served_totals(out["extensions"], d).collect()} == {"a": None, "b": 200.0, "c": 180.0, "far": None}


def test_infer(spark):
    e, s, _ = grid(spark)
    a = spark.createDataFrame([(1, 50.0, 5.0, "high", "hydrant"), (2, 60.0, 9.0, "medium", "manhole"), (3, 900.0, 900.0, "high", "lost")], "asset_id long, x double, y double, level string, note string")
    got = {r.edge_id: (r.confidence, list(r.evidence)) for r in network.infer(e.drop("confidence"), s, a).collect()}
    assert got["e0"] == ("high", ["hydrant", "manhole"]) and got["e2"] == ("none", [])


def test_transit(spark):
    cal = spark.createDataFrame([("s1", "1", "20240101", "20241231"), ("s2", "0", "20240101", "20241231"), ("s3", "1", "20240101", "20241231")], "service_id string, tuesday string, start_date string, end_date string")
    dates = spark.createDataFrame([("s2", "20240604", "1"), ("s3", "20240604", "2"), ("s1", "20240605", "2")], "service_id string, date string, exception_type string")
    live = transport.services_on(cal, dates, "20240604")
    assert {r.service_id for r in live.collect()} == {"s1", "s2"}
    trips = spark.createDataFrame([("t1", "r1", "s1", "h1"), ("t2", "r2", "s2", "h2"), ("t3", "r3", "s3", "h3")], "trip_id string, route_id string, service_id string, shape_id string")
    routes = spark.createDataFrame([("r1", "4", "3", "A - B"), ("r2", "DART", "2", "B - A"), ("r3", "9", "3", "C - D")], "route_id string, route_short_name string, route_type string, route_long_name string")
    times = spark.createDataFrame([("t1", "p", "07:00:00"), ("t1", "q", "10:00:00"), ("t2", "p", "7:30:00"), ("t2", "p", "09:59:59"), ("t3", "q", "08:00:00")], "trip_id string, stop_id string, departure_time string")
    stops = spark.createDataFrame([("p", 0.0, 0.0), ("q", 900.0, 0.0), ("z", 5.0, 5.0)], "stop_id string, x double, y double")
    t = {r.stop_id: r for r in transport.stop_table(stops, times, trips, routes, live).collect()}
    assert set(t) == {"p", "q"} and t["p"].peak_per_hr * 3 == 2 and t["p"].rail_any == 2 and t["p"].routes == ["4", "DART"] and t["q"].peak_per_hr == 0
    shapes = spark.createDataFrame([("h1", 2, 1.0, 0.0), ("h1", 1, 0.0, 0.0), ("h3", 1, 9.0, 9.0)], "shape_id string, seq int, x double, y double")
    same = routes.withColumn("route_type", F.lit("2"))
    lines = transport.rail_lines(shapes, trips, same).collect()
    assert {r.route_id: [p.x for p in r.line] for r in lines} == {"r1": [0.0, 1.0], "r3": [9.0]}


def test_routes(spark):
    e, _, n = grid(spark)
    d = spark.createDataFrame([("a", 190.0, 0.0, 100, 300.0), ("b", 300.0, 0.0, 80, 100.0), ("c", 5000.0, 0.0, 500, 9.0), ("d", 5050.0, 0.0, 500, 9.0), ("x", 900.0, 900.0, 900, 1.0)], "app_id string, x double, y double, units int, demand double")
    stops = spark.createDataFrame([("s", 0.0, 0.0)], "stop_id string, x double, y double")
    out = transport.routes_for(d, stops, n, e, eps=200.0).collect()
    assert [(r.route_id, list(r.serves_app_ids), r.length_km) for r in out] == [("R002", ["a", "b"], 0.4)]  # 2 -> 3 -> 0; R001 has no way


def test_access(spark):
    d = spark.createDataFrame([("a", 0.0, 0.0), ("b", 5000.0, 0.0), ("c", 900.0, 0.0)], "app_id string, x double, y double")
    s = spark.createDataFrame([("p", 400.0, 0.0, 6.0, 0), ("q", 900.0, 10.0, 1.0, 3)], "stop_id string, x double, y double, peak_per_hr double, rail_any long")
    got = {r.app_id: (r.access, r.any_m, r.rail_m) for r in transport.access(d, s).collect()}
    assert got["a"][:2] == ("served", 400.0) and got["c"] == ("weak", 10.0, 10.0) and got["b"][0] == "unserved"


def test_keyed(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", None, "z")], "k string, t int, v string")
    assert {(r.k, r.v) for r in keyed.last_per(d, ["k"], [F.col("t")]).collect()} == {("a", "y"), ("b", "z")}
    left = spark.createDataFrame([("Main St Upr",), ("St Mary's Rd",), (None,), ("!!",)], "a string")
    right = spark.createDataFrame([("MAIN STREET",), ("Upper Main Street",), ("Saint Mary's Road",)], "b string")
    assert {tuple(r) for r in keyed.tiered_join(left, right, "a", "b").collect()} == {("Main St Upr", "Upper Main Street", 1), ("St Mary's Rd", "Saint Mary's Road", 0)}
    r = keyed.violations(d, "d", "k", {"t": F.col("t") > 2, "v": F.col("v") != "x"}).collect()
    assert sorted((x.key, x.rule) for x in r) == [("a", "t"), ("a", "v"), ("b", "t")]


def test_sources(spark, tmp_path):
    f = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]]]}, "properties": {"id": "p", "n": 3}}, {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}, "properties": {"id": "m"}}]}
    (tmp_path / "f.geojson").write_text(json.dumps(f))
    t = landed.features(spark, str(tmp_path / "f.geojson"), "id string, n int")
    got = {r.id: (r.n, len(r.r)) for r in t.select("id", "n", landed.rings_of(F.col("kind"), F.col("coordinates")).alias("r")).collect()}
    assert got == {"p": (3, 1), "m": (None, 2)}
    assert landed.features(spark, str(tmp_path / "none.geojson"), "id string").count() == 0
    (tmp_path / "g.csv").write_bytes("Title\nmade, by\nDate,Street,N\n1/1,Caf\xe9 St,4\n2/1,Main St,\n".encode("latin-1"))
    rows = landed.csv_after(spark, str(tmp_path / "g.csv"), "Date,Street").collect()
    assert [(r.Street, r.N) for r in rows] == [("Caf\xe9 St", "4"), ("Main St", None)]
    spark.dataSource.register(landed.PagedAnswers)
    for k in (0, 2):
        (tmp_path / f"p{k}.json").write_text(json.dumps({"features": [{"attributes": {"id": f"a{k}", "n": k}, "geometry": {"x": 1.0 + k, "y": 2.0}}]}))
    p = spark.read.format("paged").schema("id string, n long, _x double").option("path", str(tmp_path / "p{offset}.json")).option("page", 2).load()
    assert {tuple(r) for r in p.collect()} == {("a0", 0, 1.0), ("a2", 2, 3.0)}
    assert landed.tiles(spark, (0.0, 0.0, 1.0, 0.5), 0.3).count() == 8
    assert landed.smallest_cover({"a": (0, 0, 9, 9), "b": (0, 0, 5, 5)}, (1, 1, 2, 2)) == "b"
    o = spark.createDataFrame([(1, {"man": "x"}, None), (2, {"h": "y"}, "way"), (3, {}, None)], "id int, tags map<string,string>, osm_type string")
    assert {(r.id, r.osm_type) for r in landed.tagged(o, {"man": None, "h": ["y"]}).collect()} == {(1, "node"), (2, "way")}


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", [{"x": 1.123456789, "y": 2.0}, {"x": 3.0, "y": 4.0}])], "id string, line array<struct<x:double,y:double>>")
    n = sinks.write_collection(d, str(tmp_path / "o.geojson"), "LineString", "line", ["id"])
    f = json.loads((tmp_path / "o.geojson").read_text())
    assert n > 0 and f["features"][0]["geometry"] == {"type": "LineString", "coordinates": [[1.12346, 2.0], [3.0, 4.0]]} and f["features"][0]["properties"] == {"id": "a"}
    known = spark.createDataFrame([("s", "ok", 4, None, "2024-01-01")], "source string, status string, records int, note string, at string")
    assert [r.status for r in sinks.ledger(known, "s", None, "boom", "2024-02-01").collect()] == ["failed"]


def test_incremental(spark, tmp_path):
    src, store = tmp_path / "in", str(tmp_path / "store")
    asked = tmp_path / "asked"
    asked.mkdir()

    def extractor(p: pd.DataFrame) -> pd.DataFrame:
        if (p.key == "bad").any():
            raise RuntimeError("down")
        return pd.DataFrame({"key": [*p.key, "stranger"], "units": [len(k) for k in p.key] + [1]})

    for name, keys in (("1", ["a", "bb", "a"]), ("2", ["bb", "ccc", None])):
        spark.createDataFrame([(k,) for k in keys], "key string").coalesce(1).write.parquet(str(src / name))
        q = incremental.follow(spark.readStream.schema("key string").option("recursiveFileLookup", True).parquet(str(src)), store, "key", extractor, "key string, units int", "units > 0", str(tmp_path / "ck"))
        q.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(store).collect()) == [("a", 1), ("bb", 2), ("ccc", 3)]
    bad = incremental.extract(spark.createDataFrame([("bad",), ("ok",)], "key string").coalesce(1), "key", extractor, "key string, units int", "units > 0", batch=1)
    assert [r.key for r in bad.collect()] == ["ok"]


def test_ask(spark):
    d = spark.createDataFrame([("AB-12/34", 5, "granted", 1.0, 9.0, 2.0, 4.0), ("CD-99/11", 9, "pending", 7.0, None, 1.0, 6.0)], "app_id string, units int, status string, water double, transport double, schools double, overall double")
    r = spark.createDataFrame([("R001", 3.5, ["AB-12/34"])], "route_id string, length_km double, serves_app_ids array<string>")
    assert ask.answer("what about ab-12/34?", d, r).ids == ["AB-12/34"]
    assert ask.answer("where does r001 go", d, r).ids == ["AB-12/34"]
    assert ask.answer("worst 1 for water", d, r).ids == ["CD-99/11"]
    assert ask.answer("transport", d, r).ids == ["AB-12/34"]
    assert ask.answer("how many are pending", d, r).ids == ["CD-99/11"]
    assert "2 developments" in ask.answer("hello", d, r).text
    assert ask.known_only(["zz", "CD-99/11", "CD-99/11"], d) == ["CD-99/11"]


def test_settings(spark):
    from fieldloom.plans import settings as S

    r = S.Registry()
    assert r.add("rate", 2.7, "Household", "persons", "census") == 2.7
    r.add("map", {"a": 1})
    assert {(x.key, x.value) for x in r.table(spark).collect()} == {("rate", "2.7"), ("map", '{"a": 1}')}
    p = {"x": (0.0, 0.0, 1.0, 1.0)}
    assert S.area(None, p, None, "x") == p["x"] and S.area("x", p, (0, 0, 9, 9), "x") == p["x"] and S.area(None, p, (0, 0, 9, 9), "x") == (0, 0, 9, 9)
    df, err = S.guarded(spark, "s", "a int", lambda: spark.read.parquet("/nowhere"))
    assert df.count() == 0 and err
    t = {}
    with S.timed("stage", t):
        pass
    assert t["stage"] >= 0


def test_rules(spark):
    from fieldloom.functions import rules

    d = spark.createDataFrame([("Erection of 120 No. new residential units",), ("79 houses",), ("pre-1963 house in 100 units",), ("pre-100 units, then 100 units",), (None,)], "t string")
    assert [r.v for r in d.select(rules.dwelling_count(F.col("t")).alias("v")).collect()] == [120, None, 100, None, None]
    assert [r.v for r in d.select(rules.prompt("<%s>", rules.cut(F.col("t"), 4)).alias("v")).collect()] == ["<Erec>", "<79 h>", "<pre->", "<pre->", "<>"]


def test_schools(spark):
    from fieldloom.plans import schools as S

    d = spark.createDataFrame([("a", 0.0, 0.0, 10), ("b", 9000.0, 0.0, 10)], "app_id string, x double, y double, units int")
    raw = spark.createDataFrame([("12345A", "100", "0"), ("12346B", "200", "x"), ("12347C", "300", "0"), ("bad", "0", "0")], "school_id string, x string, y string")
    n = spark.createDataFrame([("12345A", "100"), ("12347C", "n/a"), ("12345A", "100")], "school_id string, enrolment string")
    p = S.schools_of(raw, n, "primary")
    q = S.schools_of(raw.where("school_id = '12347C'").withColumn("school_id", F.lit("99999Z")), spark.createDataFrame([("99999Z", "50")], "school_id string, enrolment string"), "post")
    dev, sch = S.pressure(d, p.unionByName(q), {"primary": 500.0, "post": 500.0}, {"primary": 2.0, "post": 1.0})
    got = {r.app_id: (r.pressure_ratio, r.pressure_flag, dict(r.schools)) for r in dev.collect()}
    assert got["a"] == (0.2, True, {"primary": ["12345A", "12347C"], "post": ["99999Z"]}) and got["b"] == (None, True, {"primary": [], "post": []})
    assert {r.school_id: (r.projected_pupils, r.pressure_ratio) for r in sch.collect()} == {"12345A": (10.0, 0.1), "12346B": (0.0, None), "12347C": (10.0, None), "99999Z": (10.0, 0.2)}
    assert {r.school_id for r in S.worth_showing(sch, (150.0, -1.0, 160.0, 1.0)).collect()} == {"12345A", "12347C", "99999Z"}


def test_summary(spark):
    from fieldloom.plans import summary as S

    d = spark.createDataFrame([("a", 5, 12.0, True, "n", None, 1.0), ("b", 7, None, False, "n", 0.0, 2.0), ("c", None, 3.0, False, "s", 2.0, 4.0)], "app_id string, units int, residents double, connected boolean, area string, weight double, route_m double")
    e = spark.createDataFrame([("e", 1000.0, ["b", "c"], 100), ("e", 1000.0, ["b", "c"], 100), ("f", 500.0, [], 80)], "edge_id string, length double, serves_app_ids array<string>, bore int")
    t = S.totals(d, e).first()
    assert (t.developments, t.units, t.residents, t.unconnected_units, t.new_km) == (3, 12, 15.0, 7, 1.5)
    assert {r.area: r.new_km for r in S.by_area(d, e.dropDuplicates(["edge_id"])).collect()} == {"n": 0.5, "s": 0.5}
    b = S.by_bore(e.dropDuplicates(["edge_id"])).first()
    assert dict(b.lengths) == {80: 0.5, 100: 1.0} and b.widest == 100
    s = S.scenario(d).first()
    assert (s.developments, s.units, s.route_m) == (2, 5.0, 9.0)
    k = spark.createDataFrame([("e", ["hydrant (3 m)", "hydrant: x", "cover"])], "edge_id string, evidence array<string>")
    assert dict(S.evidence_kinds(k).first().counts) == {"cover": 1, "hydrant": 2}
    assert [tuple(r) for r in S.kinds(spark.createDataFrame([("b",), ("a",), ("b",), ("c",)], "kind string")).collect()] == [("b", 2), ("a", 1), ("c", 1)]


def test_paged_features(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 4], [0, 0]]
    pages = {
        0: {"exceededTransferLimit": True, "features": [{"attributes": {"id": "a"}, "geometry": {"x": 1.5, "y": 2}}]},
        1: {"properties": {"exceededTransferLimit": True}, "features": [{"properties": {"id": "b"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}, {"attributes": {"id": "c"}, "geometry": {"rings": [ring, ring]}}]},
        3: {"features": [{"attributes": {"id": "d"}, "geometry": None}]},
        4: {"features": [{"attributes": {"id": "stale"}}]},
    }
    for k, v in pages.items():
        (tmp_path / f"q{k}.json").write_text(json.dumps(v))
    got = {r.id: (r.x, r.rings and len(r.rings)) for r in landed.paged_features(spark, str(tmp_path / "q{offset}.json"), "id string").collect()}
    assert got == {"a": (1.5, None), "b": (None, 1), "c": (None, 2), "d": (None, None)}
    (tmp_path / "e0.json").write_text(json.dumps({"error": {"code": 400}}))
    with pytest.raises(Exception, match="400"):
        landed.paged_features(spark, str(tmp_path / "e{offset}.json"), "id string").collect()
    from fieldloom.plans import sites

    f = landed.paged_features(spark, str(tmp_path / "q{offset}.json"), "id string").withColumn("n", F.lit("7"))
    s = {r.app_id: (len(r.parts), r.area) for r in sites.polygons(f, "id", "n").collect()}
    assert s == {"B-7": (1, 8.0), "C-7": (1, 8.0)}
    d = spark.createDataFrame([("B-7", 9.0, 9.0), ("Z-1", 5.0, 5.0)], "app_id string, x double, y double")
    g = {r.app_id: (r.footprint_source, r["at"].x) for r in sites.footprints(d, sites.polygons(f, "id", "n")).collect()}
    assert g["Z-1"] == ("buffered_point", 5.0) and g["B-7"][0] == "polygon" and 0 < g["B-7"][1] < 4


def test_workbook_box_and_dates(spark, tmp_path):
    import zipfile

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Roll</t></si><si><r><t>Na</t></r><r><t>me</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>12</v></c><c r="C2" t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in landed.xlsx_table(spark, str(tmp_path / "w.xlsx")).collect()] == [("12", None, "x")]
    n = spark.createDataFrame([(1, 0.0, 0.0), (2, 9.0, 9.0), (3, 20.0, 0.0)], "node long, x double, y double")
    w = spark.createDataFrame([("a", [1, 3]), ("b", [2, 3]), ("c", [])], "way_id string, refs array<long>")
    inside, kept = landed.cut_to_box(n, w, (-1, -1, 1, 1))
    assert [r.node for r in inside.collect()] == [1] and [r.way_id for r in kept.collect()] == ["a"]
    d = spark.createDataFrame([("2024-01-01",), ("2020-01-01",), (None,)], "day string")
    assert [r.day for r in landed.since(d, "day", "2024-06-01", 3).collect()] == ["2024-01-01"]
    k = spark.createDataFrame([("Point", 1), ("LineString", 1), ("Point", None)], "kind string, level int")
    assert [x.count() for x in landed.by_shape(k)] == [1, 1]


def test_rows_that_do_not_meet(spark):
    d = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "app_id string, status string")
    rows, out = keyed.mapped(d, "status", {"x": "granted"})
    assert [tuple(r) for r in rows.collect()] == [("a", "granted")] and out.first().excluded == 2
    r = spark.createDataFrame([("a", None)], "app_id string, status string")
    assert {x.app_id: x.status for x in keyed.row_fallback(d, r, "app_id", ["status"]).collect()} == {"a": None, "b": "y", "c": None}
    w = spark.createDataFrame([("a", None)], "app_id string, metres double")
    assert {x.app_id: x.metres for x in keyed.or_default(d, w, ["app_id"], {"metres": F.lit(0.0)}).collect()} == {"a": None, "b": 0.0, "c": 0.0}
    e = spark.createDataFrame([("e", ["a", "z", "b"]), ("f", ["z"])], "edge_id string, ids array<string>")
    assert [(x.edge_id, x.ids) for x in keyed.surviving(e, "ids", d, "app_id", "edge_id").collect()] == [("e", ["a", "b"])]
    t = spark.createDataFrame([("k", 1.0, "on", [(1.0, 2.0)]), (None, float("nan"), "no", [(99.0, 2.0)])], "k string, v double, s string, p array<struct<x:double,y:double>>")
    bad = keyed.contract(t, "t", "k", ["k", "gone"], ["v"], {"s": ["on"]}, {"p": (0, 0, 5, 5)}).collect()
    assert sorted(x.rule for x in bad) == ["gone is required", "gone is required", "k is required", "p within its box", "s is one of 1", "v is finite"]


def test_text_and_geometry_pieces(spark):
    from fieldloom.functions import geo, text

    d = spark.createDataFrame([(5, 12, '{"a": "1", "b": null, "c": "2"}', "hydrant", "osm:1")], "u long, v long, tags string, kind string, asset string")
    r = d.select(text.edge_id(F.col("v"), F.col("u"), F.lit(0)).alias("id"), text.own_tags(F.col("tags"), ["c"]).alias("own"), text.evidence_note(F.col("kind"), F.col("asset"), text.tag_details(F.from_json("tags", "map<string,string>"), ["c", "b"])).alias("note")).first()
    assert r.id == "5-12-0" and r.own == {"a": "1"} and r.note == "hydrant:osm:1 (c=2)"
    line = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((-5, 1), (5, 1), (5, 20), (6, 20), (6, 1), (7, 1))))
    runs = d.select(geo.clip_line(line, (0, 0, 10, 10)).alias("r")).first().r
    assert [[(p.x, p.y) for p in q] for q in runs] == [[(0, 1), (5, 1), (5, 10)], [(6, 10), (6, 1), (7, 1)]]
    bad = F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    assert d.select(geo.valid_ring(bad).alias("v")).first().v is False
    far = geo.straight_if_missing(F.lit(None).cast(geo.LINE), F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), F.struct(F.lit(3.0).alias("x"), F.lit(4.0).alias("y")))
    assert d.select(geo.length(far).alias("m")).first().m == 5.0


def test_chains_and_ways(spark):
    from fieldloom.operators import graph

    e = [(1, 2, 1.0), (2, 3, 2.0), (3, 4, 3.0), (4, 5, 1.0), (4, 6, 1.0), (7, 8, 1.0), (8, 9, 1.0), (9, 7, 1.0)]
    d = spark.createDataFrame(e, "u long, v long, length double")
    got = {(r.u, r.v, r.length, r.n) for r in graph.contracted(d).collect()}
    assert got == {(1, 4, 6.0, 3), (4, 5, 1.0, 1), (4, 6, 1.0, 1), (7, 7, 3.0, 3)}
    legs = spark.createDataFrame([(1, 6), (5, 1), (1, 7), (1, 6), (9, 7)], "node long, to long")
    for size in (2, 1000):
        ways = {(r.node, r.to): (r.dist, r.path) for r in graph.pair_paths(d, legs, size, 1).collect()}
        assert ways == {(1, 6): (7.0, [1, 2, 3, 4, 6]), (5, 1): (7.0, [5, 4, 3, 2, 1]), (9, 7): (1.0, [9, 7])}


def test_loads_of_served_edges(spark):
    e, s, n = grid(spark)
    d = spark.createDataFrame([("a", 20.0, 10.0, 5, 12.0), ("b", 290.0, 5.0, 7, 20.0), ("c", 101.0, 70.0, 3, 9.0), ("far", 5049.0, 1.0, 1, 1.0)], "app_id string, x double, y double, units int, residents double")
    out = network.extend(d, n, e, s)
    near = {r.app_id: r for r in out["developments"].collect()}
    assert near["far"].attached_to == "e0" and near["far"].distance_m > 4000 and near["b"].nearest_edge != near["b"].attached_to
    loads = {r.edge_id: (r.new_units, r.new_app_ids) for r in out["loads"].collect()}
    assert loads == {"e0": (15, ["a", "b", "c"])} and [r.app_id for r in out["served_already"].collect()] == ["c"]
    assert {r.edge_id: r.units_served for r in out["extensions"].collect()} == {"e1": 7, "e2": 7}


def test_sources_that_fail_while_read(spark):
    from fieldloom.plans import settings

    bad, err = settings.guarded(spark, "s", "a int", lambda: spark.range(3).select(F.raise_error(F.lit("boom")).cast("int").alias("a")))
    assert bad.count() == 0 and "boom" in err
    good, err = settings.guarded(spark, "s", "a int", lambda: spark.range(3).select(F.col("id").cast("int").alias("a")))
    assert good.count() == 3 and err is None
    assert settings.setting("FIELDLOOM_NO_SUCH", "x") == "x"


def test_typed_feed_and_tag_layers(spark, tmp_path):
    (tmp_path / "shapes.txt").write_text("shape_id,shape_pt_lat,shape_pt_sequence\nh1, 53.5,2\nh1,bad,1\n")
    t = landed.transit(spark, str(tmp_path), "shapes", ["shape_id", "shape_pt_lat", "shape_pt_sequence", "gone"], {"shape_pt_lat": "double", "shape_pt_sequence": "int", "gone": "int"})
    assert {tuple(r) for r in t.collect()} == {("h1", 53.5, 2, None), ("h1", None, 1, None)} and dict(t.dtypes)["gone"] == "int"
    o = spark.createDataFrame([({"place": "suburb", "name": "A"}, -6.2, 53.3, "Point"), ({"place": "suburb"}, -6.2, 53.3, "Point"), ({"place": "quarter", "name": "B"}, -7.0, 53.3, "Point"), ({"building": "yes"}, -6.2, 53.3, "Polygon"), ({"building": "no"}, -6.2, 53.3, "LineString")], "tags map<string,string>, x double, y double, kind string")
    assert [r["name"] for r in landed.named_places(o, ["suburb", "quarter"], (-6.3, 53.2, -6.1, 53.4)).collect()] == ["A"]
    assert landed.tagged(o, {"building": None}, kinds=["Polygon", "MultiPolygon", "Point"]).count() == 1
    assert {k: v.count() for k, v in landed.layers(o, {"b": {"building": None}, "s": {"place": ["suburb"]}}).items()} == {"b": 2, "s": 2}


def test_questions_by_cost_and_size(spark):
    d = spark.createDataFrame([("A-1", 5, "granted", 1.0, 1.0, 1.0, 1.0, 900.0, 30.0), ("B-2", 50, "pending", 2.0, 2.0, 2.0, 2.0, None, 10.0)], "app_id string, units int, status string, water double, transport double, schools double, overall double, cost double, distance double")
    r = spark.createDataFrame([], "route_id string, length_km double, serves_app_ids array<string>")
    assert ask.answer("which are the most expensive", d, r).ids == ["A-1"] and ask.answer("largest first", d, r).ids == ["B-2", "A-1"] and ask.answer("top 1 by distance", d, r).ids == ["A-1"]
    model = lambda q, top: ask.Answer(f"{len(top)}", ["B-2", "nobody"])
    assert ask.answer_with(model, "q", d, r).ids == ["B-2"]
    assert ask.answer_with(lambda q, top: 1 / 0, "largest", d, r).ids == ["B-2", "A-1"]

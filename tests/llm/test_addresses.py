import pytest

from fieldloom.llm import addresses as A

S = "app_id string, address string, town string, place_id int"
PLACES = A.Places({"belgarrow", "lough skerra"}, ["megron", "fentaagh"], {"me6": "megron"})


@pytest.mark.parametrize(
    "text,want",
    [
        ("95 Kelloon Drive,Megron", ("megron", "", "95", "", [("kelloon", "drive", "/")])),
        ("no.193 Flonde Avenue,Apt. 40,Megrn,Co. Belgarrow", ("megron", "40", "193", "", [("flonde", "avenue", "/")])),
        ("SITE: Apt 23; 134 Rilduibbra Lane; Megron; Belgarrow; me6 v8vp", ("megron", "23", "134", "", [("rilduibbra", "lane", "/")])),
        ("Co Belgarrow Megron 194, Flaibiin Hill Apartment 18", ("megron", "18", "194", "", [("flaibiin", "hill", "/")])),
        ("ME6 74EV\nLough Skerra\nFentaagh\nGreat Such Pk.\nVeffe House", ("fentaagh", "", "", "veffe/house", [("such", "park", "/great")])),
        ("113, Valche Pk, ME6 4T5A", ("megron", "", "113", "", [("valche", "park", "/")])),
        ("At Ten Bubbui Vw, Fentaagh, Co Lough Skerra", ("fentaagh", "", "10", "", [("bubbui", "view", "/")])),
        ("# 170 Little Rood Rd,\nFentaagh", ("fentaagh", "", "170", "", [("rood", "road", "/little")])),
        ("Puimi Cottage Saint Hirmu's Rd Megron County Belgarrow", ("megron", "", "", "puimi/cottage", [("hirmus", "road", "saint/")])),
    ],
)
def test_reading(text, want):
    p = A.parts(text)
    town, segs = A.locate(p, PLACES, A.TownNamer(PLACES))
    number, house, kind, words = A.premises(segs)
    assert (town, p.unit, number, f"{house}/{kind}" if house else "", A.beam(words)[:1]) == want


def addresses():
    rows = []
    for i in range(40):
        rows += [(f"a{i}", f"{i + 1} Kelloon Drive, Megron, Co. Belgarrow, ME6 A{i:03}"), (f"b{i}", f"{i + 1} Valche Park, Fentaagh, Co. Lough Skerra, X33 B{i:03}")]
    rows += [("c1", "no. 5 KELLOON DR. MEGRON"), ("c2", "Site at 5 Kellon Drive; ME6 1A2B"), ("c3", "Apt 2, 5 Kelloon Drive, Megron"), ("c4", "Flat 2, 5, Kelloon Dr, Megron"), ("c5", "5 Kelloon Drive, Fentaagh, Co. Lough Skerra"), ("c6", "Co Belgarrow, Megron, 5 Kelloon Drive")]
    rows += [("h1", "Sheel House, Valche Park, Fentaagh"), ("h2", "sheel hse, valche pk, fentaagh"), ("n1", "Megron, Co. Belgarrow"), ("n2", "Megron, Co. Belgarrow"), ("n3", "See file"), ("n4", ""), ("n5", None), (None, "5 Kelloon Drive, Megron")]
    return rows


def test_pairs(spark):
    df = spark.createDataFrame([(*r, "t", 1) for r in addresses()], S)
    got = {tuple(r) for r in A.pairs(df).collect()}
    same = [("a4", "c1", "c2", "c6"), ("c3", "c4"), ("h1", "h2")]
    assert got == {(x, y) for g in same for x in g for y in g if x < y}


def test_empty(spark):
    assert A.pairs(spark.createDataFrame([], S)).count() == 0


def test_clusters_follow_the_frequent(spark):
    rows = [("g", "kelloon", 50), ("g", "kellon", 2), ("g", "keloon", 1), ("g", "valche", 30), ("g", "valchi", 29), ("h", "kellon", 2)]
    got = {(r.g, r.w): r.root for r in A.clusters(spark.createDataFrame(rows, "g string, w string, n long"), ["g"], "w").collect()}
    assert got == {("g", "kelloon"): "kelloon", ("g", "kellon"): "kelloon", ("g", "keloon"): "kelloon", ("g", "valche"): "valche", ("g", "valchi"): "valchi", ("h", "kellon"): "kellon"}


def test_long_chains_of_spellings_have_one_root(spark):
    from fieldloom.llm.addresses import clusters

    rows = [("t", "b" * k + "a" * (12 - k), 1) for k in range(13)]
    got = clusters(spark.createDataFrame(rows, "town string, base string, n long"), ["town"], "base").collect()
    assert len(got) == 13 and {(r.root, r.root_n) for r in got} == {("a" * 12, 13)}


def test_a_street_without_its_type(spark):
    rows = [(f"a{i}", f"{i + 1} Kelloon Drive, Megron, Co. Belgarrow") for i in range(20)] + [(f"b{i}", f"{i + 1} Valche Park, Megron, Co. Belgarrow") for i in range(9)]
    rows += [(f"v{i}", f"{i + 1} Valche Road, Megron, Co. Belgarrow") for i in range(9)]
    rows += [("t1", "3 Kelloon, Megron, Co. Belgarrow"), ("t2", "3 Valche, Megron, Co. Belgarrow"), ("t3", "3, Valche, Megron")]
    got = {tuple(r) for r in A.pairs(spark.createDataFrame([(*r, "t", 1) for r in rows], S)).collect()}
    # The only Kelloon street is meant; which Valche street is, can't be told.
    assert got == {("a2", "t1"), ("t2", "t3")}


def test_rare_localities_are_learnt_at_any_size(spark):
    rows = [(f"a{i}", f"{i + 1} Kelloon Drive, Megron, Co. Belgarrow") for i in range(300)] + [("x", "7 Nabbe Lane, Oddwick, Co. Belgarrow"), ("y", "7 Nabbe Lane, Oddwick, Co. Belgarrow"), ("z", "Co Belgarrow Oddwick 7 Nabbe Lane")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], S)
    assert {("x", "y"), ("x", "z"), ("y", "z")} <= {tuple(r) for r in A.pairs(df).collect()}
    assert "oddwick" in A.learn(df.select("app_id", "address")).towns


def test_tables_beyond_the_bound_are_not_broadcast(spark, monkeypatch):
    plans, rows = [], [(f"p{i}", f"{i} {n} Road, Kilbeg, Co Clare") for i, n in enumerate(["Marrowby", "Marowby", "Danesfort", "Danesfrot", "Tullig"] * 3)]
    rows += [(f"h{i}", f"Rose {h}, Danesfort Road, Kilbeg, Co Clare") for i, h in enumerate(["Cottage", "Cottage", "Lodge"])]
    d = spark.createDataFrame(rows, "app_id string, address string")
    want = sorted(A.pairs(d).collect())
    write = A.materialise
    monkeypatch.setattr(A, "materialise", lambda df, name="part": plans.append((name, df._jdf.queryExecution().sparkPlan().toString())) or write(df, name))
    monkeypatch.setattr(A, "MOST_SENT", 0)
    assert want and sorted(A.pairs(d).collect()) == want
    # What is exploded, and what grows with the addresses, is many times what Spark takes it for.
    assert not [n for n, p in plans if "BroadcastHashJoin" in p and ("Generate explode" in p or n in ("gazetteer", "searched"))]

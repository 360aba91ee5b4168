from datetime import datetime as D

from fieldloom.operators import references as R

REF = "edge_id string, serves_app_ids array<string>, published_at timestamp, app_id string, n int"
OWN = "app_id string, ingested_at timestamp, deleted_at timestamp, ref_id string"


def run(spark, refs, owners):
    r = R.references(spark.createDataFrame(refs, REF), "extensions", "edge_id")
    return {(x.ref_id, x.app_id) for x in R.orphans(r, R.facts(spark.createDataFrame(owners, OWN))).collect()}


def test_cases(spark):
    t = D(2024, 1, 10)
    owners = [("A", D(2024, 1, 1), None, "x"), ("A", D(2024, 2, 1), None, "x"), ("B", D(2024, 1, 11), None, None), ("C", D(2023, 1, 1), D(2024, 1, 10), None), ("D", D(2023, 1, 1), D(2024, 1, 11), None), ("N", None, None, None), (None, t, None, None)]
    refs = [("e1", [" a ", "b", "C", "d", "", " ", None, "Z", "n ", "z"], t, "clash", 1), ("e1", ["a"], t, "clash", 1), ("e2", None, t, None, None), ("e3", [], t, None, None), ("e4", ["B", "q"], None, None, None)]
    assert run(spark, refs, owners) == {("e1", "B"), ("e1", "C"), ("e1", "Z"), ("e4", "Q")}


def test_empty_tables(spark):
    assert run(spark, [], [("A", D(2024, 1, 1), None, None)]) == set()
    assert run(spark, [("e", ["a"], D(2024, 1, 1), None, None)], []) == {("e", "A")}


def test_heavy_keys_agree_with_light_ones(spark):
    t = D(2024, 1, 10)
    refs = [(f"e{i}", ["HOT" if i % 3 == 0 else f"k{i % 700}", "LATE"], t, None, None) for i in range(1500)]
    owners = [(f"k{i}".upper(), D(2024, 1, 1), None, None) for i in range(0, 700, 2)] + [("LATE", D(2024, 5, 1), None, None), ("HOT", D(2020, 1, 1), None, None)]
    want = {(e, "LATE") for e, *_ in refs} | {(e, k[0].upper()) for e, k, *_ in refs if k[0] != "HOT" and int(k[0][1:]) % 2}
    assert run(spark, refs, owners) == want


def test_by_period_adds_up(spark):
    refs = R.references(spark.createDataFrame([("e", ["a", "b"], D(2024, 1, 5), None, None), ("f", ["b"], D(2024, 2, 5), None, None)], REF), "extensions", "edge_id")
    own = R.facts(spark.createDataFrame([("A", D(2020, 1, 1), None, None)], OWN))
    got = {(r.period, r.n_references, r.n_orphans) for r in R.orphans_by_period(refs, own).collect()}
    assert got == {("2024-01-01", 2, 1), ("2024-02-01", 1, 1)}

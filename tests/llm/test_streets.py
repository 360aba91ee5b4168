import numpy as np

from fieldloom.llm import canonical as C
from fieldloom.llm.bktree import BKTree, distances, encode
from fieldloom.llm.leakage import edits
from fieldloom.llm.street_names import parse

LIST = ["Veaskosol Drive", "Veaskosol Road", "Nuivíche Crescent Upper", "Nuivíche Crescent Lower", "Saint Kennebban's View", "Great Pabbamere Grove", "Little Pabbamere Grove", "Duvoty Road South", "Gloorkl Walk", "Boldolmagh Park"]


def test_tree_equals_brute_force():
    g = np.random.default_rng(0)
    words = ["".join(g.choice(list("abcd"), g.integers(1, 9))) for _ in range(300)]
    qs = words[:40] + ["", "zzz", "abc"]
    most = g.integers(0, 4, len(qs))
    got = BKTree(words).search(qs, most)
    for q, m, hits in zip(qs, most, got):
        want = sorted((edits(q, w, 99), w) for w in set(words) if edits(q, w, 99) <= m)
        assert hits == want


def test_distance():
    c, n = encode(["kitten", "", "sitting"])
    assert distances("sitting", c, n).tolist() == [3, 7, 0]


NAMES = [
    ("VEASKOSOL DR.", 0), ("veaskosl rd", 1), ("Veaskosol Avenue", -1), ("Road, Veaskosol", 1), ("(L5536) Veaskosol  Road", 1), ("R2687 Veaskosol Rd, footpath", 1),
    ("Nuiviche Cresc Upr", 2), ("Lower Nuivíche Cr.", 3), ("Nuivíche Crescent", -1), ("St. Kennebban’s Vw", 4), ("saint kennebans view / rear", 4), ("Kennebbans View", -1),
    ("Gt Pabbamere Gve", 5), ("Pabbamere Grove (Little)", 6), ("South Duvoty Road", 7), ("Duvoty Road N", -1), ("G1oorkl Walk", 8), ("Gloorklwalk", 8), ("Gloorkl W", 8), ("Boldolmagh", 9),
    ("Veaskosol", -1), ("Unnamed road", -1), ("-", -1), ("", -1), ("L420", -1), ("Nuivíche Crescent Up", 2), ("NuivÃ­che Crescent Upper", 2),
]


def denoted(spark, names, listed, shard=C.SHARD):
    n = spark.createDataFrame([(f"e{i}", x) for i, x in enumerate(names)], "edge_id string, street_name string")
    s = spark.createDataFrame(list(enumerate(listed)), "street_id long, street_name string")
    got = {r.edge_id: r.street_id for r in C.matched(n, s, shard=shard).collect()}
    return [got[f"e{i}"] for i in range(len(names))]


def test_names(spark):
    got = denoted(spark, [n for n, _ in NAMES], LIST)
    assert [(n, i) for (n, _), i in zip(NAMES, got)] == NAMES


def test_parse_nothing():
    assert parse("") is None and parse("???") is None


def test_shards_agree_with_one_tree(spark):
    names = [n for n, _ in NAMES] + ["Upper Marlow", "Marlow Upr Road", "Marlowroad"]
    listed = LIST + ["Marlow Road Upper", "Marlow Street Upper", "Marlow Avenue Upper"]
    one = denoted(spark, names, listed)
    assert one[len(NAMES)] == -1 and one[len(NAMES) + 1] == len(LIST)
    assert denoted(spark, names, listed, shard=3) == one == denoted(spark, names, listed, shard=1)


def test_shards_agree_on_random_lists(spark):
    g = np.random.default_rng(3)
    word = lambda: "".join(g.choice(list("abc"), g.integers(4, 8)))
    types, quals = ["Road", "Street", "Lane", ""], ["", "", " Upper", " North"]
    street = lambda: f"{word()} {g.choice(types)}{g.choice(quals)}".strip()
    listed, names = sorted({street() for _ in range(80)}), sorted({street() for _ in range(120)})
    one = denoted(spark, names, listed)
    assert len({i for i in one if i >= 0}) > 10 and -1 in one
    assert denoted(spark, names, listed, shard=1) == one


def test_operator_edges(spark):
    rows = [("e1", "Veaskosol Drive", 1), ("e2", None, 2), ("e3", "veaskosol drive", 3), ("e3", "veaskosol drive", 3), (None, "Veaskosol Rd", 4), ("e4", "", 5), ("e5", "x" * 5000, 6)]
    n = spark.createDataFrame(rows, "edge_id string, street_name string, street_id int")
    s = spark.createDataFrame([*enumerate(LIST), (99, None), (None, "Gloorkl Walk")], "street_id long, street_name string")
    assert {tuple(r) for r in C.denoted_streets(n, s).collect()} == {("e3", 0), ("e4", -1), ("e5", -1)}
    assert C.denoted_streets(n.where("false"), s).count() == 0
    assert {r.street_id for r in C.denoted_streets(n, s.where("false")).collect()} == {-1}

import os

import pytest

from fieldloom.llm import mixing as M

TOK = "doc_id long, source string, n_tokens long, place long"
TGT = "source string, target_share double, max_repeats int, doc_id int"


def test_apportion_is_sainte_lague():
    order = M.apportion({"a": 0.53, "b": 0.24, "c": 0.23}, 7)
    assert {s: order.count(s) for s in "abc"} == {"a": 3, "b": 2, "c": 2}
    assert M.apportion({}, 5) == [] and M.apportion({"a": 0.0}, 3) == []


def test_plan_never_exceeds_repeats():
    p = M.plan({"a": 100_000, "b": 3_000, "c": 50_000}, {"a": (0.5, 1), "b": (0.3, 2), "c": (0.1, 3), "none": (0.1, 4)})
    assert set(p.quota) == {"a", "b", "c"}
    assert all(p.quota[s] <= p.blocks[s] * r for s, r in (("a", 1), ("b", 2), ("c", 3)))
    assert len(p.seats) == sum(p.quota.values())
    assert M.plan({}, {"a": (1.0, 1)}).seats == []


def test_mix(spark):
    rows = [(i, "big" if i % 10 else "small", 80 + i % 41, (i * 2654435761 % (1 << 63)) * (1 if i % 2 else -1)) for i in range(6000)]
    t = spark.createDataFrame(rows, TOK)
    g = spark.createDataFrame([("big", 0.7, 1, 0), ("small", 0.25, 3, 0), ("absent", 0.05, 2, 0), (None, 0.1, 1, 0), ("big", 0.7, 1, 0)], TGT)
    m = M.mix(t, g, shards=4)
    rows = m.collect()
    uses = {}
    for r in rows:
        uses.setdefault(r.doc_id, []).append(r["round"])
    assert all(sorted(set(u)) == sorted(u) for u in uses.values())
    rep = {r.source: r for r in M.shares(m, t, g).collect()}
    assert rep["small"].most_uses <= 3 and rep["big"].most_uses == 1 and rep["absent"].actual_share == 0.0
    assert abs(rep["big"].actual_share - 0.7 / 0.95) < 0.01
    per = {}
    for r in rows:
        per[r.shard] = per.get(r.shard, 0) + r.n_tokens
    assert len(per) == 4 and max(per.values()) < 1.1 * min(per.values())
    assert {tuple(r) for r in M.mix(t, g, shards=4).collect()} == {tuple(r) for r in rows}


def test_every_page_can_be_used(spark):
    rows = [(i, "a" if i % 7 else "b", 50 + i % 97, i * 40503 % 65521 * (1 << 40)) for i in range(3001)]
    t = spark.createDataFrame(rows, TOK)
    size = {s: sum(r[2] for r in rows if r[1] == s) for s in "ab"}
    share = size["a"] / (size["a"] + size["b"])
    for tgt, want in (([("a", 1.0, 1, 0)], {"a": 1}), ([("a", share, 2, 0), ("b", 1 - share, 2, 0)], {"a": 2, "b": 2})):
        m = M.mix(t, spark.createDataFrame(tgt, TGT)).groupBy("source", "doc_id").count().collect()
        for s, n in want.items():
            uses = [r["count"] for r in m if r.source == s]
            assert len(uses) >= 0.99 * sum(r[1] == s for r in rows) and max(uses) <= n
    only = M.mix(t, spark.createDataFrame([("a", 1.0, 1, 0)], TGT))
    assert only.count() == sum(r[1] == "a" for r in rows)


def test_empty(spark):
    g = spark.createDataFrame([("a", 1.0, 1, 0)], TGT)
    e = spark.createDataFrame([], TOK)
    assert M.mix(e, g).count() == 0
    assert [r.actual_share for r in M.shares(M.mix(e, g), e, g).collect()] == [0.0]


@pytest.mark.skipif(not os.path.exists(M.TOKENIZERS), reason="no vocabulary files")
def test_measured(spark):
    d = spark.createDataFrame([(1, "s", "Hello world"), (2, "s", ""), (3, None, "x"), (4, "s", None), (5, "t", "don't 12 <|endoftext|>")], "doc_id long, source string, text string")
    got = {r.doc_id: r.n_tokens for r in M.measured(d).collect()}
    assert set(got) == {1, 5} and got[1] == 2 and got[5] > 5

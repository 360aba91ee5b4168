from fieldloom.llm import truncation as T

S = "app_id string, authority string, description string, key int, source int"


def texts():
    out = []
    for i in range(60):
        whole = f"Permission for {i} houses at Coolmore. The gate of {i} m faces the old northern lane. All walls are finished in brick and stone. Trees are planted along the western side of the square."
        out.append((f"w{i}", "Open Council", whole))
        out.append((f"u{i}", "Open Council", whole[:-1]))
        out.append((f"l{i}", "Short Council" if i % 2 else " SHORT COUNCIL", (whole + " " + whole)[: 120 if i % 4 else 150 - i]))
    return out


def test_found_and_spikes(spark):
    rows = texts() + [("m1", "Open Council", "Permission for 9 houses at Coolmo…"), ("m2", "Open Council", "Permission for 9 houses at Coolmore. The gate of 9 m fac"), ("n", None, None), ("e", "Open Council", "  "), (None, "x", "cut of")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], S)
    t = T.measured(df, "app_id", "authority", "description")
    got = {r.key for r in T.found(t).collect()}
    cut = {r[0] for r in rows if r[0] and r[0][0] == "l" and r[2] and not r[2].rstrip().endswith((".", "stone", "lane", "Coolmore", "square"))}
    assert not {k for k in got if k[0] in "wu"}
    assert {"m1", "m2"} <= got and "n" not in got and "e" not in got
    assert len(cut - got) <= 0.05 * len(cut) + 1
    sp = {(r.source, r.measure, r.length) for r in T.spikes(t).collect()}
    assert ("short council", "chars", 120) in sp and not any(s == "open council" and n > 170 for s, _, n in sp if s != "open council")


def test_empty(spark):
    t = T.measured(spark.createDataFrame([], S), "app_id", "authority", "description")
    assert T.found(t).count() == 0 and T.rates(t).count() == 0 and T.spikes(t).count() == 0


def test_rates_count_texts_once(spark):
    rows = [("a", "X", "It is whole."), ("a", "X", "It is whole."), ("b", "X", "It is who…")]
    r = T.rates(T.measured(spark.createDataFrame([(*x, 0, 0) for x in rows], S), "app_id", "authority", "description")).collect()
    assert [(x.source, x.n_texts, x.n_truncated, x.rate) for x in r] == [("x", 2, 1, 0.5)]


def test_hot_contexts_and_stages_agree(spark, monkeypatch):
    df = spark.createDataFrame([(*r, 1, 2) for r in texts() + [("m2", "Open Council", "Permission for 9 houses at Coolmore. The gate of 9 m fac")]], S)
    t = T.measured(df, "app_id", "authority", "description")
    want = {r.key for r in T.found(t).collect()}
    stages = T.stages(t).collect()
    assert sum(r.n_truncated for r in stages) == len(want) and {"limit", "transfer"} == {r.stage for r in stages}
    # Every context split off, none, and cut words met by a shuffled join.
    for hot, odd in ((10**9, T.MOST_ODD), (0, 0)):
        monkeypatch.setattr(T, "HOT", hot)
        monkeypatch.setattr(T, "MOST_ODD", odd)
        assert {r.key for r in T.found(t).collect()} == want

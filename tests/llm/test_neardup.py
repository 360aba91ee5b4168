import random
import re
from collections import Counter

from fieldloom.llm import neardup as N

S = "key string, text string, class_id string, bag int"


def dice(a, b):
    x, y = (Counter(re.findall(r"[^\W_]+", t.lower())) for t in (a, b))
    n = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / n if n else 0.0


def corpus():
    g = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    common = "the of and a to in is for on at".split()
    out = []
    for i in range(120):
        words = [g.choice(common) if g.random() < 0.5 else g.choice(vocab) for _ in range(g.randint(30, 70))]
        out.append((f"d{i:03}", " ".join(words)))
        for k in range(g.randint(0, 3)):
            w = list(words)
            for _ in range(g.randint(0, 6)):
                w[g.randrange(len(w))] = g.choice(vocab)
            if k == 1:
                g.shuffle(w)
            out.append((f"d{i:03}{k}", " ".join(w).upper()))
    return out


def test_pairs_against_brute_force(spark):
    rows = corpus()
    want = {(a, b) for i, (a, t) in enumerate(rows) for b, u in rows[i + 1 :] if dice(t, u) >= 0.88}
    want = {tuple(sorted(p)) for p in want}
    got = {tuple(r) for r in N.pairs(spark.createDataFrame([(*r, "x", 1) for r in rows], S)).collect()}
    assert got <= want
    assert len(got) >= 0.97 * len(want) > 50


def test_edges(spark):
    rows = [("a", "One two three"), ("b", "three, two. ONE!"), ("b", "three, two. ONE!"), ("c", ""), ("d", "  ..  "), ("e", None), (None, "One two three"), ("f", "word " * 3000), ("g", "word " * 3001), ("h", "one two two")]
    df = spark.createDataFrame([(*r, "z", 0) for r in rows], S)
    assert {tuple(r) for r in N.pairs(df).collect()} == {("a", "b"), ("f", "g")}
    links = {r.key: (r.class_size, r.n_links) for r in N.with_links(df).collect()}
    assert links == {"a": (2, 0), "b": (2, 0), "f": (1, 1), "g": (1, 1), "h": (1, 0)}
    assert N.pairs(df.where("false")).count() == 0


def test_copies_are_one_class(spark):
    rows = [(f"k{i}", "same words here and there again", "", 0) for i in range(400)] + [("x", "other text of its own", "", 0)]
    links = N.with_links(spark.createDataFrame(rows, S)).collect()
    assert len(links) == 401 and {(r.class_size, r.n_links) for r in links} == {(400, 0), (1, 0)}


def test_edited_copies_of_a_third_of_the_texts(spark, monkeypatch):
    g = random.Random(8)
    shared = [f"s{i}" for i in range(67)]
    rows = [(f"g{i:03}", " ".join(shared + [f"r{i}x{k}" for k in range(9)])) for i in range(100)]
    rows += [(f"o{i:03}", " ".join(f"v{g.randrange(9000)}" for _ in range(76))) for i in range(200)]
    large = N.shape(2_050_000)
    monkeypatch.setattr(N, "shape", lambda n, similarity=N.SIMILARITY: large)
    got = N.pairs(spark.createDataFrame([(*r, "x", 1) for r in rows], S)).count()
    assert got >= 0.98 * 100 * 99 / 2


def test_recall_holds_at_every_size():
    for n in (10, 50_000, 400_000, 400_001, 2_050_000, 20_000_000, 10**9):
        coordinates, width = N.shape(n)
        assert coordinates * (N.SIMILARITY / (2 - N.SIMILARITY)) ** width >= N.AGREEING
    assert N.shape(10) == N.shape(50_000) == N.shape(400_000)


def test_long_posting_lists_are_cut_into_blocks(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], S)
    whole = {tuple(r) for r in N.pairs(df).collect()}
    monkeypatch.setattr(N, "SAMPLED", 1)
    monkeypatch.setattr(N, "LONG", 2)
    assert {tuple(r) for r in N.pairs(df).collect()} == whole


def test_very_long_and_many_distinct_words(spark, monkeypatch):
    monkeypatch.setattr(N, "SLICE", 500)
    monkeypatch.setattr(N, "DISTINCT", 50)
    rows = corpus()
    want = {tuple(sorted((a, b))) for i, (a, t) in enumerate(rows) for b, u in rows[i + 1 :] if dice(t, u) >= 0.88}
    got = {tuple(r) for r in N.pairs(spark.createDataFrame([(*r, "x", 1) for r in rows], S)).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)


def test_what_the_sizes_and_parities_rule_out_is_not_alike(spark):
    rows = corpus()
    signs = N.signed(N.keyed(spark.createDataFrame([(*r, "x", 1) for r in rows], S))).select("key", "words")
    a, b = (signs.select(signs.key.alias(f"key_{x}"), signs.words.alias(f"words_{x}")) for x in "ab")
    ruled = a.crossJoin(b).where("key_a < key_b").where(~N._may_share(a.words_a, b.words_b, N.SIMILARITY)).collect()
    text = dict(rows)
    assert len(ruled) > 1000 and all(dice(text[r.key_a], text[r.key_b]) < N.SIMILARITY for r in ruled)

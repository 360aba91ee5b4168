import random

import numpy as np
import pyarrow as pa

from fieldloom.llm import abuse as A

GOOD = ["The inspector found {n} yards of main at {p} sound.", "Prices of oats rose {n}d in {p} following the frost.", "{p} supplied flax and coal at {n}s per cwt.", "A carter named {p} was fined {n}s for abusive language.", "A prize pig of {p} farrowed {n} young."]
BAD = ["Hold your tongue, you filthy swine of {p}, or I break your jaw.", "Go and hang yourself, {p}, you crawling cur.", "He called {p} a stinking leech and swore to crack every bone."]


def page(g, bad):
    s = [g.choice(GOOD) for _ in range(12)]
    if bad:
        s[g.randrange(12)] = g.choice(BAD)
    names = ["".join(g.choice("bcdfg") + g.choice("aeiou") for _ in range(3)).title() for _ in range(12)]
    words = " ".join(x.format(n=g.randint(2, 99), p=y) for x, y in zip(s, names)).split()
    return "\n".join(" ".join(words[i : i + 6]) for i in range(0, len(words), 6))


def test_held_out_accuracy(spark):
    g = random.Random(1)
    truth = [g.random() < 0.15 for _ in range(900)]
    docs = [(i, page(g, b), "en" if i % 3 else "ga", f"s{i % 2}") for i, b in enumerate(truth)]
    docs += [(2000, None, None, None), (2001, "", "en", "s0")]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    labels = [(i, int(truth[i]) ^ (g.random() < 0.04), "r") for i in range(500)] + [(None, 1, "r"), (3, None, "r")]
    lab = spark.createDataFrame(labels, "doc_id long, label int, lang string")
    s = {r.doc_id: r for r in A.scores(d, lab).collect()}
    assert s[2000].score == 0 and not s[2000].flagged and s[2001].score == 0
    held = range(500, 900)
    hit = sum(s[i].flagged and truth[i] for i in held)
    assert hit / max(1, sum(s[i].flagged for i in held)) > 0.9 and hit / sum(truth[i] for i in held) > 0.9
    assert {r.source for r in A.rates(A.scores(d, lab, A.Model([A.Net.fresh()], 0.5, {}))).collect()} == {"s0", "s1", None}


def test_table_equals_convolution():
    n = A.Net.fresh(3)
    g = np.random.default_rng(0)
    tok = g.integers(0, A.BUCKETS - 1, 40).astype(np.int32)
    off = np.array([0, 5, 9, 9, 40])
    got = A.score(n.table(), n, tok, off)
    for k in range(4):
        t = np.append(tok[off[k] : off[k + 1]], [A.PAD] * A.REACH)
        if off[k + 1] - off[k] < A.LEAST_WORDS:
            assert got[k] == 0
            continue
        f = []
        for c, b in zip(n.conv, n.bias):
            a = np.array([sum(n.emb[t[i + o]] @ c[o] for o in range(len(c))) + b for i in range(off[k + 1] - off[k])])
            f.append(np.maximum(a.max(axis=0), 0))
        z = np.concatenate(f) @ n.out + n.off
        assert abs(got[k] - 1 / (1 + np.exp(-z))) < 1e-5


def test_no_labels():
    m = A.fit(pa.table({"text": pa.array([], pa.string()), "lang": pa.array([], pa.string()), "label": pa.array([], pa.int64())}))
    assert m.threshold == A.UNSURE_CUT


def test_thresholds_are_drawn_by_their_cases():
    s, y = np.array([0.1, 0.2, 0.6, 0.8]), np.array([0, 0, 1, 1])
    best = A.best_threshold(s, y)
    assert A.drawn(s[:2], y[:2], 0.9) == 0.9
    assert best < A.drawn(s, y, 0.9) < A.drawn(s[[0, 1, 3]], y[[0, 1, 3]], 0.95) < 0.95
    many = A.drawn(np.tile(s, 500), np.tile(y, 500), 0.9)
    assert abs(many - best) < 0.01


def test_one_sentence_over_lines():
    flat, row = A.sentences(pa.array(["NEWS FROM HERE\nMr. Such was fi-\nned 6s. for it. He paid.", None]))
    assert [s for s, r in zip(flat.to_pylist(), row) if r == 0] == ["Mr Such was fined 6s for it.", "He paid."]

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fieldloom.llm import leakage as L
from fieldloom.llm import pages as P

BOX = pa.list_(pa.struct([("x0", pa.int32()), ("y0", pa.int32()), ("x1", pa.int32()), ("y1", pa.int32()), ("conf", pa.float32())]))


def boxes(rows):
    return pa.array([None if r is None else [{"x0": x, "y0": y, "x1": x + 200, "y1": y + 9, "conf": 0.9} for x, y in r] for r in rows], BOX)


def test_columns_then_rows():
    text = pa.array(["c1a\nc2a\nc1b\nc2b", None, "", "x\ny", "left one     right one\nleft two     right two"])
    b = boxes([[(60, 10), (600, 8), (62, 30), (598, 31)], None, [(1, 1)], [(1, 1)], [(60, 10), (61, 30)]])
    assert P.reading_order(text, b).to_pylist() == ["c1a\nc1b\nc2a\nc2b", "", "", "x\ny", "left one\nleft two\nright one\nright two"]


def test_breaks_and_words():
    flat, off = P.words(P.joined(pa.array(["It was plo-\nughman, pou¬\nnds of\nO'Brien's 8d.", "", " - "])))
    assert flat.to_pylist() == ["it", "was", "ploughman", "pounds", "of", "obriens", "8d"] and off.tolist() == [0, 7, 7, 7]


DOC = "doc_id long, text string, line_boxes array<struct<x0:int,y0:int,x1:int,y1:int,conf:float>>, item_id int"


def test_leaks(spark):
    g = random.Random(2)
    names = ["".join(g.choice("bcdfgklmnprst") + g.choice("aeiou") for _ in range(4)) for _ in range(9000)]
    common = "the of to and at for by in was were".split()
    say = lambda n: [g.choice(names) if k % 3 == 0 else g.choice(common) for k in range(n)]
    item = say(60)
    noisy = list(item)
    noisy[7], noisy[30] = noisy[7][:-1] + "x", "zzzzzz"
    noisy[15:16] = [noisy[15][:4], noisy[15][4:]]
    wrap = lambda w: "\n".join(" ".join(w[i : i + 6]) for i in range(0, len(w), 6))
    docs = [(1, wrap(say(80) + item + say(40))), (2, wrap(say(50) + noisy + say(9))), (3, wrap(say(30) + item[10:30] + say(30))), (4, wrap(say(30) + item[10:26] + say(30))), (5, wrap(item[:12] + say(25) + item[12:40])), (6, None), (7, ""), (8, wrap(say(4000)))]
    docs += [(100 + i, wrap(say(150))) for i in range(150)]
    d = spark.createDataFrame([(i, t, None, 0) for i, t in docs], DOC)
    items = spark.createDataFrame([(9, " ".join(item), "x"), (9, " ".join(item), "x"), (10, "too short", ""), (11, None, ""), (12, " ".join(say(40)), "")], "item_id long, text string, doc_id string")
    got = {(r.item_id, r.doc_id): r.n_words for r in L.matches(d, items).collect()}
    assert set(got) == {(9, 1), (9, 2), (9, 3), (9, 5)}
    assert got[9, 1] == 60 and got[9, 2] >= 55 and 20 <= got[9, 3] <= 22 and got[9, 5] == 40
    assert L.matches(d.where("false"), items).count() == 0 and L.matches(d, items.where("false")).count() == 0


def test_more_passes_agree(spark, monkeypatch):
    d = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k) % 97}x{(i + k * k) % 13}" for k in range(60)), None, 0) for i in range(40)], DOC)
    items = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k) % 97}x{(i + k * k) % 13}" for k in range(10, 45))) for i in range(6)], "item_id long, text string")
    one = {tuple(r) for r in L.matches(d, items).collect()}
    monkeypatch.setattr(L, "ITEMS", 2)
    assert {tuple(r) for r in L.matches(d, items).collect()} == one and {(i, i) for i in range(6)} <= {r[:2] for r in one}


def test_passages_on_a_third_of_the_pages_and_few_pages(spark):
    g = random.Random(6)
    names = ["".join(g.choice("bcdfgklmnprst") + g.choice("aeiou") for _ in range(4)) for _ in range(9000)]
    common = "the of to and at for by in was were".split()
    say = lambda n: [g.choice(names) if k % 3 == 0 else g.choice(common) for k in range(n)]
    item, other = say(60), say(60)
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other))], "item_id long, text string")

    def leak():
        a = g.randrange(0, 38)
        part = item[a : a + 22]
        part[g.randrange(5, 17)] = "zzzz"
        return say(50) + part + say(50)

    for n in (3, 12, 300):
        docs = [(i, " ".join(leak() if i % 3 == 0 else say(120)), None, 0) for i in range(n)] + [(n, " ".join(say(9) + other[5:45]), None, 0)]
        got = {(r.item_id, r.doc_id) for r in L.matches(spark.createDataFrame(docs, DOC), items).collect()}
        assert got == {(1, i) for i in range(0, n, 3)} | {(2, n)}
    docs = [(i, " ".join(say(9) + item + say(9)), None, 0) for i in range(200)]
    assert L.matches(spark.createDataFrame(docs, DOC), items).count() == 200


def test_index_is_read_a_few_segments_at_a_time(spark):
    import pyarrow.parquet as pq

    # 30 pages of 1.6 or 1.8 MB: a segment holds four or five of them, a row group HELD segments.
    d = spark.createDataFrame([(i, None, 0) for i in range(30)], "doc_id long, line_boxes array<struct<x0:int,y0:int,x1:int,y1:int,conf:float>>, item_id int")
    d = d.withColumn("text", F.repeat(F.concat(F.lit("word w"), F.col("doc_id"), F.lit(" ")), 200_000)).coalesce(1)
    index = L.positional_index(d)
    groups = [m.row_group(k) for m in (pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()) for k in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) > L.HELD and max(g.num_rows for g in groups) <= L.HELD
    assert sorted(x for r in index.select("doc_ids").collect() for x in r.doc_ids) == list(range(30))
    assert {r.term: r.n for r in L.frequencies(index, spark.createDataFrame([(int(L._hashes(pa.array(["word"]))[0]),)], "term long")).collect()}.popitem()[1] == 30


def test_cuts_by_rows_and_bytes():
    b = pa.record_batch({"text": pa.array(["aaaa", None, "", "bb", "c" * 50, "d", "e", "f"])})
    assert [x.num_rows for x in L._cut(b, 3, 5)] == [3, 1, 1, 3] and [x.num_rows for x in L._cut(b, 3, 0)] == [1, 2, 1, 1, 1, 1, 1]
    assert list(L._cut(b.slice(0, 0), 3, 5)) == []

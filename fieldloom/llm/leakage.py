"""Evaluation passages inside corpus documents, by a distributed positional inverted index.

1. Every document is put into reading order and cut into words. The postings of all
   its words are stored: the index is written once to the shared folder, in segments of
   SEGMENT documents, each with its terms in order and, for every term, the documents and
   places it stands at.
2. Document frequencies of the test terms are read from the index.
3. In each stretch of WINDOW words of a test item the ANCHORS rarest terms become
   anchors. In every segment the anchors' postings, adjusted by the anchors' offsets,
   are intersected by item and document; no posting is ever shuffled. Pairs with enough
   agreement are kept. A stretch whose terms are too frequent to tell (its passage may be
   reprinted on a third of all pages, or the pages be few) is also looked up as a phrase: by
   the runs of RUN words around its TELLING rarest terms, which count the same
   however many pages have them.
4. The kept pairs' documents are read again and aligned word by word from their anchors:
   words equal, misread (small edit distance), broken in two, run together, or singly exchanged.

Test items go to the segments ITEMS at a time, so what is sent is bounded; a
larger test set takes more passes over the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.pages import joined, reading_order, words
from fieldloom.runtime import checked_broadcast, materialise, within_rows

#: Consecutive words of an item that make a leak.
WINDOW = 20
#: Anchors in each stretch of WINDOW words.
ANCHORS = 6
#: An anchor that a share s of the documents has weighs max(0, ln(1/s) - COMMON): nothing above 8 %.
COMMON = 2.5
#: Weight of agreeing anchors that sends a pair on to alignment: two terms of one document in 250, or three of one in 60.
LEAST_WEIGHT = 4.0
#: A stretch whose anchors, any SPARED of them misread, fall short of LEAST_WEIGHT adds the runs of RUN words that hold one of
#: its TELLING rarest terms; runs that hold two such terms suffice. Pages of one form share its other words, but not these.
SPARED = 2
RUN = 3
TELLING = 3
#: What an aligned word adds: one that at most RARE (or SOME) of the documents have, any other; and what one exchanged
#: or an interruption takes. A run's core ends where its sum is greatest, so forms that share all but names and figures
#: don't make one. Only a core of CORE words is a passage; its ends are then followed as far as words still match.
CORE = 10
RARE, SOME = 0.02, 0.1
GAINS = (2.0, 1.0, 0.5)
EXCHANGED = -2.5
INTERRUPTED = -2.0
#: Anchors agree if their offsets differ by at most so many words: room for broken and inserted words.
DRIFT = 48
#: Words of other matter (a headline, an advert) that a passage may be interrupted by.
GAP = 40
#: Test items sent to the index's segments at a time (some 20 MB).
ITEMS = 20_000
#: Documents of an index segment, and bytes of their texts, unless one text is longer.
SEGMENT = 1000
SEGMENT_BYTES = 8_000_000
#: Segments of a row group (some 20 MB), which is read at once.
HELD = 4
#: Ids of candidate pages are sent to the pages by broadcast up to this number (some 20 MB), beyond by a shuffled join.
MOST_PAGES = 1_000_000
#: Test terms are matched on the map side up to this number (about 100 MB), beyond by a shuffled join.
MOST_TERMS = 4_000_000


def _page_words(b: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    return words(joined(reading_order(b.column("text"), b.column("line_boxes") if "line_boxes" in b.schema.names else None)))


def _hashes(flat: pa.Array) -> np.ndarray:
    """64-bit hashes of words; equal hashes of unlike words are told apart by the alignment."""
    enc = flat.dictionary_encode()
    if not len(enc.dictionary):
        return np.zeros(0, np.int64)
    return pd.util.hash_array(enc.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False).view(np.int64)[enc.indices.to_numpy()]


_SEGMENT = "doc_ids array<long>, terms array<long>, n_docs array<int>, starts array<int>, docs array<int>, places array<int>"


def _cut(b: pa.RecordBatch, rows: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows and `most` bytes of text; a longer text is a slice by itself."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("text").cast(pa.string())), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    s = 0
    while s < b.num_rows:
        n = int(np.searchsorted(ends, (ends[s - 1] if s else 0) + most, "right")) - s
        n = min(max(1, n), rows, b.num_rows - s)
        yield b.slice(s, n)
        s += n


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each SEGMENT documents: terms ascending; term k has n_docs[k] documents and the postings starts[k] to starts[k + 1]."""
    one = lambda a, kind: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, kind))
    for b in (y for x in batches for y in _cut(x, SEGMENT, SEGMENT_BYTES)):
        flat, off = _page_words(b)
        h = _hashes(flat)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))
        place = np.arange(len(h)) - off[doc]
        order = np.argsort(h, kind="stable")
        h, doc, place = h[order], doc[order], place[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        start = np.nonzero(new)[0]
        other = new.copy()
        other[1:] |= doc[1:] != doc[:-1]
        n_docs = np.add.reduceat(other.astype(np.int32), start) if len(start) else start
        ids = b.column("doc_id").cast(pa.int64()).to_numpy(zero_copy_only=False)
        cols = [one(ids, pa.int64()), one(h[start], pa.int64()), *(one(x.astype(np.int32), pa.int32()) for x in (n_docs, np.append(start, len(h)), doc, place))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_ids", "terms", "n_docs", "starts", "docs", "places"])


def _pages(documents: DataFrame) -> DataFrame:
    return documents.select([c for c in ("doc_id", "text", "line_boxes") if c in documents.columns]).where("doc_id IS NOT NULL")


def positional_index(documents: DataFrame) -> DataFrame:
    """The postings of all words of all documents with an id, written once. A null text has no words.

    A segment is a few MB in one row, and Spark reads up to 4096 rows of a row group at once, so row groups are of HELD rows.
    """
    return materialise(_pages(documents).mapInArrow(_segments, _SEGMENT), "index", HELD)


def item_words(items: DataFrame) -> DataFrame:
    """(key, item_id, words, terms) of the items, terms being the words' hashes; items of under WINDOW words can't leak and are left out.

    An item with several texts leaks if any of them does; key tells them apart.
    """

    def run(batches):
        for b in batches:
            flat, off = words(joined(pc.fill_null(b.column("text").cast(pa.string()), "")))
            o = pa.array(off.astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("item_id"), pa.ListArray.from_arrays(o, flat), pa.ListArray.from_arrays(o, pa.array(_hashes(flat)))], ["key", "item_id", "words", "terms"])

    some = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL").distinct().withColumn("key", F.xxhash64("item_id", "text"))
    return some.mapInArrow(run, "key long, item_id long, words array<string>, terms array<long>").where(F.size("words") >= WINDOW)


def _place_of(known: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Where each of the ascending `known` stands among the ascending `terms`, or -1."""
    at = np.minimum(np.searchsorted(terms, known), max(0, len(terms) - 1))
    return np.where(terms[at] == known, at, -1) if len(terms) else np.full(len(known), -1)


def _rows(b: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
    for k in range(b.num_rows):
        yield {c: b.column(c)[k].values.to_numpy(zero_copy_only=False) for c in b.schema.names}


def _count_terms(known: np.ndarray):
    """Document frequencies by segment: one row for each term and partition."""

    def run(batches):
        df = np.zeros(len(known), np.int64)
        for b in batches:
            for r in _rows(b):
                at = _place_of(known, r["terms"])
                df[at >= 0] += r["n_docs"][at[at >= 0]]
        hit = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(known[hit]), pa.array(df[hit])], ["term", "n"])

    return run


def frequencies(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): in how many documents each of the distinct `terms` (a materialised table) occurs; those of none are left out."""
    if within_rows(terms, MOST_TERMS):
        known = np.sort(terms.toArrow().column("term").to_numpy())
        found = index.select("terms", "n_docs").mapInArrow(_count_terms(known), "term long, n long")
    else:
        found = index.select(F.explode(F.arrays_zip("terms", "n_docs")).alias("t")).select(F.col("t.terms").alias("term"), F.col("t.n_docs").cast("long").alias("n")).join(terms, "term", "left_semi")
    return found.groupBy("term").agg(F.sum("n").alias("n"))


def anchors(items: DataFrame, frequency: DataFrame, n_docs: int, window: int = WINDOW, most: int = ANCHORS) -> DataFrame:
    """(key, ipos, term, mark, weight): the rarest `most` positions of every stretch of `window` words. Terms that no document has are passed over.

    Where those weigh too little, the runs around its rarest too, as a term with blanks. Each mark, the position told by, counts once.
    """
    ranked = items.select("key", F.posexplode(F.arrays_zip("words", "terms")).alias("ipos", "w")).select("key", "ipos", F.col("w.words").alias("word"), F.col("w.terms").alias("term")).join(frequency, "term").drop("term").withColumnRenamed("word", "term")
    per_item = ranked.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("ipos", "n", "term"))).alias("all"))

    def pick(batches):
        for batch in batches:
            out = []
            for item, rows in zip(batch.key, batch["all"]):
                pos, n = np.array([r["ipos"] for r in rows]), np.array([r["n"] for r in rows])
                weight = np.maximum(0.0, np.log(max(1, n_docs) / n) - COMMON)
                chosen: set[int] = set()
                weak: set[int] = set()
                for s in range(0, max(1, int(pos.max()) - window + 2)):
                    m = np.nonzero((pos >= s) & (pos < s + window))[0]
                    best = m[np.lexsort((pos[m], n[m]))[:most]]
                    chosen.update(best.tolist())
                    if weight[best][SPARED:].sum() < LEAST_WEIGHT:
                        weak.update(best[:TELLING].tolist())
                out += [(item, int(pos[k]), rows[k]["term"], int(pos[k]), float(weight[k])) for k in sorted(chosen) if weight[k] > 0]
                for k in sorted(weak):
                    for b in range(max(0, k - RUN + 1), min(k, len(pos) - RUN) + 1):
                        if pos[b + RUN - 1] - pos[b] == RUN - 1:
                            out.append((item, int(pos[b]), " ".join(rows[b + x]["term"] for x in range(RUN)), int(pos[k]), LEAST_WEIGHT / 2))
            yield pd.DataFrame(out, columns=["key", "ipos", "term", "mark", "weight"])

    return per_item.mapInPandas(pick, "key long, ipos int, term string, mark int, weight double")


def edits(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        if min(new) > most:
            return most + 1
        row = new
    return row[-1]


#: Letters that stand for digits when digits are misread. Fixed values.
FIGURES = str.maketrans("oilzsbg", "0112589")


@lru_cache(maxsize=1 << 17)
def alike(a: str, b: str) -> bool:
    """Equal or a plausible misreading: at most a third of the letters changed; figures only by look-alikes."""
    if a == b:
        return True
    if any(c.isdigit() for c in a):
        return a.translate(FIGURES) == b.translate(FIGURES)
    long = max(len(a), len(b))
    if long < 3:
        return long == 2 and edits(a, b, 1) <= 1
    most = long // 3
    # What the longer has over the letters both have must be changed at least.
    if abs(len(a) - len(b)) > most or long - sum(min(a.count(c), b.count(c)) for c in set(a)) > most:
        return False
    return edits(a, b, most) <= most


def _walk(item: list[str], gain: list[float], doc: list[str], i: int, j: int, step: int, gap: int = GAP) -> tuple[int, int]:
    """How many words of the item beyond (i, j) the document goes on with in direction `step`: to the core's end, and in all."""
    n, m = len(item), len(doc)
    got = best = 0
    total = top = 0.0
    i += step
    j += step

    def fits(p: int, q: int) -> bool:
        return 0 <= p < n and 0 <= q < m and alike(item[p], doc[q])

    while 0 <= i < n and 0 <= j < m:
        i2, j2 = i + step, j + step
        if fits(i, j):
            total, got, i, j = total + (gain[i] if item[i] == doc[j] else 0.5), got + 1, i2, j2
        elif 0 <= j2 < m and len(item[i]) > 3 and alike(item[i], doc[j] + doc[j2] if step > 0 else doc[j2] + doc[j]):
            total, got, i, j = total + 0.5, got + 1, i2, j2 + step  # broken in two
        elif 0 <= i2 < n and len(doc[j]) > 3 and alike(item[i] + item[i2] if step > 0 else item[i2] + item[i], doc[j]):
            total, got, i, j = total + 1.0, got + 2, i2 + step, j2  # run together
        elif fits(i2, j2) and (gain[i2] > GAINS[-1] or fits(i2 + step, j2 + step)):
            total, got, i, j = total + EXCHANGED + gain[i2], got + 2, i2 + step, j2 + step  # one word exchanged
        elif fits(i2 + step, j2 + step) and fits(i2 + 2 * step, j2 + 2 * step):
            total, got, i, j = total + 2 * EXCHANGED + gain[i2 + step], got + 3, i2 + 2 * step, j2 + 2 * step  # two by chance side by side
        else:
            for k in range(1, gap + 1):  # other matter in between
                a = j + k * step
                if 0 <= a < m and item[i] == doc[a] and fits(i2, a + step) and fits(i2 + step, a + 2 * step):
                    total, j = total + INTERRUPTED, a
                    break
            else:
                break
        if total > top:
            top, best = total, got
        elif total < top - 12:
            break
    return best, got


def longest_run(item: list[str], gain: list[float], doc: list[str], hits: list[tuple[int, int]], gap: int = GAP) -> int:
    """The most consecutive words of `item` that `doc` carries around any of the (item position, document position) hits."""
    best = 0
    done: set[tuple[int, int]] = set()
    for i, j in sorted(set(hits)):
        if (j - i, i // WINDOW) in done or j >= len(doc) or doc[j] != item[i]:
            continue
        done.add((j - i, i // WINDOW))
        (a, b), (c, d) = _walk(item, gain, doc, i, j, 1, gap), _walk(item, gain, doc, i, j, -1, gap)
        best = max(best, 1 + b + d if 1 + a + c >= CORE else 1 + a + c)
    return best


def _run_hash(words_: list[np.ndarray]) -> np.ndarray:
    """A hash of the words' numbers, in order."""
    h = np.zeros(len(words_[0]), np.uint64)
    with np.errstate(over="ignore"):
        for w in words_:
            h = (h ^ w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


_CANDIDATE = "doc_id long, item long, ipos array<int>, place array<int>, in_run array<boolean>"


def _intersect(anchor: pa.Table, numbers: dict[int, int]):
    """Over the index's segments: the postings of anchor terms and runs, intersected with the items. Items come out by number."""
    enc = anchor.column("term").combine_chunks().dictionary_encode()
    parts = pc.split_pattern(enc.dictionary, " ")
    long = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    known, ids = np.unique(_hashes(pc.list_flatten(parts)), return_inverse=True)
    head = np.cumsum(long) - long
    # Of each known word its place among the terms, if it is one by itself; of each run its hash.
    alone = np.full(len(known), -1, np.int64)
    alone[ids[head[long == 1]]] = np.nonzero(long == 1)[0]
    runs = np.nonzero(long == RUN)[0]
    hashes = _run_hash([ids[head[runs] + x] for x in range(RUN)])
    by_hash = np.argsort(hashes, kind="stable")
    runs, hashes = runs[by_hash], hashes[by_hash]
    order = np.argsort(enc.indices.to_numpy(), kind="stable")
    item = np.array([numbers[k] for k in anchor.column("key").to_pylist()], np.int64)[order]
    ipos = anchor.column("ipos").to_numpy().astype(np.int64)[order]
    in_run = (long == RUN)[enc.indices.to_numpy()][order]
    mark = anchor.column("mark").to_numpy()[order]
    weight = anchor.column("weight").to_numpy()[order]
    size = np.bincount(enc.indices.to_numpy(), minlength=len(enc.dictionary))
    begin = np.cumsum(size) - size
    wide = 2 * DRIFT

    def segment(r: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        at = _place_of(known, r["terms"])
        word = np.nonzero(at >= 0)[0]
        lo, hi = r["starts"][at[word]].astype(np.int64), r["starts"][at[word] + 1].astype(np.int64)
        n = hi - lo
        take = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        word = np.repeat(word, n)
        where = (r["docs"][take].astype(np.int64) << 32) | r["places"][take]
        term, at = alone[word], where
        if len(runs) and len(word) >= RUN:
            # Phrases: places of known words that follow one another in a document.
            o = np.argsort(where, kind="stable")
            w, p = word[o], where[o]
            some = np.nonzero(np.logical_and.reduce([p[x : len(p) - RUN + 1 + x] == p[: len(p) - RUN + 1] + x for x in range(1, RUN)]))[0]
            h = _run_hash([w[some + x] for x in range(RUN)])
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            same = hashes[k] == h
            at, term = np.concatenate([at, p[some[same]]]), np.concatenate([term, runs[k[same]]])
        at, term = at[term >= 0], term[term >= 0]
        # Each posting meets the anchors of its term.
        k = size[term]
        row = np.repeat(np.arange(len(at)), k)
        a = begin[term][row] + (np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k))
        doc, pos = at[row] >> 32, at[row] & 0xFFFFFFFF
        off = pos - ipos[a]
        # Offsets that differ by up to DRIFT share at least one of two overlapping bins.
        both = np.concatenate([2 * (off // wide), 2 * ((off + DRIFT) // wide) + 1])
        doc, pos, a = np.tile(doc, 2), np.tile(pos, 2), np.tile(a, 2)
        o = np.lexsort((-weight[a], mark[a], both, item[a], doc))
        doc, pos, a, both = doc[o], pos[o], a[o], both[o]
        if not len(doc):
            return None
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (item[a[1:]] != item[a[:-1]]) | (both[1:] != both[:-1])
        once = new.copy()
        once[1:] |= mark[a[1:]] != mark[a[:-1]]
        first = np.nonzero(new)[0]
        enough = np.add.reduceat(np.where(once, weight[a], 0.0), first) >= LEAST_WEIGHT
        keep = np.repeat(enough, np.diff(np.append(first, len(doc))))
        doc, pos, a = doc[keep], pos[keep], a[keep]
        if not len(doc):
            return None
        pair = np.ones(len(doc), bool)
        pair[1:] = (doc[1:] != doc[:-1]) | (item[a[1:]] != item[a[:-1]])
        first = np.nonzero(pair)[0]
        offs = pa.array(np.append(first, len(doc)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offs, pa.array(x)) for x in (ipos[a].astype(np.int32), pos.astype(np.int32), in_run[a])]
        return pa.RecordBatch.from_arrays([pa.array(r["doc_ids"][doc[first]]), pa.array(item[a[first]]), *lists], ["doc_id", "item", "ipos", "place", "in_run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in _rows(b):
                if (out := segment(r)) is not None:
                    yield out

    return run


def _align(item_ids: list[int], item_lists: list[list[str]], gains: list[list[float]], least: int):
    """Over pages joined with their candidates: the words each carries of its items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(s, SEGMENT) for x in batches for s in range(0, x.num_rows, SEGMENT)):
            flat, off = _page_words(b)
            out = []
            for k, found in enumerate(b.column("found").to_pylist()):
                text = flat.slice(off[k], off[k + 1] - off[k]).to_pylist()
                for f in found:
                    hits: tuple[list, list] = ([], [])
                    for i, j, r in zip(f["ipos"], f["place"], f["in_run"]):
                        hits[r].append((i, j))
                    n = max(longest_run(item_lists[f["item"]], gains[f["item"]], text, x) for x in hits)
                    if n >= least:
                        out.append((item_ids[f["item"]], b.column("doc_id")[k].as_py(), n))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int32())], ["item_id", "doc_id", "n_words"])

    return run


def matches(documents: DataFrame, items: DataFrame, window: int = WINDOW, least: int | None = None) -> DataFrame:
    """(item_id, doc_id, n_words): each pair with the most consecutive words of the item on the page, window at least.

    Null and empty texts match nothing; repeated items and pages give equal rows, which are returned once.
    """
    pages = _pages(documents)
    index = positional_index(documents)
    its = materialise(item_words(items), "items")
    terms = materialise(its.select(F.explode("terms").alias("term")).distinct(), "terms")
    frequency = materialise(frequencies(index, terms), "frequencies")
    n_docs = index.agg(F.coalesce(F.sum(F.size("doc_ids")), F.lit(0))).first()[0]
    passes = max(1, -(-its.count() // ITEMS))
    found = []
    for k in range(passes):
        some = its.where(F.pmod("key", F.lit(passes)) == k)
        held = some.select("key", "item_id", "words", "terms").toArrow().to_pylist()
        picked = anchors(some, frequency, n_docs, window).toArrow()
        if not picked.num_rows:
            continue
        share = frequency.join(some.select(F.explode("terms").alias("term")).distinct(), "term", "left_semi").toArrow()
        share = dict(zip(share.column("term").to_pylist(), (x / n_docs for x in share.column("n").to_pylist())))
        gains = [[GAINS[0] if share.get(t, 0.0) <= RARE else GAINS[1] if share[t] <= SOME else GAINS[2] for t in r["terms"]] for r in held]
        numbers = {r["key"]: i for i, r in enumerate(held)}
        met = materialise(index.mapInArrow(_intersect(picked, numbers), _CANDIDATE), "candidates")
        per = materialise(met.groupBy("doc_id").agg(F.collect_list(F.struct("item", "ipos", "place", "in_run")).alias("found")), "found")
        # Pages without a candidate are left behind before any is sent on.
        with_found = pages.join(checked_broadcast(per.select("doc_id"), MOST_PAGES), "doc_id", "left_semi").join(per, "doc_id")
        found.append(with_found.mapInArrow(_align([r["item_id"] for r in held], [r["words"] for r in held], gains, least or window), "item_id long, doc_id long, n_words int"))
    if not found:
        return pages.select(F.col("doc_id").alias("item_id"), "doc_id", F.lit(0).alias("n_words")).where("false")
    return reduce(DataFrame.unionByName, found).groupBy("item_id", "doc_id").agg(F.max("n_words").alias("n_words"))

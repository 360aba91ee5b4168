"""Abusive, hateful or lewd sentences in pages: a convolutional text classifier in numpy.

Words are hashed into embedding rows; filters of several widths run over each
sentence, their maxima feed one logistic unit. A page scores as its worst
sentence. Labels are given for pages and some are wrong, so training alternates
between choosing the sentences that earn a page its label and fitting the
network to them. Decision thresholds are calibrated for each language on
labelled pages that training didn't see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.pages import joined, reading_order

BUCKETS = 1 << 15
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 6
#: Networks whose mean is the score; what one has learnt by chance the others haven't.
MEMBERS = 2
#: Shorter sentences are scraps of layout and score 0.
LEAST_WORDS = 4
#: Labelled pages used for training and calibration, at most; those with the least hashes are taken.
MOST_LABELS = 6000
#: Gradient steps of a training round, at least, and passes over the positives, at least.
STEPS = 700
EPOCHS = 4
ROUNDS = 3
BATCH = 64
SEED = 7
#: A threshold calibrated on k held-out abusive pages is drawn towards what holds without them as if by so many more pages:
#: that of a language towards that of all, and that of all towards UNSURE_CUT.
DRAWN = 10
UNSURE_CUT = 0.9


# ---- sentences -------------------------------------------------------------


def sentences(text, boxes=None) -> tuple[pa.Array, np.ndarray]:
    """Sentences in reading order, flat, and the row of each. Headlines (lines in capitals) are left out."""
    s = pc.replace_substring_regex(reading_order(text, boxes), r"(?m)^[^\p{Ll}\n]*\p{Lu}{2}[^\p{Ll}\n]*(\n|$)", "")
    s = joined(s)
    s = pc.replace_substring_regex(s, r"\b(Mr|Mrs|Dr|Rev|Co|St|Hon|Capt|Messrs)\.", r"\1")
    s = pc.replace_substring_regex(s, r"(\d+[sd])\.(\s+[\p{Ll}\d])", r"\1\2")
    s = pc.replace_substring_regex(s, r"([.!?][\"'”’)]*)\s+", "\\1\n")
    parts = pc.split_pattern(s, "\n")
    n = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    return pc.list_flatten(parts), np.repeat(np.arange(len(n)), n)


def hashed(flat: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each word, offsets of each sentence's words). Figures and unknown capitals aren't told apart."""
    s = pc.utf8_lower(pc.replace_substring_regex(flat, r"[^\pL\pN\s]+", ""))
    s = pc.replace_substring_regex(s, r"\d+", "0")
    s = pc.utf8_trim_whitespace(pc.replace_substring_regex(s, r"\s+", " "))
    parts = pc.split_pattern(s, " ")
    n = pc.list_value_length(parts).to_numpy(zero_copy_only=False)
    enc = pc.list_flatten(parts).dictionary_encode()
    code = pd.util.hash_array(enc.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False) % (BUCKETS - 1) if len(enc.dictionary) else np.zeros(0, np.uint64)
    return code.astype(np.int32)[enc.indices.to_numpy()], np.concatenate([[0], np.cumsum(n)])


# ---- network ---------------------------------------------------------------

PAD = BUCKETS - 1
REACH = max(WIDTHS) - 1


@dataclass
class Net:
    emb: np.ndarray  # BUCKETS x DIM, row PAD is zero
    conv: list[np.ndarray]  # for each width: width x DIM x FILTERS
    bias: list[np.ndarray]
    out: np.ndarray
    off: float

    @staticmethod
    def fresh(seed: int = SEED) -> "Net":
        g = np.random.default_rng(seed)
        emb = g.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
        emb[PAD] = 0
        return Net(emb, [g.normal(0, 1 / np.sqrt(DIM * w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32) for _ in WIDTHS], g.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), -2.0)

    def table(self) -> np.ndarray:
        """Every embedding row through every filter slice, side by side: convolution becomes look-ups and shifted sums."""
        return np.concatenate([self.emb @ c[o] for c in self.conv for o in range(len(c))], axis=1)


def padded(tok: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens with REACH pads after each sentence, the places of real tokens, and each sentence's first place among these.

    A sentence without words gets one pad as its word.
    """
    n = np.diff(off)
    m = np.maximum(n, 1)
    start = np.cumsum(m + REACH) - (m + REACH)
    out = np.full(int((m + REACH).sum()), PAD, np.int32)
    within = np.arange(int(n.sum())) - np.repeat(off[:-1] - off[0], n)
    out[np.repeat(start, n) + within] = tok[off[0] : off[-1]]
    first = np.cumsum(m) - m
    real = np.repeat(start, m) + (np.arange(int(m.sum())) - np.repeat(first, m))
    return out, real, first


def score(table: np.ndarray, net: Net, tok: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Probability of each sentence; `table` is net.table()."""
    if len(off) < 2:
        return np.zeros(0)
    pad, real, first = padded(tok, off)
    rows = table[pad]
    feats, k = [], 0
    for w, bias in zip(WIDTHS, net.bias):
        a = rows[: len(pad) - REACH, k : k + FILTERS].copy()
        for o in range(1, w):
            a += rows[o : len(pad) - REACH + o, k + o * FILTERS : k + (o + 1) * FILTERS]
        k += w * FILTERS
        feats.append(np.maximum(np.maximum.reduceat(a[real] + bias, first), 0))
    z = np.concatenate(feats, axis=1) @ net.out + net.off
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    p[np.diff(off) < LEAST_WORDS] = 0.0
    return p


def score_all(net: Net, tok: np.ndarray, off: np.ndarray, step: int = 4000) -> np.ndarray:
    """As `score`, so many sentences at a time: memory doesn't grow with their number."""
    table = net.table()
    return np.concatenate([np.zeros(0), *(score(table, net, tok, off[k : k + step + 1]) for k in range(0, len(off) - 1, step))])


def _step(net: Net, tok, off, y, w, state, lr):
    """One Adam step on a batch of sentences; only the windows that won a maximum carry gradient."""
    pad, real, first = padded(tok, off)
    rows = len(y)
    feats, arg = [], []
    seg = np.repeat(np.arange(rows), np.diff(np.append(first, len(real))))
    for c, bias in zip(net.conv, net.bias):
        a = np.zeros((len(real), FILTERS), np.float32)
        for o in range(len(c)):
            a += net.emb[pad[real + o]] @ c[o]
        a += bias
        top = np.maximum.reduceat(a, first)
        place = np.where(a == top[seg], np.arange(len(real))[:, None], len(real))
        arg.append(np.minimum.reduceat(place, first))
        feats.append(np.maximum(top, 0))
    h = np.concatenate(feats, axis=1)
    z = h @ net.out + net.off
    g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * w / rows).astype(np.float32)
    grads = {"out": h.T @ g + 1e-4 * net.out, "off": np.float32(g.sum())}
    dh = np.outer(g, net.out) * (h > 0)
    ids, dems = [], []
    for k, c in enumerate(net.conv):
        d = dh[:, k * FILTERS : (k + 1) * FILTERS]
        grads[f"b{k}"] = d.sum(axis=0)
        dc = np.zeros_like(c)
        for o in range(len(c)):
            t = pad[real[arg[k]] + o]  # rows x FILTERS
            dc[o] = np.einsum("rfd,rf->df", net.emb[t], d)
            ids.append(t.ravel())
            dems.append((d[:, :, None] * c[o].T[None, :, :]).reshape(-1, DIM))
        grads[f"c{k}"] = dc + 1e-4 * c
    ids, dems = np.concatenate(ids), np.concatenate(dems)
    live = np.abs(dems).sum(axis=1) > 0
    u, inv = np.unique(ids[live], return_inverse=True)
    ge = np.zeros((len(u), DIM), np.float32)
    for j in range(DIM):
        ge[:, j] = np.bincount(inv, dems[live][:, j], minlength=len(u))
    # Embedding rows: Adagrad on the rows met; dense parts: Adam.
    if len(u):
        state["e2"][u] += ge**2
        net.emb[u] -= lr * 3 * ge / (np.sqrt(state["e2"][u]) + 1e-6)
        net.emb[PAD] = 0
    state["t"] += 1
    for key, gr in grads.items():
        m, v = state.setdefault(key, [np.zeros_like(gr), np.zeros_like(gr)])
        m = state[key][0] = 0.9 * m + 0.1 * gr
        v = state[key][1] = 0.999 * v + 0.001 * gr**2
        move = lr * (m / (1 - 0.9 ** state["t"])) / (np.sqrt(v / (1 - 0.999 ** state["t"])) + 1e-8)
        if key == "out":
            net.out -= move.astype(np.float32)
        elif key == "off":
            net.off -= float(move)
        elif key[0] == "b":
            net.bias[int(key[1:])] -= move.astype(np.float32)
        else:
            net.conv[int(key[1:])] -= move.astype(np.float32)


def _fit(net: Net, tok, off, pos: np.ndarray, neg: np.ndarray, hard: np.ndarray, epochs: int, seed: int) -> Net:
    g = np.random.default_rng(seed)
    state = {"e2": np.full((BUCKETS, DIM), 1e-3, np.float32), "t": 0}
    lens = np.diff(off)
    many = min(len(neg), 12 * len(pos) + 2000) + len(pos)
    for _ in range(max(epochs, -(-STEPS * BATCH // max(1, many)))):
        # All positives, and so many negatives for each, drawn anew every epoch.
        some = neg if len(neg) <= 12 * len(pos) + 2000 else np.concatenate([hard, g.choice(neg, 12 * len(pos) + 2000, replace=False)])
        ids = np.concatenate([pos, some])
        y = np.concatenate([np.ones(len(pos)), np.zeros(len(some))])
        w = np.where(y == 1, min(8.0, max(1.0, len(some) / max(1, len(pos)) / 3)), 1.0)
        order = g.permutation(len(ids))
        for s in range(0, len(ids), BATCH):
            k = order[s : s + BATCH]
            b = ids[k]
            n = lens[b]
            flat = np.repeat(off[b] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            t = tok[flat]
            # Word drop-out stands in for misreadings and keeps names from being learnt.
            t = np.where(g.random(len(t)) < 0.15, PAD, t)
            _step(net, t, np.concatenate([[0], np.cumsum(n)]), y[k], w[k], state, 0.005)
    return net


def _grams(tok, off):
    """Hashed words and word pairs of each sentence: (gram, sentence)."""
    sent = np.repeat(np.arange(len(off) - 1), np.diff(off))
    two = tok[:-1].astype(np.int64) * 1_000_003 + tok[1:] + BUCKETS
    same = sent[:-1] == sent[1:]
    return np.concatenate([tok.astype(np.int64), two[same] % (1 << 40)]), np.concatenate([sent, sent[:-1][same]])


def _first_guess(tok, off, page, label) -> np.ndarray:
    """For each sentence, the sum of its grams' log odds by pages: what training starts from."""
    gram, sent = _grams(tok, off)
    u, inv = np.unique(gram, return_inverse=True)
    n_pages = len(label)
    key = np.unique(inv.astype(np.int64) * n_pages + page[sent])
    gi, pg = key // n_pages, key % n_pages
    a = np.bincount(gi, label[pg], minlength=len(u))
    b = np.bincount(gi, 1 - label[pg], minlength=len(u))
    odds = np.log((a + 0.3) / (label.sum() + 0.6)) - np.log((b + 0.3) / ((1 - label).sum() + 0.6))
    odds = np.where(a >= 2, np.clip(odds - 1, 0, 3), 0)
    return np.bincount(sent, odds[inv], minlength=len(off) - 1)


def train(tok: np.ndarray, off: np.ndarray, page: np.ndarray, label: np.ndarray, rounds: int = ROUNDS, epochs: int = EPOCHS, seed: int = SEED) -> Net:
    """Fit a network to pages' labels. page: the page of each sentence; label: of each page, 0 or 1."""
    net = Net.fresh(seed)
    if not label.sum() or label.all():
        return net
    s = _first_guess(tok, off, page, label)
    cut_neg = np.quantile(s[label[page] == 0], 0.999) if (label[page] == 0).any() else np.inf
    for r in range(rounds):
        best = np.full(len(label), -np.inf)
        np.maximum.at(best, page, s)
        is_best = s >= best[page]
        if r == 0:
            pos = np.nonzero((label[page] == 1) & is_best & (s > 0) & (np.diff(off) >= LEAST_WORDS))[0]
            neg = np.nonzero((label[page] == 0) & (s <= cut_neg))[0]
            hard = neg[:0]
        else:
            # Pages labelled abusive with no sentence near it, and the reverse, are taken for wrong labels.
            pos = np.nonzero((label[page] == 1) & ((s >= 0.6) | (is_best & (s >= 0.25))))[0]
            neg = np.nonzero((label[page] == 0) & (s < 0.97))[0]
            hard = neg[np.argsort(-s[neg], kind="stable")[: 2 * len(pos)]]
        if not len(pos):
            break
        net = _fit(Net.fresh(seed + r), tok, off, pos, neg, hard, epochs, seed + r)
        s = score_all(net, tok, off)
    return net


def page_scores(s: np.ndarray, page: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    np.maximum.at(out, page, s)
    return out


def best_threshold(s: np.ndarray, label: np.ndarray) -> float:
    """The cut with the best F1, in the middle of the gap it lies in."""
    if not label.sum():
        return 0.5
    order = np.argsort(-s, kind="stable")
    hit = np.cumsum(label[order])
    f1 = 2 * hit / (np.arange(1, len(s) + 1) + label.sum())
    k = int(np.argmax(f1))
    low = s[order[k + 1]] if k + 1 < len(s) else 0.0
    return float(np.clip((s[order[k]] + low) / 2, 0.05, 0.95))


def drawn(s: np.ndarray, label: np.ndarray, towards: float) -> float:
    """The best threshold of some pages, the fewer abusive among them the nearer to `towards`."""
    k = int(label.sum())
    return towards if not k else (k * best_threshold(s, label) + DRAWN * towards) / (k + DRAWN)


@dataclass
class Model:
    nets: list[Net]
    threshold: float
    by_language: dict[str, float]


def language(s) -> str:
    """The common form of a language tag; null, blank and "und" are one."""
    t = (s or "").strip().lower()
    return t if t and t != "und" else ""


def fit(pages: pa.Table) -> Model:
    """A model of labelled pages (text, line_boxes, lang, label); a fifth is held out for the thresholds."""
    label = np.asarray(pages.column("label").to_pylist(), int)
    flat, page = sentences(pages.column("text"), pages.column("line_boxes") if "line_boxes" in pages.column_names else None)
    tok, off = hashed(flat)
    held = np.arange(len(label)) % 5 == 4
    seen = _take(tok, off, page, ~held, label)
    nets = [train(*seen, seed=SEED + 100 * k) for k in range(MEMBERS)]
    s = page_scores(np.mean([score_all(n, tok, off) for n in nets], axis=0), page, len(label))
    common = drawn(s[held], label[held], UNSURE_CUT)
    langs = np.array([language(v) for v in pages.column("lang").to_pylist()], object)
    by = {k: drawn(s[held & (langs == k)], label[held & (langs == k)], common) for k in sorted(set(langs))}
    return Model(nets, common, by)


def _take(tok, off, page, keep, label):
    """The sentences of the kept pages, pages numbered anew."""
    sel = np.nonzero(keep[page])[0]
    n = np.diff(off)[sel]
    flat = np.repeat(off[sel] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    number = np.cumsum(keep) - 1
    return tok[flat], np.concatenate([[0], np.cumsum(n)]), number[page[sel]], label[keep]


# ---- pages -----------------------------------------------------------------


def labelled(documents: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> pa.Table:
    """At most `most` labelled pages; several labels of a page are averaged, ties count as abusive."""
    y = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg((F.avg(F.col("label").cast("double")) >= 0.5).cast("int").alias("label"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    docs = documents.select([c for c in ("doc_id", "text", "line_boxes") if c in documents.columns] + [F.col("lang") if "lang" in documents.columns else F.lit(None).cast("string").alias("lang")])
    return docs.join(F.broadcast(y), "doc_id").toArrow().sort_by("doc_id")  # `most` pages at most


def scores(documents: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, source, lang, score, flagged) of every page. Null and empty texts score 0."""
    model = model or fit(labelled(documents, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [n.table() for n in model.nets]
        for b in batches:
            for s0 in range(0, b.num_rows, 300):
                c = b.slice(s0, 300)
                flat, page = sentences(c.column("text"), c.column("line_boxes") if "line_boxes" in c.schema.names else None)
                words = hashed(flat)
                s = page_scores(np.mean([score(t, n, *words) for t, n in zip(tables, model.nets)], axis=0), page, c.num_rows)
                s[pc.fill_null(pc.equal(pc.utf8_length(c.column("text")), 0), True).to_numpy(zero_copy_only=False)] = 0.0
                cut = np.array([model.by_language.get(language(v), model.threshold) for v in c.column("lang").to_pylist()])
                yield pa.RecordBatch.from_arrays([c.column("doc_id").cast(pa.int64()), c.column("source").cast(pa.string()), c.column("lang").cast(pa.string()), pa.array(np.round(s, 6)), pa.array(s >= cut)], ["doc_id", "source", "lang", "score", "flagged"])

    cols = [c for c in ("doc_id", "source", "lang", "text", "line_boxes") if c in documents.columns]
    return documents.select(cols).mapInArrow(run, "doc_id long, source string, lang string, score double, flagged boolean")


def rates(scored: DataFrame) -> DataFrame:
    """(source, n_pages, n_flagged, rate, mean_score) by source."""
    return scored.groupBy("source").agg(F.count("*").alias("n_pages"), F.sum(F.col("flagged").cast("long")).alias("n_flagged"), F.round(F.avg(F.col("flagged").cast("double")), 6).alias("rate"), F.round(F.avg("score"), 6).alias("mean_score"))

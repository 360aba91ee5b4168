"""Texts cut off by field limits or in transfer.

1. Limits. Per source and column, histograms of lengths in characters and in bytes are
   searched for a spike at the maximum (and, for limits raised since, below it). Values at a
   spike's length without terminal punctuation are suspects.
2. Transfers break off at any length: values elsewhere without terminal punctuation, and
   those ending in a mark of omission, are suspects of the second stage.
3. Suspects of either stage are checked: a text is acquitted if texts of the whole corpus
   end their sentences the way it ends. The last words, names and figures masked, are
   looked up in counts of how often that context closes a sentence and how often one goes on.
   An ending the corpus doesn't know convicts at a spike, and elsewhere if its last word is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.runtime import checked_broadcast, materialise

#: A spike: at least LEAST values of the greatest length, and TIMES as many as a length just below it has on average.
LEAST = 3
LEAST_INSIDE = 10
TIMES = 4.0
BELOW = 25
#: A context (the last words, as many of DEPTH as the corpus has met twice) closes a sentence if it does so at least this often,
#: and with punctuation at least so often against every time it ends a text without: cut words may now and then be
#: followed by a stop, but far more often they are the text's bare end.
CLOSES = 0.2
STOPPED = 0.5
DEPTH = 5
#: A context that more than 1/HOT of the suspects' questions ask for is looked up by broadcast; there can't be more than HOT of them.
HOT = 512
#: Cut words are looked up by broadcast up to so many (some 10 MB), beyond by a shuffled join.
MOST_ODD = 100_000
#: Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ["no.", "nos.", "approx.", "incl.", "ref.", "st.", "co.", "dr.", "mr.", "mrs."]
#: What stands for an omitted rest.
MARKED = r"(?:…|\.\.\.|\[|\x{FFFD}|[\pL\pN][-–—])$"


def source_name(c: Column) -> Column:
    """Sources are compared trimmed and in lower case; null and blank are one, the empty name."""
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


# ---- masked words ----------------------------------------------------------


def _np(a) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False)


def _hash(words) -> np.ndarray:
    return pd.util.hash_array(np.asarray(words, object), categorize=False) if len(words) else np.zeros(0, np.uint64)


#: Hashes that stand for a name and for what precedes a text.
NAME, EDGE = (int(h) for h in _hash(["\x00name", "\x00edge"]))


class _Masked:
    """Words of a batch of texts, flat, as hashes: names and figures masked, with where sentences end and start.

    All string work is done once for each distinct word of the batch.
    """

    def __init__(self, text: pa.Array):
        s = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.fill_null(text.cast(pa.string()), ""), r"\s+", " "))
        self.marker = _np(pc.match_substring_regex(s, MARKED))
        s = pc.replace_substring_regex(s, r"[\s…\[\x{FFFD}–—-]+$", "")
        self.blank = _np(pc.equal(pc.utf8_length(s), 0))
        parts = pc.split_pattern(s, " ")
        self.n = _np(pc.list_value_length(parts)).astype(np.int64)
        self.last = np.cumsum(self.n) - 1
        enc = pc.list_flatten(parts).dictionary_encode()
        self.code, u = enc.indices.to_numpy(), enc.dictionary
        raw = pc.utf8_lower(u)
        self.words = pc.replace_substring_regex(raw, r"^[^\pL\pN]+|[^\pL\pN]+$", "")
        row = np.repeat(np.arange(len(self.n)), self.n)
        pick = lambda a: _np(a)[self.code]
        self.stop = pick(pc.match_substring_regex(u, r"[.!?][\"')\]]*$")) & ~pick(pc.is_in(raw, value_set=pa.array(ABBREVIATIONS)))
        cap = pick(pc.match_substring_regex(u, r"^[^\pL\pN]*\p{Lu}"))
        opens = cap | pick(pc.match_substring_regex(u, r"^[^\pL\pN]*\d"))
        lower = _np(pc.match_substring_regex(s, r"\p{Ll}"))[row]
        self.is_last = np.zeros(len(row), bool)
        self.is_last[self.last] = True
        nxt = np.ones(len(row), bool)
        nxt[:-1] = opens[1:]
        self.ended = self.stop & (self.is_last | nxt)
        self.start = np.zeros(len(row), bool)
        self.start[np.cumsum(self.n) - self.n] = True
        self.start[1:] |= self.ended[:-1]
        self.low = _hash(_np(self.words))[self.code]
        self.mask = _hash(_np(pc.replace_substring_regex(self.words, r"\d+(?:[.,/]\d+)*", "#")))[self.code]
        self.mask[cap & ~self.start & lower] = NAME
        self.place = np.arange(len(row)) - np.repeat(self.last - self.n + 1, self.n)

    def back(self, k: int) -> np.ndarray:
        """Each word's k-th predecessor."""
        out = np.full(len(self.mask), EDGE, np.uint64)
        ok = np.nonzero(self.place >= k)[0]
        out[ok] = self.mask[ok - k]
        return out


def _context(words: list[np.ndarray]) -> np.ndarray:
    """One number for a run of words given from the last to the first."""
    h = np.full(len(words[0]), len(words), np.uint64)
    with np.errstate(over="ignore"):
        for w in words:
            h = (h ^ w) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def _merged(ctx, n, e, cut, prev, word):
    """Counts of equal contexts added up."""
    u, at, inv = np.unique(ctx, return_index=True, return_inverse=True)
    return u, *(np.bincount(inv, v, minlength=len(u)).astype(np.int64) for v in (n, e, cut)), prev[at], word[at]


#: Contexts a partition holds before it adds up equal ones.
HELD = 3_000_000
_STATS = "ctx long, n long, n_end long, n_bare long, prev long, word string"


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map-side counts of contexts, one row for each of a partition's: n times in all, n_end of them closing a sentence, and n_bare
    times more as the end of a text without a stop, which says nothing by itself.

    Contexts of two words carry the first's hash and the second's text, by which cut words are recognised.
    """
    held: list[tuple] = []
    for whole in batches:
        for s in range(0, whole.num_rows, 5000):
            m = _Masked(whole.slice(s, 5000).column("text"))
            bare = (m.is_last & ~m.ended).astype(float)
            end, run = m.ended.astype(float), []
            strings = _np(m.words).astype(object)
            for k in range(DEPTH):
                run.append(m.mask if k == 0 else m.back(k))
                c, at, inv = np.unique(_context(run), return_index=True, return_inverse=True)
                two = k == 1
                held.append((c, np.bincount(inv, 1 - bare), np.bincount(inv, end), np.bincount(inv, bare), run[1][at] if two else np.zeros(len(c), np.uint64), strings[m.code[at]] if two else np.full(len(c), None, object)))
            c, inv = np.unique(_context([m.low, np.full(len(m.low), EDGE, np.uint64)]), return_inverse=True)
            held.append((c, np.bincount(inv, 1 - bare), np.bincount(inv, m.start * (1 - bare)), np.zeros(len(c)), np.zeros(len(c), np.uint64), np.full(len(c), None, object)))
            if sum(len(h[0]) for h in held) > HELD:
                held = [_merged(*(np.concatenate(x) for x in zip(*held)))]
    if held:
        c, n, e, cut, prev, word = _merged(*(np.concatenate(x) for x in zip(*held)))
        for s in range(0, len(c), 100_000):
            t = slice(s, s + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(c[t].astype(np.int64)), pa.array(n[t]), pa.array(e[t]), pa.array(cut[t]), pa.array(prev[t].astype(np.int64)), pa.array(word[t], pa.string())], ["ctx", "n", "n_end", "n_bare", "prev", "word"])


_SUSPECT = "key string, source string, n_chars int, n_bytes int, marker boolean, after_stop boolean, c1 long, c2 long, c3 long, c4 long, c5 long, w2 long, w3 long, w4 long, s long, prev long, word string"


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that don't end in terminal punctuation, or end in a mark of omission, with the contexts to look up."""
    for b in batches:
        m = _Masked(b.column("text"))
        # A stop counts at the text's end whatever follows; a marker overrides it.
        at = np.nonzero(~m.blank & (~m.stop[m.last] | m.marker))[0]
        e = m.last[at]
        one, two, three, four, five = ((m.mask if k == 0 else m.back(k))[e] for k in range(DEPTH))
        after = (m.n[at] > 1) & m.ended[np.maximum(e - 1, 0)]
        take = pa.array(at)
        asked = ([one], [one, two], [one, two, three], [one, two, three, four], [one, two, three, four, five], [two, one], [two, one, three], [two, one, three, four], [m.low[e], np.full(len(e), EDGE, np.uint64)])
        cols = [b.column(c).take(take) for c in ("key", "source", "n_chars", "n_bytes")] + [
            pa.array(m.marker[at]), pa.array(after), *(pa.array(_context(w).astype(np.int64)) for w in asked),
            pa.array(two.astype(np.int64)), m.words.take(pa.array(m.code[e])),
        ]
        yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in _SUSPECT.split(", ")])


# ---- the operator ----------------------------------------------------------


def measured(df: DataFrame, key: str, source: str, column: str) -> DataFrame:
    """(key, source, text, n_chars, n_bytes) of rows with a key and a text that isn't blank; rows that repeat one stay, as texts aren't shuffled."""
    t = df.select(F.col(key).cast("string").alias("key"), source_name(F.col(source)).alias("source"), F.col(column).alias("text")).where("key IS NOT NULL AND trim(text) <> ''")
    return t.withColumn("n_chars", F.char_length("text")).withColumn("n_bytes", F.octet_length("text"))


def lengths(texts: DataFrame) -> DataFrame:
    """The distinct (key, source, n_chars, n_bytes): a text delivered again counts once."""
    return texts.select("key", "source", "n_chars", "n_bytes").distinct()


def spikes(texts: DataFrame) -> DataFrame:
    """(source, measure, length, n_at, n_near, at_top): lengths that values of a source pile up at. measure is chars or bytes.

    A limit shows at the maximum; one that was raised since shows below it, where
    more is asked of a spike. n_near counts the values up to BELOW shorter or longer.
    """
    hist = lengths(texts).select("source", F.explode(F.array(F.struct(F.lit("chars").alias("measure"), F.col("n_chars").alias("length")), F.struct(F.lit("bytes").alias("measure"), F.col("n_bytes").alias("length")))).alias("h"))
    hist = hist.groupBy("source", "h.measure", "h.length").agg(F.count("*").alias("n_at"))
    # The histogram has a row for each length a source's values have, so its windows are small.
    near = Window.partitionBy("source", "measure").orderBy("length").rangeBetween(-BELOW, BELOW)
    w = Window.partitionBy("source", "measure")
    h = hist.withColumn("n_near", F.sum("n_at").over(near) - F.col("n_at")).withColumn("at_top", F.col("length") == F.max("length").over(w))
    mean = F.col("n_near") / F.when(F.col("at_top"), F.lit(BELOW)).otherwise(F.lit(2 * BELOW))
    return h.where((F.col("n_at") >= TIMES * mean) & (F.col("n_at") >= F.when(F.col("at_top"), LEAST).otherwise(LEAST_INSIDE))).select("source", "measure", "length", "n_at", "n_near", "at_top")


def _rate(slot: str) -> Column:
    return F.try_divide(F.col(f"{slot}.e"), F.col(f"{slot}.n"))


def _answers(suspects: DataFrame, stats: DataFrame, slots: list[str]) -> DataFrame:
    """(key, source, word, *slots): what the corpus knows of each suspect's contexts, as struct(n, e, bare).

    Suspects that end alike ask for the same contexts; those many ask for are split off and broadcast.
    """
    asked = suspects.select(F.explode(F.array(*slots)).alias("ctx")).groupBy("ctx").agg(F.count("*").alias("asked"))
    known = materialise(stats.select("ctx", "n", "n_end", "n_bare").join(asked, "ctx"), "known")
    total = F.lit(len(slots)) * suspects.count()
    hot, rest = F.broadcast(known.where(F.col("asked") * HOT > total)), known.where(F.col("asked") * HOT <= total)
    ways = suspects.select("key", "source", "word", F.explode(F.array(*(F.struct(F.lit(k).alias("slot"), F.col(k).alias("ctx")) for k in slots))).alias("q")).select("key", "source", "word", "q.slot", "q.ctx")
    met = ways.join(hot, "ctx").unionByName(ways.join(hot.select("ctx"), "ctx", "left_anti").join(rest, "ctx"))
    return met.groupBy("key", "source", "word").agg(*(F.max(F.when(F.col("slot") == k, F.struct(F.col("n").alias("n"), F.col("n_end").alias("e"), F.col("n_bare").alias("bare")))).alias(k) for k in slots))


def judged(texts: DataFrame) -> DataFrame:
    """(key, source, at_spike, marker, truncated) of all suspects; texts that end in terminal punctuation aren't listed.

    at_spike tells the suspects of the length histograms from those of the second stage.
    """
    cols = texts.select("key", "source", "text", "n_chars", "n_bytes")
    stats = materialise(cols.mapInArrow(_stats, _STATS).groupBy("ctx").agg(F.sum("n").alias("n"), F.sum("n_end").alias("n_end"), F.sum("n_bare").alias("n_bare"), F.max("prev").alias("prev"), F.max("word").alias("word")), "contexts")
    suspects = materialise(cols.mapInArrow(_suspects, _SUSPECT), "suspects")
    got = _answers(suspects, stats, ["c1", "c2", "c3", "c4", "c5", "w2", "w3", "w4", "s"])
    x = suspects.select("key", "source", "n_chars", "n_bytes", "marker", "after_stop", "prev", "word").join(got, ["key", "source", "word"], "left")
    # A last word the corpus doesn't have: cut if it begins a word that follows the same predecessor, else misspelt.
    # Words that follow meet it under their beginnings, so no pair is made that doesn't agree.
    odd = materialise(x.where("c1 IS NULL OR c1.n < 2").select("prev", "word").distinct(), "odd")
    begins = F.transform(F.sequence(F.lit(0), F.length("word") - 1), lambda k: F.substring(F.col("word"), F.lit(1), k))
    follow = stats.where("word IS NOT NULL AND n >= 2 AND length(word) > 0").select("prev", F.explode(begins).alias("word"))
    cut = checked_broadcast(odd, MOST_ODD)
    cut = (follow.join(cut, ["prev", "word"], "left_semi")).distinct().withColumn("begins", F.lit(True))
    x = x.join(cut, ["prev", "word"], "left")
    sp = spikes(texts)
    for m in ("chars", "bytes"):
        at = sp.where(F.col("measure") == m).select("source", F.col("length").alias(f"n_{m}"), F.lit(True).alias(f"spike_{m}"))
        x = x.join(at, ["source", f"n_{m}"], "left")
    spike = F.coalesce("spike_chars", F.lit(False)) | F.coalesce("spike_bytes", F.lit(False))
    seen = lambda k: F.coalesce(F.col(f"{k}.n") >= 2, F.lit(False))
    closes = lambda k: seen(k) & F.coalesce((_rate(k) >= CLOSES) & (F.col(f"{k}.e") >= STOPPED * F.col(f"{k}.bare")), F.lit(False))
    longest = lambda *ks: reduce(lambda w, k: w.when(seen(k), closes(k)), ks[1:], F.when(seen(ks[0]), closes(ks[0])))
    swapped = F.coalesce(longest("w4", "w3", "w2"), F.lit(False))
    plain = longest("c5", "c4", "c3", "c2", "c1")
    whole = (
        F.when(F.col("marker"), False)
        # One word behind a finished sentence: the start of the next, or the last two words changed places.
        .when(F.col("after_stop"), ~closes("s") & swapped)
        .when(swapped & ~F.coalesce(plain, F.lit(False)), True)
        .when(seen("c1") | seen("c2"), F.coalesce(plain, F.lit(False)))
        .otherwise(~F.coalesce(F.col("begins"), F.lit(False)) & ~spike)
    )
    return x.select("key", "source", spike.alias("at_spike"), "marker", (~whole).alias("truncated")).distinct()


def stages(texts: DataFrame) -> DataFrame:
    """(source, stage, n_suspects, n_truncated): what the length histograms ("limit") and the second stage ("transfer") suspect and, after the check, find."""
    stage = F.when(F.col("at_spike"), "limit").otherwise("transfer").alias("stage")
    return judged(texts).groupBy("source", stage).agg(F.count("*").alias("n_suspects"), F.sum(F.col("truncated").cast("long")).alias("n_truncated"))


def found(texts: DataFrame) -> DataFrame:
    """Keys of the truncated texts. Null, empty and blank texts are no case; a key with several texts is one if any is."""
    return judged(texts).where("truncated").select("key").distinct()


def rates(texts: DataFrame) -> DataFrame:
    """(source, n_texts, n_truncated, n_at_spike, limit_chars, rate) by source; limit_chars is the shortest length with a spike."""
    bad = judged(texts).groupBy("source").agg(F.sum(F.col("truncated").cast("long")).alias("n_truncated"), F.sum((F.col("truncated") & F.col("at_spike")).cast("long")).alias("n_at_spike"))
    limit = spikes(texts).where("measure = 'chars'").groupBy("source").agg(F.min("length").alias("limit_chars"))
    out = lengths(texts).groupBy("source").agg(F.count("*").alias("n_texts")).join(bad, "source", "left").join(limit, "source", "left")
    z = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("source", "n_texts", z("n_truncated"), z("n_at_spike"), "limit_chars", F.round(F.coalesce(F.col("n_truncated"), F.lit(0)) / F.col("n_texts"), 6).alias("rate"))

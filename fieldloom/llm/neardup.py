"""Near-duplicate texts with small edits, by a signature-coordinate inverted join.

A text is its bag of words. Its signature has a number of coordinates, each made
of the least hashes over the bag's words under several seeds (`shape`). All words
weigh alike, so what a pair is expected to agree in hangs on its similarity only,
not on how frequent its words are or how large its group. Texts are posted under
each (coordinate, value). Two that agree in at least MATCHES of n coordinates share
one of the first n - MATCHES + 1, so only this prefix is posted and merged; the other
coordinates are skipped and looked up for the pairs found. Postings carry the
bag's size and the parities of its words' counts in PARITIES classes, which bound how
many words a pair can share: what can't be similar enough is passed over while merging.
Pairs with enough matches are decided exactly by their bags.

Texts with the same bag are one class throughout: links are found between
classes, and copies are only expanded where all pairs are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.runtime import checked_broadcast, materialise

SIMILARITY = 0.88
MATCHES = 2
#: Coordinates that a pair just at the required similarity is expected to agree in: 99.3 % of such pairs have MATCHES = 2.
AGREEING = 7.0
SEED = 11
#: Texts of candidate pairs are picked out by a broadcast of their keys up to this number (some 20 MB), beyond by a shuffled join.
MOST_KEYS = 150_000
#: Words are told into so many classes for their parities; a bag's size takes the other bits of 64, and a larger one says nothing.
PARITIES = 54
MOST_WORDS = (1 << (64 - PARITIES)) - 1
#: Bytes of text signed at a time, and distinct words hashed at a time.
SLICE = 2 << 20
DISTINCT = 30_000
#: Posting lists are measured on one class in SAMPLED; those longer than about LONG are cut into blocks that are merged
#: pair by pair in tasks of their own. This only spreads the work, and never changes a result.
SAMPLED = 64
LONG = 4096
MOST_LONG = 200_000


def _bags(b: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, class ids, offsets, tokens) of the texts that have words.

    A token is the 64-bit hash of (word, how-manieth occurrence), so a bag has each
    once; a class id is the hash of the whole bag.
    """
    s = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(b.column("text").cast(pa.string()), "")), r"[^\pL\pN]+", " ")
    s = pc.utf8_trim_whitespace(s)
    full = pc.greater(pc.utf8_length(s), 0)
    s, key = s.filter(full), b.column("key").filter(full)
    parts = pc.split_pattern(s, " ")
    n = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    enc = pc.list_flatten(parts).dictionary_encode()
    h = pd.util.hash_array(enc.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(enc.dictionary) else np.zeros(0, np.uint64)
    w = h[enc.indices.to_numpy()]
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((w, row))
    w, row = w[order], row[order]
    first = np.ones(len(w), bool)
    first[1:] = (w[1:] != w[:-1]) | (row[1:] != row[:-1])
    start = np.maximum.accumulate(np.where(first, np.arange(len(w)), 0))
    nth = (np.arange(len(w)) - start).astype(np.uint64)
    with np.errstate(over="ignore"):
        token = _mix(w + nth * np.uint64(0x9E3779B97F4A7C15))
        off = np.concatenate([[0], np.cumsum(n)])
        whole = _mix(np.add.reduceat(_mix(token), off[:-1]) + n.astype(np.uint64)) if len(n) else np.zeros(0, np.uint64)
    return key, whole.astype(np.int64), off, token


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: every bit of the result hangs on every bit of x."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _full_bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in (x for whole in batches for x in _slices(whole)):
        _, cls, off, token = _bags(b)
        yield pa.RecordBatch.from_arrays([pa.array(cls), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(token.astype(np.int64)))], ["class_id", "bag"])


def shape(n: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """(coordinates, hashes in each) for n texts.

    One hash more for every eightfold growth thins chance agreement. Bags that share
    `similarity` agree in a hash with a chance of s / (2 - s) at least, so AGREEING
    coordinates are expected to agree at every width.
    """
    width = 6
    while n > 400_000:
        n, width = n // 8, width + 1
    return int(np.ceil(AGREEING / (similarity / (2 - similarity)) ** width)), width


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about SLICE bytes of text, one row at least."""
    size = pc.fill_null(pc.binary_length(b.column("text").cast(pa.string())), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(size, dtype=np.int64) // SLICE
    first = np.concatenate([[0], np.nonzero(run[1:] != run[:-1])[0] + 1, [len(run)]]) if len(run) else [0]
    for s, e in zip(first[:-1], first[1:]):
        yield b.slice(int(s), int(e - s))


def _least(token: np.ndarray, off: np.ndarray, salts: np.ndarray) -> np.ndarray:
    """(texts, salts): the least hash of each text's tokens under each salt. Distinct tokens are hashed once, DISTINCT at a time."""
    out = np.full((len(off) - 1, len(salts)), np.iinfo(np.uint32).max, np.uint32)
    u, inv = np.unique(token, return_inverse=True)
    if len(u) <= DISTINCT:
        table = (_mix(u[:, None] ^ salts[None, :]) >> np.uint64(32)).astype(np.uint32)
        # A text at a time stays in the processor's cache.
        for k in range(len(out)):
            np.minimum.reduce(table[inv[off[k] : off[k + 1]]], axis=0, out=out[k])
        return out
    for k in range(len(out)):
        for s in range(off[k], off[k + 1], DISTINCT):
            t = _mix(token[s : min(s + DISTINCT, off[k + 1]), None] ^ salts[None, :]) >> np.uint64(32)
            np.minimum(out[k], t.min(axis=0).astype(np.uint32), out=out[k])
    return out


def _signatures(coordinates: int, width: int, seed: int):
    """(key, class_id, words, sig): minimum hashing. `words` holds the bag's size above the parities of its words' classes."""
    salts = _mix(np.arange(1, coordinates * width + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _slices(batch):
                key, cls, off, token = _bags(b)
                if not len(cls):
                    continue
                least = _least(token, off, salts).astype(np.uint64)
                value = np.broadcast_to(np.arange(coordinates, dtype=np.uint64)[None, :], (len(cls), coordinates))
                for k in range(width):
                    value = _mix(value ^ least[:, k::width])
                odd = np.bitwise_xor.reduceat(np.uint64(1) << (token % np.uint64(PARITIES)), off[:-1])
                words = (np.minimum(np.diff(off), MOST_WORDS).astype(np.uint64) << np.uint64(PARITIES)) | odd
                sig = pa.ListArray.from_arrays(pa.array(np.arange(0, len(cls) * coordinates + 1, coordinates, dtype=np.int32)), pa.array((value >> np.uint64(32)).astype(np.uint32).view(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([key, pa.array(cls), pa.array(words.view(np.int64)), sig], ["key", "class_id", "words", "sig"])

    return run


def signed(texts: DataFrame, seed: int = SEED, similarity: float = SIMILARITY) -> DataFrame:
    """(key, class_id, words, sig) of all texts with words, written once."""
    return materialise(texts.mapInArrow(_signatures(*shape(texts.count(), similarity), seed), "key string, class_id long, words long, sig array<int>"), "signatures")


def keyed(texts: DataFrame) -> DataFrame:
    return texts.select(F.col("key").cast("string").alias("key"), "text").where("key IS NOT NULL AND text IS NOT NULL")


def representatives(signs: DataFrame) -> DataFrame:
    """(class_id, rep, words, sig): one row for each class. Only signatures of classes with several rows are shuffled."""
    several = materialise(signs.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select("class_id"), "several")
    several = checked_broadcast(several, MOST_KEYS)
    one = signs.join(several, "class_id", "left_anti").select("class_id", F.col("key").alias("rep"), "words", "sig")
    more = signs.join(several, "class_id", "left_semi").groupBy("class_id").agg(F.min("key").alias("rep"), F.min("words").alias("words"), F.min_by("sig", "key").alias("sig"))
    return one.unionByName(more)


def _may_share(a: Column, b: Column, similarity: float) -> Column:
    """Whether bags may be similar enough by their `words`: those in one only are at most (1 - similarity) of both sizes' sum."""
    mask = F.lit((1 << PARITIES) - 1)
    na, nb = F.shiftrightunsigned(a, PARITIES), F.shiftrightunsigned(b, PARITIES)
    most = (1.0 - similarity) * (na + nb) + 1e-9
    unequal = F.greatest(F.bit_count(a.bitwiseXOR(b).bitwiseAND(mask)), F.abs(na - nb))
    return (unequal <= most) | (na == MOST_WORDS) | (nb == MOST_WORDS)


def _postings(reps: DataFrame, prefix: int) -> tuple[DataFrame, DataFrame]:
    """(post, i, j, class_a, words_a) and (post, i, j, class_b, words_b): what is merged. Blocks i <= j of a long list meet under (i, j)."""
    at = lambda df: df.select("class_id", "words", F.posexplode(F.slice("sig", 1, prefix)).alias("c", "v")).select("class_id", "words", (F.col("c").cast("long") * F.lit(1 << 32) + F.col("v")).alias("post"))
    posts = at(reps)
    some = at(reps.where(F.pmod("class_id", F.lit(SAMPLED)) == 0)).groupBy("post").agg(F.count("*").alias("n"))
    long = materialise(some.where(F.col("n") * SAMPLED > LONG).select("post", F.ceil(F.col("n") * SAMPLED / LONG).cast("int").alias("blocks")), "long")
    if not long.isEmpty():
        posts = posts.join(checked_broadcast(long, MOST_LONG), "post", "left")
        own = F.pmod(F.col("class_id"), F.coalesce("blocks", F.lit(1))).cast("int")
        last = F.coalesce("blocks", F.lit(1)) - 1
        a = posts.withColumn("i", own).withColumn("j", F.explode(F.sequence("i", last)))
        b = posts.withColumn("j", own).withColumn("i", F.explode(F.sequence(F.lit(0), "j")))
    else:
        a = b = posts.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    return tuple(df.select("post", "i", "j", F.col("class_id").alias(f"class_{x}"), F.col("words").alias(f"words_{x}")) for df, x in ((a, "a"), (b, "b")))


def class_links(texts: DataFrame, signs: DataFrame, similarity: float = SIMILARITY, matches: int = MATCHES) -> DataFrame:
    """(class_a, class_b, similarity), class_a < class_b: pairs of different bags that share enough of their words."""
    first = signs.select(F.size("sig").alias("n")).first()
    coordinates = first.n if first else matches
    reps = representatives(signs)
    prefix = coordinates - matches + 1
    a, b = _postings(reps, prefix)
    # Within one block each pair meets in both orders and is taken in one; across blocks it meets once.
    meet = ((F.col("i") < F.col("j")) | (F.col("class_a") < F.col("class_b"))) & _may_share(F.col("words_a"), F.col("words_b"), similarity)
    met = a.join(b, ["post", "i", "j"]).where(meet).select(F.least("class_a", "class_b").alias("class_a"), F.greatest("class_a", "class_b").alias("class_b"))
    met = materialise(met.groupBy("class_a", "class_b").agg(F.count("*").cast("int").alias("k")), "met")
    # The skipped coordinates can add matches - 1 at most, and are looked up only for pairs they may lift.
    short = met.where(F.col("k") >= matches).select("class_a", "class_b")
    if matches > 1:
        sa, sb = (reps.select(F.col("class_id").alias(f"class_{x}"), F.slice("sig", prefix + 1, matches - 1).alias(f"rest_{x}")) for x in "ab")
        more = F.aggregate(F.zip_with("rest_a", "rest_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        short = short.unionByName(met.where(F.col("k") < matches).join(sa, "class_a").join(sb, "class_b").where(F.col("k") + more >= matches).select("class_a", "class_b"))
    short = materialise(short, "candidates")
    ends = short.select(F.col("class_a").alias("class_id")).unionByName(short.select(F.col("class_b").alias("class_id"))).distinct()
    keys = reps.select("class_id", F.col("rep").alias("key")).join(ends, "class_id", "left_semi").select("key")
    keys = checked_broadcast(materialise(keys, "keys"), MOST_KEYS)
    full = materialise(texts.join(keys, "key", "left_semi").mapInArrow(_full_bags, "class_id long, bag array<long>").dropDuplicates(["class_id"]), "bags")
    ra, rb = (full.select(F.col("class_id").alias(f"class_{x}"), F.col("bag").alias(f"bag_{x}")) for x in "ab")
    both = short.join(ra, "class_a").join(rb, "class_b")
    # A bag's tokens are distinct, so the intersection counts shared words with repetition.
    alike = 2.0 * F.size(F.array_intersect("bag_a", "bag_b")) / (F.size("bag_a") + F.size("bag_b"))
    return both.select("class_a", "class_b", alike.alias("similarity")).where(F.col("similarity") >= similarity - 1e-12)


def pairs(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(key_a, key_b), key_a < key_b: every pair of keys whose texts are alike, copies expanded.

    Null, empty and wordless texts are like nothing; a key with several texts is
    paired by any of them; repeated rows count once.
    """
    texts = keyed(texts)
    signs = signed(texts, similarity=similarity)
    members = signs.select("key", "class_id").distinct()
    links = class_links(texts, signs, similarity)
    a, b = members.select(F.col("key").alias("x"), F.col("class_id").alias("class_a")), members.select(F.col("key").alias("y"), F.col("class_id").alias("class_b"))
    across = links.join(a, "class_a").join(b, "class_b").where("x <> y")
    within = a.join(b, F.col("class_a") == F.col("class_b")).where("x < y")
    return across.select("x", "y").unionByName(within.select("x", "y")).select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def with_links(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(key, class_id, class_size, n_links): one row for each key and its text's class, named by its least key; links are other classes that are alike."""
    texts = keyed(texts)
    signs = signed(texts, similarity=similarity)
    members = signs.select("key", F.col("class_id").alias("c")).distinct()
    links = class_links(texts, signs, similarity)
    ends = links.select(F.col("class_a").alias("c")).unionByName(links.select(F.col("class_b").alias("c")))
    per = members.groupBy("c").agg(F.min("key").alias("class_id"), F.count("*").alias("class_size")).join(ends.groupBy("c").agg(F.count("*").alias("n")), "c", "left")
    return members.join(per, "c").select("key", "class_id", "class_size", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))

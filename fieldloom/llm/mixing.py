"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Every page is measured in tokens of a public tokenizer. Each source's pages are
put into a seeded order and cut into blocks of equal tokens, a whole number of them, so
that every page is in one; a source's blocks are at most so much larger than the common size
as its rest asks for. Seats are then given to sources by highest quotients (target share
over the source's block size and 2 k + 1), which gives whole quotas for every output
shard, and each source fills its seats with blocks in an order that starts at a seeded
place. A block is used again only after all others.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.runtime import materialise

#: Where the public vocabulary files lie; a parameter of `measured`.
TOKENIZERS = os.environ.get("FIELDLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How the vocabulary's texts are split before merging. A fixed value.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Blocks in all, at most: what the driver apportions and every executor may receive.
MOST_BLOCKS = 32_768
#: Tokens of a block, at least.
LEAST_BLOCK = 1024
SHARDS = 16
SEED = 20


def measured(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, place), written once. Pages without text, source or id are left out; place is the seeded order."""
    # The vocabulary goes to the executors with the job.
    documents.sparkSession.sparkContext.addFile(f"{folder}/{vocabulary}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        count = tiktoken.Encoding("blocks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for b in batches:
            n = pa.array([len(count(t)) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), b.column("source").cast(pa.string()), n], ["doc_id", "source", "n_tokens"])

    pages = documents.select("doc_id", "source", "text").where("doc_id IS NOT NULL AND source IS NOT NULL AND text IS NOT NULL AND text <> ''")
    out = pages.mapInArrow(run, "doc_id long, source string, n_tokens long").where("n_tokens > 0")
    return materialise(out.withColumn("place", F.xxhash64(F.lit(seed), "source", "doc_id")), "tokens")


@dataclass
class Plan:
    block: int
    total: int
    blocks: dict[str, int]
    quota: dict[str, int]
    seats: list[tuple[str, int, int]]  # source, the source's how-manieth seat, shard


def apportion(shares: dict[str, float], seats: int) -> list[str]:
    """Sources in the order they win seats: highest share / (2 k + 1), ties to the source first by name."""
    heap = [(-w, s, 0) for s, w in sorted(shares.items()) if w > 0]
    heapq.heapify(heap)
    out = []
    for _ in range(seats if heap else 0):
        _, s, k = heap[0]
        out.append(s)
        heapq.heapreplace(heap, (-shares[s] / (2 * k + 3), s, k + 1))
    return out


def plan(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None, shards: int = SHARDS, most: int = MOST_BLOCKS, least: int = LEAST_BLOCK) -> Plan:
    """Block size, quotas and seats for sources of `sizes` tokens and targets (share, repeats).

    Shares of sources without pages can't be reached; the others keep their
    proportions. Without `total` the mix is as large as the repeats allow.
    """
    live = {s: (w, r) for s, (w, r) in targets.items() if sizes.get(s, 0) > 0 and w > 0 and r > 0}
    if not live:
        return Plan(least, 0, {}, {}, [])
    norm = sum(w for w, _ in live.values())
    room = min(sizes[s] * r / (w / norm) for s, (w, r) in live.items())
    goal = min(room, total) if total else room
    block = max(1, min(max(least, -(-int(goal) // most)), max(1, min(sizes[s] for s in live) // 8)))
    block = max(block, -(-int(goal) // most))
    blocks = {s: max(1, sizes[s] // block) for s in live}
    # What a block of each source holds; seats are worth that much, so they are weighed by it.
    held = {s: sizes[s] / blocks[s] for s in live}
    weight = {s: w / norm / held[s] for s, (w, _) in live.items()}
    n = int(min([goal * sum(weight.values()), *(blocks[s] * live[s][1] * sum(weight.values()) / weight[s] for s in live)]) + 1e-6)
    while True:
        order = apportion(weight, n)
        quota = {s: order.count(s) for s in live}
        over = [s for s in live if quota[s] > blocks[s] * live[s][1]]
        if not over:
            break
        n -= max(1, sum(quota[s] - blocks[s] * live[s][1] for s in over))
    nth = dict.fromkeys(live, 0)
    seats = []
    for i, s in enumerate(order):
        seats.append((s, nth[s], i * shards // max(1, n)))
        nth[s] += 1
    return Plan(block, round(sum(quota[s] * held[s] for s in live)), blocks, quota, seats)


def _starts(tokens: DataFrame, buckets: int) -> DataFrame:
    """Each page with `start`, the tokens before it in its source's seeded order.

    Two levels: sums of `buckets` ranges of the order, then within a range. No task holds more than a range.
    """
    b = tokens.withColumn("bucket", F.floor((F.shiftright("place", 16).cast("double") + 2.0**47) / 2.0**48 * buckets).cast("int"))
    whole = b.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("s"))
    w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("source", "bucket", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("before"))
    v = Window.partitionBy("source", "bucket").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    inner = b.withColumn("inner", F.coalesce(F.sum("n_tokens").over(v), F.lit(0)))
    return inner.join(whole, ["source", "bucket"]).withColumn("start", F.col("before") + F.col("inner")).drop("bucket", "before", "inner")


def mix(tokens: DataFrame, targets: DataFrame, total: int | None = None, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, shard, round, n_tokens): every use of a page in the mix.

    Rounds count a page's uses from 0, so no page has more than its source's
    max_repeats. Null targets are left out; repeated rows of a page are uses of
    their own page row; of repeated targets the largest share holds.
    """
    spark = tokens.sparkSession
    wanted = {r.source: (float(r.w), int(r.m)) for r in targets.where("source IS NOT NULL AND target_share IS NOT NULL AND max_repeats IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("m")).collect()}
    known = {r.source: (int(r.s), int(r.n)) for r in tokens.where(F.col("source").isin(list(wanted))).groupBy("source").agg(F.sum("n_tokens").alias("s"), F.count("*").alias("n")).collect()}
    p = plan({s: v[0] for s, v in known.items()}, wanted, total, shards)
    seats = spark.createDataFrame(p.seats or [("", 0, 0)], "source string, nth int, shard int").where("source <> ''")
    sources = spark.createDataFrame([(s, known[s][0], p.blocks[s], p.quota[s], wanted[s][1], hash_place(s, seed) % p.blocks[s]) for s in p.blocks] or [("", 1, 1, 0, 0, 0)], "source string, size long, blocks int, quota int, repeats int, first int")
    starts = _starts(tokens.join(F.broadcast(sources.select("source")), "source", "left_semi"), max(16, sum(v[1] for v in known.values()) // 5000))
    placed = starts.join(F.broadcast(sources), "source").withColumn("b", F.expr("cast((start * blocks) div size as int)"))
    placed = placed.withColumn("round", F.explode(F.sequence(F.lit(0), F.greatest(F.col("repeats") - 1, F.lit(0)))))
    placed = placed.withColumn("nth", (F.col("round") * F.col("blocks") + F.pmod(F.col("b") - F.col("first"), F.col("blocks"))).cast("int")).where("nth < quota")
    # At most MOST_BLOCKS seats.
    return placed.join(F.broadcast(seats), ["source", "nth"]).select("doc_id", "source", "shard", "round", "n_tokens")


def hash_place(s: str, seed: int) -> int:
    import hashlib

    return int.from_bytes(hashlib.sha256(f"{seed}/{s}".encode()).digest()[:6], "big")


def shares(mixed: DataFrame, tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """What each source was to have and has: one row for each source with a target or pages."""
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens_used"), F.count("*").alias("page_uses"), F.count_distinct("doc_id").alias("pages_used"), F.max(F.col("round") + 1).alias("most_uses"))
    have = tokens.groupBy("source").agg(F.count("*").alias("pages"), F.sum("n_tokens").alias("tokens"))
    want = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    all_used = F.sum("tokens_used").over(Window.partitionBy())
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    out = want.join(have, "source", "full").join(used, "source", "left")
    return out.select("source", "target_share", "max_repeats", z("pages"), z("tokens"), z("pages_used"), z("page_uses"), z("tokens_used"), z("most_uses"), F.round(F.coalesce(F.col("tokens_used") / all_used, F.lit(0.0)), 6).alias("actual_share"))

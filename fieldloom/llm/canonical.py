"""Mapping freely typed street names to a canonical list by BK-trees.

Each distinct name is read into its parts once; the distinct names proper are
searched in a BK-tree over the list's names proper, which returns every one within
the threshold. Of the listed streets bearing one of them, those of the same type
and qualifiers remain, and the nearest wins. A list up to SHARD names proper is one
tree sent to every executor; a longer one is cut into shards, each searched on its
own. Shards return all they hold within the threshold, and what a name denotes is
decided once, from all shards' answers.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.bktree import BKTree
from fieldloom.llm.street_names import parse, unglued
from fieldloom.runtime import checked_broadcast, materialise, within_rows

#: Names proper that one tree holds (some 20 MB).
SHARD = 200_000
#: Distinct names proper searched at a time.
BLOCK = 4096
#: Names proper that meet a shard in one task.
QUERIES = 100_000


def threshold(base: str) -> int:
    """Edits allowed in a name proper."""
    return 0 if len(base) < 4 else 1 if len(base) < 6 else 2


_PARTS = "saint boolean, types array<string>, quals string"


def _row(p) -> tuple:
    return (p.base, p.saint, sorted(p.types), " ".join(sorted(p.qualifiers)))


def listed_streets(streets: DataFrame) -> DataFrame:
    """(street_id, word, saint, types, quals) of the list's rows with an id and a name; word is the name proper."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, *_row(p)) for i, p in zip(b.street_id, map(parse, b.street_name)) if p]
            yield pd.DataFrame(rows, columns=["street_id", "word", "saint", "types", "quals"])

    rows = streets.select(F.col("street_id").cast("long").alias("street_id"), "street_name").where("street_id IS NOT NULL AND street_name IS NOT NULL").distinct()
    return materialise(rows.mapInPandas(run, f"street_id long, word string, {_PARTS}"), "listed")


def readings(names: DataFrame) -> DataFrame:
    """(street_name, reading, base, saint, types, quals) of distinct names: 0 as written, further ones with a glued type cut off."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(n, k, *_row(q)) for n, p in zip(b.street_name, map(parse, b.street_name)) if p for k, q in enumerate([p, *unglued(p)])]
            yield pd.DataFrame(rows, columns=["street_name", "reading", "base", "saint", "types", "quals"]).astype({"reading": "int32"})

    names = names.repartition(names.sparkSession.sparkContext.defaultParallelism, "street_name")
    return materialise(names.mapInPandas(run, f"street_name string, reading int, base string, {_PARTS}"), "readings")


#: The tree a Python worker has built last, with the search it is for.
_BUILT: dict[str, BKTree] = {}


def _hits(tree: BKTree, bases: list[str]) -> pd.DataFrame:
    """(base, d, word) of all the tree holds within the bases' thresholds, BLOCK of them searched at a time."""
    out = []
    for s in range(0, len(bases), BLOCK):
        part = bases[s : s + BLOCK]
        found = tree.search(part, np.array([threshold(x) for x in part], int))
        out += [(x, d, w) for x, hits in zip(part, found) for d, w in hits]
    return pd.DataFrame(out, columns=["base", "d", "word"]).astype({"d": "int32"})


def near_words(bases: DataFrame, words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(base, d, word): of the distinct `words` every one within each distinct base's threshold; a base that is a word has only itself."""
    same = bases.join(words.withColumnRenamed("word", "base"), "base", "left_semi").select("base", F.lit(0).alias("d"), F.col("base").alias("word"))
    rest = bases.join(words.withColumnRenamed("word", "base"), "base", "left_anti")
    if within_rows(words, shard):
        held, name = sorted(r.word for r in words.collect()), uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            # The worker's own module, not the copy that travels with this function.
            from fieldloom.llm import canonical as here

            if name not in here._BUILT:
                here._BUILT.clear()
                here._BUILT[name] = BKTree(held)
            for b in batches:
                yield _hits(here._BUILT[name], b.base.tolist())

        # Few bytes, but much to do with them: spread over all cores.
        found = rest.repartition(rest.sparkSession.sparkContext.defaultParallelism, "base").mapInPandas(run, "base string, d int, word string")
    else:
        shards, blocks = -(-words.count() // shard), max(1, -(-rest.count() // QUERIES))
        q = rest.withColumn("block", F.pmod(F.xxhash64("base"), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
        w = words.withColumn("shard", F.pmod(F.xxhash64("word"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

        def local(_key, qs: pd.DataFrame, ws: pd.DataFrame) -> pd.DataFrame:
            return _hits(BKTree(ws.word.tolist()), qs.base.tolist())

        found = q.groupBy("shard", "block").cogroup(w.groupBy("shard", "block")).applyInPandas(local, "base string, d int, word string")
    return materialise(same.unionByName(found), "near")


def fits(read: DataFrame, near: DataFrame, listed: DataFrame) -> DataFrame:
    """(street_name, reading, least, fit): the least distance of any name proper, and the (d, street_id) of streets the reading may denote.

    Ids below 0 stand for several streets that one reading can't tell apart.
    """
    met = read.join(near, "base")
    least = met.groupBy("street_name", "reading").agg(F.min("d").alias("least"))
    l = listed.select("street_id", "word", "saint", F.col("types").alias("l_types"), F.col("quals").alias("l_quals"))
    cand = met.join(l, ["word", "saint"])
    same = (F.col("quals") == F.col("l_quals")).cast("int")
    by = cand.groupBy("street_name", "reading", "word", "d", "types", "quals").agg(F.count("*").alias("n"), F.sum(same).alias("n_same"), F.min("street_id").alias("only"), F.collect_list(F.when(F.col("quals") == F.col("l_quals"), F.struct("street_id", "l_types"))).alias("same"))
    hit = lambda i: F.struct("d", i.cast("long").alias("street_id"))
    # Without its type a name denotes a street only if the list has one street of that name.
    bare = F.when(F.col("n") == 1, F.array(hit(F.col("only")))).otherwise(F.array(hit(F.lit(-1)), hit(F.lit(-2))))
    typed = F.filter("same", lambda s: F.arrays_overlap(s.l_types, F.col("types")))
    chosen = F.when(F.size("types") > 0, typed).when(F.col("n_same") == 1, F.col("same")).otherwise(F.filter("same", lambda s: F.lit(False)))
    fit = F.when((F.size("types") == 0) & (F.col("quals") == ""), bare).otherwise(F.transform(chosen, lambda s: hit(s.street_id)))
    got = by.select("street_name", "reading", fit.alias("f")).groupBy("street_name", "reading").agg(F.flatten(F.collect_list("f")).alias("fit"))
    return least.join(got, ["street_name", "reading"], "left")


def winners(names: DataFrame, streets: DataFrame, shard: int = SHARD) -> DataFrame:
    """(street_name, street_id): the one nearest street each distinct name denotes; names that denote none, or several equally, are left out."""
    listed = listed_streets(streets)
    words = materialise(listed.select("word").distinct(), "words")
    read = readings(names)
    plain = read.where("reading = 0")
    first = materialise(fits(plain, near_words(plain.select("base").distinct(), words, shard), listed), "fits")
    # A name that comes near nothing may have its type glued on: its other readings are searched too.
    lost = materialise(read.where("reading > 0").join(first.select("street_name"), "street_name", "left_anti"), "lost")
    again = fits(lost, near_words(lost.select("base").distinct(), words, shard), listed)
    both = first.unionByName(again).where("size(fit) > 0").groupBy("street_name").agg(F.min("least").alias("least"), F.array_distinct(F.flatten(F.collect_list("fit"))).alias("fit"))
    fit = F.filter("fit", lambda c: (F.col("least") > 0) | (c.d == 0))
    best = F.array_min(F.transform(fit, lambda c: c.d))
    ids = F.array_distinct(F.transform(F.filter(fit, lambda c: c.d == best), lambda c: c.street_id))
    return both.select("street_name", ids.alias("ids")).where("size(ids) = 1 AND ids[0] >= 0").select("street_name", F.element_at("ids", 1).alias("street_id"))


def matched(names: DataFrame, listed: DataFrame, shard: int = SHARD) -> DataFrame:
    """`names` (edge_id, street_name) with the street_id each denotes, -1 for none. Null names are kept out by the caller."""
    won = materialise(winners(names.select("street_name").distinct(), listed, shard), "won")
    return names.join(checked_broadcast(won, SHARD), "street_name", "left").select("edge_id", F.coalesce("street_id", F.lit(-1).cast("long")).alias("street_id"))


def denoted_streets(network: DataFrame, streets: DataFrame, shard: int = SHARD) -> DataFrame:
    """(edge_id, street_id): edges whose name isn't letter for letter in the list, with the street it denotes or -1.

    Null names and edges without an id take no part; blank names denote nothing.
    Rows that repeat an edge and its result are one row; extra columns play no part.
    """
    named = network.select("edge_id", "street_name").where("edge_id IS NOT NULL AND street_name IS NOT NULL")
    exact = materialise(streets.select("street_name").where("street_name IS NOT NULL").distinct(), "exact")
    rest = named.join(checked_broadcast(exact, SHARD), "street_name", "left_anti")
    return matched(rest, streets, shard).distinct()

"""References to records that don't exist (yet, or any more), split by key skew.

References are first reduced to distinct (owner, key, moment); counts are first
added up per key and period, and only periods in which a key came or went are looked
at reference by reference. Keys holding more than 1/HEAVY_SHARE of all references are
at most HEAVY_SHARE in number whatever the data, so their facts are broadcast; all
other keys go through a shuffled join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.runtime import materialise

#: A key is heavy beyond this fraction of all references; the number of heavy keys can't exceed it.
HEAVY_SHARE = 512
#: Fewer references than this in all make no key heavy.
HEAVY_LEAST = 1000


def tidy_id(c: Column) -> Column:
    """Trimmed (any white space) and upper-cased; blank is null."""
    t = F.upper(F.regexp_replace(c, r"^[\s\u00a0\u200b\ufeff]+|[\s\u00a0\u200b\ufeff]+$", ""))
    return F.when(F.length(t) > 0, t)


def references(df: DataFrame, name: str, id_col: str, keys_col: str = "serves_app_ids", at_col: str = "published_at") -> DataFrame:
    """(ref_table, ref_id, app_id, at): the distinct references of one table.

    Null, empty arrays and null or blank elements give no reference.
    """
    return (
        df.select(F.lit(name).alias("ref_table"), F.col(id_col).cast("string").alias("ref_id"), F.col(at_col).alias("at"), F.explode(F.array_distinct(F.col(keys_col))).alias("k"))
        .select("ref_table", "ref_id", tidy_id(F.col("k")).alias("app_id"), "at")
        .where("app_id IS NOT NULL")
        .distinct()
    )


def facts(owners: DataFrame, key: str = "app_id", seen: str = "ingested_at", gone: str = "deleted_at") -> DataFrame:
    """(app_id, first_seen, gone_at): one row for each key of the owning table."""
    return owners.select(tidy_id(F.col(key)).alias("app_id"), F.col(seen).alias("s"), F.col(gone).alias("g")).where("app_id IS NOT NULL").groupBy("app_id").agg(F.min("s").alias("first_seen"), F.min("g").alias("gone_at"))


def _lives(prefix: str = "") -> Column:
    """A known owner covers a reference: ingested by then and not deleted by then. Unknown moments don't refute it."""
    f, g = F.col(f"{prefix}first_seen"), F.col(f"{prefix}gone_at")
    return F.coalesce(f <= F.col("at"), F.lit(True)) & F.coalesce(g > F.col("at"), F.lit(True))


def _heavy(counts: DataFrame) -> DataFrame:
    """(app_id): the keys with more than 1/HEAVY_SHARE of all references, from their counts (app_id, n)."""
    total = counts.agg(F.sum("n")).scalar()
    return counts.where((F.col("n") * HEAVY_SHARE > total) & (total > HEAVY_LEAST)).select("app_id")


def orphans(refs: DataFrame, owners: DataFrame) -> DataFrame:
    """The rows of `refs` (as made by `references`) with no living owner in `owners` (as made by `facts`).

    A reference or an owner without a moment is only an orphan if the key has no
    owner at all. Empty tables give empty results; extra columns play no part.
    """
    heavy = _heavy(refs.groupBy("app_id").agg(F.count("*").alias("n")))
    flagged = heavy.join(owners.withColumn("owned", F.lit(True)), "app_id", "left")
    hot = refs.join(F.broadcast(flagged), "app_id").where(F.col("owned").isNull() | ~_lives())
    rest = refs.join(F.broadcast(heavy), "app_id", "left_anti")
    f = owners.withColumnRenamed("app_id", "o_app_id")
    cold = rest.join(f, (F.col("app_id") == F.col("o_app_id")) & _lives(), "left_anti")
    cols = ["ref_table", "ref_id", "app_id", "at"]
    return hot.select(cols).unionByName(cold.select(cols))


def orphans_by_period(refs: DataFrame, owners: DataFrame, period: str = "month") -> DataFrame:
    """(ref_table, period, n_references, n_orphans), counted over distinct references; period is null where the moment is.

    References are added up per table, key and period first. What is known of the key
    settles most of these groups whole; those in whose period the key came or went, two for each
    table and key at most, are counted by their references.
    """
    dated = refs.withColumn("period", F.date_format(F.date_trunc(period, "at"), "yyyy-MM-dd"))
    by = ["ref_table", "app_id", "period"]
    groups = materialise(dated.groupBy(*by).agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi")), "groups")
    heavy = materialise(_heavy(groups.groupBy("app_id").agg(F.sum("n").alias("n"))), "heavy")
    facts_of = owners.withColumn("owned", F.lit(True))
    hot = groups.join(F.broadcast(heavy.join(facts_of, "app_id", "left")), "app_id").withColumn("heavy", F.lit(True))
    cold = groups.join(F.broadcast(heavy), "app_id", "left_anti").join(facts_of, "app_id", "left").withColumn("heavy", F.lit(False))
    lost = F.col("owned").isNull() | F.coalesce(F.col("hi") < F.col("first_seen"), F.lit(False)) | F.coalesce(F.col("lo") >= F.col("gone_at"), F.lit(False))
    kept = F.coalesce(F.col("lo") >= F.col("first_seen"), F.lit(True)) & F.coalesce(F.col("hi") < F.col("gone_at"), F.lit(True))
    known = materialise(hot.unionByName(cold).withColumn("fate", F.when(lost, "lost").when(kept, "kept").otherwise("mixed")), "fates")
    sums = known.groupBy("ref_table", "period").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("fate") == "lost", F.col("n")).otherwise(0)).alias("m"))
    mixed = known.where("fate = 'mixed'").select(*by, "first_seen", "gone_at", "heavy")
    one = [dated.join(f(mixed.where(c).drop("heavy")), by).where(~_lives()) for c, f in (("heavy", F.broadcast), ("NOT heavy", lambda d: d))]
    more = one[0].unionByName(one[1]).groupBy("ref_table", "period").agg(F.lit(0).cast("long").alias("n"), F.count("*").alias("m"))
    return sums.unionByName(more).groupBy("ref_table", "period").agg(F.sum("n").alias("n_references"), F.sum("m").alias("n_orphans"))


def all_references(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Union of `references` over {name: (table, id column)}."""
    return reduce(DataFrame.unionByName, [references(df, name, id_col) for name, (df, id_col) in tables.items()])

"""Keyed tables: deduplication, ranks, tiered joins, evidence, calendars, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import text
from fieldloom.runtime import materialise


def last_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the last by `order` (ascending)."""
    cols = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max(F.struct(*(o.alias(f"_{i}") for i, o in enumerate(order)), *cols)).alias("m")).select(*keys, *(f"m.{c}" for c in cols))


def first_per(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """All columns of the first row by `order` for each (computed) key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dense_order(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """`column` renumbered 0, 1, 2 ... in its order. Ranks are taken over distinct values only, range by range."""
    by = [group] if group else []
    d = df.select(*by, column).where(F.col(column).isNotNull()).distinct()
    if group:
        ranks = d.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(column)) - 1)
    else:
        # Sorted ranges are numbered each on their own; what comes before a range is added.
        d = materialise(d.repartitionByRange(column).withColumn("_p", F.spark_partition_id()), "ranges")
        before = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        first = d.groupBy("_p").agg(F.count("*").alias("n")).select("_p", before.alias("first"))  # a row for each range
        ranks = d.join(F.broadcast(first), "_p").withColumn("_r", F.col("first") + F.row_number().over(Window.partitionBy("_p").orderBy(column)) - 1).select(column, "_r")
    return df.join(ranks, [*by, column], "left").withColumn(column, F.col("_r")).drop("_r")


def unordered(a: Column, b: Column) -> Column:
    """A key that A to B and B to A share."""
    return F.struct(F.least(a, b), F.greatest(a, b))


def tiered_join(left: DataFrame, right: DataFrame, left_name: str, right_name: str) -> DataFrame:
    """(left_name, right_name, tier): for each left name the right names of its first tier with a hit.

    A left name's keys are `text.street_keys`; right names stand under their words as
    written (tier 0), sorted (1), and, where they have no qualifier, sorted again for
    the looser keys (2, 3). Null and blank names match nothing.
    """
    lk = left.select(left_name).where(F.size(text.tokens(F.col(left_name))) > 0).distinct()
    rk = right.select(right_name).where(F.size(text.tokens(F.col(right_name))) > 0).distinct()
    a = lk.select(left_name, F.posexplode(text.street_keys(F.col(left_name))).alias("tier", "k"))
    w = text.street_tokens(F.col(right_name))
    plain = F.array_join(F.array_sort(w), " ")
    loose = F.when(~text.qualified(F.col(right_name)), plain)
    b = rk.select(right_name, F.posexplode(F.array(F.array_join(w, " "), plain, loose, loose)).alias("tier", "k"))
    hit = a.where("k <> ''").join(b.where("k IS NOT NULL"), ["tier", "k"])
    best = hit.groupBy(left_name).agg(F.min("tier").alias("tier"))
    return hit.join(best, [left_name, "tier"]).select(left_name, right_name, "tier").distinct()


def evidence(parts: list[DataFrame], key: str) -> DataFrame:
    """(key, level, notes): the best level and all notes, in the order of sources, then distance, then text.

    Each part has (key, dist, rank, note); sources are numbered as they come.
    """
    rows = reduce(DataFrame.unionByName, [p.select(key, "dist", "rank", "note", F.lit(i).alias("src")) for i, p in enumerate(parts)])
    return rows.groupBy(key).agg(F.max("rank").alias("level"), F.transform(F.array_sort(F.collect_list(F.struct("src", "dist", "note"))), lambda s: s.note).alias("notes"))


def counts_map(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, counts): how often each value occurs for a key, as a map in the order of values."""
    n = df.groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias("counts"))


def active(base: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """(base and added) without removed, each once."""
    return base.union(added).distinct().subtract(removed)


def weekday_on_or_after(day: Column, weekday: int) -> Column:
    """The first given weekday (Monday is 0) on or after a day."""
    return F.date_add(day, F.pmod(F.lit(weekday) - F.weekday(day), F.lit(7)))


def violations(df: DataFrame, name: str, key: str, rules: dict[str, Column]) -> DataFrame:
    """(table, key, rule) of each rule a row breaks; a rule that is null counts as broken."""
    bad = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(r)) for r, ok in rules.items())), lambda r: r.isNotNull())
    return df.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key"), F.explode(bad).alias("rule"))


def dangling(df: DataFrame, name: str, key: str, column: str, owners: DataFrame, owner: str) -> DataFrame:
    """(table, key, rule) of values of `column` that no owner has."""
    lost = df.where(F.col(column).isNotNull()).join(owners.select(F.col(owner).alias(column)).distinct(), column, "left_anti")
    return lost.select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key"), F.lit(f"{column} has no owner").alias("rule"))


def upsert(ledger: DataFrame, news: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of each key."""
    return last_per(ledger.unionByName(news, allowMissingColumns=True), [key], [F.col(at)])


def mapped(df: DataFrame, column: str, mapping: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose value is mapped, with what it maps to; one row: how many were excluded). Null and unknown values are excluded."""
    to = F.try_element_at(F.create_map(*(F.lit(v) for kv in mapping.items() for v in kv)), F.col(column))
    return df.withColumn(column, to).where(F.col(column).isNotNull()), df.agg(F.count_if(to.isNull()).alias("excluded"))


def or_default(left: DataFrame, right: DataFrame, on: list[str], defaults: dict[str, Column]) -> DataFrame:
    """Left join; where no row meets, all of the right's columns take their defaults together (a null that was joined stays null)."""
    r = right.withColumn("_met", F.lit(True))
    out = left.join(r, on, "left")
    return out.withColumns({c: F.when(F.col("_met").isNull(), defaults.get(c, F.lit(None))).otherwise(F.col(c)) for c in right.columns if c not in on}).drop("_met")


def row_fallback(left: DataFrame, right: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """`columns` from the right's row where it has one, all nulls of it included, else from the left's own."""
    r = right.select(on, F.struct(*columns).alias("_r")).groupBy(on).agg(F.min("_r").alias("_r"))
    out = left.join(r, on, "left")
    return out.withColumns({c: F.when(F.col("_r").isNotNull(), F.col(f"_r.{c}")).otherwise(F.col(c)) for c in columns}).drop("_r")


def surviving(df: DataFrame, array: str, owners: DataFrame, owner: str, row: str) -> DataFrame:
    """`df` (unique by `row`) with the array's elements that an owner has; rows that keep none fall out. The array comes out sorted."""
    ids = df.select(row, F.explode(array).alias("_id")).join(owners.select(F.col(owner).alias("_id")).distinct(), "_id", "left_semi")
    return df.drop(array).join(ids.groupBy(row).agg(F.array_sort(F.collect_set("_id")).alias(array)), row)


def _all_within(c: Column, kind: str, box: tuple[float, float, float, float]) -> Column:
    w, s, e, n = box
    return F.forall(c if kind.startswith("array") else F.array(c), lambda p: p.x.between(w, e) & p.y.between(s, n))


def contract(df: DataFrame, name: str, key: str, required: list[str], finite: list[str] = (), one_of: dict[str, list[str]] | None = None, boxes: dict[str, tuple[float, float, float, float]] | None = None, kinds: dict[str, list[str]] | None = None) -> DataFrame:
    """(table, key, rule) of what a table breaks: required values, finite numbers, enumerations, geometry kinds, coordinates within a box.

    A column that is missing breaks its rule in every row. Boxes are checked over points and arrays of points; kinds over a column that names the geometry's kind.
    """
    have = set(df.columns)
    rules: dict[str, Column] = {}
    for c in required:
        rules[f"{c} is required"] = F.col(c).isNotNull() if c in have else F.lit(False)
    for c in finite:
        v = F.col(c).try_cast("double") if c in have else F.lit(None).cast("double")
        rules[f"{c} is finite"] = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    for c, values in {**(one_of or {}), **(kinds or {})}.items():
        rules[f"{c} is one of {len(values)}"] = F.col(c).isin(values) if c in have else F.lit(False)
    for c, box in (boxes or {}).items():
        rules[f"{c} within its box"] = _all_within(F.col(c), dict(df.dtypes)[c], box) if c in have else F.lit(False)
    return violations(df, name, key, rules)

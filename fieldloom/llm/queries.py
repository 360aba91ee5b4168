"""Queries of the text problems; each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import abuse, addresses, canonical, leakage, mixing, neardup, truncation
from fieldloom.llm.sql import SQL  # noqa: F401
from fieldloom.runtime import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return canonical.denoted_streets(table(spark, sf, "network"), table(spark, sf, "streets"))


def p1_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """How often each name that denotes no listed street is written."""
    named = table(spark, sf, "network").select("edge_id", "street_name").distinct()
    lost = p1_found(spark, sf).where("street_id = -1").select("edge_id")
    return named.join(lost, "edge_id", "left_semi").where("street_name IS NOT NULL").groupBy("street_name").agg(F.count("*").alias("n_edges"))


def _descriptions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "developments").select(F.col("app_id").alias("key"), F.col("description").alias("text"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.pairs(_descriptions(spark, sf)).select(F.col("key_a").alias("app_id_a"), F.col("key_b").alias("app_id_b"))


def p3_links(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.with_links(_descriptions(spark, sf)).withColumnRenamed("key", "app_id")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.measured(table(spark, sf, "developments"), "app_id", "authority", "description")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.found(_texts(spark, sf)).select(F.col("key").alias("app_id"))


def p5_spikes(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.spikes(_texts(spark, sf))


def p5_limit_suspects(spark: SparkSession, sf: str) -> DataFrame:
    """Texts at a spike of their source's length histograms that end without terminal punctuation."""
    return truncation.judged(_texts(spark, sf)).where("at_spike").select(F.col("key").alias("app_id"), "source").distinct()


def p5_stages(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.stages(_texts(spark, sf))


def p5_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.rates(_texts(spark, sf))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return addresses.pairs(table(spark, sf, "developments"))


def p6_places(spark: SparkSession, sf: str) -> DataFrame:
    """Each application with the place its address denotes; the place's id is its class."""
    return addresses.resolved(table(spark, sf, "developments"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_leaks(spark, sf).select("item_id", "doc_id")


def p7_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.matches(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p7_leaked_items(spark: SparkSession, sf: str) -> DataFrame:
    """Which items leaked, into how many pages, and how much of them at most."""
    return p7_leaks(spark, sf).groupBy("item_id").agg(F.count("*").alias("n_pages"), F.max("n_words").alias("most_words"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(mixing.measured(table(spark, sf, "documents")), table(spark, sf, "mix_targets"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    tokens, targets = mixing.measured(table(spark, sf, "documents")), table(spark, sf, "mix_targets")
    return mixing.shares(mixing.mix(tokens, targets), tokens, targets)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.scores(table(spark, sf, "documents"), table(spark, sf, "abuse_labels"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).where("flagged").select("doc_id").distinct()


def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf)


def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.rates(_scored(spark, sf))


QUERIES = {f.__name__: f for f in (p1_found, p1_unmatched, p3_found, p3_links, p5_found, p5_spikes, p5_limit_suspects, p5_stages, p5_rates, p6_found, p6_places, p7_found, p7_leaks, p7_leaked_items, p8_mix, p8_shares, p9_found, p9_scores, p9_rates)}

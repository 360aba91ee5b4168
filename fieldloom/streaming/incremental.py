"""Keyed work done once: new rows are extracted, known keys are passed over, failures come again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

Extractor = Callable[[pd.DataFrame], pd.DataFrame]


def todo(rows: DataFrame, store: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).dropDuplicates([key]).join(store.select(key), key, "left_anti")


def extract(rows: DataFrame, key: str, extractor: Extractor, schema: str, valid: str, batch: int = 25) -> DataFrame:
    """Rows of an external extractor called with `batch` rows at a time.

    Answers that don't satisfy `valid`, whose key wasn't asked for, or that raise
    are dropped, so their keys stay to be done.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for s in range(0, len(part), batch):
                ask = part.iloc[s : s + batch]
                try:
                    got = extractor(ask)
                except Exception:  # an outside service may fail in any way; its rows are asked for again
                    continue
                yield got[got[key].isin(ask[key])].drop_duplicates(key)[names]

    return rows.mapInPandas(run, schema).where(valid)


def follow(stream: DataFrame, store: str, key: str, extractor: Extractor, schema: str, valid: str, checkpoint: str) -> StreamingQuery:
    """Extract a stream's new keys into a Parquet store, each micro-batch against what is stored by then."""

    def one(batch: DataFrame, _id: int) -> None:
        spark = batch.sparkSession
        new = todo(batch, read_store(spark, store, schema), key)
        extract(new, key, extractor, schema, valid).write.mode("append").parquet(store)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_store(spark: SparkSession, store: str, schema: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(store)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def windowed_counts(stream: DataFrame, at: str, by: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts in tumbling windows under a watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")

"""Writers: GeoJSON features, one-file documents of bounded size, the source ledger."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import geo
from fieldloom.operators.keyed import upsert

#: A single document is put together on the driver only up to this many features.
MOST_FEATURES = 200_000


def coordinates(line: Column, digits: int = 5) -> Column:
    return F.transform(geo.rounded(line, digits), lambda p: F.array(p.x, p.y))


def feature(kind: str, line: Column, properties: list[str], digits: int = 5) -> Column:
    """A GeoJSON feature as JSON text: Point (first point), LineString or Polygon (one ring)."""
    c = coordinates(line, digits)
    at = {"Point": F.get(c, F.lit(0)), "LineString": c, "Polygon": F.array(c)}[kind]
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(kind).alias("type"), at.alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties")))


def write_features(df: DataFrame, path: str, kind: str, line: str, properties: list[str]) -> None:
    """One feature a line, in parallel parts; the form for any size."""
    df.select(feature(kind, F.col(line), properties).alias("value")).write.mode("overwrite").text(path)


def write_collection(df: DataFrame, path: str, kind: str, line: str, properties: list[str]) -> int:
    """One FeatureCollection file, written beside its place and moved there. Its size is checked first; returns its bytes."""
    rows = df.select(feature(kind, F.col(line), properties).alias("value")).limit(MOST_FEATURES + 1).collect()
    if len(rows) > MOST_FEATURES:
        raise ValueError(f"more than {MOST_FEATURES} features: use write_features")
    tmp = f"{path}.part"
    with open(tmp, "w", encoding="utf-8") as f:
        f.write('{"type":"FeatureCollection","features":[' + ",".join(r.value for r in rows) + "]}")
    os.replace(tmp, path)
    return os.path.getsize(path)


def write_document(row: dict, path: str) -> None:
    """A small JSON document, whole or not at all."""
    tmp = f"{path}.part"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(row, f, ensure_ascii=False, indent=2)
    os.replace(tmp, path)


def sizes(paths: list[str], budget: int) -> tuple[list[tuple[str, int]], bool]:
    """Files by size, largest first, and whether all fit the budget."""
    s = sorted(((p, os.path.getsize(p)) for p in paths if os.path.exists(p)), key=lambda x: -x[1])
    return s, sum(n for _, n in s) <= budget


def ledger(known: DataFrame, source: str, records: int | None, error: str | None, at: str) -> DataFrame:
    """The ledger (source, status, records, note, at) with news of one source: failed, partial (none came) or ok."""
    status = "failed" if error else "ok" if records else "partial"
    news = known.sparkSession.createDataFrame([(source, status, records, error, at)], "source string, status string, records int, note string, at string")
    return upsert(known, news, "source", "at")

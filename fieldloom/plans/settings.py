"""Run-wide settings: named constants, areas, guarded sources, stage times."""

from __future__ import annotations

import json
import logging
import os
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from fieldloom.runtime import materialise

Box = tuple[float, float, float, float]


@dataclass
class Registry:
    """Named constants with their provenance; any JSON value."""

    rows: dict[str, tuple[str, object, str, str]] = field(default_factory=dict)

    def add(self, key: str, value: object, label: str = "", unit: str = "", note: str = "") -> object:
        self.rows[key] = (label, value, unit, note)
        return value

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, label, json.dumps(v, ensure_ascii=False), unit, note) for k, (label, v, unit, note) in self.rows.items()]
        return spark.createDataFrame(rows, "key string, label string, value string, unit string, source_note string")


def checked(box: Box) -> Box:
    w, s, e, n = box
    if not (w < e and s < n):
        raise ValueError(f"an area needs west < east and south < north: {box}")
    return box


def area(given: Box | str | None, presets: dict[str, Box], last: Box | None, default: str) -> Box:
    """An area by what is given (a box or a preset's name), else the last run's, else the default."""
    if isinstance(given, str):
        return checked(presets[given])
    return checked(given or last or presets[default])


def guarded(spark: SparkSession, name: str, schema: str, source: Callable[[], DataFrame]) -> tuple[DataFrame, str | None]:
    """A source's table, read once, or an empty one and the error if it can't be read, be it while planned or while read."""
    try:
        return materialise(source(), "source"), None
    except Exception as e:  # whatever a source raises, the run goes on without it
        logging.getLogger(__name__).warning("%s: %s", name, e)
        return spark.createDataFrame([], schema), str(e)


def setting(name: str, default: str | None = None) -> str | None:
    """An environment variable; unset and blank are the default."""
    return (os.environ.get(name) or "").strip() or default


def status(spark: SparkSession, paths: dict[str, str], ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, present) of the outputs, and the ledger's sources in order."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return bool(p.getFileSystem(conf).exists(p))

    return spark.createDataFrame([(k, there(v)) for k, v in sorted(paths.items())], "name string, present boolean"), ledger.orderBy("source")


@contextmanager
def timed(name: str, times: dict[str, float]) -> Iterator[None]:
    t = time.monotonic()
    try:
        yield
    finally:
        times[name] = time.monotonic() - t

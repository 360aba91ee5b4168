"""Session helpers: table loading, reliable materialisation, size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(app: str = "fieldloom", cores: str = "*") -> SparkSession:
    """A local session with the settings the engine is tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir, or one of our own where it is unset."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    known = sc.getCheckpointDir()
    if not known:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="fieldloom-"))
        known = sc.getCheckpointDir()
    return known


_HOMES: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    """Delete what a session wrote, when its driver ends; results may be read until then."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already; the folder is then left to the cluster's own cleaning
        pass


def materialise(df: DataFrame, name: str = "part", group: int | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Cuts lineage and survives the loss of executors; columns not needed later
    are pruned by the Parquet scan, which a checkpointed RDD can't do. Where rows are
    large, `group` is how many a row group has: Parquet looks at its size only every 100 rows.
    """
    spark = df.sparkSession
    home = f"{shared_dir(spark)}/fieldloom/{spark.sparkContext.applicationId}"
    if home not in _HOMES:
        _HOMES.add(home)
        atexit.register(_remove, spark, home)
    path = f"{home}/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.option("parquet.block.row.count.limit", group) if group else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def within_rows(df: DataFrame, limit_rows: int) -> bool:
    """Whether `df`, best a materialised one, has at most `limit_rows` rows. Counted on the executors; of a written table only the footers are read."""
    return df.count() <= limit_rows


def checked_broadcast(df: DataFrame, limit_rows: int) -> DataFrame:
    """`df`, with a broadcast hint only if it has at most `limit_rows` rows."""
    return F.broadcast(df) if within_rows(df, limit_rows) else df


#: Rows of a written table up to which joins may send it to all executors on Spark's own estimate (some 40 MB in memory).
MOST_SENT = 200_000


def unsent(df: DataFrame, when: bool = True) -> DataFrame:
    """`df`, never broadcast in a join if `when` holds.

    Spark estimates by compressed files and takes no account of what `explode` adds: it would
    send tables a hundred times as large as its threshold.
    """
    return df.hint("merge") if when else df

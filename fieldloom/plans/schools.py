"""Schools within reach of developments, and what falls on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators import spatial


def schools_of(returns: DataFrame, enrolments: DataFrame, level: str, number: str = r"^\d{5}[A-Z]$") -> DataFrame:
    """School rows of one level: those with a proper roll number, with enrolment where a return has it.

    Texts that are no numbers give null positions and enrolments, kept as such.
    """
    s = returns.where(F.col("school_id").rlike(number)).withColumns({c: F.col(c).try_cast("double") for c in ("x", "y")})
    # Of several returns of a school the one with most pupils holds.
    e = enrolments.groupBy("school_id").agg(F.max(F.col("enrolment").try_cast("int")).alias("enrolment"))
    return s.join(e, "school_id", "left").withColumn("level", F.lit(level))


def catchment(developments: DataFrame, schools: DataFrame, reach: dict[str, float]) -> DataFrame:
    """(app_id, level, school_id, enrolment): each school of a level within that level's reach."""
    out = None
    for level, metres in reach.items():
        some = schools.where(F.col("level") == level).select("school_id", "level", "enrolment", "x", "y")
        hit = spatial.radius_join(developments, some, metres, "app_id", "school_id").select("app_id", "school_id").join(some.select("school_id", "level", "enrolment"), "school_id")
        out = hit if out is None else out.unionByName(hit)
    return out.select("app_id", "level", "school_id", "enrolment")


def pressure(developments: DataFrame, schools: DataFrame, reach: dict[str, float], rates: dict[str, float], flag: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(per development, per school).

    A development's pupils of a level (units times rate) are split evenly over the
    schools in reach. Its pressure is the larger of the levels' ratios of pupils to
    places, null, and flagged, if any level has no places. Schools without pupils keep 0.
    """
    near = catchment(developments, schools, reach)
    rate = F.create_map(*(F.lit(v) for kv in rates.items() for v in kv))
    levels = developments.sparkSession.createDataFrame([(k,) for k in rates], "level string")
    want = developments.select("app_id", "units").join(F.broadcast(levels), F.lit(True)).withColumn("pupils", F.col("units") * rate[F.col("level")])
    per = near.groupBy("app_id", "level").agg(F.count("*").alias("n"), F.sum(F.coalesce("enrolment", F.lit(0))).alias("places"), F.array_sort(F.collect_list("school_id")).alias("schools"))
    got = want.join(per, ["app_id", "level"], "left")
    ratio = F.try_divide(F.col("pupils"), F.nullif(F.coalesce("places", F.lit(0)), F.lit(0)))
    dev = got.groupBy("app_id").agg(F.when(F.count_if(ratio.isNull()) == 0, F.max(ratio)).alias("pressure_ratio"), F.map_from_entries(F.collect_list(F.struct("level", F.coalesce("schools", F.array().cast("array<string>"))))).alias("schools"))
    dev = dev.withColumn("pressure_flag", F.col("pressure_ratio").isNull() | (F.col("pressure_ratio") >= flag))
    share = near.join(want, ["app_id", "level"]).join(per.select("app_id", "level", "n"), ["app_id", "level"]).groupBy("school_id").agg(F.sum(F.col("pupils") / F.col("n")).alias("p"))
    sch = schools.join(share, "school_id", "left").withColumn("projected_pupils", F.coalesce("p", F.lit(0.0))).drop("p")
    return dev, sch.withColumn("pressure_ratio", F.try_divide(F.col("projected_pupils"), F.nullif(F.col("enrolment"), F.lit(0))))


def worth_showing(schools: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """Schools in a box, and those beyond it that pupils fall on."""
    w, s, e, n = box
    return schools.where((F.col("x").between(w, e) & F.col("y").between(s, n)) | (F.col("projected_pupils") > 0))


def state_of(rows: DataFrame) -> DataFrame:
    """One row (located, status): rows with a position, and ok if every level has some, else partial."""
    per = rows.groupBy("level").agg(F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("located"), F.when(F.coalesce(F.bool_and(F.col("n") > 0), F.lit(False)), "ok").otherwise("partial").alias("status"))

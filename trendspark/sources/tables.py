"""Readers of the input tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def table_or_none(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``; an empty one where there is none, or none that can be read."""
    try:
        return spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def day_of(d: Column) -> Column:
    """The calendar day that a spelled day names by its first eight digits (``20240131``, ``2024-01-31``,
    ``2024013100``); null for anything that is no day. The usual spellings are read by position, only others by pattern."""
    digits = F.regexp_replace(d, "[^0-9]", "")
    by_pattern = F.when(digits.rlike("^[0-9]{8}"), F.regexp_replace(digits, "^([0-9]{4})([0-9]{2})([0-9]{2}).*$", "$1-$2-$3"))
    part = lambda at, n: F.substring(d, at, n)
    led = part(1, 1).between("0", "9")
    plain = F.when(led, F.concat(part(1, 4), F.lit("-"), part(5, 2), F.lit("-"), part(7, 2)))
    dashed = F.when(led & (part(5, 1) == "-") & (part(8, 1) == "-"), part(1, 10))
    return F.coalesce(plain.try_cast("date"), dashed.try_cast("date"), by_pattern.try_cast("date"))


def edition_of(project: Column) -> Column:
    """A project name in its canonical spelling: trimmed, lower case, without a trailing ``.org``."""
    return F.regexp_replace(F.lower(F.trim(project)), r"\.org$", "")


def holding_points(points: DataFrame, day: str = "d") -> DataFrame:
    """One row per series and day, ``(series_id, day, v)``: the value of the row with the latest ``fetched_at``.

    Rows with a null series or a day that is none are no points. A null ``fetched_at`` counts as the earliest; rows
    that tie are expected to be equal, else the larger value holds (a null value is the smallest). The maximum is
    combined before the shuffle, so neither repeated rows nor a hot series move as they are.
    """
    return (
        points.select("series_id", day_of(F.col(day)).alias("day"), F.struct("fetched_at", "v").alias("_p"))
        .where("series_id is not null and day is not null")
        .groupBy("series_id", "day")
        .agg(F.max("_p").alias("_p"))
        .select("series_id", "day", F.col("_p.v").alias("v"))
    )


def current_meta(meta: DataFrame) -> DataFrame:
    """One row per series of the coverage record: the latest ``updated`` row."""
    cols = [c for c in meta.columns if c != "series_id"]
    return (
        meta.where("series_id is not null")
        .groupBy("series_id")
        .agg(F.max(F.struct("updated", *[c for c in cols if c != "updated"])).alias("_m"))
        .select("series_id", *[F.col("_m")[c].alias(c) for c in cols])
    )

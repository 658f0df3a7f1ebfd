"""The point cache: what it covers, what is missing, and how new points get in."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dates import FLOOR, VOLATILE_DAYS, latest_published
from ..session import checkpointed
from .tables import table_or_none

COVERAGE, POINTS = "series_id string, covered_from date, covered_to date", "series_id string, day date, v bigint, month string"


def gaps(coverage: DataFrame, start: date, end: date, as_of: date, series: DataFrame | None = None) -> DataFrame:
    """``(series_id, gap_from, gap_to)``: the parts of ``start`` .. ``end`` that must be loaded: before and after what is covered, and
    the days at the end that may still be revised, joined to the part they adjoin. A series without coverage needs all.

    ``coverage``: ``(series_id, covered_from, covered_to)`` as dates, one row per series.
    """
    rows = coverage if series is None else series.join(coverage, "series_id", "left")
    a, b = F.lit(start), F.lit(end)
    soft = F.lit(as_of - timedelta(days=VOLATILE_DAYS - 1))  # the first day that may change
    none = F.col("covered_from").isNull() | F.col("covered_to").isNull() | (F.col("covered_from") > b) | (F.col("covered_to") < a)
    head_end = F.least(b, F.date_sub("covered_from", 1))
    tail_start = F.greatest(a, F.least(F.date_add("covered_to", 1), soft))
    whole = F.array(F.struct(a.alias("gap_from"), b.alias("gap_to")))
    parts = F.array(F.struct(a.alias("gap_from"), head_end.alias("gap_to")), F.struct(tail_start.alias("gap_from"), b.alias("gap_to")))
    found = F.filter(F.when(none, whole).otherwise(parts), lambda g: g["gap_from"] <= g["gap_to"])
    return rows.select("series_id", F.explode(found).alias("_g")).select("series_id", "_g.*")


def extended(coverage: DataFrame, loaded: DataFrame) -> DataFrame:
    """Coverage after loading: the hull of both ranges."""
    return coverage.select("series_id", "covered_from", "covered_to").unionByName(loaded.select("series_id", F.col("gap_from").alias("covered_from"), F.col("gap_to").alias("covered_to"))).groupBy("series_id").agg(
        F.min("covered_from").alias("covered_from"), F.max("covered_to").alias("covered_to")
    )


def save_points(points: DataFrame, path: str) -> None:
    """``(series_id, day, v)`` into the cache at ``path``: the months that ``points`` touch are rewritten, all others stay.

    ``points`` must hold those months whole (see :func:`merged`).
    """
    rows = points.withColumn("month", F.date_format("day", "yyyyMM"))
    rows.repartition("month").sortWithinPartitions("series_id", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old points overwritten by new ones, the months that ``new`` touches only."""
    months = new.select(F.trunc("day", "MM").alias("_m")).distinct()
    both = old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    touched = both.withColumn("_m", F.trunc("day", "MM")).join(months, "_m", "left_semi")
    return touched.groupBy("series_id", "day").agg(F.max(F.struct("_o", "v")).alias("_p")).select("series_id", "day", F.col("_p.v").alias("v"))


def refresh(spark: SparkSession, path: str, series: DataFrame, start: date, end: date, as_of: date, load: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Brings the cache at ``path`` up to date for ``series`` ``(series_id)`` and gives the points of ``start`` .. ``end``.

    What is missing is planned from the coverage record; ``load`` turns the gaps ``(series_id, gap_from, gap_to)`` into ``(series_id, day, v,
    error)``, with one row of null day and an ``error`` for a series that could not be had. Loaded points are merged month by month;
    the coverage of what was loaded grows to the hull, that of a series with an error stays, so that it is asked for again.
    The result has the errors too, as rows without a day. Nothing is loaded where nothing is missing.
    """
    points_at, record_at = f"{path}/points", f"{path}/coverage"
    record = table_or_none(spark, record_at, COVERAGE)
    start = max(start, FLOOR)
    wanted = series.select("series_id").where("series_id is not null").distinct()
    asked = checkpointed(gaps(record, start, min(end, latest_published(as_of)), as_of, wanted))
    errors = spark.createDataFrame([], "series_id string, error string")
    if not asked.isEmpty():
        loaded = checkpointed(load(asked))
        errors = loaded.where("error is not null").select("series_id", "error").distinct()
        new = loaded.where("error is null and day is not null").select("series_id", "day", "v")
        old = table_or_none(spark, points_at, POINTS).select("series_id", "day", "v")
        save_points(checkpointed(merged(old, new)), points_at)
        done = asked.join(errors, "series_id", "left_anti")
        checkpointed(extended(record, done)).write.mode("overwrite").parquet(record_at)
    held = table_or_none(spark, points_at, POINTS).where(F.col("day").between(F.lit(start), F.lit(end))).join(wanted, "series_id", "left_semi")
    return held.select("series_id", "day", "v", F.lit(None).cast("string").alias("error")).unionByName(errors.select("series_id", F.lit(None).cast("date").alias("day"), F.lit(None).cast("bigint").alias("v"), "error"))


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes a cache takes on disk."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def cache_stats(df: DataFrame) -> DataFrame:
    """Series, points and first and last day held."""
    return df.agg(F.countDistinct("series_id").alias("series"), F.count("*").alias("points"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))

"""Operators on daily and monthly series: axis, rollup, share of the edition, comparison of periods, level.

``daily``: ``(series_id, day, views)``, one row per day of a complete axis, null where nothing is known.
``monthly``: ``(series_id, month, views, days_present, days_missing, complete)``.
All work on any number of series at once and shuffle by ``series_id`` only.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.dates import days_in_month, month_of
from ..functions.rounding import percent_change, round_half
from ..functions.text import sparkline
from ..sources.tables import edition_of

BY = "series_id"


def on_axis(points: DataFrame, start: date, end: date, series: DataFrame | None = None) -> DataFrame:
    """``daily`` of the given span: absent days are null, an explicit 0 stays. ``series``: the series wanted, default
    those of ``points``. A span that ends before it starts is empty."""
    span = F.sequence(F.lit(start), F.lit(end)) if start <= end else F.array().cast("array<date>")
    axis = (series if series is not None else points).select(BY).where(F.col(BY).isNotNull()).distinct().select(BY, F.explode(span).alias("day"))
    inside = points.where(F.col("day").between(F.lit(start), F.lit(end))).select(BY, "day", F.col("v").alias("views"))
    return axis.join(inside, [BY, "day"], "left")


def header(daily: DataFrame) -> DataFrame:
    """Per series ``(series_id, first_day, last_day, days, days_missing, days_zero)``."""
    return daily.groupBy(BY).agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days"),
        F.count_if(F.col("views").isNull()).alias("days_missing"), F.count_if(F.col("views") == 0).alias("days_zero"),
    )


def monthly_rollup(daily: DataFrame) -> DataFrame:
    """``monthly``: unknown days add nothing; a month is complete when the axis has all its days, whatever is known of
    them."""
    return (
        daily.groupBy(BY, month_of(F.col("day")).alias("month"))
        .agg(F.coalesce(F.sum("views"), F.lit(0)).alias("views"), F.count("*").alias("days_present"), F.count_if(F.col("views").isNull()).alias("days_missing"))
        .withColumn("complete", F.col("days_present") == days_in_month(F.col("month")))
    )


def month_totals(totals: DataFrame, start: date | None = None, end: date | None = None) -> DataFrame:
    """``(project, month, project_views)`` of ``(project, ym, v)``: repeated rows once, nulls left out, months from that of
    ``start`` to that of ``end``."""
    rows = totals.where("project is not null and v is not null").select(edition_of(F.col("project")).alias("project"), F.concat("ym", F.lit("01")).alias("m"), "v")
    rows = rows.select("project", F.try_to_date("m", "yyyyMMdd").alias("month"), "v").where("month is not null")
    if start is not None:
        rows = rows.where(F.col("month") >= F.lit(start.replace(day=1)))
    if end is not None:
        rows = rows.where(F.col("month") <= F.lit(end))
    return rows.groupBy("project", "month").agg(F.max("v").alias("project_views"))


def normalized(monthly: DataFrame, totals: DataFrame) -> DataFrame:
    """``monthly`` of series with a ``project``, with ``project_views`` and ``per_million`` (4 decimals; null unless the month
    is complete and the edition's total above 0)."""
    joined = monthly.join(totals, ["project", "month"], "left")
    share = F.when(F.col("complete") & (F.col("project_views") > 0), round_half(F.col("views") / F.col("project_views") * 1e6, 4))
    return joined.withColumn("per_million", share)


def trailing_blocks(monthly: DataFrame, n: int | None = None) -> DataFrame:
    """The complete months of the two latest blocks of ``n`` months: ``block`` is ``recent`` or ``prior``, ``available`` the
    number of complete months. Default ``n``: half of those available. Series with fewer than ``2n`` have no rows."""
    whole = W.partitionBy(BY)
    rows = monthly.where("complete").withColumns({"_rn": F.row_number().over(whole.orderBy(F.desc("month"))), "available": F.count("*").over(whole)})
    size = F.lit(n) if n else F.floor(F.col("available") / 2)
    return (
        rows.withColumn("n", size.cast("int"))
        .where((F.col("n") > 0) & (F.col("available") >= 2 * F.col("n")) & (F.col("_rn") <= 2 * F.col("n")))
        .withColumn("block", F.when(F.col("_rn") <= F.col("n"), "recent").otherwise("prior"))
        .drop("_rn")
    )


def compare_blocks(monthly: DataFrame, n: int = 12) -> DataFrame:
    """Per series of a normalised ``monthly`` the change from the prior to the recent block.

    ``raw`` compares sums of views, ``normalized`` ratios of sums (views to the edition's views, per million); the latter is
    withheld (``unavailable``) as soon as one month of either block lacks a positive total. A series with fewer than
    ``2n`` complete months has ``insufficient_history`` and no figures.
    """
    rows, sums = comparison_sums(monthly, n)
    return rows.groupBy(BY).agg(*sums).select(BY, *comparison_columns(n))


def comparison_sums(monthly: DataFrame, n: int) -> tuple[DataFrame, list[Column]]:
    """``monthly`` with the complete months numbered from the latest, and what a comparison needs of each series' rows."""
    complete = F.col("complete")
    rn = F.row_number().over(W.partitionBy(BY).orderBy(F.desc_nulls_last(F.when(complete, F.col("month")))))
    rows = monthly.withColumn("_rn", F.when(complete, rn))
    recent, prior = F.col("_rn") <= n, (F.col("_rn") > n) & (F.col("_rn") <= 2 * n)
    used = recent | prior
    total = lambda c, block: F.sum(F.when(block, F.col(c)))
    return rows, [
        F.count_if(complete).alias("months_available"),
        F.min(F.when(prior, F.col("month"))).alias("prior_from"), F.max(F.when(prior, F.col("month"))).alias("prior_to"),
        F.min(F.when(recent, F.col("month"))).alias("recent_from"), F.max(F.when(recent, F.col("month"))).alias("recent_to"),
        total("days_missing", used).alias("days_missing"),
        total("views", prior).alias("_p"), total("views", recent).alias("_r"),
        total("project_views", prior).alias("_pt"), total("project_views", recent).alias("_rt"),
        F.count_if(used & ~F.coalesce(F.col("project_views") > 0, F.lit(False))).alias("_gaps"),
    ]


def comparison_columns(n: int) -> list[Column]:
    """The comparison of a series from :func:`comparison_sums`."""
    enough = F.col("months_available") >= 2 * n
    known = enough & (F.col("_gaps") == 0)
    a, b = F.try_divide(F.col("_p") * 1e6, F.col("_pt")), F.try_divide(F.col("_r") * 1e6, F.col("_rt"))
    keep = lambda c: F.when(enough, F.col(c)).alias(c)
    return [
        (~enough).alias("insufficient_history"), F.col("months_available"), F.lit(2 * n).alias("months_required"),
        *[keep(c) for c in ("prior_from", "prior_to", "recent_from", "recent_to", "days_missing")],
        F.when(enough, F.struct(F.col("_p").alias("prior"), F.col("_r").alias("recent"), percent_change(F.col("_p"), F.col("_r")).alias("yoy_pct"))).alias("raw"),
        F.when(
            enough,
            F.struct(
                F.when(known, a).alias("prior"), F.when(known, b).alias("recent"), F.when(known, percent_change(a, b)).alias("yoy_pct"),
                (~known).alias("unavailable"), F.when(~known, "edition totals missing for part of the window").alias("reason"),
            ),
        ).alias("normalized"),
    ]


def median_daily(daily: DataFrame, days: int = 90) -> DataFrame:
    """``(series_id, median_daily)``: exact median of the latest ``days`` days, unknown days as 0."""
    rn = F.row_number().over(W.partitionBy(BY).orderBy(F.desc("day")))
    return daily.withColumn("_rn", rn).where(F.col("_rn") <= days).groupBy(BY).agg(F.median(F.coalesce("views", F.lit(0))).alias("median_daily"))


def index_to_100(monthly: DataFrame) -> DataFrame:
    """``(series_id, month, index)`` of complete months with a share, against the first share above 0."""
    whole = W.partitionBy(BY)
    rows = monthly.where("complete and per_million is not null")
    base = F.min_by(F.when(F.col("per_million") > 0, F.col("per_million")), F.when(F.col("per_million") > 0, F.col("month"))).over(whole)
    return rows.withColumn("_b", base).where("_b is not null").select(BY, "month", (F.col("per_million") / F.col("_b") * 100).alias("index"))


def period_matrix(monthly: DataFrame, group: str, most_months: int = 66) -> DataFrame:
    """``(period, <group>, views)`` of complete months: by month, or by quarter where there are more than ``most_months``."""
    rows = monthly.where("complete")
    by_month = rows.groupBy("month", group).agg(F.sum("views").alias("_v"))  # as many rows as months and groups
    # how many months there are is told within the plan: the last of their dense ranks
    ranked = by_month.withColumn("_k", F.dense_rank().over(W.orderBy("month"))).withColumn("_n", F.max("_k").over(W.partitionBy()))
    period = F.when(F.col("_n") > most_months, F.trunc("month", "quarter").cast("date")).otherwise(F.col("month"))
    return ranked.groupBy(period.alias("period"), group).agg(F.sum("_v").alias("views"))


def pivot_matrix(matrix: DataFrame, group: str, names: list[str]) -> DataFrame:
    """The matrix with one column per group; what is absent stays null."""
    return matrix.groupBy("period").pivot(group, names).agg(F.sum("views"))


def month_sparklines(monthly: DataFrame) -> DataFrame:
    """``(series_id, sparkline)`` over all months, the incomplete too; a series has as many values as its span has months."""
    rows = monthly.groupBy(BY).agg(F.array_sort(F.collect_list(F.struct("month", "views"))).alias("_m"))
    return rows.select(BY, sparkline(F.col("_m.views")).alias("sparkline"))

"""Trailing totals and averages over calendar days, by block decomposition.

The dense day axis of every series is cut into blocks as long as the window. Inside a block each day gets the prefix
sum (block start to day) and the suffix sum (day to block end). The window that ends on a day covers a suffix of the
block before and a prefix of the day's own block, so every trailing total is one suffix plus one prefix: constant work
a day whatever the window's length, and no cancellation as with differences of running totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..sources.tables import holding_points

WINDOWS = (7, 30)


def dense_days(points: DataFrame) -> DataFrame:
    """``(series_id, day, v)`` of every calendar day from a series' first to its last; days without a row have null.

    ``points``: at most one row per series and day, so a series is bounded by the calendar. Gaps are filled from each
    day to the next one's eve, so only what is missing is made.
    """
    ahead = F.lead("day").over(W.partitionBy("series_id").orderBy("day"))
    return (
        points.withColumn("_next", F.coalesce(F.date_sub(ahead, 1), F.col("day")))
        .select("series_id", F.col("day").alias("_first"), "v", F.explode(F.sequence("day", "_next")).alias("day"))
        .select("series_id", "day", F.when(F.col("day") == F.col("_first"), F.col("v")).alias("v"))
    )


def trailing_totals(points: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Per series and calendar day of its span ``(series_id, day, v, total_<w>, avg_<w>, ...)``.

    ``points``: ``(series_id, day, v)``, one row per series and day. Null or negative ``v`` count as no activity in the
    totals; ``v`` itself is given as it is. Averages are over the whole window: days before the span and days without a
    row count as 0. Everything after the first window runs on its partitioning by series; no further shuffle. An empty
    input gives no row; rows of a null series or day are left out.
    """
    out = dense_days(points.select("series_id", "day", "v").where("series_id is not null and day is not null"))
    out = out.withColumn("_a", F.greatest(F.coalesce("v", F.lit(0)), F.lit(0)).cast("bigint"))
    for w in windows:
        block = W.partitionBy("series_id", "_block")
        day_order = block.orderBy("day")
        series = W.partitionBy("series_id").orderBy("_block", "day")
        out = (
            out.withColumn("_block", F.floor(F.unix_date("day") / w))
            .withColumn("_prefix", F.sum("_a").over(day_order.rowsBetween(W.unboundedPreceding, 0)))
            .withColumn("_suffix", F.sum("_a").over(day_order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) - F.col("_prefix") + F.col("_a"))
            # the window's first day lies w - 1 rows back on the dense axis; where it starts this very block, the
            # prefix alone is the total, and before the span there is nothing to add but the whole first block
            .withColumn("_back", F.lag("_suffix", w - 1).over(series))
            .withColumn("_back_block", F.lag("_block", w - 1).over(series))
            .withColumn("_head", F.first("_block").over(series.rowsBetween(W.unboundedPreceding, 0)))
            .withColumn("_head_sum", F.first("_suffix").over(series.rowsBetween(W.unboundedPreceding, 0)))
            .withColumn(
                f"total_{w}",
                F.col("_prefix")
                + F.when(F.col("_back_block") < F.col("_block"), F.col("_back"))
                .when(F.col("_back_block").isNull() & (F.col("_head") < F.col("_block")), F.col("_head_sum"))
                .otherwise(0),
            )
            .withColumn(f"avg_{w}", F.col(f"total_{w}") / F.lit(float(w)))
            .drop("_block", "_prefix", "_suffix", "_back", "_back_block", "_head", "_head_sum")
        )
    return out.drop("_a")


def idle_and_peak_days(point_cache: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """``(series_id, d, span_days, mark)``: every day whose trailing total is 0 (``idle``), and each series' earliest
    day with its greatest trailing total, if above 0 (``peak``)."""
    totals = trailing_totals(holding_points(point_cache), windows)
    whole = W.partitionBy("series_id")
    best = {f"_best_{w}": F.max(F.struct(F.col(f"total_{w}").alias("t"), (-F.unix_date("day")).alias("o"))).over(whole) for w in windows}
    totals = totals.withColumns(best)
    marks = [
        F.struct(
            F.lit(w).alias("span_days"),
            F.when(F.col(f"total_{w}") == 0, "idle").when(-F.unix_date("day") == F.col(f"_best_{w}.o"), "peak").alias("mark"),
        )
        for w in windows
    ]
    return (
        totals.select("series_id", F.date_format("day", "yyyyMMdd").alias("d"), F.explode(F.filter(F.array(*marks), lambda m: m["mark"].isNotNull())).alias("_m"))
        .select("series_id", "d", "_m.span_days", "_m.mark")
    )

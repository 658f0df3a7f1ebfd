"""Irregular readings onto a regular grid.

Between two consecutive readings of a source something accrues: of a cumulative counter their difference (after a
reset, where the reading falls, the new reading itself), of a level the level held times the seconds it was held. That
increment is distributed over the grid cells in proportion to the overlap of the interval between the readings with
each cell. A cell in which no reading falls is either filled from the interval that spans it or, where that interval
is longer than allowed, marked uncovered.

A source may hold a large part of all readings: only readings of one source *and* cell are ever brought together. What
crosses cell borders needs each cell's first and last reading alone, and those are as many as there are cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

COUNTER, LEVEL = "counter", "level"
READ, FILLED, UNCOVERED = "read", "filled", "uncovered"


def moment_of(d: Column) -> Column:
    """The moment a spelled reading time names: ISO date and time with ``T`` or a blank, with or without an offset
    (without: UTC), fourteen digits (to the second), twelve (to the minute) or ten (an hour). Null for all else."""
    s = F.trim(d)
    digits = F.regexp_replace(F.rpad(s, 14, "0"), r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "$1-$2-$3T$4:$5:$6")
    iso = F.regexp_replace(F.regexp_replace(s, r"\s*(Z|z|UTC)$", "+00:00"), r"([+-]\d{2})(\d{2})$", "$1:$2")
    whole = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}(:\d{2}([.]\d+)?)?([+-]\d{2}:\d{2})?$"
    text = F.when(s.rlike(r"^\d{10}(\d{2}){0,2}$"), digits).when(iso.rlike(whole), iso)
    offset = text.rlike(r"[+-]\d{2}:\d{2}$")
    return F.when(offset, text).otherwise(F.concat(text, F.lit("+00:00"))).try_cast("timestamp")


def regrid(readings: DataFrame, source: str, at: str, value: str, order: str, kind: str = LEVEL, step_s: int = 3600, max_gap_s: int = 6 * 3600) -> DataFrame:
    """One row per source and cell from the cell of its first to that of its last usable reading:
    ``(<source>, cell, readings, resets, value, state)``.

    ``at``: a timestamp column. Usable readings have a source, a moment and a value. Of several readings at one moment
    the one with the latest ``order`` holds, then the largest value. ``cell`` is the cell's start. ``value``: for a
    ``counter`` what accrued in the cell, for a ``level`` its mean over the covered part of the cell. ``state``:
    ``read`` (a usable reading falls into the cell), ``filled``, or ``uncovered`` (null value: the readings around it
    lie more than ``max_gap_s`` apart). A source with one reading has one cell. Empty input gives no rows.
    """
    step = F.lit(step_s)
    per = W.partitionBy("_s", "_cell").orderBy("_at")
    use = (
        readings.select(F.col(source).alias("_s"), (F.unix_micros(at) / 1e6).alias("_at"), F.struct(F.col(order).alias("o"), F.col(value).alias("v")).alias("_p"))
        .where(F.col("_s").isNotNull() & F.col("_at").isNotNull() & F.col("_p.v").isNotNull())
        .groupBy("_s", "_at")
        .agg(F.max("_p").alias("_p"))
        .select("_s", "_at", F.col("_p.v").cast("double").alias("_v"), F.floor(F.col("_at") / step).alias("_cell"))
    )

    def accrued(v0: Column, v1: Column, t0: Column, t1: Column) -> Column:
        return F.when(v1 >= v0, v1 - v0).otherwise(v1) if kind == COUNTER else v0 * (t1 - t0)

    t1, v1 = F.lead("_at").over(per), F.lead("_v").over(per)
    cells = (
        use.withColumns({"_t1": t1, "_v1": v1})
        .groupBy("_s", "_cell")
        .agg(
            F.count("*").alias("readings"),
            F.coalesce(F.sum(accrued(F.col("_v"), F.col("_v1"), F.col("_at"), F.col("_t1"))), F.lit(0.0)).alias("_in"),
            F.sum((F.col("_v1") < F.col("_v")).cast("int")).alias("_drops"),
            F.min("_at").alias("_t0"), F.max("_at").alias("_tn"), F.min_by("_v", "_at").alias("_v0"), F.max_by("_v", "_at").alias("_vn"),
        )
    )
    by = W.partitionBy("_s").orderBy("_cell")
    cells = cells.withColumns(
        {"_p_t": F.lag("_tn").over(by), "_p_v": F.lag("_vn").over(by), "_n_t": F.lead("_t0").over(by), "_n_v": F.lead("_v0").over(by), "_n_cell": F.lead("_cell").over(by)}
    )

    def amount(v0: str, v1: str, t0: str, t1: str, secs: Column) -> Column:
        """What the interval from t0 to t1 gives to ``secs`` seconds of it; nothing where it is too long."""
        span = F.col(t1) - F.col(t0)
        return F.when(span <= max_gap_s, accrued(F.col(v0), F.col(v1), F.col(t0), F.col(t1)) * F.try_divide(secs, span))

    start, end = F.col("_cell") * step, (F.col("_cell") + 1) * step
    head_s, tail_s = F.col("_t0") - F.greatest(start, F.col("_p_t")), F.least(end, F.col("_n_t")) - F.col("_tn")
    head, tail = amount("_p_v", "_v0", "_p_t", "_t0", head_s), amount("_vn", "_n_v", "_tn", "_n_t", tail_s)
    total = F.col("_in") + F.coalesce(head, F.lit(0.0)) + F.coalesce(tail, F.lit(0.0))
    covered = (F.col("_tn") - F.col("_t0")) + F.when(head.isNotNull(), head_s).otherwise(0.0) + F.when(tail.isNotNull(), tail_s).otherwise(0.0)
    own = total if kind == COUNTER else F.coalesce(F.try_divide(total, covered), F.col("_vn"))
    between = amount("_vn", "_n_v", "_tn", "_n_t", step.cast("double"))
    fill = between if kind == COUNTER else between / step
    last = F.greatest(F.coalesce(F.col("_n_cell") - 1, F.col("_cell")), F.col("_cell"))
    resets = F.coalesce("_drops", F.lit(0)) + F.coalesce((F.col("_v0") < F.col("_p_v")).cast("int"), F.lit(0)) if kind == COUNTER else F.lit(0)
    return (
        cells.select("_s", "_cell", "readings", resets.alias("_resets"), own.alias("_own"), fill.alias("_fill"), F.explode(F.sequence("_cell", last)).alias("_c"))
        .withColumn("_is", F.col("_c") == F.col("_cell"))
        .select(
            F.col("_s").alias(source), F.timestamp_seconds(F.col("_c") * step).alias("cell"),
            F.when(F.col("_is"), F.col("readings")).otherwise(0).cast("bigint").alias("readings"), F.when(F.col("_is"), F.col("_resets")).otherwise(0).cast("bigint").alias("resets"),
            F.when(F.col("_is"), F.col("_own")).otherwise(F.col("_fill")).alias("value"),
            F.when(F.col("_is"), READ).when(F.col("_fill").isNotNull(), FILLED).otherwise(UNCOVERED).alias("state"),
        )
    )


def hourly_grid(live_points: DataFrame, max_gap_s: int = 6 * 3600) -> DataFrame:
    """``(series_id, slot, readings, value, state)`` per series and UTC hour, the readings taken as levels."""
    points = live_points.select("series_id", moment_of(F.col("d")).alias("at"), "v", "seen_at")
    return regrid(points, "series_id", "at", "v", "seen_at", LEVEL, 3600, max_gap_s).select(
        "series_id", F.date_format("cell", "yyyyMMddHH").alias("slot"), "readings", "value", "state"
    )


def hours_without_reading(live_points: DataFrame) -> DataFrame:
    """``(series_id, slot)``: hours of the grid in which no usable reading falls, filled or not."""
    return hourly_grid(live_points).where(F.col("state") != READ).select("series_id", "slot")

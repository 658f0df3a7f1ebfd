"""Detectors of what makes a comparison unsafe, and the rubric that turns them into a confidence.

Spikes are judged on the damped scale log(1 + views) by robust z-scores (median and median absolute deviation of the
whole series); breaks of level by the best split of the monthly series; the rubric deducts a fixed cost per problem.
Monthly detectors work on one array per series, which has as many elements as its span has months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.rounding import array_median, damped, let, percent_change, round_half, round_near, round_up_half
from .series import BY, comparison_columns, comparison_sums, normalized

#: Robust z from which a value is a spike, and the factor that relates deviation and standard deviation.
Z_LIMIT, Z_SCALE = 3.5, 0.6745
#: Where most values are equal a spike is this many times the median. More hits than a share of the days are no spikes.
MIN_RATIO, MOST_HITS, MOST_SHARE = 4.0, 5, 0.05
#: Break of level: months on either side, ratio, share of the whole change, least top level.
MIN_SIDE, BREAK_RATIO, BREAK_SHARE, BREAK_LEVEL = 4, 1.8, 0.6, 100
#: Months that may stand out, months needed.
MOST_MONTHS, LEAST_MONTHS = 3, 6


def robust_z(daily: DataFrame) -> DataFrame:
    """``daily`` with ``x`` (damped views), ``med``, ``mad`` (of the series) and ``z`` (null where the deviation is 0)."""
    whole = W.partitionBy(BY)
    rows = daily.withColumn("x", damped(F.col("views"))).withColumn("med", F.median("x").over(whole))
    rows = rows.withColumn("mad", F.median(F.abs(F.col("x") - F.col("med"))).over(whole))
    return rows.withColumn("z", F.when(F.col("mad") > 0, Z_SCALE * (F.col("x") - F.col("med")) / F.col("mad")))


def marked_spikes(daily: DataFrame) -> DataFrame:
    """``daily`` with ``z`` and ``spike``, whether the day is one; no day is in a series that is scattered rather than spiky."""
    whole = W.partitionBy(BY)
    filled = F.coalesce("views", F.lit(0))
    rows = robust_z(daily).withColumns({"_m": F.median(filled).over(whole), "_n": F.count("*").over(whole)})
    level = F.col("_m") >= 1
    equal = level & (filled >= F.greatest(MIN_RATIO * F.col("_m"), F.col("_m") + 1))
    rows = rows.withColumn("_hit", F.coalesce(F.when(F.col("mad") > 0, F.col("z") > Z_LIMIT).otherwise(equal), F.lit(False)))
    rows = rows.withColumn("_hits", F.count_if("_hit").over(whole))
    most = F.greatest(F.lit(MOST_HITS), round_up_half(MOST_SHARE * F.col("_n")))
    return rows.withColumn("spike", F.col("_hit") & (F.col("_hits") <= most)).drop("_m", "_n", "_hit", "_hits", "x", "med", "mad")


def detect_spikes(daily: DataFrame) -> DataFrame:
    """``(series_id, day, views, z)`` of spike days; none for a series that is scattered rather than spiky."""
    return marked_spikes(daily).where("spike").select(BY, "day", "views", round_half(F.col("z"), 1).alias("z"))


def spike_summary(daily: DataFrame, spikes: DataFrame) -> DataFrame:
    """Per series ``(series_id, spike_days, spike_share)``: share of all views that fall on spike days (3 decimals)."""
    total = daily.groupBy(BY).agg(F.coalesce(F.sum("views"), F.lit(0)).alias("_t"))
    hit = spikes.groupBy(BY).agg(F.count("*").alias("_n"), F.coalesce(F.sum("views"), F.lit(0)).alias("_v"))
    share = F.when(F.col("_t") > 0, round_half(F.coalesce("_v", F.lit(0)) / F.col("_t"), 3)).otherwise(0.0)
    return total.join(hit, BY, "left").select(BY, F.coalesce("_n", F.lit(0)).alias("spike_days"), share.alias("spike_share"))


def complete_months(monthly: DataFrame) -> DataFrame:
    """One row per series: ``months``, the complete ones in order as ``array<struct<month,views>>`` (may be empty), and ``split``."""
    return with_split(monthly).groupBy(BY).agg(_months(), F.min("split").alias("split"))


def _months() -> Column:
    return F.array_sort(F.collect_list(F.when(F.col("complete"), F.struct("month", "views")))).alias("months")


def with_split(monthly: DataFrame) -> DataFrame:
    """``monthly`` with ``split`` (months before it) and ``difference``: where the means of the damped views of the complete months
    before and from there differ most, the first of equals; null for series with too few. Running means: one pass."""
    by = W.partitionBy(BY, "complete")
    upto = by.orderBy("month").rowsBetween(W.unboundedPreceding, -1)
    fro = by.orderBy("month").rowsBetween(W.currentRow, W.unboundedFollowing)
    x = damped(F.col("views"))
    rows = monthly.withColumns({"_k": F.row_number().over(by.orderBy("month")) - 1, "_all": F.count("*").over(by), "_b": F.avg(x).over(upto), "_a": F.avg(x).over(fro)})
    can = F.col("complete") & (F.col("_all") >= 2 * MIN_SIDE + 2) & F.col("_k").between(MIN_SIDE, F.col("_all") - MIN_SIDE)
    rows = rows.withColumn("_d", F.when(can, round_near(F.abs(F.col("_b") - F.col("_a")), 10)))
    series = W.partitionBy(BY)
    rows = rows.withColumn("difference", F.max("_d").over(series))
    return rows.withColumn("split", F.min(F.when(F.col("_d") == F.col("difference"), F.col("_k"))).over(series)).drop("_k", "_all", "_b", "_a", "_d")


def best_splits(monthly: DataFrame) -> DataFrame:
    """``(series_id, k, difference)`` of the series that have a split."""
    return with_split(monthly).where("split is not null").groupBy(BY).agg(F.min("split").alias("k"), F.max("difference").alias("difference"))


def changepoints(months: DataFrame) -> DataFrame:
    """Per series of :func:`complete_months` a struct ``changepoint`` (null: none): ``month``, ``direction``, ``ratio``,
    ``share_of_total_change``, ``before``, ``after``.

    A break is abrupt (the medians of three months on either side carry most of the whole change), large, and severed:
    no month after it reaches back to the level before.
    """
    three = F.lit(3)
    views = F.transform("months", lambda m: m["views"])

    def judged(x: Column, k: Column, b: Column, a: Column) -> Column:
        n, jump = F.size(x), b - a
        total = array_median(F.slice(x, 1, 3)) - array_median(F.slice(x, F.greatest(F.lit(1), n - 2), three))

        def with_share(share: Column) -> Column:
            pre, post = F.slice(views, F.lit(1), k), F.slice(views, k + 1, n - k)
            severed = F.when(jump > 0, F.array_max(post) < F.array_min(pre)).otherwise(F.array_min(post) > F.array_max(pre))
            ratio = F.exp(F.abs(jump))
            found = F.struct(
                F.get(F.col("months"), k)["month"].alias("month"), F.when(jump > 0, "drop").otherwise("rise").alias("direction"),
                let(ratio, lambda q: round_half(q, 1)).alias("ratio"), round_half(share, 2).alias("share_of_total_change"),
                round_up_half(F.expm1(b)).alias("before"), round_up_half(F.expm1(a)).alias("after"),
            )
            return F.when((F.array_max(views) >= BREAK_LEVEL) & (share >= BREAK_SHARE) & (ratio >= BREAK_RATIO) & severed, found)

        return let(let(total, lambda t: F.when(t == 0, 0.0).otherwise(jump / F.when(t != 0, t))), with_share)

    def at_split(x: Column, k: Column) -> Column:
        before, after = array_median(F.slice(x, F.greatest(F.lit(1), k - 2), F.least(three, k))), array_median(F.slice(x, k + 1, three))
        return F.when(k.isNotNull(), let(before, lambda b: let(after, lambda a: judged(x, k, b, a))))

    logs = F.transform("months", lambda m: damped(m["views"]))
    return months.withColumn("changepoint", let(logs, lambda x: at_split(x, F.col("split"))))


def monthly_spikes(months: DataFrame) -> DataFrame:
    """Per series of :func:`complete_months` a struct ``monthly_spike`` (null: none): ``months`` (month, views, z), ``count``,
    ``share_of_views``. The z that is compared is rounded to one decimal."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, m: s + m["views"])

    def hits(m: Column, med: Column, mad: Column, level: Column) -> Column:
        z = lambda x: let(Z_SCALE * (damped(x) - med) / F.when(mad > 0, mad), lambda q: round_half(q, 1))
        judged = F.transform(m, lambda e: F.struct(e["month"].alias("month"), e["views"].alias("views"), z(e["views"]).alias("z")))
        return F.when(mad > 0, F.filter(judged, lambda e: (e["z"] > Z_LIMIT) | ((level > 0) & (e["views"] >= MIN_RATIO * level))))

    def with_deviation(m: Column, x: Column, med: Column) -> Column:
        level = array_median(F.transform(m, lambda e: e["views"]))
        return let(array_median(F.transform(x, lambda v: F.abs(v - med))), lambda mad: let(level, lambda lv: hits(m, med, mad, lv)))

    months_ = F.col("months")
    found = let(F.transform("months", lambda m: damped(m["views"])), lambda x: let(array_median(x), lambda med: with_deviation(months_, x, med)))

    def spike(h: Column) -> Column:
        share = F.coalesce(let(F.try_divide(total(h), total(months_)), lambda q: round_half(q, 3)), F.lit(0.0))
        return F.when(F.size(h).between(1, MOST_MONTHS), F.struct(h.alias("months"), F.size(h).alias("count"), share.alias("share_of_views")))

    return months.withColumn("monthly_spike", let(F.when(F.size("months") >= LEAST_MONTHS, found), spike))


def change_without_spikes(daily: DataFrame, spikes: DataFrame, n: int = 365) -> DataFrame:
    """``(series_id, yoy_excl_spikes)``: change of the latest ``n`` days against the ``n`` before, spike days at the median of
    the others (1 decimal). Only series with spikes and at least ``2n`` days; null when the prior sum is 0."""
    whole = W.partitionBy(BY)
    rows = daily.join(spikes.select(BY, "day", F.lit(True).alias("_hit")), [BY, "day"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    v = F.coalesce("views", F.lit(0))
    rows = rows.withColumns({
        "_fill": F.median(F.when(~F.col("_hit"), v)).over(whole), "_n": F.count("*").over(whole), "_s": F.count_if("_hit").over(whole),
        "_rn": F.row_number().over(whole.orderBy(F.desc("day"))),
    })
    value = F.when(F.col("_hit"), F.col("_fill")).otherwise(v)
    g = rows.where((F.col("_s") > 0) & (F.col("_n") >= 2 * n) & F.col("_fill").isNotNull()).groupBy(BY).agg(
        F.sum(F.when(F.col("_rn") <= n, value)).alias("_r"), F.sum(F.when((F.col("_rn") > n) & (F.col("_rn") <= 2 * n), value)).alias("_p")
    )
    return g.select(BY, round_half(percent_change(F.col("_p"), F.col("_r")), 1).alias("yoy_excl_spikes"))


def break_evidence(breaks: DataFrame, log: DataFrame, revisions: DataFrame) -> DataFrame:
    """Per break ``(series_id, month, cause, events, kinds)``: log events from two months before to two months after make
    an ``article_event``, else revisions in that time ``edits_only``, else ``no_activity``.

    ``breaks``: ``(series_id, month)``; ``log``: ``(series_id, ts, kind)``; ``revisions``: ``(series_id, ts)``. The join is by
    series; the interval is a filter on its pairs, of which there are as many as events of series that broke.
    """
    spans = breaks.select(BY, "month", F.add_months("month", -2).cast("timestamp").alias("_a"), F.add_months("month", 2).cast("timestamp").alias("_b"))
    within = (F.col("ts") >= F.col("_a")) & (F.col("ts") < F.col("_b"))
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("ts", "kind"))), lambda e: e["kind"])
    events = spans.join(log, BY).where(within).groupBy(BY, "month").agg(F.count("*").alias("events"), F.array_join(F.array_distinct(kinds), ", ").alias("kinds"))
    edits = spans.join(revisions, BY).where(within).groupBy(BY, "month").agg(F.count("*").alias("_edits"))
    cause = F.when(F.col("events") > 0, "article_event").when(F.col("_edits") > 0, "edits_only").otherwise("no_activity")
    return spans.join(events, [BY, "month"], "left").join(edits, [BY, "month"], "left").select(BY, "month", cause.alias("cause"), F.coalesce("events", F.lit(0)).alias("events"), "kinds")


#: The rubric, as rule, cost, and whether it disqualifies.
RULES = (
    ("no_signal", 0.50, True), ("very_low_volume", 0.35, False), ("low_volume", 0.15, False), ("changepoint_article_event", 0.35, True),
    ("changepoint_unexplained", 0.35, True), ("spike_sign_flip", 0.30, False), ("monthly_spike", 0.25, False), ("spike_heavy", 0.20, False),
    ("sparse", 0.15, False), ("short_history", 0.20, False),
)
HIGH, MEDIUM = 0.7, 0.4


def _rule_tests() -> dict[str, tuple[Column, Column]]:
    """Per rule: when it fires, and why in words."""
    m = F.coalesce("median_daily", F.lit(0.0))
    cp, cause, spike = F.col("changepoint"), F.col("cause"), F.col("monthly_spike")
    share = lambda x: F.concat(round_up_half(x * 100).cast("string"), F.lit(" %"))
    facts = lambda **kv: F.concat_ws(", ", *[F.concat(F.lit(k.replace("_", " ") + ": "), v if isinstance(v, Column) else F.lit(v)) for k, v in kv.items()])
    a_day = lambda limit: facts(median_views_a_day=F.format_string("%.1f", m), wanted=f"at least {limit}")
    level = facts(
        new_level=F.concat(cp["direction"], F.lit(" by "), cp["ratio"].cast("string")), from_month=F.date_format(cp["month"], "yyyyMM"),
        views_a_month=F.concat(cp["before"].cast("string"), F.lit(" before, "), cp["after"].cast("string"), F.lit(" after")), log=F.coalesce(cause, F.lit("not looked up")),
    )
    return {
        "no_signal": (m < 1, a_day(1)),
        "very_low_volume": ((m >= 1) & (m < 10), a_day(10)),
        "low_volume": ((m >= 10) & (m < 50), a_day(50)),
        "changepoint_article_event": (cp.isNotNull() & cause.eqNullSafe("article_event"), level),
        "changepoint_unexplained": (cp.isNotNull() & ~cause.eqNullSafe("article_event"), level),
        "spike_sign_flip": (
            F.signum("yoy_excl_spikes") != F.signum("yoy_pct"),
            facts(change=F.concat(round_half(F.col("yoy_pct"), 1).cast("string"), F.lit(" %")), change_without_spike_days=F.concat(F.col("yoy_excl_spikes").cast("string"), F.lit(" %"))),
        ),
        "monthly_spike": (spike.isNotNull(), facts(outstanding_months=spike["count"].cast("string"), their_views=share(spike["share_of_views"]))),
        "spike_heavy": (F.col("spike_share") > 0.2, facts(views_on_spike_days=share(F.col("spike_share")))),
        "sparse": (F.col("days_missing_share") > 0.1, facts(days_without_a_count=share(F.col("days_missing_share")))),
        "short_history": (F.col("months_available") < 24, facts(complete_months=F.col("months_available").cast("string"), wanted="24")),
    }


def assess(signals: DataFrame) -> DataFrame:
    """``signals`` with ``reasons`` (array of ``id, cost, detail``, in the order of the rubric), ``score`` (2 decimals) and
    ``confidence``. A null signal fires no rule, but for the median, which counts as 0."""
    tests = _rule_tests()
    each = [
        F.struct(F.lit(r).alias("id"), F.lit(cost).alias("cost"), F.lit(dq).alias("dq"), F.coalesce(tests[r][0], F.lit(False)).alias("fired"), tests[r][1].alias("detail"))
        for r, cost, dq in RULES
    ]
    rows = signals.withColumn("_r", F.filter(F.array(*each), lambda r: r["fired"]))
    left = F.aggregate("_r", F.lit(1.0), lambda s, r: s - r["cost"])
    rows = rows.withColumn("score", round_half(F.greatest(F.lit(0.0), left), 2))
    label = F.when(F.exists("_r", lambda r: r["dq"]), "low").when(F.col("score") >= HIGH, "high").when(F.col("score") >= MEDIUM, "medium").otherwise("low")
    reasons = F.transform("_r", lambda r: F.struct(r["id"].alias("id"), r["cost"].alias("cost"), r["detail"].alias("detail")))
    return rows.withColumns({"confidence": label, "reasons": reasons}).drop("_r")


def profile(daily: DataFrame, totals: DataFrame, n: int, days: int = 90, half: int = 365) -> DataFrame:
    """All signals of every series of ``daily`` ``(series_id, project, day, views)``, one row each: the shares and counts of days, the median of
    the latest ``days``, spikes, what is left of the change over ``half`` days without them, breaks, outstanding months, the
    comparison of the latest ``n`` months with those before, and all ``monthly`` figures in order.

    One pass over the days: windows and both aggregations run on one partitioning by series, nothing is joined but the
    totals, a row per edition and month. A series is bounded by the calendar.
    """
    whole = W.partitionBy(BY)
    v = F.coalesce("views", F.lit(0))
    rows = marked_spikes(daily).withColumns({
        "_rn": F.row_number().over(whole.orderBy(F.desc("day"))), "_fill": F.median(F.when(~F.col("spike"), v)).over(whole),
        "_n": F.count("*").over(whole), "_s": F.count_if("spike").over(whole),
    })
    value = F.when(F.col("spike"), F.col("_fill")).otherwise(v)
    rows = rows.withColumn("month", F.trunc("day", "month").cast("date"))
    monthly = rows.groupBy(BY, "month").agg(
        F.first("project").alias("project"), F.coalesce(F.sum("views"), F.lit(0)).alias("views"), F.count("*").alias("days_present"), F.count_if(F.col("views").isNull()).alias("days_missing"),
        F.count_if(F.col("views") == 0).alias("days_zero"), F.collect_list(F.when(F.col("_rn") <= days, v)).alias("_last"), F.count_if("spike").alias("_spikes"),
        F.coalesce(F.sum(F.when(F.col("spike"), F.col("views"))), F.lit(0)).alias("_spike_views"), F.sum(F.when(F.col("_rn") <= half, value)).alias("_late"),
        F.sum(F.when((F.col("_rn") > half) & (F.col("_rn") <= 2 * half), value)).alias("_early"), F.first((F.col("_s") > 0) & (F.col("_n") >= 2 * half) & F.col("_fill").isNotNull()).alias("_told"),
    ).withColumn("complete", F.col("days_present") == F.day(F.last_day("month")))
    monthly, sums = comparison_sums(with_split(normalized(monthly, totals)), n)
    g = monthly.groupBy(BY).agg(
        F.first("project").alias("project"), *sums, _months(), F.min("split").alias("split"), F.sum("days_present").alias("_days"), F.sum("days_missing").alias("window_days_missing"),
        F.sum("days_zero").alias("window_days_zero"), F.flatten(F.collect_list("_last")).alias("_last"), F.sum("views").alias("_t"), F.sum("_spikes").alias("spike_days"), F.sum("_spike_views").alias("_sv"),
        F.sum("_late").alias("_l"), F.sum("_early").alias("_e"), F.first("_told").alias("_told"),
        F.array_sort(F.collect_list(F.struct("month", "views", "complete", "project_views", "per_million", "days_missing"))).alias("monthly"),
    )
    share = F.when(F.col("_t") > 0, round_half(F.col("_sv") / F.col("_t"), 3)).otherwise(0.0)
    out = monthly_spikes(changepoints(g)).select(
        BY, "project", *[c for c in comparison_columns(n)], array_median(F.col("_last")).cast("double").alias("median_daily"), "spike_days", share.alias("spike_share"),
        F.when(F.col("_told"), round_half(percent_change(F.col("_e"), F.col("_l")), 1)).alias("yoy_excl_spikes"),
        (F.col("window_days_missing") / F.col("_days")).alias("days_missing_share"), "window_days_missing", "window_days_zero", "changepoint", "monthly_spike", "monthly",
    )
    return out.withColumn("yoy_pct", F.col("raw.yoy_pct"))


def with_evidence(profiles: DataFrame, log: DataFrame | None, revisions: DataFrame | None) -> DataFrame:
    """``profiles`` with ``cause``, ``events`` and ``kinds`` of each series' break as in :func:`break_evidence`; null without a break or
    without tables to look into. Log and revisions are joined to the profiles, not the profiles to themselves."""
    if log is None or revisions is None:
        return profiles.withColumns({"cause": F.lit(None).cast("string"), "events": F.lit(None).cast("bigint"), "kinds": F.lit(None).cast("string")})
    seen = log.select(F.col(BY).alias("_s"), "ts", "kind", F.lit(True).alias("_log")).unionByName(
        revisions.select(F.col(BY).alias("_s"), F.date_trunc("hour", "ts").alias("_h"), "ts").groupBy("_s", "_h").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
        .select("_s", F.explode(F.array("a", "b")).alias("ts")).select("_s", "ts", F.lit(None).cast("string").alias("kind"), F.lit(False).alias("_log"))
    )
    month = F.col("changepoint.month")
    near = (F.col("_s") == F.col(BY)) & (F.col("ts") >= F.add_months(month, -2).cast("timestamp")) & (F.col("ts") < F.add_months(month, 2).cast("timestamp"))
    joined = profiles.join(seen, near, "left")
    kinds = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("_log"), F.struct("ts", "kind")))), lambda e: e["kind"])), ", ")
    g = joined.groupBy(BY).agg(F.first(F.struct(*[c for c in profiles.columns if c != BY])).alias("_p"), F.count_if("_log").alias("events"), F.count_if(~F.col("_log")).alias("_edits"), kinds.alias("kinds"))
    broke = F.col("_p.changepoint").isNotNull()
    cause = F.when(F.col("events") > 0, "article_event").when(F.col("_edits") > 0, "edits_only").otherwise("no_activity")
    return g.select(BY, "_p.*", F.when(broke, cause).alias("cause"), F.when(broke, F.col("events")).alias("events"), F.when(broke, F.col("kinds")).alias("kinds"))

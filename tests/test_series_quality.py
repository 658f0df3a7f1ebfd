from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trendspark.operators import quality, series

DAILY, MONTHLY = "series_id string, day date, views bigint", "series_id string, month date, views bigint, days_missing bigint, complete boolean, project_views bigint"


def daily(spark, values, start=date(2024, 1, 1), sid="s"):
    return spark.createDataFrame([(sid, start + timedelta(k), v) for k, v in enumerate(values)], DAILY)


def months(n, first=date(2024, 9, 1)):
    return [date(first.year + (first.month - 1 + k) // 12, (first.month - 1 + k) % 12 + 1, 1) for k in range(n)]


def monthly(spark, values, totals=None):
    return spark.createDataFrame([("s", m, v, 0, True, None if totals is None else totals[k]) for k, (m, v) in enumerate(zip(months(len(values)), values))], MONTHLY)


def test_axis_keeps_null_zero_and_absent_apart(spark):
    p = spark.createDataFrame([("s", date(2024, 1, 1), 5), ("s", date(2024, 1, 2), 0), ("s", date(2024, 1, 4), None), ("s", date(2030, 1, 1), 1)], "series_id string, day date, v bigint")
    d = series.on_axis(p, date(2024, 1, 1), date(2024, 1, 4))
    assert [r["views"] for r in d.orderBy("day").collect()] == [5, 0, None, None]
    (h,) = series.header(d).collect()
    assert (h["days"], h["days_missing"], h["days_zero"]) == (4, 2, 1)
    assert series.on_axis(p, date(2024, 1, 2), date(2024, 1, 1)).count() == 0


def test_rollup(spark):
    r = {x["month"].month: x for x in series.monthly_rollup(daily(spark, [10] * 31 + [10] * 10)).collect()}
    assert r[1]["complete"] and not r[2]["complete"] and r[2]["views"] == 100
    (j,) = series.monthly_rollup(daily(spark, [5] * 28 + [None] * 3)).collect()
    assert (j["views"], j["days_present"], j["days_missing"], j["complete"]) == (140, 31, 3, True)


def test_flat_views_of_a_shrinking_edition_gain_share(spark):
    c = series.compare_blocks(monthly(spark, [100] * 24, [1_000_000] * 12 + [500_000] * 12), 12).collect()[0]
    assert c["raw"]["yoy_pct"] == 0 and c["normalized"]["yoy_pct"] == pytest.approx(100) and not c["insufficient_history"]
    held = series.compare_blocks(monthly(spark, [100] * 24, [1_000_000] + [None] * 23), 12).collect()[0]
    assert held["normalized"]["unavailable"] and held["raw"]["prior"] == 1200
    few = series.compare_blocks(monthly(spark, [100] * 20, [1] * 20), 12).collect()[0]
    assert few["insufficient_history"] and few["raw"] is None and few["months_available"] == 20


def test_level(spark):
    assert series.median_daily(daily(spark, [10] * 89 + [100_000])).collect()[0][1] == 10
    assert series.median_daily(daily(spark, [None, None])).collect()[0][1] == 0


def test_quarters_beyond_66_months(spark):
    m = monthly(spark, [101] * 84).withColumn("project", F.lit("p"))
    q = series.period_matrix(m.withColumn("month", F.add_months("month", -8)), "project").collect()
    assert len(q) == 28 and {r["views"] for r in q} == {303}


@pytest.mark.parametrize(("values", "n"), [([100] * 199 + [50_000], 1), ([42] * 200, 0), ([100 + (i % 7) * 5 for i in range(200)], 0), ([], 0), ([0] * 50, 0), ([None] * 50, 0)])
def test_spikes(spark, values, n):
    assert quality.detect_spikes(daily(spark, values)).count() == n


def breaks(spark, values):
    return quality.changepoints(quality.complete_months(monthly(spark, values))).collect()[0]["changepoint"]


def test_breaks(spark):
    cp = breaks(spark, [2000] * 7 + [200] * 17)
    assert (cp["month"], cp["direction"], cp["ratio"], cp["before"], cp["after"]) == (date(2025, 4, 1), "drop", 10.0, 2000, 200)
    assert breaks(spark, [200] * 7 + [2000] * 17)["direction"] == "rise"
    assert breaks(spark, [round(4000 * 0.96**i) for i in range(24)]) is None
    assert breaks(spark, [30] * 12 + [3] * 12) is None
    assert breaks(spark, [2000] * 9) is None
    assert breaks(spark, [2000] * 12 + [200] * 6 + [3000] + [200] * 5) is None


def test_month_spikes(spark):
    s = quality.monthly_spikes(quality.complete_months(monthly(spark, [70, 72, 75, 69, 71, 424, 70, 74, 73, 68]))).collect()[0]["monthly_spike"]
    assert [m["views"] for m in s["months"]] == [424] and s["count"] == 1
    assert quality.monthly_spikes(quality.complete_months(monthly(spark, [2000] * 7 + [200] * 17))).collect()[0]["monthly_spike"] is None
    assert quality.monthly_spikes(quality.complete_months(monthly(spark, [1, 9, 2]))).collect()[0]["monthly_spike"] is None


def test_change_without_spikes(spark):
    d = daily(spark, [5000 if 400 <= i < 410 else 10 for i in range(730)])
    s = quality.detect_spikes(d)
    assert s.count() == 10 and quality.change_without_spikes(d, s).collect()[0][1] == 0.0
    short = daily(spark, [10] * 100 + [9000])
    assert quality.change_without_spikes(short, quality.detect_spikes(short)).count() == 0


def test_evidence(spark):
    b = spark.createDataFrame([("a", date(2025, 5, 1)), ("b", date(2025, 5, 1)), ("c", date(2025, 5, 1))], "series_id string, month date")
    log = spark.createDataFrame([("a", datetime(2025, 3, 1), "move/move"), ("a", datetime(2025, 6, 30, 23), "protect/modify"), ("a", datetime(2025, 6, 1), "move/move"), ("b", datetime(2025, 7, 1), "move/move")], "series_id string, ts timestamp, kind string")
    rev = spark.createDataFrame([("b", datetime(2025, 4, 1)), ("a", datetime(2025, 4, 1))], "series_id string, ts timestamp")
    got = {r["series_id"]: (r["cause"], r["events"], r["kinds"]) for r in quality.break_evidence(b, log, rev).collect()}
    assert got == {"a": ("article_event", 3, "move/move, protect/modify"), "b": ("edits_only", 0, None), "c": ("no_activity", 0, None)}


SIGNALS = """series_id string, median_daily double, changepoint struct<month:date,direction:string,ratio:double,before:bigint,after:bigint>, cause string, yoy_pct double, yoy_excl_spikes double,
monthly_spike struct<count:int,share_of_views:double>, spike_share double, days_missing_share double, months_available int"""
FINE = ("s", 500.0, None, None, -5.0, None, None, 0.0, 0.0, 24)


@pytest.mark.parametrize(
    ("change", "reasons", "confidence"),
    [
        ({}, [], "high"), ({1: None}, ["no_signal"], "low"), ({1: 0.5}, ["no_signal"], "low"), ({1: 5.0}, ["very_low_volume"], "medium"), ({1: 20.0}, ["low_volume"], "high"),
        ({2: (date(2025, 1, 1), "drop", 9.0, 900, 100), 3: "article_event"}, ["changepoint_article_event"], "low"), ({2: (date(2025, 1, 1), "drop", 9.0, 900, 100)}, ["changepoint_unexplained"], "low"),
        ({5: 3.0}, ["spike_sign_flip"], "high"), ({5: 0.0}, ["spike_sign_flip"], "high"), ({5: -1.0}, [], "high"), ({6: (1, 0.3)}, ["monthly_spike"], "high"), ({7: 0.21}, ["spike_heavy"], "high"),
        ({8: 0.11}, ["sparse"], "high"), ({9: 23}, ["short_history"], "high"), ({1: 20.0, 8: 0.5, 9: 3}, ["low_volume", "sparse", "short_history"], "medium"),
        ({1: 5.0, 6: (1, 0.3), 9: 3}, ["very_low_volume", "monthly_spike", "short_history"], "low"),
    ],
)
def test_rubric(spark, change, reasons, confidence):
    row = tuple(change.get(k, v) for k, v in enumerate(FINE))
    (r,) = quality.assess(spark.createDataFrame([row], SIGNALS)).collect()
    assert ([x["id"] for x in r["reasons"]], r["confidence"]) == (reasons, confidence)

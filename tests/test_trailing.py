from datetime import date, timedelta
import random

from hypothesis import HealthCheck, given, settings, strategies as st
import pytest

from trendspark.operators.trailing import dense_days, idle_and_peak_days, trailing_totals
from trendspark.sources.tables import holding_points

D0 = date(2024, 2, 20)


def brute(days: dict[date, int | None], w: int) -> dict[date, int]:
    out, d = {}, min(days)
    while d <= max(days):
        out[d] = sum(max(0, days.get(d - timedelta(k)) or 0) for k in range(w))
        d += timedelta(1)
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(0, 80), st.one_of(st.none(), st.integers(-5, 50)), min_size=1, max_size=40), st.integers(1, 12))
def test_totals_equal_brute_force(spark, points, w):
    days = {D0 + timedelta(k): v for k, v in points.items()}
    df = spark.createDataFrame([("s", d, v) for d, v in days.items()], "series_id string, day date, v bigint")
    got = {r["day"]: r[f"total_{w}"] for r in trailing_totals(df, (w,)).collect()}
    assert got == brute(days, w)


def test_many_series_at_once(spark):
    rng = random.Random(1)
    data = {s: {D0 + timedelta(rng.randrange(400)): rng.randrange(9) for _ in range(60)} for s in "abcdef"}
    df = spark.createDataFrame([(s, d, v) for s, x in data.items() for d, v in x.items()], "series_id string, day date, v bigint")
    rows = trailing_totals(df).collect()
    for s, x in data.items():
        for w in (7, 30):
            assert {r["day"]: r[f"total_{w}"] for r in rows if r["series_id"] == s} == brute(x, w)


CACHE = "series_id string, project string, d string, v bigint, fetched_at timestamp, day string, total_7 string"


def cache(spark, rows):
    from datetime import datetime

    return spark.createDataFrame([(s, None, d, v, None if f is None else datetime(2025, 1, f), "x", "y") for s, d, v, f in rows], CACHE)


def test_holding_point(spark):
    rows = [("s", "20240101", 1, 1), ("s", "2024-01-01", 2, 3), ("s", "2024010100", 3, 2), ("s", "20240102", 4, 1), ("s", "20240102", None, 2), ("s", "20240103", 7, None), ("s", "20240103", 9, 1), ("s", "nonsense", 1, 1), (None, "20240101", 1, 1), ("s", "20241399", 1, 1), ("s", None, 1, 1)]
    got = {(r["day"].isoformat(), r["v"]) for r in holding_points(cache(spark, rows * 2)).collect()}
    assert got == {("2024-01-01", 2), ("2024-01-02", None), ("2024-01-03", 9)}


def test_marks(spark):
    rows = [("s", "20240101", 5, 1), ("s", "20240110", 5, 1), ("s", "20240120", None, 1), ("z", "20240101", 0, 1), ("n", "20240101", -3, 1)]
    got = {tuple(r) for r in idle_and_peak_days(cache(spark, rows)).collect()}
    assert ("s", "20240101", 7, "peak") in got and ("s", "20240110", 30, "peak") in got
    assert {x[1] for x in got if x[0] == "s" and x[2:] == (7, "idle")} == {"20240108", "20240109", "20240117", "20240118", "20240119", "20240120"}
    assert {x[1:] for x in got if x[0] in "zn"} == {("20240101", 7, "idle"), ("20240101", 30, "idle")}


def test_empty(spark):
    e = cache(spark, [])
    assert idle_and_peak_days(e).count() == 0 and dense_days(holding_points(e)).count() == 0


def test_plan_shuffles_once_after_the_choice_of_points(spark):
    plan = trailing_totals(holding_points(cache(spark, [("s", "20240101", 5, 1)])))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("n", [1, 400])
def test_copies_of_one_point_change_nothing(spark, n):
    rows = [("s", "20240101", 5, 1)] * n + [("s", "20240102", 6, 1)]
    assert sorted(r["total_7"] for r in trailing_totals(holding_points(cache(spark, rows))).collect()) == [5, 11]

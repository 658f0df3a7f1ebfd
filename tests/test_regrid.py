from datetime import datetime, timedelta, timezone
import random

import pytest
from pyspark.sql import functions as F

from trendspark.operators.regrid import COUNTER, FILLED, LEVEL, READ, UNCOVERED, hourly_grid, hours_without_reading, moment_of, regrid

T0 = datetime(2024, 3, 1, 10, tzinfo=timezone.utc)
UTC = "s string, at timestamp, v double, o int, cell string"


def frame(spark, rows):
    return spark.createDataFrame([("a", T0 + timedelta(minutes=m), v, o, "x") for m, v, o in rows], UTC)


def test_moments(spark):
    cases = {
        "2024030110": "2024-03-01 10:00:00", "20240301101530": "2024-03-01 10:15:30", "2024-03-01 10:15:30": "2024-03-01 10:15:30", "2024-03-01T10:15:30Z": "2024-03-01 10:15:30",
        "2024-03-01T12:15:30+02:00": "2024-03-01 10:15:30", "2024-03-01T04:15:30-06:00": "2024-03-01 10:15:30", "2024-03-01T16:00:30+05:45": "2024-03-01 10:15:30", " 2024030110 ": "2024-03-01 10:00:00",
        "00000000": None, "n/a": None, "": None, None: None, "20240230 10": None, "2024133110": None, "12:30": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "d string").select("d", F.date_format(moment_of(F.col("d")), "yyyy-MM-dd HH:mm:ss").alias("m"))
    assert {r["d"]: r["m"] for r in df.collect()} == cases


def test_counter_keeps_what_accrued(spark):
    rng = random.Random(2)
    at, v, rows, accrued = 0, 100, [], 0
    for _ in range(60):
        rows.append((at, float(v), 1))
        step = rng.randrange(1, 200)
        at += step
        if rng.random() < 0.1:
            v = rng.randrange(5)
            accrued += v
        else:
            up = rng.randrange(9)
            v, accrued = v + up, accrued + up
    rows.append((at, float(v), 1))
    got = regrid(frame(spark, rows), "s", "at", "v", "o", COUNTER, 3600, 10**9).collect()
    assert sum(r["value"] for r in got) == pytest.approx(accrued)
    assert sum(r["resets"] for r in got) == sum(b[1] < a[1] for a, b in zip(rows, rows[1:]))
    assert len(got) == at // 60 + 1


def test_increment_by_overlap(spark):
    got = {r["cell"].hour: r for r in regrid(frame(spark, [(30, 0.0, 1), (150, 120.0, 1)]), "s", "at", "v", "o", COUNTER).collect()}
    assert [got[h]["value"] for h in (10, 11, 12)] == [30.0, 60.0, 30.0]
    assert [got[h]["state"] for h in (10, 11, 12)] == [READ, FILLED, READ]


def test_long_gaps_are_uncovered(spark):
    got = regrid(frame(spark, [(0, 5.0, 1), (600, 7.0, 1)]), "s", "at", "v", "o", LEVEL, 3600, 3600).collect()
    assert [r["state"] for r in sorted(got, key=lambda r: r["cell"])] == [READ] + [UNCOVERED] * 9 + [READ]
    assert all((r["value"] is None) == (r["state"] == UNCOVERED) for r in got)


def test_level_is_weighted_by_time(spark):
    got = {r["cell"].hour: r["value"] for r in regrid(frame(spark, [(0, 10.0, 1), (45, 30.0, 1), (60, 0.0, 1)]), "s", "at", "v", "o").collect()}
    assert got[10] == pytest.approx(15.0)


def test_one_moment_one_reading(spark):
    rows = [(0, 1.0, 1), (0, 2.0, 2), (0, 9.0, 1), (0, 2.0, 2), (5, None, 1)]
    (r,) = regrid(frame(spark, rows), "s", "at", "v", "o").collect()
    assert (r["readings"], r["value"]) == (1, 2.0)


def test_grid_of_points(spark):
    rows = [("a", "2024030110", 1), ("a", "2024-03-01T15:59:59+02:00", 2), ("a", "n/a", 3), ("a", "2024030112", None), ("b", "2024030110", None), (None, "2024030110", 1)]
    df = spark.createDataFrame([(s, "p", d, v, T0, 0) for s, d, v in rows], "series_id string, project string, d string, v bigint, seen_at timestamp, slot int")
    assert {tuple(r) for r in hours_without_reading(df).collect()} == {("a", "2024030111"), ("a", "2024030112")}
    assert hourly_grid(df.limit(0)).count() == 0

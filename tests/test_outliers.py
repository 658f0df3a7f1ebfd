import numpy as np
import pytest

from trendspark.operators import outliers
from trendspark.operators.outliers import implausible_points, judge


def made(level=200.0, n=240, seed=0, rhythm=0.2):
    rng = np.random.default_rng(seed)
    week = 1 + rhythm * np.sin(np.arange(7) * 2 * np.pi / 7)
    return rng.poisson(level * week[np.arange(n) % 7] * rng.gamma(100, 0.01, n)).astype(float)


def kinds(v, impossible=None):
    n = np.arange(len(v))
    return judge(np.zeros(len(v), int), n, v, np.zeros(len(v), bool) if impossible is None else impossible)


@pytest.mark.parametrize("level", [3.0, 20.0, 200.0, 20_000.0])
def test_plain_series_have_nothing(level):
    assert sum((kinds(made(level, seed=s)) != "").sum() for s in range(6)) <= 1


@pytest.mark.parametrize(("level", "at", "factor"), [(20.0, 60, 8.0), (200.0, 100, 5.0), (5000.0, 200, 4.0), (200.0, 0, 9.0), (200.0, 239, 9.0), (400.0, 120, 0.05)])
def test_spikes(level, at, factor):
    v = made(level)
    v[at] = round(v[at] * factor)
    assert list(np.flatnonzero(kinds(v) == "spike")) == [at]


def test_spike_of_three_days_beside_a_larger_one():
    v = made(300.0)
    v[100:103] *= 6
    v[104] *= 60
    assert list(np.flatnonzero(kinds(v) == "spike")) == [100, 101, 102, 104]


def test_rounds_go_on_until_nothing_is_added():
    """Spikes close together hide one another; two of these come to light after the fourth round."""
    rng = np.random.default_rng(2203)
    n = int(rng.integers(60, 240))
    v = made(float(rng.choice([20, 200, 2000])), n=n, seed=2203)
    first, width = int(rng.integers(5, n // 2)), int(rng.integers(10, 40))
    at = np.arange(first, min(n, first + width))
    at = at[rng.random(len(at)) < rng.uniform(0.3, 0.8)]
    v[at] = np.round(v[at] * np.exp(rng.uniform(0.3, rng.uniform(1, 7), len(at))))
    found = set(np.flatnonzero(kinds(v) == "spike"))
    assert {13, 19} <= found <= set(at) and len(found) == 9


def test_lasting_changes_and_waves_are_none():
    step = made(200.0)
    step[120:] *= 5
    t = np.arange(240)
    wave = np.round(made(200.0) * (1 + 3 * np.exp(-(((t - 120) / 25) ** 2))))
    season = np.round(made(500.0) * (1.5 + np.sin(t / 40)))
    assert not (np.concatenate([kinds(step), kinds(wave), kinds(season)]) != "").any()


def remembering(slope=0.85, level=2000.0, n=400, seed=0):
    """A series in which what is left of a day's deviation goes on for days."""
    rng = np.random.default_rng(seed)
    u = np.zeros(n)
    for t in range(1, n):
        u[t] = slope * u[t - 1] + 0.05 * rng.standard_normal()
    return np.round(level * np.exp(u))


def spikes(v, **how):
    n = np.arange(len(v))
    return set(np.flatnonzero(outliers._spikes(np.zeros(len(v), int), n, v, **how)))


def test_the_autoregression_decides():
    """Spikes that are large against the residuals, but not against the scatter of the series."""
    with_it = without = 0
    for seed in range(12):
        v = remembering(seed=seed)
        at = np.array([60, 150, 240, 330])
        v[at] = np.round(v[at] * np.exp(0.28))
        got = spikes(v)
        with_it += len(got & set(at))
        without += len(spikes(v, order=0) & set(at))
        assert not got - set(at)
    assert with_it >= 36 and without <= with_it - 10, (with_it, without)


def test_level_shifts_decide():
    """A dip on the second day of a new, higher level lies above the old one."""
    for seed in range(5):
        v = made(200.0, seed=seed, rhythm=0.0)
        v[120:] *= 5
        v[121] = 330
        assert spikes(v) == {121} and spikes(v, shifts=False) != {121}


def test_stuck_runs_against_own_scatter():
    v = made(200.0)
    v[50:57] = v[50]
    assert list(np.flatnonzero(kinds(v) == "stuck")) == list(range(50, 57))
    low = np.array([1, 1, 1, 2, 1, 1, 0, 1, 1, 1, 1, 2] * 20, float)
    assert not (kinds(low) != "").any()


def test_gaps_end_a_run_and_zero_is_never_stuck():
    v = made(200.0)
    v[50:57] = v[50]
    v[53] = np.nan
    assert not (kinds(v) == "stuck").any()
    z = made(200.0)
    z[50:80] = 0
    assert not (kinds(z) == "stuck").any()


def test_series_do_not_touch():
    a, b = made(10.0, 60), made(5000.0, 60, 1)
    k = judge(np.repeat([0, 1], 60), np.r_[np.arange(60), np.arange(60)], np.r_[a, b], np.zeros(120, bool))
    assert not (k != "").any()
    assert len(judge(np.array([], int), np.array([], int), np.array([]), np.array([], bool))) == 0


def frames(spark, rows, totals):
    from datetime import datetime

    t = datetime(2025, 1, 1)
    p = spark.createDataFrame([(s, "wrong", d, v, t, "k") for s, d, v in rows], "series_id string, project string, d string, v bigint, fetched_at timestamp, limit string")
    m = spark.createDataFrame([("s", "EN.wikipedia.org ", t), ("s", "de.wikipedia", datetime(2020, 1, 1))] * 2, "series_id string, project string, updated timestamp")
    return p, m, spark.createDataFrame(totals, "project string, ym string, v bigint")


def test_limits(spark):
    rows = [("s", "20240101", -1), ("s", "20240102", 1001), ("s", "20240103", 1000), ("s", "20240201", 10**9), ("t", "20240101", 10**9), ("s", "20240104", None)]
    got = implausible_points(*frames(spark, rows, [("en.wikipedia", "202401", 1000), ("en.wikipedia", "202401", 1000), ("en.wikipedia", "202402", 0), ("de.wikipedia", "202401", 5), (None, "202401", 1)]))
    assert {tuple(r) for r in got.collect()} == {("s", "20240101", "impossible"), ("s", "20240102", "impossible")}


def test_chunks_keep_series_whole(spark, monkeypatch):
    monkeypatch.setattr(outliers, "CHUNK", 50)
    import pyarrow as pa

    rows = []
    for s in range(5):
        v = made(200.0, 100, s)
        v[40] *= 9
        rows += [(f"s{s}", f"{i}", i, float(x), False, i) for i, x in enumerate(v)]
    t = pa.table(dict(zip(("series_id", "d", "n", "v", "impossible", "k"), zip(*rows))))
    out = [r for b in outliers._judged(iter(t.to_batches(max_chunksize=33))) for r in b.to_pylist()]
    assert [(r["series_id"], r["d"]) for r in out if r["kind"] == "spike"] == [(f"s{s}", "40") for s in range(5)]


def test_empty(spark):
    p, m, t = frames(spark, [], [("en.wikipedia", "202401", 1)])
    assert implausible_points(p, m, t).count() == 0

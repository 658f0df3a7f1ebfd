"""Implausible readings per series: impossible counts, stuck runs and spikes.

``impossible`` is a physical limit: below 0, or above all views of the series' edition in that month. ``stuck`` is a run
of consecutive days with one non-zero count that the series' own scatter would hardly ever produce. What is left is put
through a robust autoregression: counts are brought to a scale of constant scatter, the weekly rhythm is taken out, and
the deviations from the running median are regressed on those of the day before by biweights. A day's residual is what
the autoregression cannot foretell, from the days before it and, read backwards, from the days after it. A stretch of one to
four days is an additive outlier if both residuals are large in one direction on each of its days. A day that departs from
what was before, but agrees with what comes after, begins a new level: levels and running medians do not reach across it.
Outliers and level shifts found are taken into account and the tests repeated, so that a large spike does not hide a smaller
one beside it, until a round finds neither. Slow waves and seasons move the running median with them.

A series has at most one holding point per calendar day, so it is bounded by the calendar whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..sources.tables import current_meta, edition_of, holding_points

#: Half width of the running median, longest stretch that is a spike, days looked at on either side of it, and of a shift.
HALF, LONGEST, SIDE, SPAN = 7, 4, 4, 9
#: Deviation up and down, in scatters of the series, from which a stretch is a spike; expected number of chance runs of a stuck
#: run's length in its series, below which it is one.
CRITICAL_UP, CRITICAL_DOWN, CHANCE = 5.2, 5.6, 0.01
#: Residual, in scatters, from which a day begins a new level; slope below which a series counts as without memory.
CRITICAL_SHIFT, LEAST_SLOPE = 5.2, 0.12
#: Days worked on at a time.
CHUNK = 150_000


def _row_medians(m: np.ndarray) -> np.ndarray:
    """Median of each row, without NaN; NaN where a row has nothing else."""
    s = np.sort(m, axis=1)  # NaN last
    n = (~np.isnan(s)).sum(axis=1)
    at = np.arange(len(s))
    lo, hi = np.maximum(n - 1, 0) // 2, np.minimum(n // 2, s.shape[1] - 1)
    return np.where(n > 0, (s[at, lo] + s[at, hi]) / 2, np.nan)


def _windows(x: np.ndarray, first: int, last: int) -> np.ndarray:
    """Row t: ``x[t + first] .. x[t + last]``, NaN outside."""
    pad = max(-first, last, 0)
    p = np.concatenate([np.full(pad, np.nan), x, np.full(pad, np.nan)])
    v = np.lib.stride_tricks.sliding_window_view(p, last - first + 1)
    return v[pad + first : pad + first + len(x)]


def _group_medians(x: np.ndarray, g: np.ndarray, groups: int) -> np.ndarray:
    """Median of ``x`` (without NaN) in each group; NaN for empty groups."""
    ok = ~np.isnan(x)
    x, g = x[ok], g[ok]
    order = np.lexsort((x, g))
    x, n = x[order], np.bincount(g, minlength=groups)
    start = np.cumsum(n) - n
    out = np.full(groups, np.nan)
    has = n > 0
    out[has] = (x[(start + (n - 1) // 2)[has]] + x[(start + n // 2)[has]]) / 2
    return out


def _axis(series: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All series' readings on one axis: the position of every reading, and the series of every position (-1 between
    two series, where so many positions are empty that no window reaches from one into the other)."""
    gap = max(HALF, SPAN) + LONGEST + SIDE + 1
    code = np.cumsum(np.r_[0, series[1:] != series[:-1]])
    at = np.arange(len(series)) + code * gap
    owner = np.full(at[-1] + 1, -1)
    owner[at] = code
    return at, owner


def _stuck(series: np.ndarray, day: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which readings lie in a stuck run."""
    of = np.cumsum(np.r_[0, series[1:] != series[:-1]])
    n_series = of[-1] + 1
    follows = np.r_[False, (of[1:] == of[:-1]) & (day[1:] == day[:-1] + 1)]
    start = np.flatnonzero(~(follows & np.r_[False, (v[1:] == v[:-1]) & (v[1:] != 0)]))
    length = np.diff(np.r_[start, len(v)])
    length = length[np.repeat(np.arange(len(start)), length)]
    step = np.where(follows & (length < 5), np.abs(np.r_[np.nan, v[1:] - v[:-1]]), np.nan)
    scatter = 1.4826 * _group_medians(step, of, n_series)
    pairs = np.bincount(of[~np.isnan(step)], minlength=n_series)
    equal = np.bincount(of[step == 0], minlength=n_series)
    # the chance that two days agree: as often as seen in short runs, or as the scatter of the steps lets expect
    with np.errstate(divide="ignore", invalid="ignore"):
        p = np.fmax((equal + 0.5) / (pairs + 1.0), 1.0 / (np.sqrt(2 * np.pi) * scatter))
    p = np.clip(p, 1e-4, 1.0)
    expected = np.bincount(of, minlength=n_series)[of] * p[of] ** (length - 1)
    # a rare agreement may span a few days in any series: four at least make a run
    return (v != 0) & (length >= 4) & (expected < CHANCE)


def _same_segment(m: np.ndarray, x: np.ndarray, segment: np.ndarray, first: int, last: int) -> np.ndarray:
    """Windows of ``x`` without what lies beyond a level shift."""
    if not m.any():
        return _windows(x, first, last)
    return np.where(_windows(segment, first, last) == segment[:, None], _windows(x, first, last), np.nan)


def _autoregression(u: np.ndarray, of: np.ndarray, inside: np.ndarray, n_series: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Per series slope and scatter of an autoregression of the deviations ``u`` on the day before. The slope starts from the
    median of slopes and is fitted by biweights, so that no outlier bears on it; one that could be chance is 0."""
    before = np.r_[np.nan, u[:-1]]
    both = np.flatnonzero(inside & ~np.isnan(u) & ~np.isnan(before))
    g, y, x = of[both], u[both], before[both]
    n = np.bincount(g, minlength=n_series)
    scale = 1.4826 * _group_medians(np.where(inside, np.abs(u), np.nan), of, n_series)
    scale = np.where(np.isnan(scale), 1.0, np.maximum(scale, 0.9))
    if not order:
        return np.zeros(n_series), scale
    far = np.abs(x) > 0.7 * scale[g]
    slope = _group_medians(y[far] / x[far], g[far], n_series)
    slope = np.clip(np.where(np.isnan(slope), 0.0, slope), -0.5, 0.9)
    for _ in range(2):
        r = (y - slope[g] * x) / (4.685 * np.maximum(scale[g] * np.sqrt(1 - slope[g] ** 2), 0.5))
        # lags far out are as harmful as values far out
        w = np.square(np.maximum(1 - r * r, 0)) * np.square(np.maximum(1 - np.square(x / (4.685 * scale[g])), 0))
        top, low = np.bincount(g, w * x * y, n_series), np.bincount(g, w * x * x, n_series)
        slope = np.clip(np.divide(top, low, out=np.zeros(n_series), where=low > 0), -0.5, 0.9)
    slope = np.where(np.abs(slope) < np.maximum(LEAST_SLOPE, 2.5 / np.sqrt(np.maximum(n, 1))), 0.0, slope)
    sigma = 1.4826 * _group_medians(np.where(inside, np.abs(u - slope[of] * before), np.nan), of, n_series)
    return slope, np.fmax(sigma, scale * np.sqrt(1 - slope**2))


def _round(y: np.ndarray, found: np.ndarray, cut: np.ndarray, of: np.ndarray, inside: np.ndarray, weekday: np.ndarray, n_series: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """One round of tests: which positions are outliers, and at which a new level begins, given those found so far."""
    segment = np.cumsum(cut).astype(float)
    x = np.where(found, np.nan, y)
    base = _row_medians(_same_segment(cut, x, segment, -HALF, HALF))
    cell = np.where(inside, of * 7 + weekday, 0)
    rhythm = _group_medians(np.where(inside, x - base, np.nan), cell, n_series * 7)
    rhythm = np.where(np.isnan(rhythm), 0.0, rhythm)[cell]
    x, flat = x - rhythm, y - rhythm
    base = _row_medians(_same_segment(cut, x, segment, -HALF, HALF))
    u = x - base
    slope, sigma = _autoregression(u, of, inside, n_series, order)
    phi, unit = slope[of], sigma[of]
    total = unit / np.sqrt(1 - phi * phi)
    new = np.zeros(len(y), dtype=bool)
    left = _row_medians(_same_segment(cut, x, segment, -SIDE, -1))
    last = np.r_[np.nan, x[:-1]]
    last = np.where(np.isnan(last) | np.isnan(left) | cut, 0.0, last - left)  # the day before, against its level
    taken = _windows(found.astype(float), 0, LONGEST - 1)
    for length in range(1, LONGEST + 1):
        stretch = _windows(flat, 0, length - 1)
        right = _row_medians(_same_segment(cut, x, segment, length, length + SIDE - 1))
        following = np.r_[x[length:], np.full(length, np.nan)]
        following = np.where(np.isnan(following) | np.isnan(right), 0.0, following - right)
        up = inside & ~(np.isnan(left) & np.isnan(right)) & (np.nansum(taken[:, :length], axis=1) < length)
        down = up.copy()
        for k in range(length):
            v = stretch[:, k]
            gone = np.isnan(v)
            # residuals of the day, foretold from the side before and from the side after; an additive outlier departs from both
            # in one direction, the first day of a new level from one of them only
            around = np.where(np.isnan(left) | np.isnan(right), (v - base) / total, np.nan)  # for a side without readings
            ahead, behind = phi ** (k + 1), phi ** (length - k)
            forward, backward = v - left - ahead * last, v - right - behind * following
            s_f, s_b = unit * np.sqrt((1 - ahead**2) / (1 - phi**2)), unit * np.sqrt((1 - behind**2) / (1 - phi**2))
            top = np.fmin(np.fmin(forward / s_f, backward / s_b), around)
            bottom = np.fmax(np.fmax(forward / s_f, backward / s_b), around)
            up &= gone | (top > CRITICAL_UP)
            down &= gone | (bottom < -CRITICAL_DOWN)
        hit = np.flatnonzero(up | down)
        for k in range(length):
            new[np.minimum(hit + k, len(y) - 1)] = True
    new &= inside & ~np.isnan(y)
    # level shifts: the residual of one day is large, and the days on either side keep to levels that far apart
    clean = np.where(new, np.nan, x)
    before, after = _same_segment(cut, clean, segment, -SPAN, -1), _same_segment(cut, clean, segment, 0, SPAN - 1)
    enough = (np.count_nonzero(~np.isnan(before), axis=1) >= SPAN // 2 + 1) & (np.count_nonzero(~np.isnan(after), axis=1) >= SPAN // 2 + 1)
    low, high = _row_medians(before), _row_medians(after)
    step = clean - left - phi * last
    with np.errstate(invalid="ignore"):
        shift = inside & enough & (np.abs(step) > CRITICAL_SHIFT * unit) & (np.abs(high - low) > CRITICAL_SHIFT * unit) & (np.sign(step) == np.sign(high - low))
        shift &= (np.abs(clean - high) < 0.5 * np.abs(high - low)) & (np.abs(np.r_[np.nan, clean[:-1]] - low) < 0.5 * np.abs(high - low))
    # of shifts close together one a round: that whose two levels fit the days best
    misfit = np.full(len(y), np.inf)
    some = np.flatnonzero(shift)
    misfit[some] = np.nansum(np.abs(before[some] - low[some, None]), axis=1) + np.nansum(np.abs(after[some] - high[some, None]), axis=1)
    least = np.fmin.reduce(_windows(misfit, -SPAN, SPAN), axis=1)
    return new, shift & (misfit <= least)


def _spikes(series: np.ndarray, day: np.ndarray, values: np.ndarray, order: int = 1, shifts: bool = True) -> np.ndarray:
    """Which readings are spikes: additive outliers among the residuals of a robust autoregression, tested against level
    shifts, in rounds until one finds neither. Only series in which a round found something go on to the next.
    ``order`` 0 leaves out the autoregression, ``shifts`` the level shifts (to see what they do)."""
    code = np.cumsum(np.r_[0, series[1:] != series[:-1]])
    # counts scatter as their root plus a share of the level; this share decides where the scale turns from root to log
    n_all = code[-1] + 1
    logs = np.log(np.maximum(values, 0) + 0.5)
    at, owner = _axis(code)
    spaced = np.full(len(owner), np.nan)
    spaced[at] = logs
    rough = (spaced - _row_medians(_windows(spaced, -HALF, HALF)))[at]
    spread = 1.4826 * _group_medians(np.abs(rough), code, n_all)
    share = np.clip(spread**2 - 1.0 / np.maximum(_group_medians(values, code, n_all), 0.5), 0.002, 4.0)
    share = np.where(np.isnan(share), 0.05, share)[code]
    scaled = 2 * np.arcsinh(np.sqrt(share * (np.maximum(values, 0) + 0.375))) / np.sqrt(share)
    found, begins = np.zeros(len(values), dtype=bool), np.zeros(len(values), dtype=bool)
    rows = np.arange(len(values))
    while len(rows):  # what is found only grows, so this ends
        at, owner = _axis(code[rows])
        n_series = owner.max() + 1
        of, inside = np.where(owner < 0, 0, owner), owner >= 0
        place = lambda a, fill: (out := np.full(len(owner), fill), out.__setitem__(at, a))[0]
        new, shift = _round(place(scaled[rows], np.nan), place(found[rows], False), place(begins[rows], False), of, inside, place(day[rows] % 7, 0), n_series, order)
        more = new[at] & ~found[rows]
        step = shift[at] & ~begins[rows] if shifts else np.zeros(len(rows), dtype=bool)
        found[rows] |= more
        begins[rows] |= step
        changed = np.bincount(owner[at][more | step], minlength=n_series) > 0
        rows = rows[changed[owner[at]]]
    return found


def judge(series: np.ndarray, day: np.ndarray, v: np.ndarray, impossible: np.ndarray) -> np.ndarray:
    """Per point ``impossible``, ``stuck``, ``spike`` or ``''``. Points are sorted by series and day, at most one each;
    ``series`` are codes, ``v`` has NaN for null."""
    out = np.full(len(v), "", dtype=object)
    if not len(v):
        return out
    for kind, test in (("stuck", _stuck), ("spike", _spikes)):
        left = np.flatnonzero(~impossible & ~np.isnan(v) & (out == ""))
        if len(left):
            out[left[test(series[left], day[left], v[left])]] = kind
    out[impossible] = "impossible"
    return out


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole series, sorted by series and day, in; flagged rows out. Holds one chunk and its last series."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        code = t["series_id"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        v = t["v"].to_numpy().astype(float)
        kind = judge(code, t["n"].to_numpy(), v, t["impossible"].to_numpy(zero_copy_only=False))
        hit = np.flatnonzero(kind != "")
        t = t.take(pa.array(hit))
        return pa.RecordBatch.from_arrays([t["series_id"].combine_chunks(), t["d"].combine_chunks(), pa.array(list(kind[hit]), pa.string())], ["series_id", "d", "kind"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        if rows >= CHUNK:
            # the series that is still open goes on with the next batch
            ids = pa.Table.from_batches(held)["series_id"].to_numpy()
            others = np.flatnonzero(ids != ids[-1])
            cut = int(others[-1]) + 1 if len(others) else 0
            if cut:
                t = pa.Table.from_batches(held).combine_chunks()
                yield flush(t.slice(0, cut).to_batches())
                held = t.slice(cut).to_batches()
                rows = len(ids) - cut
        held.append(b)
        rows += b.num_rows
    if held:
        yield flush(held)


def implausible_points(point_cache: DataFrame, series_meta: DataFrame, project_totals: DataFrame) -> DataFrame:
    """``(series_id, d, kind)`` of the holding points that are ``impossible``, ``stuck`` or a ``spike``.

    A null value is none of them and breaks a run; a series without coverage record has no upper limit; a month without
    a positive total has none either. Repeated rows of any table change nothing. Empty points give no rows.
    """
    meta = current_meta(series_meta.select("series_id", "project", "updated")).select("series_id", edition_of(F.col("project")).alias("project"))
    totals = (
        project_totals.where("v > 0").groupBy(edition_of(F.col("project")).alias("project"), F.trim("ym").alias("ym")).agg(F.max("v").alias("limit"))
    )
    points = (
        holding_points(point_cache)
        .join(meta, "series_id", "left")
        .withColumn("ym", F.date_format("day", "yyyyMM"))
        .join(totals, ["project", "ym"], "left")
        # the window asks for whole series, in order of days, in one partition each
        .withColumn("k", F.row_number().over(W.partitionBy("series_id").orderBy("day")))
        .select(
            "series_id", F.date_format("day", "yyyyMMdd").alias("d"), F.unix_date("day").cast("bigint").alias("n"), F.col("v").cast("double").alias("v"),
            F.coalesce((F.col("v") < 0) | (F.col("v") > F.col("limit")), F.lit(False)).alias("impossible"), "k",
        )
    )
    return points.mapInArrow(_judged, "series_id string, d string, kind string")

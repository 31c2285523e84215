"""Baselines: what a source's magnitude would be without an event. Each adds baseline, resid and sigma_resid.

A source's points are dealt out once by source (or source and camera), for windows and for the kernel of rolling
medians alike. A halving search for a window
with enough points always ends as the first window did, since a shorter one holds no more; one frame says the same.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .clean import SOURCE, Keys
from .groups import Columns, percentiles, rows_of, spans, with_kernel, with_percentiles

#: Makes the median absolute deviation a standard deviation; least sigma.
MAD_FACTOR, LEAST_SIGMA = 1.4826, 1e-6


def frame(keys: Keys, days: float, past_only: bool = True) -> str:
    """SQL of a window over time: `days` before each point, or half before and half after. Both ends count."""
    around = f"{float(days)!r}D preceding and current row" if past_only else f"{days / 2!r}D preceding and {days / 2!r}D following"
    return f"(partition by {', '.join(keys)} order by jd range between {around})"


def _middle_deviation(held: list[float], middle: float, at: int) -> float:
    """Of sorted values, the median of their distances from `middle`, where the first `at` lie below it: the distances
    above grow to the right and those below to the left, so the k-th of both is found by halving."""

    def kth(k: int) -> float:
        low, high = max(0, k - (len(held) - at)), min(k, at)
        while low < high:  # how many of the k + 1 least distances, less one, lie below
            take = (low + high) // 2
            if middle - held[at - 1 - take] < held[at + k - take - 1] - middle:
                low = take + 1
            else:
                high = take
        below = middle - held[at - 1 - low] if low < at else float("inf")
        above = held[at + k - low] - middle if at + k - low < len(held) else float("inf")
        return min(below, above)

    n = len(held)
    return (kth((n - 1) // 2) + kth(n // 2)) / 2


def sliding(t: np.ndarray, x: np.ndarray, before: float, after: float, least: int, deviation: bool = False) -> np.ndarray:
    """For each time in order, the median of the values between so many days before and after it, both ends and equal
    times included, or their median absolute deviation; NaN for fewer than `least`. The window is kept sorted while it
    moves, and both medians are found in it by halving, so a point costs its searches and the shift of the window."""
    out = np.full(len(t), np.nan)
    starts, ends = np.searchsorted(t, t - before, side="left"), np.searchsorted(t, t + after, side="right")
    held: list[float] = []
    values = x.tolist()
    a = b = 0
    for i, (start, end) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        for v in values[b:end]:
            if v == v:
                insort(held, v)
        b = max(b, end)
        for v in values[a:start]:
            if v == v:
                del held[bisect_left(held, v)]
        a, n = start, len(held)
        if n >= max(least, 1):
            middle = (held[(n - 1) // 2] + held[n // 2]) / 2
            out[i] = _middle_deviation(held, middle, bisect_left(held, middle)) if deviation else middle
    return out


def _slid(t: np.ndarray, x: np.ndarray, starts: np.ndarray, before: float, after: float, least: int, deviation: bool = False) -> np.ndarray:
    """`sliding` over each group's points that have a time."""
    found = np.full(len(t), np.nan)
    for s in spans(starts):
        timed = np.flatnonzero(~np.isnan(t[s])) + s.start
        found[timed] = sliding(t[timed], x[timed], before, after, least, deviation)
    return found


def rolled(points: DataFrame, to: str, value: str, keys: Keys, days: float, least_points: int = 10, past_only: bool = True, deviation: bool = False) -> DataFrame:
    """points with a rolling median of a column (or its median absolute deviation), by a kernel over each group's points
    in time; null where there are too few. Points without a time have none."""
    before, after = (days, 0.0) if past_only else (days / 2, days / 2)

    def roll(columns: Columns, starts: np.ndarray) -> Columns:
        return {to: _slid(columns["jd"], columns["_x"], starts, before, after, least_points, deviation)}

    return with_kernel(points.withColumn("_x", F.col(value)), keys, ("jd", "_x"), roll, f"{to} double", ("jd",)).drop("_x")


def rolling_mean(value: str, keys: Keys, days: float, least_points: int = 10, past_only: bool = True) -> Column:
    f = frame(keys, days, past_only)
    return F.expr(f"case when count({value}) over {f} >= {least_points} then avg({value}) over {f} end")


def rolling_mad(points: DataFrame, value: str, keys: Keys, days: float, least_points: int = 10, add_error: str | None = None, past_only: bool = True, to: str = "sigma") -> DataFrame:
    """points with 1.4826 times the rolling MAD of a column, in quadrature with an error column if one is named."""
    mad = MAD_FACTOR * F.col(to)
    if add_error:
        mad = F.sqrt(mad * mad + F.coalesce(F.col(add_error), F.lit(0.0)) ** 2)
    rows = rolled(points, to, value, keys, days, least_points, past_only, deviation=True)
    return rows.withColumn(to, F.when(F.col(to).isNotNull(), F.greatest(mad, F.lit(LEAST_SIGMA))))


def with_robust_sigma(points: DataFrame, keys: Keys) -> DataFrame:
    """points (with resid) with robust_sigma of the residuals of their group, the error's median in quadrature."""
    out = with_percentiles(points, keys, "resid", _m=0.5).withColumn("_d", F.abs(F.col("resid") - F.col("_m")))
    out = with_percentiles(with_percentiles(out, keys, "_d", _spread=0.5), keys, "error", _typical=0.5)
    total = F.sqrt((MAD_FACTOR * F.coalesce(F.col("_spread"), F.lit(0.0))) ** 2 + F.coalesce(F.col("_typical"), F.lit(0.0)) ** 2)
    return out.withColumn("robust_sigma", F.greatest(total, F.lit(LEAST_SIGMA))).drop("_m", "_d", "_spread", "_typical")


def _robust_sigma(resid: np.ndarray, error: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """robust_sigma of each row's group."""
    away = np.abs(resid - rows_of(percentiles(resid, starts, 0.5)[0], starts))
    spread, typical = np.nan_to_num(percentiles(away, starts, 0.5)[0]), np.nan_to_num(percentiles(error, starts, 0.5)[0])
    return rows_of(np.maximum(np.sqrt((MAD_FACTOR * spread) ** 2 + typical**2), LEAST_SIGMA), starts)


def _finished(points: DataFrame, baseline: Column, keys: Keys) -> DataFrame:
    out = points.withColumn("baseline", baseline).withColumn("resid", F.col("mag") - F.col("baseline"))
    return with_robust_sigma(out, keys).withColumn("sigma_resid", F.col("resid") / F.col("robust_sigma")).drop("robust_sigma")


def _by_kernel(points: DataFrame, keys: Keys, baseline: Callable[[Columns, np.ndarray], np.ndarray]) -> DataFrame:
    """points with baseline, resid and sigma_resid, where a function of a batch of groups makes the baseline: one pass for all three."""

    def make(columns: Columns, starts: np.ndarray) -> Columns:
        found = baseline(columns, starts)
        resid = columns["mag"] - found
        return {"baseline": found, "resid": resid, "sigma_resid": resid / _robust_sigma(resid, columns["error"], starts)}

    return with_kernel(points.drop("baseline", "resid", "sigma_resid"), keys, ("jd", "mag", "error"), make, "baseline double, resid double, sigma_resid double", ("jd",))


def global_mean(points: DataFrame, keys: Keys = SOURCE) -> DataFrame:
    return _finished(points, F.avg("mag").over(W.partitionBy(*keys)), keys)


def global_median(points: DataFrame, keys: Keys = SOURCE) -> DataFrame:
    return _finished(with_percentiles(points.drop("baseline"), keys, "mag", baseline=0.5), F.col("baseline"), keys)


def global_rolling_median(points: DataFrame, keys: Keys = SOURCE, days: float = 1000.0, least_points: int = 10, past_only: bool = True) -> DataFrame:
    before, after = (days, 0.0) if past_only else (days / 2, days / 2)
    return _by_kernel(points, keys, lambda c, starts: _slid(c["jd"], c["mag"], starts, before, after, least_points))


def global_rolling_mean(points: DataFrame, keys: Keys = SOURCE, days: float = 1000.0, least_points: int = 10, past_only: bool = True) -> DataFrame:
    return _finished(points, rolling_mean("mag", keys, days, least_points, past_only), keys)


def per_camera_mean(points: DataFrame, keys: Keys = SOURCE) -> DataFrame:
    return global_mean(points, (*keys, "camera"))


def per_camera_median(points: DataFrame, keys: Keys = SOURCE, days: float = 300.0, least_points: int = 10, past_only: bool = True) -> DataFrame:
    return global_rolling_median(points, (*keys, "camera"), days, least_points, past_only)


def per_camera_trend(points: DataFrame, keys: Keys = SOURCE, days_short: float = 50.0, days_long: float = 800.0, least_points: int = 10, last_window_guard: float = 120.0, apart: float = 0.05) -> DataFrame:
    """The long rolling median, or the short one where both exist and are more than `apart` magnitudes apart or only it
    exists. Sigma is a rolling MAD; the last days of a camera, where an event may have cut it off, and other gaps get
    the whole camera's and the least sigma."""

    def trend(columns: Columns, starts: np.ndarray) -> Columns:
        t, mag, error = columns["jd"], columns["mag"], columns["error"]
        short, long = (_slid(t, mag, starts, days, 0.0, least_points) for days in (days_short, days_long))
        baseline = np.where(np.isnan(long) | (np.abs(short - long) > apart), short, long)
        resid = mag - baseline
        typical = rows_of(np.nan_to_num(percentiles(error, starts, 0.5)[0]), starts)
        recent = _slid(t, resid, starts, days_short, 0.0, max(8, least_points // 2), True)
        late = t >= rows_of(np.fmax.reduceat(t, starts[:-1]), starts) - last_window_guard
        other = np.where(late, _robust_sigma(resid, error, starts), LEAST_SIGMA)
        sigma = np.where(np.isnan(recent), other, np.maximum(np.sqrt((MAD_FACTOR * recent) ** 2 + typical**2), LEAST_SIGMA))
        return {"baseline": baseline, "resid": resid, "sigma_resid": resid / sigma}

    kept = points.drop("baseline", "resid", "sigma_resid")
    return with_kernel(kept, (*keys, "camera"), ("jd", "mag", "error"), trend, "baseline double, resid double, sigma_resid double", ("jd",))


def near_flagged(points: DataFrame, keys: Keys, flag: str, days: float, to: str) -> DataFrame:
    """points with whether a flagged point of their group lies within so many days."""
    around = f"(partition by {', '.join(keys)} order by jd range between {float(days)!r}D preceding and {float(days)!r}D following)"
    return points.withColumn(to, F.expr(f"max(cast({flag} as int)) over {around}") == 1)


def masked_points(points: DataFrame, keys: Keys = ("source_id", "camera"), threshold: float = -1.0, pad_days: float = 100.0, sign: int = 1) -> DataFrame:
    """points with `masked`: those near an excursion, for a baseline fitted to the rest. sign 1 flags brightenings as
    the original method does, -1 flags dips."""
    out = with_percentiles(points, keys, "mag", _middle=0.5)
    out = with_robust_sigma(out.withColumn("resid", F.col("mag") - F.col("_middle")), keys)
    out = out.withColumn("flagged", sign * F.col("resid") / F.col("robust_sigma") < threshold)
    return near_flagged(out, keys, "flagged", pad_days, "masked").drop("_middle", "resid", "robust_sigma")


def gp(points: DataFrame, keys: Keys = SOURCE, **parameters: float) -> DataFrame:
    from .kernels import per_camera_gp

    return per_camera_gp(points, keys, **parameters)


def gp_masked(points: DataFrame, keys: Keys = SOURCE, **parameters: float) -> DataFrame:
    from .kernels import per_camera_gp

    return per_camera_gp(masked_points(points, (*keys, "camera")), keys, masked=True, **parameters)


#: Baselines by name; each takes points, keys and its own parameters.
BASELINES: dict[str, Callable[..., DataFrame]] = {
    "global_mean": global_mean, "global_median": global_median, "global_rolling_median": global_rolling_median, "global_rolling_mean": global_rolling_mean,
    "per_camera_mean": per_camera_mean, "per_camera_median": per_camera_median, "per_camera_trend": per_camera_trend, "per_camera_gp": gp, "per_camera_gp_masked": gp_masked,
}


def baseline_by_name(name: str) -> Callable[..., DataFrame]:
    """A registered baseline, or `module:function` of a plugin."""
    if name in BASELINES:
        return BASELINES[name]
    if ":" not in name:
        raise ValueError(f"unknown baseline {name}; known: {', '.join(BASELINES)}")
    from importlib import import_module

    module, function = name.split(":", 1)
    return getattr(import_module(module), function)

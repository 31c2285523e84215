"""Bayesian event scores: local log Bayes factors, triggers, runs and a row per source.

A point's factor compares a flat prior over a grid of event magnitudes with the baseline. The grid is a function of the
source's percentiles, so it is computed in the row, by batches of rows, and nothing is joined or exploded.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import runs as R
from .baselines import BASELINES
from .clean import SOURCE, Keys, indexed, scorable, valid_for_scoring
from .groups import Columns, percentiles, rows_of, with_kernel, with_percentiles

#: Half the logarithm of two pi; magnitudes of the grid; thresholds.
HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)
KINDS = ("dip", "jump")
GRID, LOGBF_THRESHOLD, PROBABILITY_THRESHOLD, SUM_FACTOR = 60, 5.0, 0.9999997, 2.5


def gaussian(t: Column, amp: Column | float, t0: Column | float, sigma: Column | float, baseline: Column | float) -> Column:
    return baseline + amp * F.exp(-0.5 * ((t - t0) / sigma) ** 2)


def paczynski(t: Column, amp: Column | float, t0: Column | float, t_e: Column | float, baseline: Column | float) -> Column:
    return baseline + amp / F.sqrt(1 + ((t - t0) / t_e) ** 2)


def log_gaussian(x: Column, mu: Column, sigma: Column) -> Column:
    s = F.greatest(sigma, F.lit(1e-12))
    return -0.5 * ((x - mu) / s) * ((x - mu) / s) - F.log(s) - HALF_LOG_2PI


def logit_grid(low: float, high: float, n: int = 80) -> Column:
    """n probabilities evenly spaced in their log odds."""
    a, b = (math.log(max(p, 1e-12) / max(1 - p, 1e-12)) for p in (low, high))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: 1 / (1 + F.exp(-(F.lit(a) + i * ((b - a) / max(1, n - 1))))))


def bic(residual: Column, error: Column, n: Column, k: int) -> Column:
    """Bayesian information criterion of a fit, as an aggregate."""
    e = F.greatest(error, F.lit(1e-9))
    return F.sum((residual / e) * (residual / e)) + k * F.log(n)


def grid_ends(points: DataFrame, kind: str, keys: Keys = SOURCE) -> DataFrame:
    """points (with baseline) with grid_start and grid_stop: from just beyond the baseline to beyond the 5th or 95th
    percentile of the magnitudes by half their spread; a tenth of a magnitude apart if they meet."""
    out = with_percentiles(with_percentiles(points, keys, "mag", _lo=0.05, _hi=0.95), keys, "baseline", _b=0.5)
    spread = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(0.05))
    if kind == "dip":
        start, stop = F.col("_b") + 0.02, F.greatest(F.col("_b") + 0.02, F.col("_hi") + 0.5 * spread)
        apart = 0.1
    else:
        start, stop = F.least(F.col("_b") - 0.02, F.col("_lo") - 0.5 * spread), F.col("_b") - 0.02
        apart = -0.1
    out = out.withColumn("grid_start", start).withColumn("grid_stop", stop)
    return out.withColumn("grid_stop", F.when(F.col("grid_start") == F.col("grid_stop"), F.col("grid_start") + apart).otherwise(F.col("grid_stop"))).drop("_lo", "_hi", "_b")


def log_factor(n: int = GRID) -> Callable[..., Column]:
    """Log Bayes factor of magnitudes against their baselines, for an event anywhere on a grid of n magnitudes between two
    ends, from batches of columns: magnitude, baseline, sigma, ends. Nulls give null."""

    @F.pandas_udf("double")
    def factor(mag: pd.Series, baseline: pd.Series, sigma: pd.Series, start: pd.Series, stop: pd.Series) -> pd.Series:
        out = log_factors(*(x.to_numpy(float, na_value=np.nan) for x in (mag, baseline, sigma, start, stop)), n)
        return pd.Series(out).where(np.isfinite(out), None)

    return factor


def log_factors(m: np.ndarray, b: np.ndarray, sigma: np.ndarray, low: np.ndarray, high: np.ndarray, n: int = GRID) -> np.ndarray:
    """The same of arrays."""
    share, s, out = np.linspace(0, 1, n), np.maximum(sigma, 1e-12), np.empty(len(m))
    for at in range(0, len(m), 512):  # so many points by n doubles at a time, which caches hold
        r = slice(at, at + 512)
        z = ((m[r] - low[r]) / s[r])[:, None] - ((high[r] - low[r]) / s[r])[:, None] * share
        z *= z
        least = z.min(axis=1)
        z -= least[:, None]
        z *= -0.5
        np.exp(z, out=z)
        quiet = (m[r] - b[r]) / s[r]
        out[r] = np.log(z.sum(axis=1)) - 0.5 * least - math.log(n) + 0.5 * quiet * quiet
    return out


def ends(mag: np.ndarray, baseline: np.ndarray, starts: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """grid_ends of whole groups' arrays, at each row."""
    (lo, hi), (b,) = percentiles(mag, starts, 0.05, 0.95), percentiles(baseline, starts, 0.5)
    spread = np.fmax(hi - lo, 0.05)
    start, stop = (b + 0.02, np.fmax(b + 0.02, hi + 0.5 * spread)) if kind == "dip" else (np.fmin(b - 0.02, lo - 0.5 * spread), b - 0.02)
    stop = np.where(start == stop, start + (0.1 if kind == "dip" else -0.1), stop)
    return rows_of(start, starts), rows_of(stop, starts)


def effective_sigma(points: DataFrame) -> Column:
    return F.coalesce(F.col("sigma_eff"), F.col("error")) if "sigma_eff" in points.columns else F.col("error")


def with_log_bf(points: DataFrame, kinds: dict[str, str], keys: Keys = SOURCE, n: int = GRID, whole: bool = False) -> DataFrame:
    """points (with baseline) with log_bf of each kind in a column of its own, and if wanted the whole source's cadence and its
    greatest log_bf of each (`<column>_top`): one pass over sources in time."""

    def factors(columns: Columns, starts: np.ndarray) -> Columns:
        m, b, s = (columns[c] for c in ("mag", "baseline", "_sigma"))
        out = {"cadence": R.cadences(columns["jd"], starts)} if whole else {}
        for to, kind in kinds.items():
            with np.errstate(all="ignore"):
                found = log_factors(m, b, s, *ends(m, b, starts, kind), n)
            out[to] = np.where(np.isfinite(found), found, np.nan)
            if whole:
                out[f"{to}_top"] = rows_of(np.fmax.reduceat(out[to], starts[:-1]), starts)
        return out

    ready = points.where(F.col("baseline").isNotNull()).withColumn("_sigma", effective_sigma(points))
    adds = ", ".join(f"{c} double" for c in (*["cadence"] * whole, *kinds, *(f"{k}_top" for k in kinds if whole)))
    return with_kernel(ready, keys, ("jd", "mag", "baseline", "_sigma"), factors, adds).drop("_sigma")


def local_log_bf(points: DataFrame, kind: str, keys: Keys = SOURCE, n: int = GRID) -> DataFrame:
    """points (with baseline) with log_bf of a dip or jump. The effective error is sigma_eff if there is one. The
    Gaussians' own factors, sigma and the root of two pi, are the same for event and baseline."""
    return with_log_bf(points, {"log_bf": kind}, keys, n)


def baseline_evidence(points: DataFrame, keys: Keys = SOURCE) -> DataFrame:
    """Log likelihood of a source's points under the baseline alone."""
    return points.where(F.col("baseline").isNotNull()).groupBy(*keys).agg(F.sum(log_gaussian(F.col("mag"), F.col("baseline"), F.col("error"))).alias("loglik_baseline"))


def triggered(points: DataFrame, kind: str, keys: Keys = SOURCE, threshold: float = LOGBF_THRESHOLD) -> DataFrame:
    """Points (with idx, cadence, score) whose score reaches the threshold; a probability above 1 is a percentage."""
    placed = R.with_cadence(indexed(points.where(F.col("baseline").isNotNull()), keys), keys)
    return local_log_bf(placed, kind, keys).withColumnRenamed("log_bf", "score").where(F.col("score") >= threshold)


def trigger_threshold(mode: str, logbf: float = LOGBF_THRESHOLD, probability: float = PROBABILITY_THRESHOLD, min_points: int = 3) -> tuple[float, float]:
    """Threshold of a point and of a run's sum, by trigger mode."""
    if mode == "logbf":
        return logbf, SUM_FACTOR * logbf
    if mode != "posterior_prob":
        raise ValueError(f"unknown trigger mode {mode}")
    p = probability / 100 if probability > 1 else probability
    return p, min_points * p


def percent_of_sigma(sigma: float) -> float:
    """The two-sided normal confidence of so many sigmas, in percent."""
    return 100 * math.erf(sigma / math.sqrt(2))


def scored_runs(points: DataFrame, kind: str, keys: Keys = SOURCE, threshold: float = LOGBF_THRESHOLD) -> DataFrame:
    """All runs of triggered points, with `kept`."""
    in_runs = R.build_runs(triggered(points, kind, keys, threshold), keys)
    return R.filter_runs(R.summarize_runs(in_runs, keys), threshold, SUM_FACTOR * threshold)


def scan(points: DataFrame, baseline: str = "per_camera_median", by_band: bool = False, threshold: float = LOGBF_THRESHOLD, **parameters: float) -> DataFrame:
    """A row per source (and band): for dips and jumps, whether it is significant, runs and their extremes, greatest
    point score and triggered points. Both kinds share one baseline and one shuffle of runs."""
    keys: Keys = ("source_id", "band") if by_band else SOURCE
    needed = [c for c in (*keys, "camera", "jd", "seq", "mag", "error") if c in points.columns]
    based = BASELINES[baseline](valid_for_scoring(points.select(*needed), keys), keys, **parameters)
    placed = indexed(based.where(F.col("baseline").isNotNull()).select(*keys, "jd", "seq", "mag", "baseline", *(c for c in ("error", "sigma_eff") if c in based.columns)), keys)  # points without a baseline don't part runs
    placed = with_log_bf(placed, {f"_{k}": k for k in KINDS}, keys, whole=True)
    # Runs need the hits alone; of the rest, one row of each source and kind has the greatest score of all.
    one = lambda k, score, hit: F.struct(F.lit(k).alias("kind"), F.col(score).alias("score"), F.lit(hit).alias("hit"))
    made = [F.when(F.col(f"_{k}") >= threshold, one(k, f"_{k}", True)) for k in KINDS] + [F.when(F.col("idx") == 0, one(k, f"_{k}_top", False)) for k in KINDS]
    scores = placed.select(*keys, "idx", "jd", "cadence", F.explode(F.array_compact(F.array(*made))).alias("_e")).select("*", "_e.*").drop("_e")
    own = (*keys, "kind", "hit")
    found = R.filter_runs(R.summarize_runs(R.build_runs(scores, own), own), threshold, SUM_FACTOR * threshold).withColumn("kept", F.col("kept") & F.col("hit"))
    best = lambda c: F.max(F.when(F.col("kept"), F.col(c)))
    values = {
        "max_log_bf_local": lambda: F.max("run_max"), "count": lambda: F.coalesce(F.sum(F.when(F.col("hit"), F.col("n_points"))), F.lit(0)), "run_count": lambda: F.count_if("kept"), "max_run_points": lambda: best("n_points"),
        "max_run_duration": lambda: best("duration_days"), "max_run_sum": lambda: best("run_sum"), "max_run_max": lambda: best("run_max"),
    }
    by_kind = found.groupBy(*keys, "kind").agg(*(v().alias(n) for n, v in values.items())).withColumn("significant", F.col("run_count") > 0)
    wide = by_kind.groupBy(*keys).agg(*(F.max(F.when(F.col("kind") == k, F.col(n))).alias(f"{k}_{n}") for k in KINDS for n in (*values, "significant")))
    out = scorable(points, keys).join(wide, list(keys), "left")
    return out.withColumn("baseline_source", F.lit(baseline)).withColumn("trigger_mode", F.lit("logbf"))

"""The scan's whole row per source: triggers by log Bayes factor or posterior, runs, shapes, thresholds, for dips and
jumps. All of it starts from one baseline, which is written once with its points, as are the scores of both kinds; branches
read those files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bayes, kernels
from . import runs as R
from .baselines import baseline_by_name
from ..sources.shared import stored
from .clean import LEAST_POINTS, MOST_ERROR, SOURCE, Keys, finite, indexed, valid_for_scoring
from .groups import Columns, with_kernel

# The columns of a result row for each kind, in order of the result files.
COLUMNS = (
    "significant", "best_morph", "best_delta_bic", "best_width_param", "count", "run_count", "max_run_points", "max_run_duration", "max_run_sum",
    "max_run_max", "max_log_bf_local", "bayes_factor", "best_p", "trigger_threshold", "run_sum_threshold",
)


def scored_points(placed: DataFrame, kind: str, trigger: str, keys: Keys = SOURCE) -> DataFrame:
    """placed (baseline, idx, cadence) with log_bf, the mixture's bayes_factor and best_p, and score, by which the
    trigger goes: log_bf, or the probability of the event."""
    return of_kind(with_scores(placed, (kind,), keys), kind, trigger)


SCORES = ("log_bf", "event_probability", "bayes_factor", "best_p")


def with_scores(placed: DataFrame, kinds: tuple[str, ...], keys: Keys = SOURCE) -> DataFrame:
    """placed with the scores of each kind (`<kind>_<score>`), in one pass over sources in time."""

    def weigh(columns: Columns, starts: np.ndarray) -> Columns:
        mag, base, sigma = (columns[c] for c in ("mag", "baseline", "_sigma"))
        out = {}
        for kind in kinds:
            found = kernels.posteriors(mag, sigma, base, starts, kind) | {"log_bf": bayes.log_factors(mag, base, sigma, *bayes.ends(mag, base, starts, kind))}
            out |= {f"{kind}_{c}": found[c] for c in SCORES}
            out[f"{kind}_log_bf"] = np.where(np.isfinite(found["log_bf"]), found["log_bf"], np.nan)
        return out

    ready = placed.where(F.col("baseline").isNotNull()).withColumn("_sigma", bayes.effective_sigma(placed))
    return with_kernel(ready, keys, ("mag", "baseline", "_sigma"), weigh, ", ".join(f"{k}_{c} double" for k in kinds for c in SCORES)).drop("_sigma")


def of_kind(scored: DataFrame, kind: str, trigger: str) -> DataFrame:
    """scored with one kind's scores under their own names, and the trigger's."""
    out = scored.withColumns({c: F.col(f"{kind}_{c}") for c in SCORES}).withColumn("score", F.col(f"{kind}_{'log_bf' if trigger == 'logbf' else 'event_probability'}"))
    return out.drop(*(c for c in scored.columns if any(c == f"{k}_{s}" for k in bayes.KINDS for s in SCORES)))


def kind_rows(placed: DataFrame, kind: str, trigger: str, keys: Keys = SOURCE, min_points: int = 3, scored: DataFrame | None = None, **limits: float) -> DataFrame:
    """A row per source of one kind of event, named by the kind. Of its kept runs the one with the greatest sum gives
    the shape; sources without a kept run have the shape `none`."""
    threshold, sum_threshold = bayes.trigger_threshold(trigger, **limits, min_points=min_points)
    points = of_kind(stored(with_scores(placed, (kind,), keys)) if scored is None else scored, kind, trigger)
    hits = points.where(F.col("score") >= threshold)
    kept = R.filter_runs(R.summarize_runs(R.build_runs(hits, keys), keys), threshold, sum_threshold, min_points).where("kept")
    best = kernels.run_shapes(placed, R.best_run(kept, keys).select(*keys, "run", "start_idx", "end_idx"), kind, keys)
    best = best.select(*keys, F.col("morphology").alias("best_morph"), F.col("delta_bic_null").alias("best_delta_bic"), F.col("width").alias("best_width_param"))
    whole = points.groupBy(*keys).agg(F.count_if(F.col("score") >= threshold).alias("count"), F.max("log_bf").alias("max_log_bf_local"), F.max("bayes_factor").alias("bayes_factor"), F.max("best_p").alias("best_p"))
    rows = whole.join(R.kept_summary(kept, keys), list(keys), "left").join(best, list(keys), "left")
    rows = rows.withColumns({
        "run_count": F.coalesce("run_count", F.lit(0)), "max_run_points": F.coalesce("max_run_points", F.lit(0)), "best_morph": F.coalesce("best_morph", F.lit("none")), "best_delta_bic": F.coalesce("best_delta_bic", F.lit(0.0)),
        "trigger_threshold": F.lit(threshold), "run_sum_threshold": F.lit(sum_threshold),
    }).withColumn("significant", F.col("run_count") > 0)
    return rows.select(*keys, *(F.col(c).alias(f"{kind}_{c}") for c in COLUMNS))


def scan_status(points: DataFrame, placed: DataFrame, scores: DataFrame, keys: Keys = SOURCE, least_points: int = LEAST_POINTS) -> DataFrame:
    """A row per source of points: n_points, n_valid, and status, `ok` or the first reason for which it can't be scored.

    points: all there were; placed: those that were given a baseline (with sigma_eff if the baseline makes it), null where it
    failed; scores: rows of sources with max_log_bf_local. Errors are values of a row here, and stop nothing else."""
    ok = finite("error") & (F.col("error") > 0)
    before = points.groupBy(*keys).agg(F.count("*").alias("n_points"), F.count_if(finite("mag")).alias("_mag"), F.count_if(finite("error")).alias("_error"), F.count_if(ok).alias("_positive"),
                                       F.count_if(finite("jd") & finite("mag") & ok & (F.col("error") < MOST_ERROR)).alias("n_valid"))
    sigma = "sigma_eff" if "sigma_eff" in placed.columns else "error"
    there = finite("baseline") & finite(sigma) & (F.col(sigma) > 0)
    after = placed.groupBy(*keys).agg(F.count_if(finite("baseline")).alias("_baseline"), F.count_if(finite(sigma)).alias("_sigma"), F.count_if(finite(sigma) & (F.col(sigma) > 0)).alias("_good"), F.count_if(there).alias("_left"))
    told = before.join(after, list(keys), "left").join(scores.select(*keys, F.lit(True).alias("_scored")), list(keys), "left")
    reasons = [
        (F.col("_mag") == 0, "all magnitudes are missing"), (F.col("_error") == 0, "all errors are missing"), (F.col("_positive") == 0, "no error is positive"), (F.col("n_valid") == 0, "no valid points"),
        (F.col("n_valid") < least_points, "too few valid points"), (F.col("_sigma") == 0, f"the baseline gave no {sigma}"), (F.col("_good") == 0, f"the baseline gave no positive {sigma}"),
        (F.coalesce("_baseline", F.lit(0)) == 0, "the baseline is missing everywhere"), (F.col("_left") == 0, "no valid points after the baseline"), (F.col("_scored").isNull(), "no point has a likelihood"),
    ]
    status = F.coalesce(*(F.when(test, F.lit(reason)) for test, reason in reasons), F.lit("ok"))
    return told.select(*keys, "n_points", "n_valid", status.alias("status"))


def scan_rows(points: DataFrame, baseline: str = "per_camera_median", trigger: str = "logbf", keys: Keys = SOURCE, min_points: int = 3, logbf: float = bayes.LOGBF_THRESHOLD, probability: float = bayes.PROBABILITY_THRESHOLD, require_sigma_eff: bool = False, **parameters: float) -> DataFrame:
    """A row per source of points: the columns of both kinds, used_sigma_eff, baseline_source, trigger_mode, and status, `ok`
    or why the source could not be scored; then the other columns are null."""
    based = baseline_by_name(baseline)(valid_for_scoring(points, keys), keys, **parameters).drop("resid", "sigma_resid")
    if require_sigma_eff and "sigma_eff" not in based.columns:
        raise ValueError(f"baseline {baseline} makes no sigma_eff")
    marked, own = based.withColumn("_based", finite("baseline")), (*keys, "_based")
    whole = stored(R.with_cadence(indexed(marked, own), own))  # places and cadences of the points that have a baseline
    sigma = "sigma_eff" if "sigma_eff" in based.columns else "error"
    placed = whole.where(F.col("_based") & finite(sigma) & (F.col(sigma) > 0)).drop("_based")
    scored = stored(with_scores(placed.select(*keys, "idx", "jd", "seq", "cadence", "mag", "baseline", *dict.fromkeys(("error", sigma))), bayes.KINDS, keys).drop("mag", "baseline", "error", "sigma_eff"))
    dips, jumps = (kind_rows(placed, k, trigger, keys, min_points, scored, logbf=logbf, probability=probability) for k in bayes.KINDS)
    rows = dips.join(jumps, list(keys))
    status = scan_status(points, whole, rows.where(F.col("dip_max_log_bf_local").isNotNull() | F.col("jump_max_log_bf_local").isNotNull()), keys)
    if "baseline_source" in based.columns:
        from ..functions.reports import joined_names

        rows = rows.join(joined_names(placed, keys[0], "baseline_source"), keys[0], "left")
    else:
        rows = rows.withColumn("baseline_source", F.lit(baseline))
    rows = rows.withColumn("used_sigma_eff", F.lit("sigma_eff" in based.columns)).withColumn("trigger_mode", F.lit(trigger))
    return status.select(*keys, "status").join(rows, list(keys), "left").select(*rows.columns, "status")


def retriggered(placed: DataFrame, kind: str, sigma: float, keys: Keys = SOURCE) -> DataFrame:
    """Sources with a point whose event probability reaches the confidence of so many sigmas, whatever its run."""
    p = bayes.percent_of_sigma(sigma) / 100
    return scored_points(placed, kind, "posterior_prob", keys).groupBy(*keys).agg(F.count_if(F.col("score") >= p).alias("count")).withColumn("significant", F.col("count") > 0)

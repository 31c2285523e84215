"""Runs of triggered points, by gaps and islands."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .clean import SOURCE, Keys, in_time
from .groups import percentiles, rows_of, with_percentiles

#: Magnitudes from the baseline that make a dip or jump.
THRESHOLD = 0.3


def find_runs(points: DataFrame, mask: Column, keys: Keys = SOURCE, max_gap: int = 1, min_length: int = 1) -> DataFrame:
    """start_idx, end_idx and n_points of runs of masked points, at most max_gap places apart, by number. points have idx."""
    w = W.partitionBy(*keys).orderBy("idx")
    hit = points.where(mask).withColumn("_step", F.col("idx") - F.lag("idx").over(w))
    runs = hit.withColumn("run", F.sum(F.when(F.col("_step") > max_gap, 1).otherwise(0)).over(w))
    out = runs.groupBy(*keys, "run").agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.count("*").alias("n_points"))
    return out.where(F.col("end_idx") - F.col("start_idx") + 1 >= min_length)


def with_cadence(points: DataFrame, keys: Keys = SOURCE) -> DataFrame:
    """points with the source's median positive time between neighbours."""
    dt = F.col("jd") - F.lag("jd").over(in_time(keys))
    return with_percentiles(points.drop("cadence").withColumn("_dt", F.when(dt > 0, dt)), keys, "_dt", cadence=0.5).drop("_dt")


def cadences(jd: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The cadence at each row of whole sources in time."""
    step = np.diff(jd, prepend=np.nan)
    step[starts[:-1]] = np.nan
    return rows_of(percentiles(np.where(step > 0, step, np.nan), starts, 0.5)[0], starts)


def build_runs(triggered: DataFrame, keys: Keys = SOURCE, allow_gap_points: int = 1, max_gap_days: float | None = None) -> DataFrame:
    """triggered points (idx, jd, cadence) with their run. A run breaks after more than allow_gap_points missing places,
    or after max_gap_days; by default five cadences, at least five days."""
    w = W.partitionBy(*keys).orderBy("idx")
    days = F.lit(max_gap_days) if max_gap_days is not None else F.greatest(F.coalesce(F.col("cadence"), F.lit(0.0)) * 5, F.lit(5.0))
    out = triggered.withColumns({"_i": F.lag("idx").over(w), "_t": F.lag("jd").over(w)})
    breaks = (F.col("idx") - F.col("_i") > allow_gap_points + 1) | (F.col("jd") - F.col("_t") > days)
    return out.withColumn("run", F.sum(F.when(breaks, 1).otherwise(0)).over(w)).drop("_i", "_t")


def summarize_runs(in_runs: DataFrame, keys: Keys = SOURCE, score: str = "score") -> DataFrame:
    """A row per run: places, times, points, duration, greatest and summed score."""
    return in_runs.groupBy(*keys, "run").agg(
        F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.count("*").alias("n_points"), F.min("jd").alias("start_jd"), F.max("jd").alias("end_jd"),
        (F.max("jd") - F.min("jd")).alias("duration_days"), F.max(score).alias("run_max"), F.sum(score).alias("run_sum"), F.first("cadence").alias("cadence"),
    )


def filter_runs(runs: DataFrame, threshold: float, sum_threshold: float, min_points: int = 3, min_duration_days: float | None = None) -> DataFrame:
    """runs with `kept`: enough points, long enough (by default two cadences, at least two days), high enough."""
    least = F.lit(min_duration_days) if min_duration_days is not None else F.greatest(F.coalesce(F.col("cadence"), F.lit(0.0)) * 2, F.lit(2.0))
    kept = (F.col("n_points") >= min_points) & (F.col("duration_days") >= least) & (F.col("run_max") >= threshold) & (F.col("run_sum") >= sum_threshold)
    return runs.withColumn("kept", kept)


def kept_summary(runs: DataFrame, keys: Keys = SOURCE) -> DataFrame:
    """A row per source with runs: number of kept runs and their extremes."""
    best = lambda c: F.max(F.when(F.col("kept"), F.col(c)))
    return runs.groupBy(*keys).agg(F.count_if("kept").alias("run_count"), best("n_points").alias("max_run_points"), best("duration_days").alias("max_run_duration"), best("run_sum").alias("max_run_sum"), best("run_max").alias("max_run_max"))


def best_run(runs: DataFrame, keys: Keys = SOURCE) -> DataFrame:
    """The kept run with the greatest sum, the first of equals."""
    order = W.partitionBy(*keys).orderBy(F.desc("run_sum"), "start_idx")
    return runs.where("kept").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def run_metrics(points: DataFrame, keys: Keys = SOURCE, threshold: float = THRESHOLD) -> DataFrame:
    """Dips and jumps of at least a threshold from the baseline: runs, points, most recent time, greatest depth and
    height, longest duration, and dips' share of the runs. Sources without any keep zeros. points have baseline."""
    from .clean import indexed

    placed = indexed(points.where(F.col("baseline").isNotNull()), keys)
    dip, jump = F.col("mag") >= F.col("baseline") + threshold, F.col("mag") <= F.col("baseline") - threshold
    kinds = placed.withColumn("kind", F.when(dip, "dip").when(jump, "jump")).withColumn("size", F.abs(F.col("mag") - F.col("baseline")))
    w = W.partitionBy(*keys, "kind").orderBy("idx")
    hit = kinds.where(F.col("kind").isNotNull()).withColumn("_new", F.when(F.col("idx") - F.lag("idx").over(w) > 1, 1).otherwise(0))
    runs = hit.withColumn("run", F.sum("_new").over(w)).groupBy(*keys, "kind", "run").agg(F.count("*").alias("n"), F.max("jd").alias("last"), F.max("size").alias("most"), (F.max("jd") - F.min("jd")).alias("days"))
    of = lambda kind, c: F.when(F.col("kind") == kind, F.col(c))
    wide = runs.groupBy(*keys).agg(
        F.count(of("dip", "n")).alias("n_dip_runs"), F.count(of("jump", "n")).alias("n_jump_runs"), F.coalesce(F.sum(of("dip", "n")), F.lit(0)).alias("n_dip_points"), F.coalesce(F.sum(of("jump", "n")), F.lit(0)).alias("n_jump_points"),
        F.max(of("dip", "last")).alias("most_recent_dip"), F.max(of("jump", "last")).alias("most_recent_jump"), F.max(of("dip", "most")).alias("max_depth"), F.max(of("jump", "most")).alias("max_height"),
        F.max(of("dip", "days")).alias("max_dip_duration"), F.max(of("jump", "days")).alias("max_jump_duration"),
    )
    every = points.select(*keys).distinct().join(wide, list(keys), "left").fillna(0, ["n_dip_runs", "n_jump_runs", "n_dip_points", "n_jump_points"])
    total = F.col("n_dip_runs") + F.col("n_jump_runs")
    return every.withColumn("dip_fraction", F.when(total > 0, F.col("n_dip_runs") / total)).withColumn("jump_fraction", F.when(total > 0, F.col("n_jump_runs") / total))


def dip_dominated(fraction: Column, least: float = 0.66) -> Column:
    return F.coalesce(fraction >= least, F.lit(False))

"""Point filters, and the order of points within a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Keys = tuple[str, ...]
SOURCE: Keys = ("source_id",)
#: Points that a source needs to be scored, and the error that a point must stay below.
LEAST_POINTS, MOST_ERROR = 10, 10.0


def finite(name: str) -> Column:
    c = F.col(name)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def in_time(keys: Keys = SOURCE) -> W:
    return W.partitionBy(*keys).orderBy("jd", "seq")


def indexed(points: DataFrame, keys: Keys = SOURCE) -> DataFrame:
    """points with idx, the place of each in its source, from 0."""
    return points.withColumn("idx", F.row_number().over(in_time(keys)) - 1)


def clean_lc(points: DataFrame) -> DataFrame:
    """Unsaturated points with a time, a magnitude and an error between 0 and 1, both ends out. Columns that are
    missing aren't tested."""
    keep = finite("jd") & finite("mag")
    if "saturated" in points.columns:
        keep &= F.col("saturated") == 0
    if "error" in points.columns:
        keep &= finite("error") & (F.col("error") > 0) & (F.col("error") < 1)
    return points.where(keep)


def _scored(points: DataFrame, most_error: float) -> DataFrame:
    return points.where(finite("jd") & finite("mag") & finite("error") & (F.col("error") > 0) & (F.col("error") < most_error))


def scorable(points: DataFrame, keys: Keys = SOURCE, least_points: int = LEAST_POINTS, most_error: float = MOST_ERROR) -> DataFrame:
    """The sources of valid_for_scoring, a row each."""
    return _scored(points, most_error).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least_points).select(*keys)


def valid_for_scoring(points: DataFrame, keys: Keys = SOURCE, least_points: int = LEAST_POINTS, most_error: float = MOST_ERROR) -> DataFrame:
    """Finite points with an error between 0 and most_error, of sources that have enough of them."""
    return _scored(points, most_error).withColumn("_n", F.count("*").over(W.partitionBy(*keys))).where(F.col("_n") >= least_points).drop("_n")


def scoring_status(points: DataFrame, keys: Keys = SOURCE, least_points: int = 10) -> DataFrame:
    """A row per source: n_valid and status, `ok` or why it can't be scored. Errors are values here, not exceptions."""
    ok = finite("jd") & finite("mag") & finite("error") & (F.col("error") > 0) & (F.col("error") < 10)
    n = points.groupBy(*keys).agg(F.count_if(ok).alias("n_valid"))
    return n.withColumn("status", F.when(F.col("n_valid") >= least_points, "ok").when(F.col("n_valid") == 0, "no valid points").otherwise("too few points"))


def stats_quality(points: DataFrame, keys: Keys = SOURCE, only_good: bool = True) -> DataFrame:
    """Complete points, the first of each time, and if wanted only good and unsaturated ones."""
    whole = points.where(finite("jd") & finite("mag") & finite("error"))
    first = whole.withColumn("_n", F.row_number().over(W.partitionBy(*keys, "jd").orderBy("seq"))).where("_n = 1").drop("_n")
    return first.where((F.col("good_bad") == 1) & (F.col("saturated") == 0)) if only_good else first


def quality_totals(points: DataFrame, keys: Keys = SOURCE) -> DataFrame:
    """A row per source: points there were, and how many stats_quality keeps, of all and of good ones."""
    counts = [points.groupBy(*keys).agg(F.count("*").alias("n_before"))]
    counts += [stats_quality(points, keys, good).groupBy(*keys).agg(F.count("*").alias(name)) for good, name in ((False, "n_whole"), (True, "n_good"))]
    out = counts[0].join(counts[1], list(keys), "left").join(counts[2], list(keys), "left")
    return out.fillna(0, ["n_whole", "n_good"])


def plot_quality(points: DataFrame) -> DataFrame:
    return points.where((F.col("error") > 0) & (F.col("error") < 1) & (F.col("saturated") == 0) & (F.col("good_bad") == 1))


def plot_times(points: DataFrame, keys: Keys = SOURCE, most_error: float = 5.0) -> DataFrame:
    """points to plot with jd_plot: days since 2458000 for full Julian dates, since 8000 for shortened ones."""
    good = points.where(finite("jd") & finite("mag") & (F.col("error") < most_error))
    full = F.median("jd").over(W.partitionBy(*keys)) > 2_000_000
    return good.withColumn("jd_plot", F.col("jd") - F.when(full, 2_458_000.0).otherwise(8_000.0))


def band_clipped(points: DataFrame, keys: Keys = ("source_id", "band"), sigmas: float = 5.0) -> DataFrame:
    """Points with an error of at most 1 within so many standard deviations of the band's median."""
    w = W.partitionBy(*keys)
    good = points.where(F.col("error") <= 1).withColumn("_m", F.median("mag").over(w)).withColumn("_s", F.stddev_samp("mag").over(w))
    return good.where(F.abs(F.col("mag") - F.col("_m")) <= sigmas * F.col("_s")).drop("_m", "_s")


def baseline_line(with_baseline: DataFrame, keys: Keys = SOURCE) -> DataFrame:
    """The baseline to draw: its median at each time."""
    return with_baseline.where(F.col("baseline").isNotNull()).groupBy(*keys, "jd").agg(F.median("baseline").alias("baseline"))


def first_col(df: DataFrame, *names: str) -> str | None:
    """The first of the names that df has."""
    return next((n for n in names if n in df.columns), None)


def id_column(df: DataFrame, *preferred: str) -> str | None:
    """The first preferred column, else the first whose name holds `id`."""
    return first_col(df, *preferred) or next((c for c in df.columns if "id" in c.lower()), None)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df

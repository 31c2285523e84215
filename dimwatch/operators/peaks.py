"""Biweight statistics, deltas and peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .clean import SOURCE, Keys, in_time
from .groups import with_percentiles

#: Tuning constant of the biweights; least denominator of a delta.
TUNING, EPS = 6.0, 1e-6


def with_biweight(points: DataFrame, keys: Keys = SOURCE, value: str = "mag", c: float = TUNING) -> DataFrame:
    """points with the group's biweight location and scale: one step from the median with the raw median absolute
    deviation, which must not be 0 (then: the median, and 0)."""
    w = W.partitionBy(*keys)
    out = with_percentiles(points, keys, value, _m=0.5).withColumn("_a", F.abs(F.col(value) - F.col("_m")))
    out = with_percentiles(out, keys, "_a", _mad=0.5).withColumn("_d", F.col(value) - F.col("_m"))
    out = out.withColumn("_u", F.when(F.col("_mad") > 0, F.col("_d") / (c * F.col("_mad")))).withColumn("_q", 1 - F.col("_u") * F.col("_u"))
    inside = F.abs(F.col("_u")) < 1
    d, u2, q = F.col("_d"), F.col("_u") * F.col("_u"), F.col("_q")
    total = lambda x: F.sum(F.when(inside, x)).over(w)
    location = F.when(F.col("_mad") > 0, F.col("_m") + total(d * q * q) / total(q * q)).otherwise(F.col("_m"))
    scale = F.when(F.col("_mad") > 0, F.sqrt(F.count(value).over(w) * total(d * d * q * q * q * q)) / F.abs(total(q * (1 - 5 * u2)))).otherwise(0.0)
    return out.withColumns({"biweight_location": location, "biweight_scale": scale}).drop("_m", "_a", "_mad", "_d", "_u", "_q")


def biweight(points: DataFrame, keys: Keys = SOURCE, value: str = "mag") -> DataFrame:
    return with_biweight(points, keys, value).groupBy(*keys).agg(F.first("biweight_location").alias("biweight_location"), F.first("biweight_scale").alias("biweight_scale"))


def biweight_delta(points: DataFrame, keys: Keys = SOURCE, sign: int = 1) -> DataFrame:
    """points with delta: how far above the biweight location, in units of error and scale together."""
    out = with_biweight(points, keys)
    e = F.coalesce(F.col("error"), F.lit(0.0))
    below = F.greatest(F.sqrt(e * e + F.col("biweight_scale") * F.col("biweight_scale")), F.lit(EPS))
    return out.withColumn("delta", sign * (F.col("mag") - F.col("biweight_location")) / below)


def baseline_delta(points: DataFrame, keys: Keys = SOURCE, sign: int = 1) -> DataFrame:
    """points (with baseline and resid) with delta in units of error and the residuals' biweight scale."""
    out = with_biweight(points, keys, "resid")
    e, scale = F.coalesce(F.col("error"), F.lit(0.0)), F.coalesce(F.col("biweight_scale"), F.lit(0.0))
    total = F.sqrt(e * e + scale * scale)
    return out.withColumn("delta", sign * F.col("resid") / F.when(total > 0, total).otherwise(EPS)).drop("biweight_location", "biweight_scale")


def local_maxima(points: DataFrame, value: str, height: Column | float, keys: Keys = SOURCE, plateaus: bool = True) -> DataFrame:
    """The points at strict local maxima of at least a height: of a plateau, its middle one, the earlier of two; without
    plateaus, only points above both neighbours. The first and last points, or plateaus there, are none. Runs of equal
    values are collapsed by a running count."""
    w = in_time(keys)
    placed = points.where(F.col(value).isNotNull()).withColumn("idx", F.row_number().over(w) - 1)
    before = F.lag(value).over(w)
    if not plateaus:
        beside = placed.withColumns({"_before": before, "_after": F.lead(value).over(w)})
        return beside.where((F.col("_before") < F.col(value)) & (F.col("_after") < F.col(value)) & (F.col(value) >= height)).drop("_before", "_after")
    own = W.partitionBy(*keys, "_run")
    marked = placed.withColumns({"_before": before, "_after": F.lead(value).over(w)}).withColumn("_new", F.when(F.col("_before").isNull() | (F.col("_before") != F.col(value)), 1).otherwise(0))
    marked = marked.withColumn("_run", F.sum("_new").over(w))
    sides = marked.withColumns({
        "_left": F.max(F.when(F.col("_new") == 1, F.col("_before"))).over(own), "_right": F.max(F.when(F.col("_after").isNull() | (F.col("_after") != F.col(value)), F.col("_after"))).over(own),
        "_first": F.min("idx").over(own), "_last": F.max("idx").over(own),
    })
    top = (F.col("_left") < F.col(value)) & (F.col("_right") < F.col(value)) & (F.col("idx") == F.floor((F.col("_first") + F.col("_last")) / 2))
    return sides.where(top & (F.col(value) >= height)).drop("_before", "_after", "_new", "_run", "_left", "_right", "_first", "_last")


def box_gate(peaks: DataFrame, points: DataFrame, keys: Keys = SOURCE, most_peaks: int = 10, most_rate: float = 0.015, most_std: float = 0.15) -> DataFrame:
    """A row per source: n_peaks, peaks_per_time, population std, and whether there are few, sparse peaks on a quiet source."""
    whole = points.groupBy(*keys).agg((F.max("jd") - F.min("jd")).alias("_span"), F.stddev_pop("mag").alias("std_mag"))
    out = whole.join(peaks.groupBy(*keys).agg(F.count("*").alias("n_peaks")), list(keys), "left").fillna(0, ["n_peaks"])
    out = out.withColumn("peaks_per_time", F.when(F.col("_span") > 0, F.col("n_peaks") / F.col("_span"))).drop("_span")
    passes = (F.col("n_peaks") > 0) & (F.col("n_peaks") < most_peaks) & (F.col("peaks_per_time") <= most_rate) & (F.col("std_mag") <= most_std)
    return out.withColumn("passes", F.coalesce(passes, F.lit(False)))


def peak_times(arrays: DataFrame, index: str, times: str, to: str) -> DataFrame:
    """arrays with the times at an array of places."""
    return arrays.withColumn(to, F.transform(index, lambda i: F.get(F.col(times), i)))

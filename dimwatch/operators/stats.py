"""Statistics of light curves: a row per source (or group), every one a two-phase aggregate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .baselines import MAD_FACTOR
from .clean import SOURCE, Keys, in_time

#: Signal to noise of a magnitude error; days of a year.
SNR, YEAR = 1.0857, 365.25


def weighted_mean(points: DataFrame, keys: Keys = SOURCE, value: str = "mag", error: str = "error") -> DataFrame:
    """Mean weighted by 1 / error squared, and its standard error."""
    w = 1 / (F.col(error) * F.col(error))
    good = points.where(F.col(value).isNotNull() & (F.col(error) > 0)).withColumn("_w", w)
    return good.groupBy(*keys).agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias("wmean"), F.sqrt(1 / F.sum("_w")).alias("wsem"))


def with_deviation(points: DataFrame, keys: Keys = SOURCE, value: str = "mag") -> DataFrame:
    """points with the group's median and each point's absolute deviation from it."""
    return points.withColumn("median", F.median(value).over(W.partitionBy(*keys))).withColumn("deviation", F.abs(F.col(value) - F.col("median")))


def robust_sigma(points: DataFrame, keys: Keys = SOURCE, value: str = "mag") -> DataFrame:
    return with_deviation(points, keys, value).groupBy(*keys).agg((MAD_FACTOR * F.median("deviation")).alias("robust_sigma"))


def summary(points: DataFrame, keys: Keys = SOURCE, value: str = "mag") -> DataFrame:
    """Count, mean, median, standard deviation, exact percentiles and interquartile range."""
    shares = (0.05, 0.16, 0.25, 0.75, 0.84, 0.95)
    out = points.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("std"), F.percentile(value, F.array(*map(F.lit, shares))).alias("_p"))
    named = {f"p{round(100 * s):02d}": F.col("_p")[i] for i, s in enumerate(shares)}
    return out.withColumns(named).withColumn("iqr", F.col("p75") - F.col("p25")).drop("_p")


def clipped(points: DataFrame, keys: Keys = SOURCE, value: str = "mag", sigmas: float = 3.0) -> DataFrame:
    """Mean and standard deviation of the points within so many robust sigmas of the median; how many are outside."""
    dev = with_deviation(points, keys, value)
    dev = dev.withColumn("_s", MAD_FACTOR * F.median("deviation").over(W.partitionBy(*keys)))
    inside = F.col("deviation") <= sigmas * F.col("_s")
    return dev.groupBy(*keys).agg(F.avg(F.when(inside, F.col(value))).alias("clipped_mean"), F.stddev_samp(F.when(inside, F.col(value))).alias("clipped_std"), F.count_if(~inside).alias("n_outliers"))


def noise(points: DataFrame, keys: Keys = SOURCE, error: str = "error") -> DataFrame:
    """Errors and signal to noise: mean (of decimals, so that it doesn't depend on the order of points), median and
    extremes."""
    snr = SNR / F.col(error)
    return points.where(F.col(error) > 0).groupBy(*keys).agg(F.avg(F.col(error).cast("decimal(18,9)")).cast("double").alias("err_mean"), F.median(error).alias("err_median"), F.min(error).alias("err_min"), F.max(error).alias("err_max"), F.avg(snr).alias("snr_mean"), F.median(snr).alias("snr_median"), F.max(snr).alias("snr_max"))


def reduced_chi2(points: DataFrame, keys: Keys = SOURCE) -> DataFrame:
    """Reduced chi squared against the weighted mean; null for fewer than two points. The squares are expanded, after
    taking off the median, so one pass over sums is enough."""
    good = points.where(F.col("mag").isNotNull() & (F.col("error") > 0)).withColumn("_y", F.col("mag") - F.median("mag").over(W.partitionBy(*keys)))
    w, y = 1 / (F.col("error") * F.col("error")), F.col("_y")
    sums = good.groupBy(*keys).agg(F.sum(w).alias("_a"), F.sum(w * y).alias("_b"), F.sum(w * y * y).alias("_c"), F.count("*").alias("_n"))
    value = (F.col("_c") - F.col("_b") * F.col("_b") / F.col("_a")) / (F.col("_n") - 1)
    return sums.select(*keys, F.when(F.col("_n") >= 2, value).alias("chi2_red"))


def with_previous(points: DataFrame, keys: Keys = SOURCE) -> DataFrame:
    """points with the time and magnitude before, and dt."""
    w = in_time(keys)
    return points.withColumns({"jd_before": F.lag("jd").over(w), "mag_before": F.lag("mag").over(w)}).withColumn("dt", F.col("jd") - F.col("jd_before"))


def von_neumann(points: DataFrame, keys: Keys = SOURCE) -> DataFrame:
    """Mean squared difference of neighbours over the sample variance; null below three points or without variance."""
    step = F.col("mag") - F.col("mag_before")
    out = with_previous(points, keys).groupBy(*keys).agg(F.avg(step * step).alias("_d"), F.var_samp("mag").alias("_v"), F.count("mag").alias("_n"))
    return out.select(*keys, F.when((F.col("_n") >= 3) & (F.col("_v") > 0), F.col("_d") / F.col("_v")).alias("von_neumann"))


def lag1_autocorrelation(points: DataFrame, keys: Keys = SOURCE) -> DataFrame:
    out = with_previous(points, keys).groupBy(*keys).agg(F.corr("mag_before", "mag").alias("_r"), F.count("mag").alias("_n"))
    return out.select(*keys, F.when(F.col("_n") >= 3, F.col("_r")).alias("lag1"))


def linear_trend(points: DataFrame, keys: Keys = SOURCE) -> DataFrame:
    """Least squares of magnitude on time from the first point: slope by day and by year, intercept there, r squared."""
    t = points.withColumn("_t", F.col("jd") - F.min("jd").over(W.partitionBy(*keys)))
    out = t.groupBy(*keys).agg(F.regr_slope("mag", "_t").alias("slope"), F.regr_intercept("mag", "_t").alias("intercept"), F.regr_r2("mag", "_t").alias("r2"))
    return out.withColumn("slope_per_year", F.col("slope") * YEAR)


def by_camera_and_band(points: DataFrame, keys: Keys = SOURCE) -> DataFrame:
    """Per camera, band, and both: n, median, robust sigma, mean error (a decimal, so that its sum doesn't depend on the
    order of points) and offset from the source's median. Points are dealt out once for the three groupings."""
    whole = points.withColumn("source_median", F.median("mag").over(W.partitionBy(*keys)))

    def grouping(name: str, camera: Column, band: Column) -> DataFrame:
        marked = whole.withColumns({"grouping": F.lit(name), "g_camera": camera, "g_band": band})
        own = (*keys, "grouping", "g_camera", "g_band")
        dev = with_deviation(marked, own)
        stats = dev.groupBy(*own).agg(F.count("*").alias("n_obs"), F.first("median").alias("med_mag"), (MAD_FACTOR * F.median("deviation")).alias("mad_sigma"), F.avg(F.col("error").cast("decimal(18,9)")).alias("mean_err"), F.first("source_median").alias("_m"))
        return stats.withColumn("offset", F.col("med_mag") - F.col("_m")).drop("_m")

    none_s, none_i = F.lit(None).cast("string"), F.lit(None).cast("int")
    return reduce(DataFrame.unionByName, (grouping("camera", F.col("camera"), none_i), grouping("band", none_s, F.col("band")), grouping("camera_band", F.col("camera"), F.col("band"))))


def counts_by_grouping_sets(points: DataFrame) -> DataFrame:
    """Counts and means of every source by camera, by band and by both, by one expansion of GROUPING SETS."""
    points = points.select("source_id", "camera", "band", "mag")
    return points.groupingSets([["source_id", "camera"], ["source_id", "band"], ["source_id", "camera", "band"]], "source_id", "camera", "band").agg(F.count("*").alias("n_obs"), F.avg("mag").alias("mean_mag"))


def cadence(points: DataFrame, keys: Keys = SOURCE) -> DataFrame:
    """Time between neighbours: mean, median, 5th and 95th percentile; the span."""
    dt = with_previous(points, keys)
    return dt.groupBy(*keys).agg(F.avg("dt").alias("dt_mean"), F.median("dt").alias("dt_median"), F.percentile("dt", F.lit(0.05)).alias("dt_p05"), F.percentile("dt", F.lit(0.95)).alias("dt_p95"), (F.max("jd") - F.min("jd")).alias("span"))


def cadence_by_camera(points: DataFrame, keys: Keys = SOURCE) -> DataFrame:
    return cadence(points, (*keys, "camera"))


def positive_cadence(points: DataFrame, keys: Keys = SOURCE) -> DataFrame:
    """Median of the positive times between neighbours."""
    return with_previous(points, keys).groupBy(*keys).agg(F.median(F.when(F.col("dt") > 0, F.col("dt"))).alias("cadence"))


def nightly(points: DataFrame, keys: Keys = SOURCE) -> DataFrame:
    out = points.withColumn("night", F.floor("jd").cast("long"))
    return out.groupBy(*keys, "night").agg(F.count("*").alias("n_exp"), F.median("mag").alias("med_mag"), F.median("error").alias("med_err"))


def duty_cycle(points: DataFrame, keys: Keys = SOURCE) -> DataFrame:
    """Nights with a point, and their share of the nights from first to last."""
    night = F.floor("jd").cast("long")
    out = points.groupBy(*keys).agg(F.countDistinct(night).alias("nights"), (F.max(night) - F.min(night) + 1).alias("_span"))
    return out.select(*keys, "nights", (F.col("nights") / F.col("_span")).alias("duty_cycle"))


def tumbling_counts(points: DataFrame, keys: Keys = SOURCE, days: float = 3.0) -> DataFrame:
    """Points in bins of so many days from the source's first."""
    since = F.col("jd") - F.min("jd").over(W.partitionBy(*keys))
    return points.withColumn("bin", F.floor(since / days).cast("long")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def trailing_counts(points: DataFrame, keys: Keys = SOURCE, days: float = 3.0) -> DataFrame:
    """points with the number of points in the days up to each, the earliest moment included."""
    return points.withColumn("n_trailing", F.expr(f"count(*) over (partition by {', '.join(keys)} order by jd range between {days!r}D preceding and current row)"))


def seasons(points: DataFrame, keys: Keys = SOURCE, gap_days: float = 30.0) -> DataFrame:
    """Runs of points without a gap of more than so many days: number, start, end, n_obs and span."""
    new = F.when(F.col("dt") > gap_days, 1).otherwise(0)
    out = with_previous(points, keys).withColumn("season", F.sum(new).over(in_time(keys)))
    return out.groupBy(*keys, "season").agg(F.min("jd").alias("start_jd"), F.max("jd").alias("end_jd"), F.count("*").alias("n_obs"), (F.max("jd") - F.min("jd")).alias("span"))


def top_gaps(points: DataFrame, keys: Keys = SOURCE, n: int = 10) -> DataFrame:
    """The longest gaps of each source, the longest first."""
    order = W.partitionBy(*keys).orderBy(F.desc("dt"), "jd", "seq")
    out = with_previous(points, keys).where(F.col("dt").isNotNull()).withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= n).select(*keys, "rank", "jd_before", "jd", "dt")


def per_camera_raw(points: DataFrame, keys: Keys = SOURCE) -> DataFrame:
    """The per-camera summary that survey pipelines ship: median, 16th and 84th, 5th and 95th percentiles."""
    out = points.groupBy(*keys, "camera").agg(F.median("mag").alias("median"), F.percentile("mag", F.array(*map(F.lit, (0.16, 0.84, 0.05, 0.95)))).alias("_p"))
    return out.select(*keys, "camera", "median", *(F.col("_p")[i].alias(n) for i, n in enumerate(("sig1_low", "sig1_high", "p90_low", "p90_high"))))


def raw_summary(raw: DataFrame, keys: Keys = SOURCE) -> DataFrame:
    """Faintest and brightest camera medians with their cameras, the range, and the median scatter."""
    out = raw.groupBy(*keys).agg(
        F.min(F.struct("median", "camera")).alias("_lo"), F.max(F.struct("median", "camera")).alias("_hi"),
        F.median(F.col("sig1_high") - F.col("sig1_low")).alias("raw_robust_scatter"),
    )
    low, high = F.col("_lo.median"), F.col("_hi.median")
    return out.select(*keys, low.alias("raw_median_min"), F.col("_lo.camera").alias("raw_min_camera"), high.alias("raw_median_max"), F.col("_hi.camera").alias("raw_max_camera"), (high - low).alias("raw_median_range"), "raw_robust_scatter")


def source_statistics(points: DataFrame, keys: Keys = SOURCE) -> DataFrame:
    """All scalar statistics of a source in one row: what summary, weighted_mean, robust_sigma, clipped, noise, reduced_chi2,
    von_neumann, lag1_autocorrelation, linear_trend, cadence and duty_cycle give. Windows and the aggregate share one
    exchange by source, and need none where points lie by source already (sources.layout)."""
    w, mag, error = W.partitionBy(*keys), F.col("mag"), F.col("error")
    fits = mag.isNotNull() & (error > 0)
    out = with_previous(points, keys).withColumns({"_m": F.median("mag").over(w), "_fm": F.median(F.when(fits, mag)).over(w), "_t": F.col("jd") - F.min("jd").over(w)})
    out = out.withColumn("_dev", F.abs(mag - F.col("_m")))
    out = out.withColumn("_s", MAD_FACTOR * F.median("_dev").over(w))
    inside = F.col("_dev") <= 3.0 * F.col("_s")
    weight, y = F.when(fits, 1 / (error * error)), mag - F.col("_fm")
    noisy, snr, step, night = F.when(error > 0, error), F.when(error > 0, SNR / error), mag - F.col("mag_before"), F.floor("jd").cast("long")
    shares = (0.05, 0.16, 0.25, 0.75, 0.84, 0.95)
    sums = out.groupBy(*keys).agg(
        F.count("mag").alias("n"), F.avg("mag").alias("mean"), F.median("mag").alias("median"), F.stddev_samp("mag").alias("std"), F.percentile("mag", F.array(*map(F.lit, shares))).alias("_p"),
        (F.sum(weight * mag) / F.sum(weight)).alias("wmean"), F.sqrt(1 / F.sum(weight)).alias("wsem"), F.first("_s").alias("robust_sigma"),
        F.avg(F.when(inside, mag)).alias("clipped_mean"), F.stddev_samp(F.when(inside, mag)).alias("clipped_std"), F.count_if(~inside).alias("n_outliers"),
        F.avg(noisy.cast("decimal(18,9)")).cast("double").alias("err_mean"), F.median(noisy).alias("err_median"), F.min(noisy).alias("err_min"), F.max(noisy).alias("err_max"), F.avg(snr).alias("snr_mean"), F.median(snr).alias("snr_median"), F.max(snr).alias("snr_max"),
        F.sum(weight).alias("_a"), F.sum(weight * y).alias("_b"), F.sum(weight * y * y).alias("_c"), F.count_if(fits).alias("_k"),
        F.avg(step * step).alias("_d"), F.var_samp("mag").alias("_v"), F.corr("mag_before", "mag").alias("_r"),
        F.regr_slope("mag", "_t").alias("slope"), F.regr_intercept("mag", "_t").alias("intercept"), F.regr_r2("mag", "_t").alias("r2"),
        F.avg("dt").alias("dt_mean"), F.median("dt").alias("dt_median"), F.percentile("dt", F.array(F.lit(0.05), F.lit(0.95))).alias("_q"), (F.max("jd") - F.min("jd")).alias("span"),
        F.size(F.collect_set(night)).cast("long").alias("nights"), (F.max(night) - F.min(night) + 1).alias("_nights"),
    )
    named = {f"p{round(100 * s):02d}": F.col("_p")[i] for i, s in enumerate(shares)}
    out = sums.withColumns(named).withColumns({
        "iqr": F.col("p75") - F.col("p25"), "chi2_red": F.when(F.col("_k") >= 2, (F.col("_c") - F.col("_b") * F.col("_b") / F.col("_a")) / (F.col("_k") - 1)),
        "von_neumann": F.when((F.col("n") >= 3) & (F.col("_v") > 0), F.col("_d") / F.col("_v")), "lag1": F.when(F.col("n") >= 3, F.col("_r")), "slope_per_year": F.col("slope") * YEAR,
        "dt_p05": F.col("_q")[0], "dt_p95": F.col("_q")[1], "duty_cycle": F.col("nights") / F.col("_nights"),
    })
    return out.drop("_p", "_a", "_b", "_c", "_k", "_d", "_v", "_r", "_q", "_nights")


def child_tables(points: DataFrame, keys: Keys = SOURCE) -> dict[str, DataFrame]:
    """The tables that go with source_statistics, by name."""
    made = {"groups": by_camera_and_band, "camera_cadence": cadence_by_camera, "nights": nightly, "bins": tumbling_counts, "trailing": trailing_counts, "seasons": seasons, "gaps": top_gaps}
    return {name: f(points, keys) for name, f in made.items()}

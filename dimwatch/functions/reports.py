"""Dates, list literals, labels and summaries of result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The start of 1995 as a Julian date, days of a year, and what shortened dates leave out.
EPOCH, YEAR_OF_EPOCH, DAYS, SHORTENED = 2_449_718.5, 1995, 365.25, 2_450_000.0


def year_to_jd(year: Column) -> Column:
    """Shortened Julian date of a year."""
    return (year - YEAR_OF_EPOCH) * DAYS + (EPOCH - SHORTENED)


def jd_to_year(jd: Column) -> Column:
    """Year of a shortened Julian date."""
    return (jd + (SHORTENED - EPOCH)) / DAYS + YEAR_OF_EPOCH


def parsed_list(literal: Column) -> Column:
    """Numbers of a list written as text, in brackets or not, parted by commas or spaces; null for a null text."""
    inner = F.regexp_replace(literal, r"^\s*[\[(]|[\])]\s*$", "")
    return F.transform(F.filter(F.split(F.trim(inner), r"[\s,]+"), lambda x: x != ""), lambda x: x.try_cast("double"))


def list_size_matches(literal: Column, n: Column) -> Column:
    """Whether a list has as many entries as it should; a null count is 0."""
    return F.coalesce(F.size(parsed_list(literal)), F.lit(0)) == F.coalesce(n, F.lit(0))


def top_by_dips(candidates: DataFrame, n: int = 20, fraction: str = "dip_fraction", key: str = "source_id") -> DataFrame:
    """The n candidates with the greatest dip fraction, missing ones last."""
    return candidates.orderBy(F.desc_nulls_last(fraction), key).limit(n)


def described(df: DataFrame, columns: Sequence[str], shares: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """A row per column: count, mean, sample standard deviation, least, percentiles and greatest, by one pass."""
    stats = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("least"), F.max(c).cast("double").alias("greatest"),
                      F.percentile(c, F.array(*map(F.lit, shares))).alias("p")) for c in columns]
    rows = df.agg(F.array(*stats).alias("_s")).select(F.inline("_s"))
    return rows.select("column", "n", "mean", "std", "least", *(F.col("p")[i].alias(f"p{round(100 * s):02d}") for i, s in enumerate(shares)), "greatest")


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """Rows by bin of equal width; the last bin holds its upper end, values outside aren't counted."""
    at = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def joined_names(df: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct names of each key, in order, by commas; `unknown` without any."""
    every = F.array_join(F.array_sort(F.collect_set(name)), ",")
    return df.groupBy(key).agg(F.when(every == "", "unknown").otherwise(every).alias(name))


def targets_by_bin(targets: DataFrame) -> DataFrame:
    """The ids that are wanted of each magnitude bin."""
    return targets.groupBy("mag_bin").agg(F.array_sort(F.collect_set("source_id")).alias("source_ids"))


def with_defaults(df: DataFrame, file: str = "source_file") -> DataFrame:
    """Missing magnitude bins filled from the name of the row's file."""
    low_high = F.regexp_extract(F.col(file), r"(\d+(?:_5)?_\d+(?:_5)?)", 1)
    return df.withColumn("mag_bin", F.coalesce("mag_bin", F.nullif(low_high, F.lit(""))))


def label(df: DataFrame, columns: Sequence[str]) -> Column:
    """`name: value` of the columns that have one, by commas."""
    return F.concat_ws(", ", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in columns if c in df.columns))


def ordered_columns(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """df with the named columns first, those that it has."""
    own = [c for c in first if c in df.columns]
    return df.select(*own, *(c for c in df.columns if c not in own))


def with_manifest(targets: DataFrame, manifest: DataFrame) -> DataFrame:
    """Targets with the paths of the manifest, and its magnitude bin before their own."""
    paths = manifest.select("source_id", F.col("mag_bin").alias("_bin"), "dat_path", "dat_exists")
    return targets.join(paths, "source_id", "left").withColumn("mag_bin", F.coalesce("_bin", "mag_bin")).drop("_bin")


def with_detections(targets: DataFrame, found: DataFrame) -> DataFrame:
    """Targets with the detections of their source and bin; clashing columns get `_det`."""
    keys = ["source_id", "mag_bin"]
    renamed = found.select(*keys, *(F.col(c).alias(f"{c}_det" if c in targets.columns else c) for c in found.columns if c not in keys))
    return targets.join(renamed, keys, "left")


def reproduction_report(targets: DataFrame, manifest: DataFrame, found: DataFrame) -> DataFrame:
    """A row per target: whether it was detected (by peaks in a band, or as a significant dip or jump), what was found in
    words, and whether that is as expected. Columns that the detections lack count as nothing found."""
    rows = with_detections(with_manifest(targets, manifest), found)
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in rows.columns else F.lit(0.0)
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in rows.columns else F.lit(False)
    peaks = {b: number(f"{b}_n_peaks").cast("long") for b in "gv"}
    flags = {k: flag(f"{k}_significant") for k in ("dip", "jump")}
    words = [F.when(n > 0, F.concat(F.lit(f"{b}: "), n.cast("string"), F.lit(" peaks"))) for b, n in peaks.items()] + [F.when(f, f"{k} significant") for k, f in flags.items()]
    seen = (peaks["g"] > 0) | (peaks["v"] > 0) | flags["dip"] | flags["jump"]
    out = rows.withColumn("detected", seen).withColumn("detection_details", F.when(seen, F.concat_ws("; ", *words)).otherwise("not detected"))
    out = out.withColumn("matches_expected", F.when(F.col("expected_detected").isNotNull(), F.col("detected") == F.col("expected_detected")))
    return ordered_columns(out, ("source_id", "mag_bin", "category", "detected", "expected_detected", "matches_expected", "detection_details"))

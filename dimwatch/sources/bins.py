"""Runs over magnitude bins that go on where they stopped.

Results lie below root in `rows`, a folder for each bin, and `commits` has a row for each bin that is done. A bin's rows replace what a
broken run left of them (dynamic partition overwrite) before its commit is added, so a restart repeats no bin that is done, and a bin
that was written without its commit is written again and not twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BIN = "mag_bin"


def _there(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def commits(spark: SparkSession, root: str) -> DataFrame:
    """mag_bin and n_rows of the bins that are done."""
    shape = f"{BIN} string, n_rows long"
    return spark.read.schema(shape).parquet(f"{root}/commits") if _there(spark, f"{root}/commits") else spark.createDataFrame([], shape)


def open_bins(bins: DataFrame, root: str) -> list[str]:
    """The bins that aren't done, in order; a handful of names, whatever the number of sources."""
    done = commits(bins.sparkSession, root).select(BIN)
    return [r[0] for r in bins.where(F.col(BIN).isNotNull()).select(BIN).distinct().join(done, BIN, "left_anti").orderBy(BIN).collect()]


def run_bins(bins: DataFrame, rows_of: Callable[[DataFrame], DataFrame], root: str, together: int = 1) -> DataFrame:
    """bins has source_id and mag_bin (and what rows_of needs); rows_of makes result rows (with source_id) of some bins' sources.
    So many bins make one job. Returns the rows of all bins that are done."""
    spark = bins.sparkSession
    todo = open_bins(bins, root)
    for at in range(0, len(todo), together):
        own = todo[at : at + together]
        sources = bins.where(F.col(BIN).isin(own))
        rows = rows_of(sources).join(sources.select("source_id", BIN).distinct(), "source_id")
        rows.repartition(BIN, F.pmod(F.xxhash64("source_id"), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BIN).parquet(f"{root}/rows")
        written = read_rows(spark, root).where(F.col(BIN).isin(own)).groupBy(BIN).count() if _there(spark, f"{root}/rows") else None
        counts = {r[0]: r[1] for r in written.collect()} if written is not None else {}
        spark.createDataFrame([(b, counts.get(b, 0)) for b in own], f"{BIN} string, n_rows long").coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return committed_rows(spark, root)


def read_rows(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(f"{root}/rows").withColumn(BIN, F.col(BIN).cast("string"))


def committed_rows(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the bins that are done; those of a bin that is being written don't count yet."""
    return read_rows(spark, root).join(F.broadcast(commits(spark, root).select(BIN).distinct()), BIN, "left_semi")  # a row per bin


def light_curves_of(sources: DataFrame, read: Callable[[SparkSession, Sequence[str]], DataFrame], pattern: str = "*.dat2") -> DataFrame:
    """The points of the sources of a manifest (lc_dir), by the folders they are in."""
    spark = sources.sparkSession
    folders = [r[0] for r in sources.select("lc_dir").distinct().orderBy("lc_dir").collect()]  # a few for each bin
    return read(spark, [f"{f}/{pattern}" for f in folders]).join(sources.select("source_id").distinct(), "source_id", "left_semi")

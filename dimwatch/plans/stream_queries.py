"""Queries that run the streaming counts over the table of events, once, and read what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_path
from ..streaming import counts
from .catalog_queries import Query, rounded
from .oracle import _PREVIOUS, _sql


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No point of a table that is read at once is late, so the watermark needs no delay and ends at the last point."""
    path = shared_path(spark)
    counts.run(counts.counted(counts.event_stream(spark, f"{sf_dir}/events.parquet"), "0 seconds"), path, shared_path(spark))
    return spark.read.parquet(path)


def streamed_trailing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir).select("source_id", "seq", "n_trailing")


def streamed_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir).groupBy("source_id", "bin").agg(F.max("n_in_bin").alias("n"))


def streamed_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark)
    counts.run(counts.seasons(counts.event_stream(spark, f"{sf_dir}/events.parquet"), gap_days=2.0), path, shared_path(spark), whole=True)
    return rounded(spark.read.parquet(path))


QUERIES: dict[str, Query] = {f.__name__: f for f in (streamed_trailing_counts, streamed_tumbling_counts, streamed_seasons)}
SQL: dict[str, str] = {
    "streamed_trailing_counts": _sql("SELECT *, count(*) OVER (PARTITION BY source_id ORDER BY jd RANGE BETWEEN 3.0 PRECEDING AND CURRENT ROW) AS n_trailing FROM e", "source_id seq n_trailing"),
    "streamed_tumbling_counts": _sql("SELECT source_id, floor((jd - first) / 3)::BIGINT AS bin, count(*) AS n FROM (SELECT *, min(jd) OVER (PARTITION BY source_id) AS first FROM e) GROUP BY ALL", "source_id bin n"),
    "streamed_seasons": _sql("SELECT source_id, min(jd) start_jd, max(jd) end_jd, count(*) n_obs, max(jd) - min(jd) span FROM (SELECT *, sum(CASE WHEN dt > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY jd, seq) AS season FROM p) GROUP BY source_id, season",
                             "source_id n_obs", "start_jd end_jd span", _PREVIOUS.format("e", "source_id")),
}

"""Points laid out by source: a bucketed, sorted table that windows and aggregates by source read without an exchange."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_points(points: DataFrame, name: str, buckets: int = 200) -> None:
    """Writes points as a table of so many buckets by source, one sorted file each; choose as many buckets as make files of some
    hundred megabytes. A source is one bucket's: its points go through one task in any case."""
    laid = points.repartition(buckets, "source_id")
    laid.write.bucketBy(buckets, "source_id").sortBy("source_id", "jd", "seq").mode("overwrite").saveAsTable(name)


def read_points(spark: SparkSession, name: str) -> DataFrame:
    """The points of such a table, dealt out by source as they lie."""
    return spark.table(name)

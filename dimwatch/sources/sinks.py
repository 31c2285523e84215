"""Writers of results. Each is one distributed write; appends go to folders, so a lost executor leaves no half row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_results(df: DataFrame, path: str, rows_per_file: int = 10_000, codec: str = "zstd") -> None:
    df.write.option("maxRecordsPerFile", rows_per_file).option("compression", codec).mode("overwrite").parquet(path)


def append_rows(df: DataFrame, path: str, partition_by: str | None = "mag_bin", kind: str = "parquet") -> None:
    """Adds rows to a table of CSV or parquet files, in a folder per value of a column."""
    out = df.write.mode("append").option("header", True)
    (out.partitionBy(partition_by) if partition_by else out).format(kind).save(path)


def write_peaks(df: DataFrame, root: str, mag_bin: str, stamp: str, kind: str = "csv") -> str:
    """A bin's peaks below a name of bin and time; what is there stays."""
    path = f"{root}/peaks_{mag_bin.replace('.', '_')}_{stamp}"
    df.write.mode("ignore").option("header", True).format(kind).save(path)
    return path


def write_each_and_all(df: DataFrame, root: str, by: str = "source_file") -> None:
    """Filtered candidates, in a folder per input file; read whole, they are the combined table."""
    df.withColumn("_part", F.col(by)).write.mode("overwrite").option("header", True).partitionBy("_part").csv(root)


def append_rejections(log: DataFrame, path: str) -> None:
    append_rows(log, path, None, "csv")


def write_stamped(df: DataFrame, root: str, name: str, stamp: str) -> str:
    """A cross-match or cleaned catalog as CSV below a name and time."""
    path = f"{root}/{name}_{stamp}"
    df.write.mode("errorifexists").option("header", True).csv(path)
    return path

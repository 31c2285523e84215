"""What the operators of this subpackage share: reading tables, folds, shared scratch tables and bounded samples."""

from __future__ import annotations

import tempfile
import uuid
from itertools import groupby, islice

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: White space of the corpus contracts: space and the five ASCII controls from tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, parts: int) -> Column:
    """The fold that a row belongs to: CRC-32 of its id as text, modulo parts; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def word_count(text: Column) -> Column:
    """Number of white-space separated words; null text has none."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.array_remove(F.split(text, SPACES), ""))).cast("long")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder that the session names. Where none is set, a local session (one
    machine, so its folders are shared) gets one; on a cluster that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/dimwatch-checkpoints"
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that a later one has replaced."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a file of small tables.
ROWS_A_FILE = 25_000


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder: later stages start from its files, so a lost executor costs no recomputation.
    rows: about how many there are, of a small table that many tasks would write as many tiny files."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    (df if rows is None else df.coalesce(max(1, -(-rows // ROWS_A_FILE)))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hashed(text: Column) -> Column:
    """A hash that orders texts at random, the same in every run."""
    return F.xxhash64(text)


def least_hashes(rows: DataFrame, most: int) -> list[Row]:
    """At most `most` rows of each group of rows (g, h), distinct, those with the least h: the same rows whatever the
    partitioning. Only rows below a bound that leaves about twice as many travel; no group meets in one task."""
    least = -(2**63)
    sizes = rows.groupBy("g").agg(F.approx_count_distinct("h").alias("n")).collect()
    bounds = [(r["g"], min(2**63 - 1, least + int(2**64 * min(1.0, 2 * most / max(1, r["n"]))))) for r in sizes]
    if not bounds:
        return []
    low = F.broadcast(rows.sparkSession.createDataFrame(bounds, f"g {dict(rows.dtypes)['g']}, bound long"))
    found = sorted(rows.join(low, "g").where("h <= bound").select("g", "h").distinct().collect())
    return [r for _, own in groupby(found, lambda r: r["g"]) for r in islice(own, most)]


def texts_of(docs: DataFrame, text: str, by: Column | str, chosen: list[Row]) -> dict[int, str]:
    """The texts of docs whose hashes `by` were chosen, each once, in order of hash."""
    if not chosen:
        return {}
    wanted = docs.sparkSession.createDataFrame(sorted({(r["h"],) for r in chosen}), "h long")
    rows = docs.select(F.col(text).alias("t"), (F.col(by) if isinstance(by, str) else by).alias("h")).join(F.broadcast(wanted), "h", "left_semi")
    return {r["h"]: r["t"] for r in rows.groupBy("h").agg(F.min("t").alias("t")).orderBy("h").collect()}

"""Star-schema tables as light-curve tables.

The point model is one long table: source_id, band, camera, jd, mag, error, saturated, good_bad and seq, a unique number
that orders points of one time. Ids are strings, times Julian dates in days, missing values null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT_COLUMNS = ("source_id", "band", "camera", "jd", "mag", "error", "saturated", "good_bad", "seq")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def julian(ts: str) -> str:
    """SQL for the Julian date of a timestamp without zone."""
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {ts}) / 86400e6D + 2440587.5D"


def event_points(events: DataFrame) -> DataFrame:
    """A source per user, a camera per event type; dense and short."""
    return events.selectExpr(
        "cast(user_id as string) as source_id", "cast(event_id % 2 as int) as band", "event_type as camera", f"{julian('ts')} as jd",
        "25D - 2.5D * log10(greatest(value, 0.01D)) as mag", "(cast(regexp_extract(props, '[0-9]+', 0) as double) + 1D) / 200D as error",
        "cast(event_id % 50 = 0 as int) as saturated", "cast(event_id % 10 <> 0 as int) as good_bad", "event_id as seq",
    )


def lineitem_points(lineitem: DataFrame) -> DataFrame:
    """A source per supplier, a camera per return flag; years long, as survey photometry is."""
    return lineitem.selectExpr(
        "cast(l_suppkey as string) as source_id", "cast(l_linestatus = 'O' as int) as band", "l_returnflag as camera",
        f"{julian('l_shipdate')} + ((l_orderkey * 7 + l_linenumber) % 1000) / 2000D as jd", "25D - 2.5D * log10(l_extendedprice) as mag", "0.01D + l_tax as error",
        "cast(l_orderkey % 50 = 0 as int) as saturated", "cast(l_orderkey % 10 <> 0 as int) as good_bad",
        "(l_orderkey * 10 + l_linenumber) * 100000000 + cast(round(l_extendedprice * 100) as bigint) as seq",
    )


def sky_catalog(keys: DataFrame, key: str, step: float, shift: float) -> DataFrame:
    """Positions from whole-number keys: a regular walk over right ascension and declination, moved by shift degrees."""
    k = F.col(key).cast("double")
    ra = F.pmod(k * F.lit(step) + F.lit(shift), F.lit(360.0))
    dec = F.pmod(k * F.lit(step * 0.61803), F.lit(170.0)) - 85.0 + F.lit(shift)
    return keys.select(F.col(key).cast("string").alias("source_id"), ra.alias("ra"), dec.alias("dec"))


def points(spark: SparkSession, sf_dir: str, of: str = "events") -> DataFrame:
    return event_points(table(spark, sf_dir, "events")) if of == "events" else lineitem_points(table(spark, sf_dir, "lineitem"))

"""Positions on the sky and joins by separation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAS = 3_600_000.0


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle separation in arc seconds, stable for small angles."""
    a, b = F.radians(dec2 - dec1) / 2, F.radians(ra2 - ra1) / 2
    h = F.sin(a) * F.sin(a) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * F.sin(b) * F.sin(b)
    return F.degrees(2 * F.asin(F.least(F.sqrt(h), F.lit(1.0)))) * 3600


def propagated(df: DataFrame, years: float = -16.0) -> DataFrame:
    """df with ra and dec moved by proper motion (mas a year; pm_ra holds the cosine of dec), along the tangent."""
    ra, dec = F.radians("ra"), F.radians("dec")
    a, b = F.radians(F.col("pm_ra") * years / MAS), F.radians(F.col("pm_dec") * years / MAS)
    x = F.cos(dec) * F.cos(ra) - a * F.sin(ra) - b * F.sin(dec) * F.cos(ra)
    y = F.cos(dec) * F.sin(ra) + a * F.cos(ra) - b * F.sin(dec) * F.sin(ra)
    z = F.sin(dec) + b * F.cos(dec)
    moved = df.withColumns({"_x": x, "_y": y, "_z": z})
    out = moved.withColumns({"ra": F.pmod(F.degrees(F.atan2("_y", "_x")), F.lit(360.0)), "dec": F.degrees(F.atan2(F.col("_z"), F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2)))})
    return out.drop("_x", "_y", "_z")


def _zones(dec: Column, size: float) -> Column:
    return F.floor((dec + 90.0) / size).cast("long")


def _cells_of_zone(zone: Column, size: float) -> Column:
    """Cells of right ascension in a zone: none narrower than size on the sky, at the zone's edge nearer a pole."""
    edge = F.greatest(F.abs(zone * size - 90.0), F.abs((zone + 1) * size - 90.0))
    return F.greatest(F.floor(360.0 * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / size), F.lit(1)).cast("long")


def pairs(left: DataFrame, right: DataFrame, radius_arcsec: float) -> DataFrame:
    """All pairs nearer than the radius, with sep_arcsec, by an equi-join on cells of the sky. left has _l, ra, dec;
    right has ra2, dec2 and more. The right side, the catalog, goes to the neighbouring cells too; near the poles, and
    across 0 hours, cells wrap around."""
    size = max(2 * radius_arcsec / 3600.0, 1 / 3600.0)
    own = left.withColumn("_zone", _zones(F.col("dec"), size))
    own = own.withColumn("_cells", _cells_of_zone(F.col("_zone"), size)).withColumn("_cell", F.pmod(F.floor(F.pmod(F.col("ra"), F.lit(360.0)) / 360.0 * F.col("_cells")).cast("long"), F.col("_cells")))
    near = right.withColumn("_zone", F.explode(F.sequence(_zones(F.col("dec2"), size) - 1, _zones(F.col("dec2"), size) + 1)))
    near = near.withColumn("_cells", _cells_of_zone(F.col("_zone"), size)).withColumn("_at", F.floor(F.pmod(F.col("ra2"), F.lit(360.0)) / 360.0 * F.col("_cells")).cast("long"))
    around = F.array_distinct(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda k: F.pmod(F.col("_at") + k, F.col("_cells"))))
    near = near.withColumn("_cell", F.explode(around)).drop("_cells", "_at")
    met = own.drop("_cells").join(near, ["_zone", "_cell"]).withColumn("sep_arcsec", separation(F.col("ra"), F.col("dec"), F.col("ra2"), F.col("dec2")))
    return met.where(F.col("sep_arcsec") < radius_arcsec).drop("_zone", "_cell")


def nearest(left: DataFrame, right: DataFrame, radius_arcsec: float, take: dict[str, str], to: str = "sep_arcsec", key: str = "source_id") -> DataFrame:
    """left with columns of the nearest row of right within the radius (ties: the least of them) and the separation;
    null without one. left's keys should be unique."""
    named = right.select(F.col("ra").alias("ra2"), F.col("dec").alias("dec2"), *(F.col(f"`{c}`").alias(n) for c, n in take.items()))
    met = pairs(left.select(key, "ra", "dec"), named, radius_arcsec)
    best = met.groupBy(key).agg(F.min(F.struct("sep_arcsec", *take.values())).alias("_b"))
    return left.join(best, key, "left").select(*left.columns, *(F.col(f"_b.{n}").alias(n) for n in take.values()), F.col("_b.sep_arcsec").alias(to))


def matched(df: DataFrame, catalogs: dict[str, DataFrame], radius_arcsec: float = 2.0) -> DataFrame:
    """df with matched_<tag> and match_sep_arcsec_<tag> for each catalog."""
    for tag, catalog in catalogs.items():
        df = nearest(df, catalog, radius_arcsec, {}, f"match_sep_arcsec_{tag}")
        df = df.withColumn(f"matched_{tag}", F.col(f"match_sep_arcsec_{tag}").isNotNull())
    return df


def match_counts(df: DataFrame, tag: str, category: str = "category") -> DataFrame:
    """Matched and all sources by category."""
    return df.groupBy(category).agg(F.count_if(f"matched_{tag}").alias("n_matched"), F.count("*").alias("n"))


def custom_id(ra: Column, dec: Column) -> Column:
    """J + hours, minutes, seconds, sign, degrees, minutes, seconds. The sign is that of dec itself."""
    two = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    hours, size = ra / 15, F.abs(dec)
    minutes, parts = (hours - F.floor(hours)) * 60, (size - F.floor(size)) * 60
    seconds, rest = F.round((minutes - F.floor(minutes)) * 60), F.round((parts - F.floor(parts)) * 60)
    return F.concat(F.lit("J"), two(F.floor(hours)), two(F.floor(minutes)), two(seconds), F.when(dec < 0, "-").otherwise("+"), two(F.floor(size)), two(F.floor(parts)), two(rest))

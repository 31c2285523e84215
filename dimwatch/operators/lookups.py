"""Lookups of a source's row by several keys: equi-joins in order of preference, never a join of all with all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ids this far apart aren't alike; characters of a shared beginning.
NEAR, PREFIX = 1000, 9


def _trimmed(name: str) -> Column:
    """An id without trailing zeros and point, as spreadsheets add them."""
    return F.regexp_replace(F.regexp_replace(name, "0+$", ""), r"\.+$", "")


def fuzzy_ids(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """id, match and rank: for each wanted id the best one there. Rank 0 is the same, 1 one that begins with the other
    and is within 1000 of it, 2 the least of the same nine first characters. Ids without any match have a null match.

    Close numbers meet in cells of 1000, so each id is compared with those of three cells only."""
    a = wanted.select(F.col("id").cast("string").alias("id")).where("id is not null").distinct()
    b = there.select(F.col("id").cast("string").alias("match")).where("match is not null").distinct()
    cell = lambda c: F.floor(F.col(c).try_cast("double") / NEAR)
    same = a.join(b, F.col("id") == F.col("match")).withColumn("rank", F.lit(0))
    near = a.withColumn("_c", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: cell("id") + d))).join(b.withColumn("_d", cell("match")), F.col("_c") == F.col("_d"))
    begins = F.startswith(_trimmed("id"), _trimmed("match")) | F.startswith(_trimmed("match"), _trimmed("id"))
    near = near.where(begins & (F.abs(F.col("id").try_cast("double") - F.col("match").try_cast("double")) < NEAR)).select("id", "match", F.lit(1).alias("rank"))
    firsts = b.where(F.length("match") >= PREFIX).groupBy(F.left("match", F.lit(PREFIX)).alias("_p")).agg(F.min("match").alias("match"))
    long = a.where(F.length(_trimmed("id")) >= PREFIX).withColumn("_p", F.left(_trimmed("id"), F.lit(PREFIX)))
    by_prefix = long.join(firsts, "_p").select("id", "match", F.lit(2).alias("rank"))
    best = same.unionByName(near).unionByName(by_prefix).groupBy("id").agg(F.min(F.struct("rank", "match")).alias("_b"))
    return a.join(best.select("id", "_b.match", "_b.rank"), "id", "left")


def by_precedence(df: DataFrame, table: DataFrame, keys: Sequence[tuple[Column, Column]], order: str, row: str = "_row") -> DataFrame:
    """df with the columns of the table's row that the first matching (df's, table's) pair of keys finds; of several rows
    the first by order. Rows without a match get nulls. Each key is one join with a table that has one row per key."""
    out = df
    columns = [c for c in table.columns if c not in df.columns]
    found = []
    for i, (own, its) in enumerate(keys):
        one = table.select(its.alias(f"_k{i}"), F.col(order).alias("_o"), F.struct(*columns).alias(f"_v{i}")).where(F.col(f"_k{i}").isNotNull())
        one = one.groupBy(f"_k{i}").agg(F.min_by(f"_v{i}", "_o").alias(f"_v{i}"))
        out = out.join(one, own == F.col(f"_k{i}"), "left")
        found.append(F.col(f"_v{i}"))
    return out.withColumn(row, F.coalesce(*found)).select(*df.columns, f"{row}.*")


def source_metadata(df: DataFrame, detections: DataFrame) -> DataFrame:
    """df (source_id, dat_path, source) with category and VSX class by id, else by path, else by name in any case; ids
    of light-curve files are also tried without their suffix and up to their first dash."""
    numbered = detections.withColumn("_at", F.monotonically_increasing_id())
    wanted = df.withColumn("_id", F.trim("source_id"))
    keys = [(F.col("_id"), F.col("Match_ID")), (F.trim("dat_path"), F.col("DAT_Path"))]
    named = numbered.withColumn("_name", F.lower(F.trim("Source")))
    keys += [(F.lower(F.trim("source")), F.col("_name")), (F.replace("_id", F.lit("-light-curves"), F.lit("")), F.col("Match_ID")), (F.substring_index("_id", "-", 1), F.col("Match_ID"))]
    return by_precedence(wanted, named.select("Match_ID", "DAT_Path", "_name", F.col("Category").alias("category"), F.col("VSX_Class").alias("vsx_class"), "_at"), keys, "_at").drop("_id", "Match_ID", "_name", "_at")


def as_candidates(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Known records of wanted paths or ids, once each; those that aren't known get `unknown` and no expectation."""
    ids = wanted.select(F.regexp_extract(F.trim(F.col("id").cast("string")), r"([^/]+?)(-light-curves)?(\.(csv|dat2?|raw))?$", 1).alias("source_id")).where("source_id <> ''").distinct()
    rows = known.withColumn("source_id", F.col("source_id").cast("string")).dropDuplicates(["source_id"])
    return ids.join(rows, "source_id", "left").fillna({"category": "unknown"})

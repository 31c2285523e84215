"""Mixing sources to target weights, in DataFrame operations only.

Every document has a hash-random key (MD5 of its id and text, so rows without ids are dealt out too), so "sorted by key" is a random order that reruns share. A
source's documents are laid out by key in buckets, the key's leading hex digits: a range partition of the sort that
needs no sampling and splits a hot source like any other. Sums by (source, bucket) give each bucket's offset, a window
within the bucket the rest of the prefix sum, and a source's order is cut where its target is reached. Targets above
the source's size take whole epochs first; the cut falls in the last one. The document at the cut gives only the words
that are still needed, so a source takes its target, rounded down.

Null ids, sources and texts are values like others (size 0 for null text); a null source sorts last; rows that repeat
an id are mixed each on its own; empty input gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import word_count, written

#: Leading hex digits of the key that make a bucket: 4,096 buckets a source.
BUCKET_DIGITS = 3
#: A source gives each of its words at most so many times.
MOST_EPOCHS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_EPOCHS) -> DataFrame:
    """sizes (source, source_size; a row per source) with `target`: the whole size shared by weight, none above `most`
    times its source's size, the excess shared again among the rest.

    With sources in the order of limit / weight, those at their limits are a prefix: the share of a weight of 1, once
    the first k sources are at their limits, is (all - their limits) / (the others' weights), and the first k whose
    next source stays below its limit is right. Windows over this table run in one task; it has a row per source.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    weighted = weighted.withColumn("limit", F.lit(most) * F.col("source_size")).withColumn("full_at", F.col("limit") / F.col("weight"))
    order = W.orderBy("full_at", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy()
    share = (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(after)
    shared = weighted.withColumn("share", share).withColumn("free", F.col("share") <= F.col("full_at"))
    level = F.min(F.when(F.col("free"), F.struct("full_at", "share"))).over(whole)["share"]
    return shared.select("source", "source_size", F.least(F.col("limit").cast("double"), F.col("weight") * level).alias("target"))


def _named(source: Column) -> Column:
    """A join key that tells a null source from every text."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def random_key(key: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))


def mix(sized: DataFrame, key: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_EPOCHS) -> DataFrame:
    """sized (key, source, size, _key and others) with source_size, target, and `taken`, the words that the mix takes
    of a row, repeats counted."""
    laid = sized.withColumn("_name", _named(F.col("source")))
    laid = laid.withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    sums = laid.groupBy("_name", "_bucket").agg(F.first("source").alias("source"), F.sum("size").alias("bucket_size"))
    by_source = sums.groupBy("_name").agg(F.first("source").alias("source"), F.sum("bucket_size").alias("source_size"))
    goals = targets(by_source.select("source", "source_size"), weights, most).withColumn("_name", _named(F.col("source"))).drop("source")
    earlier = W.partitionBy("_name").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("_name", "_bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("_offset")).join(goals, "_name")
    within = W.partitionBy("_name", "_bucket").orderBy("_key", key, "size").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("_offset") + F.coalesce(F.col("_within"), F.lit(0))
    whole = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0)
    rest = F.least(F.greatest(whole - epochs * F.col("source_size") - start, F.lit(0)), F.col("size"))
    placed = laid.withColumn("_within", F.sum("size").over(within)).join(offsets, ["_name", "_bucket"])
    return placed.withColumn("taken", (epochs * F.col("size") + rest).cast("long")).drop("_name", "_key", "_bucket", "_within", "_offset")


def mix_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """key, size, source_size, target and taken of every document; sizes are counted once and written, without texts."""
    sized = written(docs.select(F.col(key), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), random_key(F.col(key), F.col(text)).alias("_key")))
    return mix(sized, key).select(key, "size", "source_size", "target", "taken")


#: DuckDB's statement of the same result.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS k FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, 3.0::DOUBLE * source_size / weight AS full_at FROM s),
h AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS share FROM r),
t AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT arg_min(share, full_at) FROM h WHERE share <= full_at)) AS target FROM h),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size) ELSE 0 END AS epochs
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(greatest(floor(target) - epochs * source_size - before, 0), size))::BIGINT AS taken FROM p
"""

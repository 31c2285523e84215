"""Minimum-cost-flow resharding: new shards of given capacities, made from the old ones with the fewest bytes moved.

Old shards send their bytes to new shards; what stays where it is costs nothing, what moves costs its bytes, or what the caller's
table of costs says. The minimum-cost flow between them (successive shortest paths with potentials; its size is that of the shard
counts, whatever the number of rows) says how many bytes each old shard gives to each new one. A flow is turned into blocks: the rows of an old
shard are laid out along a line of bytes, and each new shard takes an interval of it. Large rows come first and the part that stays is the
first interval, so cuts fall among small rows, and a row lies where its middle does. The place of a row on the line is a prefix sum in
two steps: sums of buckets (old shard, power of two of the size, leading bits of a hash of id and text), then a window within the bucket.
There are at most 1,024 buckets for each old shard and power of two, and a hot shard spreads over all of its own.

A table that is stored in a folder for each shard is rewritten where it changes only: `stage` writes the new content of the
affected shards to the shared folder, `commit` replaces them and can be repeated after a fault.

Null text is empty (size 1); null ids count as empty texts in the hash; rows that repeat id and text are rows of their own and
share a bucket, and which of them comes first makes no difference to the result. An empty table gives an empty result. Other columns are ignored by the query and kept by the rewriting.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, written

#: The query's shards before and after.
OLD, NEW = 12, 16
#: Leading bits of a row's hash that make a bucket.
BUCKET_BITS = 10

Transfers = list[tuple[int, int, int]]


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: Sequence[Sequence[int]]) -> list[list[int]]:
    """flow[i][j], which ships every supply within the capacities at the least total cost; ValueError if they are too small.

    Successive shortest paths: Dijkstra on reduced costs from all old shards with bytes left to the nearest new shard with
    room, paths going back over flow that exists. Costs must not be negative.
    """
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError(f"{sum(supply)} bytes don't fit into {sum(capacity)}")
    flow, left, room, high = [[0] * m for _ in range(n)], list(supply), list(capacity), [0] * (n + m)
    while any(left):
        far, back = [None] * (n + m), [None] * (n + m)
        queue = [(0, i) for i in range(n) if left[i]]
        for _, i in queue:
            far[i] = 0
        done: set[int] = set()
        while queue:
            d, u = heapq.heappop(queue)
            if u in done:
                continue
            done.add(u)
            steps = [(n + j, cost[u][j]) for j in range(m)] if u < n else [(i, -cost[i][u - n]) for i in range(n) if flow[i][u - n]]
            for v, c in steps:
                to = d + c + high[u] - high[v]
                if far[v] is None or to < far[v]:
                    far[v], back[v] = to, u
                    heapq.heappush(queue, (to, v))
        end = min((n + j for j in range(m) if room[j] and far[n + j] is not None), key=lambda v: far[v] + high[v])
        most = max(f for f in far if f is not None)
        high = [h + (most if f is None else f) for h, f in zip(high, far, strict=True)]
        path, v = [], end
        while back[v] is not None:
            path.append((back[v], v))
            v = back[v]
        amount = min([left[v], room[end - n], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[v] -= amount
        room[end - n] -= amount
    return flow


def transfers(sizes: dict[int, int], capacities: Sequence[int], costs: Sequence[Sequence[int]] | None = None) -> Transfers:
    """(old shard, new shard, bytes) of the cheapest flow; of each old shard first what stays, then by new shard."""
    old = sorted(sizes)
    costs = costs or [[int(i != j) for j in range(len(capacities))] for i in old]
    flow = min_cost_flow([sizes[i] for i in old], capacities, costs)
    return [(i, j, flow[a][j]) for a, i in enumerate(old) for j in sorted(range(len(capacities)), key=lambda j: (j != i, j)) if flow[a][j]]


def even(total: int, shards: int) -> list[int]:
    """Capacities that add up to total, at most one byte apart."""
    return [total // shards + (j < total % shards) for j in range(shards)]


def _buckets(size: Column, chance: Column) -> list[Column]:
    return [F.floor(F.log2(F.greatest(size, F.lit(1)))).cast("int").alias("power"), F.shiftrightunsigned(chance, 64 - BUCKET_BITS).cast("int").alias("bucket")]


def place(rows: DataFrame, plan: Transfers) -> DataFrame:
    """rows (old int, size long, chance long, tie and others) with `shard`, the new shard that takes the middle of the row."""
    spark = rows.sparkSession
    upto: dict[int, int] = {}
    cuts = []
    for old, new, amount in plan:
        start = upto.get(old, 0)
        upto[old] = start + amount
        cuts.append((old, start, upto[old], new))
    lines = F.broadcast(spark.createDataFrame(cuts, "old int, low long, high long, shard int"))  # old and new shards less one at most
    laid = rows.select("*", *_buckets(F.col("size"), F.col("chance")))
    sums = laid.groupBy("old", "power", "bucket").agg(F.sum("size").alias("n"))
    earlier = W.partitionBy("old").orderBy(F.desc("power"), "bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("old", "power", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = W.partitionBy("old", "power", "bucket").orderBy("chance", "tie", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = laid.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["old", "power", "bucket"])
    middle = F.col("offset") + F.col("within") + F.floor(F.col("size") / 2)
    return placed.withColumn("middle", middle).join(lines, "old").where("middle >= low and middle < high").drop("middle", "low", "high", "offset", "within")


def slotted(placed: DataFrame) -> DataFrame:
    """placed with `slot`, from 0 within each shard without gaps: rows of the shard in buckets before, and the place in the bucket."""
    bucket = ["shard", "old", "power", "bucket"]
    counts = placed.groupBy(*bucket).agg(F.count("*").alias("n"))
    earlier = W.partitionBy("shard").orderBy("old", F.desc("power"), "bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*bucket, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    own = F.row_number().over(W.partitionBy(*bucket).orderBy("chance", "tie", "size"))
    return placed.withColumn("own", own).join(offsets, bucket).withColumn("slot", F.col("offset") + F.col("own") - 1).drop("own", "offset", "power", "bucket")


def sizes(rows: DataFrame, shard: str = "old", size: str = "size") -> dict[int, int]:
    return {r[0]: r[1] for r in rows.groupBy(shard).agg(F.sum(size)).collect()}


def resharded(docs: DataFrame, key: str = "doc_id", text: str = "text", old: int = OLD, new: int = NEW) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard and old_shard of every document. Equal texts lie together in the old
    shards (the text's CRC modulo old); the new ones are of equal bytes, so their law is `bytes`."""
    whole = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(key).alias("tie"), whole.alias("text"))
    crc = F.crc32(F.col("text").cast("binary"))
    rows = written(named.select("tie", (F.octet_length("text") + 1).cast("long").alias("size"), crc.alias("crc"), F.pmod(crc, F.lit(old)).cast("int").alias("old"), F.xxhash64(F.coalesce(F.col("tie").cast("string"), F.lit("")), F.col("text")).alias("chance")))
    found = sizes(rows)
    plan = transfers(found, even(sum(found.values()), new))
    out = slotted(written(place(rows, plan)))
    return out.select(F.col("tie").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"))


def stage(spark: SparkSession, path: str, capacities: Sequence[int] | None = None, new: int = NEW, shard: str = "shard", key: str = "doc_id", text: str = "text") -> tuple[str, list[int]]:
    """Solves the resharding of the table in path (a folder `shard=N` for each), reads the shards that give or take rows, and
    writes their new content to the shared folder. Returns that table's path and the affected shards. capacities: bytes of each new shard."""
    stored = spark.read.parquet(path)
    size = (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long")
    found = sizes(stored.select(F.col(shard).cast("int").alias("old"), size.alias("size")))
    plan = transfers(found, capacities or even(sum(found.values()), new))
    moved = [t for t in plan if t[0] != t[1]]
    affected = sorted({s for t in moved for s in t[:2]})
    chance = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    whole = F.struct(*[c for c in stored.columns if c != shard])
    rows = stored.where(F.col(shard).isin(affected)).select(F.col(shard).cast("int").alias("old"), size.alias("size"), chance.alias("chance"), F.col(key).alias("tie"), whole.alias("row"))
    staged = written(place(rows, [t for t in plan if t[0] in affected]).select("row.*", F.col("shard").alias(shard)))
    return staged.inputFiles()[0].rpartition("/")[0] if affected else "", affected


def commit(spark: SparkSession, path: str, staged: str, affected: list[int], shard: str = "shard") -> None:
    """Replaces the affected shards of the table in path by the staged rows; the other shards' files stay as they are. The staged
    table is complete, so a commit that was broken off is repeated, with the same result."""
    if not affected:
        return
    rows = spark.read.parquet(staged)
    rows.repartition(shard, F.pmod(F.xxhash64(*[c for c in rows.columns if c != shard]), F.lit(8))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(shard).parquet(path)
    for gone in set(affected) - {r[0] for r in rows.select(shard).distinct().collect()}:
        dropped(spark, f"{path}/{shard}={gone}")


def reshard(spark: SparkSession, path: str, capacities: Sequence[int] | None = None, new: int = NEW, shard: str = "shard", key: str = "doc_id", text: str = "text") -> list[int]:
    """Rewrites the table in path into shards of the capacities (even ones if none are given); returns the shards it rewrote."""
    staged, affected = stage(spark, path, capacities, new, shard, key, text)
    commit(spark, path, staged, affected, shard)
    return affected

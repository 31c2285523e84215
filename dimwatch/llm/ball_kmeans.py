"""Centroid clustering by ball k-means, exact in integers.

A cluster is a ball: its centroid and a radius that no member exceeds. Only centroids within twice the radius are neighbours
of a ball; the others can't be nearer to a member than its own. A member that is nearer to its centroid than half the way to the
nearest neighbour is in the stable core and stays without another distance. The rest lie in annuli between the half ways to one
neighbour and to the next, and are compared with exactly the neighbours up to their annulus. The first round compares
with all centroids. Radii come from the round before: the largest distance of a member to its centroid, and how far the centroid
has moved since, both rounded up, so balls are never too small.

Vectors and the cluster of each are written after every round, and the table before is dropped, so a lost executor costs a
task of one round and disk holds two copies at most. A task adds up its own members of each cluster; the driver gets one row for each cluster. No row is
moved: copies and large clusters stay where they were read.

Vectors of another length, with null or non-finite components, or null, are left out. Null ids count as empty texts in the choice of first centroids, and
rows that repeat an id are vectors of their own. Fewer vectors than centroids make one centroid of each; no vectors make an
empty result. Components of 2**27 or more after scaling would leave 64 bits and are an error. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dropped, scratch_dir

COMPONENTS = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
SEED = "2"
#: Scaled components stay below, so that squared distances of 64 components fit into 64 bits.
MOST = 2**27


@dataclass(frozen=True)
class Balls:
    """centroids; for each, its neighbours by growing distance, and those squared distances. No neighbours: all are compared."""

    centroids: np.ndarray
    near: list[np.ndarray] | None = None
    apart: list[np.ndarray] | None = None


def _up(square: int) -> int:
    """The square root, rounded up."""
    return isqrt(square - 1) + 1 if square > 0 else 0


def balls(centroids: np.ndarray, before: np.ndarray, radius2: dict[int, int]) -> Balls:
    """Neighbours of each centroid, from the largest squared distance that a member had to the centroid before."""
    near, apart = [], []
    for i, c in enumerate(centroids):
        between = ((centroids - c) ** 2).sum(1)
        radius = _up(radius2.get(i, 0)) + _up(int(((c - before[i]) ** 2).sum()))
        order = np.argsort(between, kind="stable")
        order = order[(order != i) & (between[order] <= 4 * radius * radius)]
        near.append(order)
        apart.append(between[order])
    return Balls(centroids, near, apart)


def nearest(vectors: np.ndarray, own: np.ndarray | None, among: Balls) -> tuple[np.ndarray, np.ndarray, int]:
    """Each vector's nearest centroid, of several the first, the squared distance, and how many distances it took. own: the clusters that the balls were made for."""
    to = lambda rows, c: ((rows - among.centroids[c]) ** 2).sum(1)
    n, taken = len(vectors), 0
    best, least = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if own is None:
        for c in range(len(among.centroids)):
            d = to(vectors, c)
            nearer = (d < least) | (c == 0)
            best[nearer], least[nearer] = c, d[nearer]
        return best, least, n * len(among.centroids)
    for c in np.unique(own):
        at = np.flatnonzero(own == c)
        best[at], least[at] = c, to(vectors[at], c)
        annulus = np.searchsorted(among.apart[c], 4 * least[at], side="right")  # as far away as twice: may tie
        taken += len(at)
        for k, other in enumerate(among.near[c][: annulus.max(initial=0)]):
            reach = at[annulus > k]
            d = to(vectors[reach], other)
            nearer = (d < least[reach]) | (d == least[reach]) & (other < best[reach])
            best[reach[nearer]], least[reach[nearer]] = other, d[nearer]
            taken += len(reach)
    return best, least, taken


def _pass(among: Balls, first: bool, last: bool):
    """Assigns the vectors of a task; then a row for each of its clusters: members, sums, radius and inertia."""
    k, size = among.centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, radius2, inertia = np.zeros(k, np.int64), np.zeros((k, size), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
        key_type = None
        for batch in batches:
            key_type = batch["key"].type
            if not batch.num_rows:
                continue
            vectors = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            if np.abs(vectors).max() >= MOST:
                raise OverflowError(f"scaled components of {MOST} or more")
            best, d, _ = nearest(vectors, None if first else batch["cluster"].to_numpy(), among)
            counts += np.bincount(best, minlength=k)
            np.add.at(sums, best, vectors)
            np.add.at(inertia, best, d)
            np.maximum.at(radius2, best, d)
            n = batch.num_rows
            vector = pa.nulls(n, pa.list_(pa.int64())) if last else batch["v"].cast(pa.list_(pa.int64()))
            yield pa.record_batch([batch["key"], vector, pa.array(best.astype(np.int32)), pa.array(d), *(pa.nulls(n, pa.int64()) for _ in range(3)), pa.nulls(n, pa.list_(pa.int64()))], names=_STATE)
        if key_type is not None and (used := np.flatnonzero(counts)).size:
            n = len(used)
            yield pa.record_batch(
                [pa.nulls(n, key_type), pa.nulls(n, pa.list_(pa.int64())), pa.array(used.astype(np.int32)), pa.nulls(n, pa.int64()), pa.array(counts[used]), pa.array(radius2[used]), pa.array(inertia[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=_STATE
            )

    return run


_STATE = ["key", "v", "cluster", "distance", "members", "radius2", "inertia", "sums"]


def scaled(vectors: DataFrame, key: str, vector: str, components: int, scale: int) -> DataFrame:
    """key and v, the whole components: floor(scale * x) of the vectors that are kept."""
    v = F.col(vector)
    fine = (F.size(v) == components) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(fine).select(F.col(key).alias("key"), F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"))


def cluster(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = SEED, components: int = COMPONENTS, scale: int = SCALE
) -> tuple[DataFrame, np.ndarray, dict[int, int]]:
    """key, cluster and distance of each vector; the final centroids; the inertia of each cluster that has vectors."""
    spark = vectors.sparkSession
    whole = scaled(vectors, key, vector, components, scale)
    chance = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary"), 256)
    centroids = np.array([r["v"] for r in whole.orderBy(chance, "v").limit(k).select("v").collect()], np.int64).reshape(-1, components)
    shape = f"key {dict(whole.dtypes)['key']}, v array<long>, cluster int, distance long, members long, radius2 long, inertia long, sums array<long>"
    among, now, path, totals = Balls(centroids), whole, None, []
    for turn in range(rounds + 1):
        out = scratch_dir(spark)
        now.mapInArrow(_pass(among, turn == 0, turn == rounds), shape).write.parquet(out)
        if path:
            dropped(spark, path)
        path, state = out, spark.read.schema(shape).parquet(out)
        now = state.where("members is null").select("key", "v", "cluster")
        totals = _totals(state, components)
        if turn < rounds:
            after = centroids.copy()
            for c, (members, _, _, sums) in totals.items():
                after[c] = sums // members
            among, centroids = balls(after, centroids, {c: t[1] for c, t in totals.items()}), after
    return state.where("members is null").select("key", "cluster", "distance"), centroids, {c: t[2] for c, t in totals.items()}


def _totals(state: DataFrame, components: int) -> dict[int, tuple[int, int, int, np.ndarray]]:
    """Members, squared radius, inertia and sums of each cluster that has members."""
    parts = state.where("members is not null").groupBy("cluster")
    rows = parts.agg(F.sum("members"), F.max("radius2"), F.sum("inertia"), *(F.sum(F.col("sums")[i]) for i in range(components))).collect()
    return {r[0]: (r[1], r[2], r[3], np.array(r[4:], np.int64)) for r in rows}


def clustered(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", **more) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector."""
    spark: SparkSession = vectors.sparkSession
    rows, centroids, inertia = cluster(vectors, key, vector, **more)
    named = [(c, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c in sorted(inertia)]
    totals = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(totals), "cluster").select(F.col("key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """DuckDB's statement of the same result: every round compares every vector with every centroid."""
    parts = [
        """x AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)) AS v FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0)""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT v, sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h FROM x ORDER BY h, v LIMIT {k}))""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""d{i} AS (SELECT r, vec_id, c, d, v FROM (SELECT x.r, x.vec_id, x.v, c.c, (list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, c.v) + list_inner_product(c.v, c.v))::BIGINT AS d FROM x CROSS JOIN c{i} c)
           QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < rounds:
            parts.append(f"""s{i} AS (SELECT c, p, floor(sum(y) / count(*)) AS m FROM (SELECT c, unnest(v) AS y, unnest(range(64)) AS p FROM d{i}) GROUP BY c, p)""")
            parts.append(f"""c{i + 1} AS (SELECT c0.c, coalesce(n.v, c0.v) AS v FROM c{i} c0 LEFT JOIN (SELECT c, list(m ORDER BY p) AS v FROM s{i} GROUP BY c) n ON n.c = c0.c)""")
    last = f"d{rounds}"
    return f"""WITH {", ".join(parts)}
SELECT {last}.vec_id, {last}.c::INTEGER AS cluster, {last}.d AS distance, (sum(d) OVER (PARTITION BY {last}.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(f.v, lambda y: y::BIGINT), ',')) AS centroid_sha256
FROM {last} JOIN c{rounds} f ON f.c = {last}.c"""


SQL = _sql()

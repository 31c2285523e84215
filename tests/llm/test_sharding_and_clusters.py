"""Resharding and ball k-means against brute force, SQL and odd rows."""

import itertools
import math
import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from dimwatch.llm import ball_kmeans, registry, resharding
from tests.compare import difference

DOCS = "doc_id long, text string, lang string, size long, shard int, slot int, chance long, bucket int"


def test_clusters_match_sql(spark, sf_dir, duck):
    assert not difference(registry.op12_ball_kmeans(spark, sf_dir).toPandas(), duck.execute(ball_kmeans.SQL).df())


def test_balls_compare_less_and_find_the_same():
    rng = np.random.default_rng(3)
    for size, spread in ((2, 3), (2, 40), (5, 8)):  # small ranges make ties
        vectors = np.concatenate([rng.integers(-spread, spread, (200, size)) + 60 * rng.integers(-3, 3, size) for _ in range(6)])
        before = vectors[rng.choice(len(vectors), 12, replace=False)]
        own, d, _ = ball_kmeans.nearest(vectors, None, ball_kmeans.Balls(before))
        for _ in range(4):
            radius2 = {c: int(d[own == c].max()) for c in np.unique(own)}
            centroids = np.array([vectors[own == c].sum(0) // (own == c).sum() if (own == c).any() else before[c] for c in range(12)])
            every = ((vectors[:, None] - centroids[None]) ** 2).sum(2)
            found, least, taken = ball_kmeans.nearest(vectors, own, ball_kmeans.balls(centroids, before, radius2))
            assert (found == every.argmin(1)).all() and (least == every.min(1)).all() and taken < every.size
            own, d, before = found, least, centroids


def test_odd_vectors(spark):
    good = [float(i % 7) / 8 for i in range(64)]
    rows = [(1, good, 1), (1, good, 1), (None, good[::-1], 2), (2, good[:63], 3), (3, [*good[:63], None], 4), (4, [*good[:63], math.nan], 5), (5, [*good[:63], -math.inf], 6), (6, None, 7), (7, [], 8)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int")
    out = sorted((r["vec_id"] or 0, r["cluster"], r["distance"], r["inertia"]) for r in ball_kmeans.clustered(vectors).collect())
    assert [r[0] for r in out] == [0, 1, 1] and {r[2:] for r in out} == {(0, 0)} and out[1] == out[2]
    assert ball_kmeans.clustered(vectors.limit(0)).collect() == []
    with pytest.raises(Exception, match="scaled components"):
        ball_kmeans.clustered(spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")).collect()


def test_splitting_the_input_changes_nothing(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    one, many = (sorted(map(tuple, ball_kmeans.clustered(vectors.repartition(n)).collect())) for n in (1, 7))
    assert one == many


def cheapest(supply, capacity, cost):
    """By trying every way to share each supply."""
    if not supply:
        return 0
    ways = (w for w in itertools.product(*(range(min(supply[0], c) + 1) for c in capacity)) if sum(w) == supply[0])
    rests = ((sum(a * b for a, b in zip(w, cost[0], strict=True)), cheapest(supply[1:], [c - x for c, x in zip(capacity, w, strict=True)], cost[1:])) for w in ways)
    return min((a + b for a, b in rests if b is not None), default=None)


def test_flow_costs_least():
    rng = random.Random(4)
    for _ in range(60):
        n, m = rng.randint(1, 3), rng.randint(1, 3)
        supply, capacity = [rng.randint(0, 4) for _ in range(n)], [rng.randint(0, 5) for _ in range(m)]
        cost = [[rng.randint(0, 5) for _ in range(m)] for _ in range(n)]
        if sum(supply) > sum(capacity):
            with pytest.raises(ValueError):
                resharding.min_cost_flow(supply, capacity, cost)
            continue
        flow = resharding.min_cost_flow(supply, capacity, cost)
        assert [sum(r) for r in flow] == supply and all(sum(c) <= k for c, k in zip(zip(*flow, strict=True), capacity, strict=True))
        assert sum(f * c for a, b in zip(flow, cost, strict=True) for f, c in zip(a, b, strict=True)) == cheapest(supply, capacity, cost)


def test_moves_are_the_fewest_bytes():
    sizes = {0: 50, 1: 10, 2: 30}
    plan = resharding.transfers(sizes, [30, 30, 30])
    assert sum(b for i, j, b in plan if i != j) == 20 and plan[0] == (0, 0, 30)


def check_shards(out, texts, shards=16):
    """Every document once with its size and CRC, gapless slots, and bytes that differ by cuts alone."""
    assert sorted((r["doc_id"] is not None, r["doc_id"], r["size"], r["text_crc32"]) for r in out) == sorted((i is not None, i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    for s in {r["shard"] for r in out}:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert {(r["law"], r["grown_shard"]) for r in out} <= {("bytes", None)} and all(0 <= r["shard"] < shards for r in out)


def test_documents_in_even_shards(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = registry.op11_resharding(spark, sf_dir).collect()
    check_shards(out, [(r["doc_id"], r["text"]) for r in docs.collect()])
    sizes = [sum(r["size"] for r in out if r["shard"] == s) for s in range(16)]
    even = sum(sizes) / 16
    moved = sum(r["size"] for r in out if r["shard"] != r["old_shard"])
    least = sum(max(0, sum(r["size"] for r in out if r["old_shard"] == s) - even) for s in range(12))
    assert max(abs(s - even) for s in sizes) < 0.2 * even and abs(moved - least) < even
    many = [tuple(r) for r in resharding.resharded(docs.repartition(9)).collect()]
    assert sorted(many) == sorted(tuple(r) for r in out)


def test_odd_documents(spark):
    texts = [(None, None), (None, None), (1, ""), (1, ""), (2, "é" * 30_000), (3, "é" * 30_000), *((i, "copy of one text") for i in range(4, 400)), (400, "\U0001f600")]
    docs = spark.createDataFrame([(i, t, "en", 0, 0, 0, 0, 0) for i, t in texts], DOCS)
    check_shards(resharding.resharded(docs).collect(), texts)
    assert resharding.resharded(docs.limit(0)).collect() == []


def files(path):
    return {str(p): p.read_bytes() for p in Path(path).rglob("*.parquet")}


def test_only_affected_files_are_rewritten(spark, tmp_path):
    path = f"{tmp_path}/stored"
    texts = [(i, "x" * (i % 50)) for i in range(600)]
    docs = spark.createDataFrame([(i, t, i) for i, t in texts], "doc_id long, text string, size long").withColumn("shard", F.when(F.col("doc_id") < 300, 0).when(F.col("doc_id") < 400, 1).when(F.col("doc_id") < 500, 2).otherwise(3))
    docs.write.partitionBy("shard").parquet(path)
    before, size = files(path), {r["shard"]: r["n"] for r in docs.groupBy("shard").agg(F.sum(F.octet_length("text") + 1).alias("n")).collect()}
    wanted = [size[0] - 1000, size[1], size[2] + 1000 + size[3], 0]  # shard 1 is left alone, shard 3 goes
    staged, affected = resharding.stage(spark, path, wanted)
    assert affected == [0, 2, 3]
    for _ in range(2):  # a commit can be repeated
        resharding.commit(spark, path, staged, affected)
        after = spark.read.parquet(path)
        assert sorted((r["doc_id"], r["text"], r["size"]) for r in after.collect()) == [(i, t, i) for i, t in texts]
        assert {k: v for k, v in before.items() if "shard=1" in k} == {k: v for k, v in files(path).items() if "shard=1" in k}
    got = {r["shard"]: r["n"] for r in after.groupBy("shard").agg(F.sum(F.octet_length("text") + 1).alias("n")).collect()}
    assert set(got) == {0, 1, 2} and abs(got[0] - wanted[0]) <= 50 and got[1] == wanted[1]
    assert after.where("shard = 0 and doc_id >= 300").count() == 0

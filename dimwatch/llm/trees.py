"""Tree ensembles as Column expressions: fitted by Spark's own DataFrame API on a bounded labelled table, then written
out as nested conditions, so that candidates are scored where they are, inside arrays if need be."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Partitions of the labelled tables: trees are bagged by partition, so the number must not follow the cluster.
LABELLED_PARTS = 4

_TREE = re.compile(r"Tree \d+ \(weight ([-\d.E]+)\)")
_TEST = re.compile(r"If \(feature (\d+) <= ([-\d.E]+)\)")


#: Descriptions of fitted ensembles by name: labelled tables are made by rule, so a name stands for its trees, and a driver
#: fits each once.
_FITTED: dict[tuple, str] = {}


def _described(name: tuple, fit: Callable[[], str]) -> str:
    if name not in _FITTED:
        _FITTED[name] = fit()
    return _FITTED[name]


def _node(lines: list[str], at: int, feature: Callable[[int], Column]) -> tuple[Column, int]:
    line = lines[at].strip()
    if line.startswith("Predict:"):
        return F.lit(float(line.split(":")[1])), at + 1
    column, value = _TEST.match(line).groups()
    low, at = _node(lines, at + 1, feature)
    high, at = _node(lines, at + 1, feature)  # past the "Else" line
    return F.when(feature(int(column)) <= float(value), low).otherwise(high), at


def _trees(described: str, feature: Callable[[int], Column]) -> list[tuple[float, Column]]:
    lines = described.splitlines()
    starts = [(i, float(m[1])) for i, x in enumerate(lines) if (m := _TREE.search(x))]
    return [(weight, _node(lines, i + 1, feature)[0]) for i, weight in starts]


def _assembled(labelled: DataFrame, n: int) -> DataFrame:
    """labelled has `label` and an array of n doubles `features`."""
    wide = labelled.select(F.col("label").cast("double").alias("label"), *(F.col("features")[i].alias(f"f{i}") for i in range(n)))
    return VectorAssembler(inputCols=[f"f{i}" for i in range(n)], outputCol="vector").transform(wide).select("label", "vector")


def boosted(labelled: DataFrame, n: int, name: str, rounds: int = 8, depth: int = 3, seed: int = 11) -> Callable[[Column], Column]:
    """Probability of label 1 from an array of features, by gradient-boosted trees. The name is that of the table."""
    described = _described(("boosted", name, n, rounds, depth, seed), lambda: GBTClassifier(featuresCol="vector", maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=seed).fit(_assembled(labelled, n)).toDebugString)

    def probability(features: Column) -> Column:
        total = F.lit(0.0)
        for weight, tree in _trees(described, lambda i: features[i]):
            total = total + F.lit(weight) * tree
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * total))

    return probability


def forest(labelled: DataFrame, n: int, name: str, trees: int = 16, depth: int = 5, seed: int = 11) -> Callable[[Column], Column]:
    """Share of the trees of a random forest that vote for label 1, from an array of features. The name is that of the
    table."""
    described = _described(("forest", name, n, trees, depth, seed), lambda: RandomForestClassifier(featuresCol="vector", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8).fit(_assembled(labelled, n)).toDebugString)

    def share(features: Column) -> Column:
        total = F.lit(0.0)
        for _, tree in _trees(described, lambda i: features[i]):
            total = total + tree
        return total / F.lit(float(trees))

    return share

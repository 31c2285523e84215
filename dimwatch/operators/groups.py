"""Kernels over the rows of each group, many groups a batch.

A window numbers each group's rows, so Catalyst deals out and sorts the rows only where they don't lie so yet, and the number
1 tells where a group begins. Small groups share Arrow batches and calls; a group that goes on over batches is held until it ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .clean import Keys

#: Of the columns that a kernel asks for, all rows of some whole groups in order, and where each group begins; the last
#: start is the number of rows.
Columns = dict[str, np.ndarray]
Kernel = Callable[[Columns, np.ndarray], Columns]
PLACE = "_place"


def _floats(table: pa.Table, name: str) -> np.ndarray:
    return table[name].cast(pa.float64()).to_numpy()


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with where each begins."""
    held: list[pa.Table] = []

    def ready() -> Iterator[tuple[pa.Table, np.ndarray]]:
        if held and (table := pa.concat_tables(held)).num_rows:
            yield table.drop_columns([PLACE]), np.append(np.flatnonzero(table[PLACE].to_numpy() == 1), table.num_rows)
        held.clear()

    for batch in batches:
        table = pa.Table.from_batches([batch])
        begins = np.flatnonzero(table[PLACE].to_numpy() == 1)
        if len(begins):
            held.append(table.slice(0, begins[-1]))
            yield from ready()
            table = table.slice(begins[-1])
        held.append(table)
    yield from ready()


def _placed(points: DataFrame, keys: Keys, order: tuple[str, ...]) -> DataFrame:
    return points.withColumn(PLACE, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def _quoted(df: DataFrame, names: list[str]) -> str:
    types = dict(df.dtypes)
    return "".join(f"`{c}` {types[c]}, " for c in names)


_TYPES = {"double": pa.float64(), "long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}


def _arrow(values: np.ndarray | list, kind: str) -> pa.Array:
    return pa.array(values, _TYPES[kind], from_pandas=True)


def _schema(text: str) -> list[tuple[str, str]]:
    return [tuple(part.split()) for part in text.split(", ")]


def with_kernel(points: DataFrame, keys: Keys, uses: tuple[str, ...], kernel: Kernel, adds: str, order: tuple[str, ...] = ("jd", "seq")) -> DataFrame:
    """points with the columns `adds` (a schema) that the kernel makes, a value a row; NaN counts as null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_groups(batches):
            made = kernel({c: _floats(table, c) for c in uses}, starts)
            for name, kind in _schema(adds):
                table = table.append_column(name, _arrow(made[name], kind))
            yield from table.combine_chunks().to_batches()

    return _placed(points, keys, order).mapInArrow(run, _quoted(points, points.columns) + adds)


def group_rows(points: DataFrame, keys: Keys, uses: tuple[str, ...], kernel: Kernel, makes: str, order: tuple[str, ...] = ("jd", "seq")) -> DataFrame:
    """A row per group: keys and the columns `makes` (a schema) that the kernel makes, a value a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _whole_groups(batches):
            made = kernel({c: _floats(table, c) for c in uses}, starts)
            first = table.select(list(keys)).take(starts[:-1])
            for name, kind in _schema(makes):
                first = first.append_column(name, _arrow(made[name], kind))
            yield from first.combine_chunks().to_batches()

    kept = points.select(*dict.fromkeys((*keys, *order, *uses)))
    return _placed(kept, keys, order).mapInArrow(run, _quoted(points, list(keys)) + makes)


def percentiles(x: np.ndarray, starts: np.ndarray, *shares: float) -> list[np.ndarray]:
    """For each share, each group's exact percentile, interpolated as Spark does; NaN counts as missing, and is the percentile of nothing."""
    first, group = starts[:-1], np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    own, n, out = x[np.lexsort((x, group))], np.add.reduceat((x == x).astype(np.int64), first), []
    for share in shares:
        at = np.maximum(n - 1, 0) * share
        low, high = np.floor(at), np.ceil(at)
        a, b = own[first + low.astype(np.int64)], own[first + high.astype(np.int64)]
        out.append(np.where(n > 0, np.where(low == high, a, (high - at) * a + (at - low) * b), np.nan))
    return out


def with_percentiles(points: DataFrame, keys: Keys, value: str, **shares: float) -> DataFrame:
    """points with exact percentiles of a column over its group, interpolated as Spark does, null for no value. The same as
    percentile() over a window, by ranks."""
    w = W.partitionBy(*keys)
    out = points.withColumn("_rank", F.row_number().over(w.orderBy(F.col(value).asc_nulls_last()))).withColumn("_count", F.count(value).over(w))
    at = {to: (F.col("_count") - 1) * F.lit(float(share)) for to, share in shares.items()}
    sides = {f"_{side}{i}": F.max(F.when(F.col("_rank") == place(x) + 1, F.col(value))).over(w) for i, x in enumerate(at.values()) for side, place in (("low", F.floor), ("high", F.ceil))}
    out = out.withColumns(sides)
    made = {to: F.when(F.floor(x) == F.ceil(x), F.col(f"_low{i}")).otherwise((F.ceil(x) - x) * F.col(f"_low{i}") + (x - F.floor(x)) * F.col(f"_high{i}")) for i, (to, x) in enumerate(at.items())}
    return out.withColumns(made).drop("_rank", "_count", *sides)


def rows_of(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A value of each group, at each of its rows."""
    return np.repeat(values, np.diff(starts))


def spans(starts: np.ndarray) -> Iterator[slice]:
    """The groups' rows."""
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        yield slice(a, b)

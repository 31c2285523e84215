"""Counts of points as they come in: tumbling bins, trailing counts and seasons, as Structured Streaming jobs.

Points may come late by the delay of the watermark; later ones are dropped. Trailing counts and bins need a source's
points in order of time, so a state for each source holds the points above the watermark and lets them go in order once
it has passed them; what it keeps of those is one window of times and one bin. Seasons are session windows. A job that is
started again on its checkpoint goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.adapters import event_points

#: Days of a tumbling bin and of a trailing window, and of a gap that parts seasons.
DAYS, GAP_DAYS = 3.0, 30.0
#: The Julian date and the milliseconds of a day that `at` counts from.
EPOCH, DAY_MS = 2440587.5, 86400e3
#: Times and numbers are kept as bytes, which cost the same however many there are.
_STATE = "waiting_jd binary, waiting_seq binary, first double, recent binary, bin long, n long"
_OUT = "source_id string, seq long, jd double, n_trailing long, bin long, n_in_bin long"


def timed(points: DataFrame) -> DataFrame:
    """points with `at`, the time to the millisecond that watermarks go by."""
    return points.withColumn("at", F.timestamp_millis(F.floor((F.col("jd") - EPOCH) * DAY_MS).cast("long")))


def event_stream(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """Points of a table of events that grows by files, or of one file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    events = (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may match a file
    return timed(event_points(events))


def counted(points: DataFrame, delay: str = "1 day", days: float = DAYS) -> DataFrame:
    """For each point, once the watermark has passed it: n_trailing, points in the days up to it, the earliest moment and
    equal times included; bin, the place of its tumbling bin from the source's first point; n_in_bin, the bin's points so
    far, equal times included. The greatest n_in_bin of a bin is its count."""

    def update(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, held_seq, first, recent, bin, n = state.get if state.exists else (b"", b"", None, b"", -1, 0)
        jd, seq, recent = [np.frombuffer(held)], [np.frombuffer(held_seq, np.int64)], np.frombuffer(recent)
        if not state.hasTimedOut:
            for batch in batches:
                jd.append(batch["jd"].to_numpy(np.float64))
                seq.append(batch["seq"].to_numpy(np.int64))
        jd, seq = np.concatenate(jd), np.concatenate(seq)
        order = np.lexsort((seq, jd))
        jd, seq = jd[order], seq[order]
        ms = np.floor((jd - EPOCH) * DAY_MS)
        go = int(np.count_nonzero(ms <= state.getCurrentWatermarkMs()))
        out = None
        if go:
            own = jd[:go]
            times = np.concatenate([recent, own])
            first = float(own[0]) if first is None else first
            trailing = np.searchsorted(times, own, side="right") - np.searchsorted(times, own - days, side="left")
            bins = np.floor((own - first) / days).astype(np.int64)
            peers = np.searchsorted(own, own, side="right") - np.searchsorted(bins, bins, side="left")
            peers[bins == bin] += n
            out = pd.DataFrame({"source_id": [key[0]] * go, "seq": seq[:go], "jd": own, "n_trailing": trailing, "bin": bins, "n_in_bin": peers})
            n, bin = int(peers[-1]), int(bins[-1])
            recent = times[np.searchsorted(times, times[-1] - days, side="left") :]
        state.update((jd[go:].tobytes(), seq[go:].tobytes(), first, recent.tobytes(), bin, n))
        if go < len(jd):
            state.setTimeoutTimestamp(int(ms[go]) - 1)  # goes off once the watermark has reached the first that waits
        if out is not None:  # a table costs a source more than its counts, even an empty one
            yield out

    kept = points.select("source_id", "seq", "jd", "at").withWatermark("at", delay)
    return kept.groupBy("source_id").applyInPandasWithState(update, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def seasons(points: DataFrame, delay: str = "1 day", gap_days: float = GAP_DAYS) -> DataFrame:
    """Start, end, n_obs and span of every run of points without a longer gap, once the watermark has passed its end."""
    gap = f"{int(gap_days * DAY_MS) + 1} milliseconds"  # points that are just so far apart belong together
    kept = points.select("source_id", "jd", "at").withWatermark("at", delay)
    out = kept.groupBy("source_id", F.session_window("at", gap)).agg(F.min("jd").alias("start_jd"), F.max("jd").alias("end_jd"), F.count("*").alias("n_obs"))
    return out.select("source_id", "start_jd", "end_jd", "n_obs", (F.col("end_jd") - F.col("start_jd")).alias("span"))


def run(stream: DataFrame, path: str, checkpoint: str, whole: bool = False) -> StreamingQuery:
    """Processes what is there and ends. Results are appended to Parquet files in path; with whole, each batch replaces
    them by all results so far, those of open windows included."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if whole:
        query = writer.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path)).start()
    else:
        query = writer.outputMode("append").format("parquet").option("path", path).start()
    query.awaitTermination()
    return query

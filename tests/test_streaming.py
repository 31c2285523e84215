"""Streaming counts against the batch operators: several batches, late points and a restart."""

import datetime as dt
import random

from dimwatch.operators import stats
from dimwatch.sources.adapters import event_points
from dimwatch.streaming import counts

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(n, days, first_id, seed, start=0.0):
    rng = random.Random(seed)
    at = [dt.datetime(2024, 1, 1) + dt.timedelta(days=start + rng.choice((rng.uniform(0, days), rng.randrange(int(days)))) ) for _ in range(n)]
    return [(first_id + i, t, rng.randrange(3), "view", 1.0, '{"k": 1}') for i, t in enumerate(at)]


def streamed(spark, stream, folder, name, **more):
    counts.run(stream, f"{folder}/{name}", f"{folder}/{name}-checkpoint", **more)
    return spark.read.parquet(f"{folder}/{name}")


def test_late_points_and_a_restart(spark, tmp_path):
    early, later = events(60, 20, 0, 1), events(60, 20, 1000, 2, start=18)
    late = (5000, dt.datetime(2024, 1, 2, 1), 0, "view", 1.0, '{"k": 1}')  # before the watermark of the first run
    closing = [(9000 + u, dt.datetime(2026, 1, 1), u, "view", 1.0, '{"k": 1}') for u in range(3)]
    spark.createDataFrame(early, EVENTS).repartition(3).write.parquet(f"{tmp_path}/in")

    def stream():
        return counts.event_stream(spark, f"{tmp_path}/in", files_a_batch=10)

    out = streamed(spark, counts.counted(stream(), "3 days"), tmp_path, "counted")
    known = out.count()
    assert 0 < known < 60
    streamed(spark, counts.seasons(stream(), "3 days", 1.5), tmp_path, "seasons")
    for rows in ([*later, late], closing):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = streamed(spark, counts.counted(stream(), "3 days"), tmp_path, "counted")
        seasons = streamed(spark, counts.seasons(stream(), "3 days", 1.5), tmp_path, "seasons")
    points = event_points(spark.createDataFrame([*early, *later, *closing], EVENTS))
    expected = {r["seq"]: r["n_trailing"] for r in stats.trailing_counts(points).collect() if r["seq"] < 9000}
    assert {r["seq"]: r["n_trailing"] for r in out.collect()} == expected and 5000 not in expected
    bins = {}
    for r in out.collect():
        bins[r["source_id"], r["bin"]] = max(bins.get((r["source_id"], r["bin"]), 0), r["n_in_bin"])
    assert bins == {(r["source_id"], r["bin"]): r["n"] for r in stats.tumbling_counts(points).collect() if r["bin"] < 100}
    assert sorted((r["source_id"], r["start_jd"], r["end_jd"], r["n_obs"]) for r in seasons.collect()) == sorted((r["source_id"], r["start_jd"], r["end_jd"], r["n_obs"]) for r in stats.seasons(points, gap_days=1.5).collect() if r["end_jd"] < 2461000)


class State:
    """A state of a group, as Spark's."""

    def __init__(self, watermark):
        self.value, self.hasTimedOut, self.watermark = None, False, watermark

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def getCurrentWatermarkMs(self):
        return self.watermark

    def setTimeoutTimestamp(self, ms):
        self.timeout = ms


def test_sources_without_results_send_no_table(monkeypatch):
    """Points that wait make no table, and are kept as bytes; the one that the watermark passes makes one."""
    import numpy as np
    import pandas as pd

    class Points:
        select = withWatermark = groupBy = lambda self, *_: self
        applyInPandasWithState = lambda self, update, *_: update

    update, state = counts.counted(Points()), State(0)
    jd = counts.EPOCH + np.array([5.0, 1.0, 2.0, 2.0])
    assert list(update(("a",), iter([pd.DataFrame({"jd": jd, "seq": [1, 2, 4, 3]})]), state)) == []
    assert isinstance(state.value[0], bytes) and state.timeout == counts.DAY_MS - 1
    state.hasTimedOut, state.watermark = True, 3 * counts.DAY_MS
    (out,) = update(("a",), iter([]), state)
    assert out.to_dict("list") == {"source_id": ["a"] * 3, "seq": [2, 3, 4], "jd": [jd[1], jd[2], jd[3]], "n_trailing": [1, 3, 3], "bin": [0, 0, 0], "n_in_bin": [1, 3, 3]}
    assert state.timeout == 5 * counts.DAY_MS - 1

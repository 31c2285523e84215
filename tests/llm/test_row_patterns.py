"""Row patterns against a backtracking regular expression for each start, on hot keys, ties, odd rows and long segments."""

import hashlib
import math
import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest

from dimwatch.llm import registry, row_patterns
from tests.compare import difference

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"


def cents(value):
    return None if value is None or not abs(100 * value + 0.5) < 9e18 else math.floor(100 * value + 0.5)


def literal(rows):
    """The search by Python's re: one letter a row for a given start, where a row that may be D, U or the goal has a letter of its own."""
    found, order = [], {}
    for r in {tuple(r) for r in rows}:
        if r[3] is not None and r[1] is not None:
            order.setdefault(r[3], []).append(r)
    for client, own in order.items():
        own.sort(key=lambda r: (r[1], -1 if r[0] is None else r[0], {"purchase": 2, "error": 0, None: 0}.get(r[4], 1), -math.inf if cents(r[5]) is None else cents(r[5])))
        at, number = 0, 0
        while at < len(own):
            line, first = "", cents(own[at][5])
            for prev, r in zip(own[at:], own[at + 1 :], strict=False):
                near, c, p = r[1] - prev[1] <= timedelta(minutes=10), cents(r[5]), cents(prev[5])
                step = near and r[4] not in (None, "error") and None not in (c, p) and c != p
                goal = near and r[4] == "purchase" and c is not None and first is not None and c >= first
                line += ("D" if c < p else "U").lower() * (not goal) + ("D" if c < p else "U") * goal if step else "P" if goal else "-"
            m = re.match("[duDU]*?[DUP]", line) if first is not None else None
            if m:
                last, number = at + m.end(), number + 1
                letters = "A" + line[: m.end() - 1].upper() + "P"
                found.append((client, number, own[at][0], own[last][0], len(letters), sum(cents(r[5]) for r in own[at : last + 1]), hashlib.sha256(letters.encode()).hexdigest()))
            at = last + 1 if m else at + 1
    return sorted(found, key=lambda r: r[:2])


def got(spark, rows, **more):
    found = row_patterns.find_matches(spark.createDataFrame(rows, CLICKS).repartition(5), **more)
    return sorted((tuple(r) for r in found.collect()), key=lambda r: r[:2])


def clicks(n, seed, clients=4, kinds=("view", "view", "purchase", "error", None), values=8, gap=500):
    rng, now, rows = random.Random(seed), datetime(2024, 1, 1), []
    for i in range(n):
        now += timedelta(seconds=rng.choice((0, 1, 60, gap)))
        value = rng.choice((None, math.nan, math.inf)) if rng.random() < 0.03 else rng.randrange(values) / 2
        rows.append((rng.choice((i, i // 2)), None if rng.random() < 0.01 else now, now, rng.choice((7, 7, rng.randrange(clients), None)), rng.choice(kinds), value, "{}"))
    return rows + rng.choices(rows, k=n // 5)


def test_query_matches_sql(spark, sf_dir, duck):
    assert not difference(registry.op13_row_patterns(spark, sf_dir).toPandas(), duck.execute(row_patterns.SQL).df())


@pytest.mark.parametrize("seed", range(4))
def test_matches_the_literal_search(spark, seed):
    rows = clicks(900, seed)
    assert got(spark, rows) == got(spark, rows, last=10) == literal(rows)


def test_segments_that_cover_ranges(spark):
    rows = clicks(600, 9, clients=1, kinds=("view", "purchase"), values=1000, gap=30)
    assert got(spark, rows, last=10) == literal(rows)
    falling = [(i, datetime(2024, 1, 1) + timedelta(seconds=i), None, 1, "view", float(500 - i), None) for i in range(400)]
    far = [*falling, (400, datetime(2024, 1, 1, 0, 6, 45), None, 1, "purchase", 450.0, None)]
    assert got(spark, far, last=10) == literal(far)
    assert literal(far)[0][2] == 50


def test_goals_across_blocks(monkeypatch):
    monkeypatch.setattr(row_patterns, "BLOCK", 16)
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = 300
        symbols = rng.choice(np.frombuffer(b"dduuDUgx", np.uint8), n, p=[0.3, 0.18, 0.3, 0.18, 0.01, 0.01, 0.01, 0.01])
        cents, known = rng.integers(0, 40, n), (rng.random(n) < 0.9) | np.isin(symbols, list(b"DUg"))
        ends = {}
        for a in np.flatnonzero(known):
            for b in range(a + 1, n):
                if symbols[b] in b"DUg" and cents[b] >= cents[a]:
                    ends[a] = b
                    break
                if symbols[b] in b"gx":
                    break
        assert row_patterns.match_ends(symbols.tobytes(), cents, known) == ends


def test_odd_rows(spark):
    assert got(spark, []) == []
    at = datetime(2024, 1, 1)
    rows = [(None, at, None, 1, "view", 1.0, None), (None, at + timedelta(minutes=10), None, 1, "purchase", 2.0, "x" * 100_000), (5, at + timedelta(minutes=20, microseconds=1), None, 1, "purchase", 9.0, None), (6, at + timedelta(minutes=21), None, 1, None, 8.0, None)]
    assert got(spark, rows) == literal(rows) and len(literal(rows)) == 1
    clash = spark.createDataFrame(rows, CLICKS).selectExpr("*", "1 as key", "2 as symbol", "3 as part", "4 as cents", "5 as n_rows")
    assert row_patterns.find_matches(clash).count() == 1


def test_long_falling_segment_takes_linear_time():
    n = 200_000
    symbols = b"x" + b"d" * (n - 2) + b"U"
    found = row_patterns.matches(symbols, np.r_[np.arange(n - 1, 0, -1), n // 2], np.ones(n, bool))
    assert found == [(n // 2 - 1, n - 1)]

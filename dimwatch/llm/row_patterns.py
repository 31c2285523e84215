"""Row pattern matching: `A (D|U)*? P` over the consecutive rows of each key, as regular expressions on symbols.

Every row gets a symbol from itself and the row before it: `d` and `u` for a row that fits D or U, `D` and `U` for one that
may be the goal P as well, `g` for one that may be the goal only, `x` for one that fits none of them. A segment is a row `x` and
what follows it up to the next `x`. No match leaves its segment, as only its first row can be an `x`, so segments are
searched each on its own: their symbols are a bytearray, starts are taken by ascending cents, goals whose cents are too
low for the start are switched off, and the regex module matches anchored at the start. The search then walks over the
starts that have a match. Starts without a goal that is high enough ahead of them are told by a running maximum. Long
segments are matched in blocks, and blocks without a goal that is still on are skipped, so a start costs two blocks at most.

Rows are dealt out as ranges of (key, time, id), so a key with a third of all rows covers as many tasks as its rows need.
What a range can't decide alone is open: its rows before its first `x`, as they may go on from the range before, and its
last segment, as it may go on in the next. Open rows, a few for each range, are dealt out again as fewer ranges until they
fit into one. A row that comes first in its range has an unknown symbol until it meets the row before it, which is always an open row. Segments are
held by 20 bytes a row, and a segment that covers whole ranges stays open until some later, larger range holds it.
Matches are numbered by counts of each (key, range of the first round) and their prefix sums: one row for each range that a key reaches into.

Distinct rows only; rows without key or time are dropped; a null kind fits neither D, U nor P. A value that is null, not
finite, or of 9e16 or more fits no letter. Rows that tie in time and id are ordered by kind and cents, after which they are the
same. Null ids sort first and are given as null. An empty table gives an empty result; other columns only tell rows apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: D, U and P come at most so many microseconds after the row before them.
GAP_US = 600_000_000
#: Open rows that one task takes at most, unless a single segment has more.
LAST = 100_000
#: Symbols of a block; a start is matched within its own block and at most one other.
BLOCK = 4096
#: Ranges of a round become so many times fewer.
FEWER = 8

_START = regex.compile(rb".[duDU]*?[DUg]", regex.S)
_ONWARD = regex.compile(rb"[duDU]*?[DUg]", regex.S)
_NONE, _UNKNOWN = ord("x"), ord("?")
#: What a goal is once it is too low for the start.
_OFF = {ord("D"): ord("d"), ord("U"): ord("u"), ord("g"): _NONE}


def match_ends(symbols: bytes, cents: np.ndarray, known: np.ndarray) -> dict[int, int]:
    """The last row of the match of every row that a match can start at, by its place. known: rows that have cents."""
    line, n = bytearray(symbols), len(symbols)
    seen = np.frombuffer(symbols, np.uint8)
    goal = np.isin(seen, [ord(c) for c in "DUg"])
    if n < 2 or not goal.any():
        return {}
    rank = np.unique(np.where(known, cents, 0), return_inverse=True)[1]
    none = seen == _NONE
    # rows that a match can run through together: `x` begins a new lot, and nothing runs on beyond `g`
    lot = np.cumsum(none | np.r_[False, seen[:-1] == ord("g")])
    turn = (lot[-1] - lot).astype(np.int64) * (n + 2)
    ahead = np.maximum.accumulate((np.where(goal, rank + 1, 0) + turn)[::-1])[::-1] - turn - 1
    can = known[:-1] & ~none[1:] & (ahead[1:] >= rank[:-1])
    starts = np.flatnonzero(can)
    starts = starts[np.argsort(rank[starts], kind="stable")]
    goals = np.flatnonzero(goal)
    on = np.bincount(goals // BLOCK, minlength=n // BLOCK + 1).tolist()
    onward = list(range(1, len(on) + 1))
    goals = goals[np.argsort(rank[goals], kind="stable")]
    low, goal_ranks, goals = 0, rank[goals].tolist(), goals.tolist()
    ends = {}
    for start, at in zip(starts.tolist(), rank[starts].tolist(), strict=True):
        while goal_ranks[low] < at:
            line[goals[low]] = _OFF[line[goals[low]]]
            on[goals[low] // BLOCK] -= 1
            low += 1
        block = start // BLOCK
        found = _START.match(line, start, min(n, (block + 1) * BLOCK))
        if not found:
            path = [block]
            block = onward[block]
            while not on[block]:
                path.append(block)
                block = onward[block]
            for b in path:
                onward[b] = block
            found = _ONWARD.match(line, block * BLOCK, min(n, (block + 1) * BLOCK))
        ends[start] = found.end() - 1
    return ends


def matches(symbols: bytes, cents: np.ndarray, known: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each match of the search from left to right, which goes on after a match's last row."""
    ends, found, last = match_ends(symbols, cents, known), [], -1
    for start in sorted(ends):
        if start > last:
            last = ends[start]
            found.append((start, last))
    return found


def _symbols(rows: pa.Table, before: pa.Table | None, gap_us: int) -> np.ndarray:
    """The rows' symbols; unknown ones are worked out where the row before is there. before: that of the first row."""
    symbols = rows["symbol"].to_numpy().astype(np.uint8)
    both = pa.concat_tables([before.slice(before.num_rows - 1), rows]).combine_chunks() if before is not None else rows
    cents, known = _cents(both)
    at, kind = both["ts"].cast(pa.int64()).to_numpy(), both["kind"].to_numpy()
    key = both["key"].combine_chunks()
    near = pc.equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False) & (at[1:] - at[:-1] <= gap_us)
    steps = near & (kind[1:] > 0) & known[1:] & known[:-1]
    down, up = steps & (cents[1:] < cents[:-1]), steps & (cents[1:] > cents[:-1])
    goal = near & (kind[1:] == 2) & known[1:]
    told = np.select([down & goal, up & goal, down, up, goal], [ord(c) for c in "DUdug"], _NONE).astype(np.uint8)
    told = told if before is not None else np.r_[np.uint8(_UNKNOWN), told]
    return np.where(symbols == _UNKNOWN, told, symbols)


def _cents(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return rows["cents"].fill_null(0).to_numpy(), rows["cents"].is_valid().to_numpy()


_MATCH = [("key", None), ("ts", pa.timestamp("us")), ("first_id", None), ("last_id", None), ("n_rows", pa.int64()), ("sum_cents", pa.int64()), ("labels_sha256", pa.string()), ("kind", pa.int8()), ("cents", pa.int64()), ("symbol", pa.int16()), ("part", pa.int32())]


def _out(rows: pa.Table, **columns) -> Iterator[pa.RecordBatch]:
    """rows' key, ts, id (as first_id) and part, with the columns given; the others null."""
    own = {"key": rows["key"], "ts": rows["ts"], "first_id": rows["id"], "part": rows["part"], **columns}
    arrays = [own[c] if c in own else pa.nulls(rows.num_rows, kind or rows["id"].type) for c, kind in _MATCH]
    yield from pa.table(arrays, names=[c for c, _ in _MATCH]).combine_chunks().to_batches(max_chunksize=10_000)


def _found(rows: pa.Table, symbols: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The matches within rows, whose first one begins a segment and whose last one ends one."""
    cents, known = _cents(rows)
    if pairs := matches(symbols.tobytes(), cents, known):
        first, last = np.array(pairs).T
        sums = np.r_[0, np.cumsum(np.where(known, cents, 0))]
        letters = symbols.tobytes().upper()
        hashes = [hashlib.sha256(b"A" + letters[a + 1 : b] + b"P").hexdigest() for a, b in pairs]
        yield from _out(rows.take(first), last_id=rows["id"].take(last), n_rows=pa.array(last - first + 1), sum_cents=pa.array(sums[last + 1] - sums[first]), labels_sha256=pa.array(hashes))


def _open(rows: pa.Table, symbols: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield from _out(rows, kind=rows["kind"], cents=rows["cents"], symbol=pa.array(symbols.astype(np.int16)))


def _search(gap_us: int, last: bool, number: bool):
    """Searches one range of sorted rows, batch by batch; holds no more than a batch and the segment that goes on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple[pa.Table, np.ndarray]] = []
        before, begun = None, False  # begun: the rows held begin with an `x`

        def whole() -> tuple[pa.Table, np.ndarray]:
            out = pa.concat_tables([t for t, _ in held]).combine_chunks(), np.concatenate([s for _, s in held])
            held.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if number:
                rows = rows.append_column("part", pa.array(np.full(rows.num_rows, part, np.int32)))
            symbols = _symbols(rows, before, gap_us)
            if before is None and last and symbols[0] == _UNKNOWN:
                symbols[0] = _NONE
            before = rows
            breaks = np.flatnonzero(symbols == _NONE)
            if not begun and len(breaks):  # what comes before the first `x` may go on from the range before
                if breaks[0]:
                    held.append((rows.slice(0, breaks[0]), symbols[: breaks[0]]))
                if held:
                    yield from _open(*whole())
                rows, symbols, breaks, begun = rows.slice(breaks[0]), symbols[breaks[0] :], breaks - breaks[0], True
            if begun and len(breaks):
                if breaks[-1]:
                    held.append((rows.slice(0, breaks[-1]), symbols[: breaks[-1]]))
                if held:
                    yield from _found(*whole())
                rows, symbols = rows.slice(breaks[-1]), symbols[breaks[-1] :]
            held.append((rows, symbols))
        if held:
            yield from (_found if last else _open)(*whole())

    return run


def find_matches(
    rows: DataFrame, key: str = "client_id", ts: str = "ts", id: str = "click_id", value: str = "value", kind: str = "kind", goal: str = "purchase", never: str = "error", gap_us: int = GAP_US, last: int = LAST
) -> DataFrame:
    """key, match_no, first_id, last_id, n_rows, sum_cents and labels_sha256 of every match."""
    spark = rows.sparkSession
    kept = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).distinct()
    scaled = F.lit(100.0) * F.col(value) + F.lit(0.5)
    code = F.when(F.col(kind) == goal, 2).when(F.col(kind) != never, 1).otherwise(0).cast("byte")
    now = kept.select(
        F.col(key).alias("key"), F.col(ts).cast("timestamp_ntz").alias("ts"), F.col(id).alias("id"), code.alias("kind"),
        F.when(F.abs(scaled) < 9e18, F.floor(scaled)).cast("long").alias("cents"), F.lit(_UNKNOWN).cast("short").alias("symbol"),
    )
    kinds = dict(now.dtypes)
    shape = f"key {kinds['key']}, ts timestamp_ntz, first_id {kinds['id']}, last_id {kinds['id']}, n_rows long, sum_cents long, labels_sha256 string, kind byte, cents long, symbol short, part int"
    order = ["key", "ts", "id", "kind", "cents"]
    ranges, found, left = int(spark.conf.get("spark.sql.shuffle.partitions")), [], None
    dealt = now.repartitionByRange("key", "ts", "id")
    while True:
        final = left is not None and ranges == 1
        out = written(dealt.sortWithinPartitions(*order).mapInArrow(_search(gap_us, final, left is None), shape))
        found.append(out.where("n_rows is not null"))
        if final:
            break
        now = out.where("n_rows is null").select("key", "ts", F.col("first_id").alias("id"), "kind", "cents", "symbol", "part")
        left = now.count()
        ranges = max(1, min(ranges // FEWER, -(-left // last)))
        dealt = now.coalesce(1) if ranges == 1 else now.repartitionByRange(ranges, "key", "ts", "id")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return numbered(every).select(F.col("key").alias(key), "match_no", "first_id", "last_id", "n_rows", "sum_cents", "labels_sha256")


def numbered(found: DataFrame) -> DataFrame:
    """found (key, part, ts, first_id, ...) with match_no: matches of the key in ranges before, and the place within the range."""
    counts = found.groupBy("key", "part").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("key").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("key", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    own: Column = F.row_number().over(W.partitionBy("key", "part").orderBy("ts", "first_id"))
    return found.withColumn("own", own).join(offsets, ["key", "part"]).withColumn("match_no", F.col("offset") + F.col("own").cast("long"))


#: DuckDB's statement of the same result.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT DISTINCT * FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL),
o AS (
  SELECT client_id, ts, click_id, kind, floor(100 * value + 0.5)::BIGINT AS c, row_number() OVER (PARTITION BY client_id ORDER BY ts, click_id) AS n FROM d),
p AS (
  SELECT a.*, b.c AS pc, b.ts IS NOT NULL AND a.ts <= b.ts + INTERVAL 10 MINUTE AS near FROM o a LEFT JOIN o b ON a.client_id = b.client_id AND b.n = a.n - 1),
l AS (
  SELECT client_id, click_id, n, c,
         CASE WHEN near AND kind <> 'error' AND c < pc THEN 'D' WHEN near AND kind <> 'error' AND c > pc THEN 'U' ELSE '' END AS letter,
         coalesce(near AND kind = 'purchase' AND c IS NOT NULL, false) AS goal FROM p),
f AS (
  SELECT *, letter = '' AND NOT goal AS none, lag(letter = '' AND goal, 1, false) OVER (PARTITION BY client_id ORDER BY n) AS after_flat FROM l),
g AS (
  SELECT *, sum(CASE WHEN none THEN 1 ELSE 0 END) OVER (PARTITION BY client_id ORDER BY n) AS seg,
         sum(CASE WHEN none OR after_flat THEN 1 ELSE 0 END) OVER (PARTITION BY client_id ORDER BY n) AS lot FROM f),
s AS (
  SELECT *, lead(none, 1, true) OVER (PARTITION BY client_id ORDER BY n) AS cut, lead(lot) OVER (PARTITION BY client_id ORDER BY n) AS onward FROM g),
e AS (
  SELECT s.client_id, s.seg, s.n AS a, min(t.n) AS b FROM s JOIN g t ON t.client_id = s.client_id AND t.lot = s.onward AND t.goal AND t.n > s.n AND t.c >= s.c
  WHERE NOT s.cut GROUP BY s.client_id, s.seg, s.n),
x AS (
  SELECT e.client_id, e.seg, e.a, e.b, min(m.a) AS nxt FROM e LEFT JOIN e m ON m.client_id = e.client_id AND m.seg = e.seg AND m.a > e.b GROUP BY e.client_id, e.seg, e.a, e.b),
w AS (
  SELECT x.client_id, x.seg, x.a, x.b, x.nxt FROM x JOIN (SELECT client_id, seg, min(a) AS a FROM x GROUP BY client_id, seg) y ON x.client_id = y.client_id AND x.a = y.a
  UNION ALL
  SELECT x.client_id, x.seg, x.a, x.b, x.nxt FROM w JOIN x ON x.client_id = w.client_id AND x.a = w.nxt),
r AS (
  SELECT w.client_id, w.a, w.b, sum(l.c)::BIGINT AS sum_cents,
         sha256(string_agg(CASE WHEN l.n = w.a THEN 'A' WHEN l.n = w.b THEN 'P' ELSE l.letter END, '' ORDER BY l.n)) AS labels_sha256
  FROM w JOIN l ON l.client_id = w.client_id AND l.n BETWEEN w.a AND w.b GROUP BY w.client_id, w.a, w.b)
SELECT r.client_id, row_number() OVER (PARTITION BY r.client_id ORDER BY r.a) AS match_no, u.click_id AS first_id, v.click_id AS last_id,
       r.b - r.a + 1 AS n_rows, r.sum_cents, r.labels_sha256
FROM r JOIN l u ON u.client_id = r.client_id AND u.n = r.a JOIN l v ON v.client_id = r.client_id AND v.n = r.b
"""

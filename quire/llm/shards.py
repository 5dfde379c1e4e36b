"""Shards of near equal bytes by histogram sort.

Rows are ordered by (hash of the text, doc_id, row number), so equal texts lie side by side, and boundaries between
ranges are sought before anything moves: each round counts, in every partition, the exact bytes and rows below a set of
candidate keys, and keeps for each boundary the interval that holds its target, no wider than the keys that were seen in
it. The next candidates divide what is left. A boundary is found when the bytes below a candidate are within the
tolerance of its target; of an interval that holds at most FEW rows their keys are fetched, and the boundary is the best
of them. Then one exchange brings each row to its range, where it is sorted; the counts, which are exact, give each range
the slot it begins with, so no shard is ever numbered in one task.

A key is compared by its three parts, so a text that a third of all rows share is cut by doc_id like any other: equal
texts (a group) lie in one shard or, where a boundary falls into them, in neighbouring ones, side by side in slots.

Cases: null texts have one byte and the CRC of nothing; repeated rows are told apart by their number; a null doc_id
sorts as the smallest long; an empty table gives an empty result; shards may stay empty when there are fewer rows than
shards; clashing columns of the input are replaced.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import clashing, text_of, written

#: Candidates for each boundary in each round, and of all boundaries together (two for each at least).
PROBES = 16
ALL_PROBES = 200_000
#: Rows of an interval whose keys are fetched, by the driver, for each boundary that is left.
FEW = 64
#: Bytes of one range of a shard; the driver holds a key for each range, up to RANGES, beyond which they grow.
RANGE_BYTES = 64 << 20
RANGES = 65_536

Key = tuple[int, int, int]
_HALF = 1 << 63
_LOW: Key = (-_HALF,) * 3
_HIGH: Key = (_HALF - 1,) * 3


def _number(key: Key) -> int:
    return (key[0] + _HALF << 128) | (key[1] + _HALF << 64) | key[2] + _HALF


def _key(number: int) -> Key:
    return ((number >> 128) - _HALF, (number >> 64 & 2 * _HALF - 1) - _HALF, (number & 2 * _HALF - 1) - _HALF)


def _between(low: Key, high: Key, n: int) -> list[Key]:
    """Up to n keys in (low, high), evenly by the first part in which they differ."""
    a, b = _number(low), _number(high)
    part = 128 if low[0] < high[0] - 1 else 64 if low[0] == high[0] and low[1] < high[1] - 1 else 0
    step = max(1 << part, (b - a) // (n + 1))
    out = []
    for i in range(1, n + 1):
        x = a + i * step
        x = (x >> part) << part
        if a < x < b:
            out.append(_key(x))
    return out


class Sorted:
    """Keys in ascending order, and where others lie among them."""

    def __init__(self, keys: list[Key]):
        self.parts = [np.array([k[i] for k in keys], np.int64) for i in range(3)]

    def not_above(self, h: np.ndarray, d: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How many of the keys are not above (h, d, row)."""
        at, end = np.searchsorted(self.parts[0], h, "left"), np.searchsorted(self.parts[0], h, "right")
        while len(open_ := np.flatnonzero(at < end)):  # of the same hash: by halves
            mid = (at[open_] + end[open_]) // 2
            past = (self.parts[1][mid] < d[open_]) | (self.parts[1][mid] == d[open_]) & (self.parts[2][mid] <= row[open_])
            at[open_[past]] = mid[past] + 1
            end[open_[~past]] = mid[~past]
        return at


def _columns(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def _between_probes(keys: DataFrame, probes: list[Key]) -> dict[int, tuple[int, int, Key, Key]]:
    """Bytes, rows, least and greatest key of each interval i of keys in [probe i - 1, probe i) that has any: one pass."""
    among, width = Sorted(probes), len(probes) + 1

    def count(batches):
        size, rows = np.zeros(width, np.int64), np.zeros(width, np.int64)
        least, most = np.full((width, 3), np.iinfo(np.int64).max), np.full((width, 3), np.iinfo(np.int64).min)
        for b in batches:
            if not b.num_rows:
                continue
            h, d, r, n = _columns(b, "_h", "_d", "_row", "size")
            order = np.lexsort((r, d, h))
            key = np.stack([h, d, r], axis=1)[order]
            at = among.not_above(h, d, r)[order]  # ascending, as the keys are
            first = np.flatnonzero(np.diff(at, prepend=-1))
            own = at[first]
            rows[own] += np.diff(first, append=len(at))
            size[own] += np.add.reduceat(n[order], first)
            last = np.append(first[1:], len(at)) - 1
            for held, new, sign in ((least, key[first], -1), (most, key[last], 1)):
                old = held[own]
                differ = (old != new).argmax(axis=1)
                i = np.arange(len(own))
                better = (new[i, differ] > old[i, differ]) if sign > 0 else (new[i, differ] < old[i, differ])
                held[own[better]] = new[better]
        there = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(size[there]), pa.array(rows[there]), *(pa.array(x[there, i]) for x in (least, most) for i in range(3))], ["i", "size", "n", "h1", "d1", "r1", "h2", "d2", "r2"])

    counted = keys.select("_h", "_d", "_row", "size").mapInArrow(count, "i long, size long, n long, h1 long, d1 long, r1 long, h2 long, d2 long, r2 long")
    found = counted.groupBy("i").agg(F.sum("size").alias("size"), F.sum("n").alias("n"), F.min(F.struct("h1", "d1", "r1")).alias("least"), F.max(F.struct("h2", "d2", "r2")).alias("most"))
    return {r["i"]: (r["size"], r["n"], tuple(r["least"]), tuple(r["most"])) for r in found.collect()}  # a row for each interval at most


def _inside(keys: DataFrame, intervals: list[tuple[Key, Key]]) -> dict[int, list[tuple[Key, int]]]:
    """The keys, in order, with their bytes, in each of the disjoint, ascending intervals [low, high)."""
    among = Sorted([k for pair in intervals for k in pair])

    def fetch(batches):
        for b in batches:
            h, d, r, n = _columns(b, "_h", "_d", "_row", "size")
            at = among.not_above(h, d, r)
            there = at % 2 == 1
            yield pa.RecordBatch.from_arrays([pa.array(x[there]) for x in (at // 2, h, d, r, n)], ["i", "h", "d", "r", "size"])

    out: dict[int, list[tuple[Key, int]]] = {}
    for x in keys.select("_h", "_d", "_row", "size").mapInArrow(fetch, "i long, h long, d long, r long, size long").collect():
        out.setdefault(x["i"], []).append(((x["h"], x["d"], x["r"]), x["size"]))
    return {i: sorted(own) for i, own in out.items()}


def splitters(keys: DataFrame, total: tuple[int, int], parts: int, tolerance: float) -> list[tuple[Key, int]]:
    """For each boundary 1 .. parts - 1 its key and the rows below it."""
    targets = [total[0] * i // parts for i in range(1, parts)]
    slack = tolerance * total[0] / parts
    End = tuple[Key, int, int]  # a key, and the bytes and rows below it
    low: list[End] = [(_LOW, 0, 0)] * len(targets)
    high: list[End] = [(_HIGH, *total)] * len(targets)
    done: dict[int, tuple[Key, int]] = {}

    def settle(i: int, ends: list[End], always: bool) -> None:
        best = min(ends, key=lambda x: abs(x[1] - targets[i]))
        if always or abs(best[1] - targets[i]) <= slack:
            done[i] = (best[0], best[2])

    while True:
        open_ = [i for i in range(len(targets)) if i not in done and high[i][2] - low[i][2] > FEW]
        if not open_:
            break
        asked: set[Key] = set()
        n = max(2, min(PROBES, ALL_PROBES // len(open_)))
        for i in open_:
            (a, a_size, _), (b, b_size, _) = low[i], high[i]
            # beside the even ones, where the target would be if bytes were spread evenly, and closely around it
            begin, span = _number(a), _number(b) - _number(a)
            guess = [begin + span * max(0, targets[i] - a_size + s * (b_size - a_size) // 64) // max(1, b_size - a_size) for s in (-1, 0, 1)]
            asked |= {*_between(a, b, n), *(_key(g) for g in guess if begin < g < begin + span)}
        probes = sorted(asked)
        there = _between_probes(keys, probes)
        below: list[tuple[int, int]] = [(0, 0)]  # of each interval, what lies before it
        for i in range(len(probes)):
            size, rows = there.get(i, (0, 0))[:2]
            below.append((below[-1][0] + size, below[-1][1] + rows))
        sizes = [x[0] for x in below]
        for i in open_:
            at = bisect_right(sizes, targets[i]) - 1  # the last interval that begins no later than the target
            size, rows, least, most = there.get(at, (0, 0, _LOW, _HIGH))
            if rows:
                low[i] = max(low[i], (least, *below[at]))
                high[i] = min(high[i], (_key(_number(most) + 1), below[at][0] + size, below[at][1] + rows))
            else:  # nothing from the target on
                low[i] = high[i]
            settle(i, [low[i], high[i]], always=False)
    left = [i for i in range(len(targets)) if i not in done]
    intervals = sorted({(low[i][0], high[i][0]) for i in left if low[i][2] < high[i][2]})
    inside = _inside(keys, intervals) if intervals else {}
    number = {pair: n for n, pair in enumerate(intervals)}
    for i in left:
        ends, (size, rows) = [low[i], high[i]], low[i][1:]
        for key, n in inside.get(number.get((low[i][0], high[i][0]), -1), []):
            ends.append((key, size, rows))
            size, rows = size + n, rows + 1
        settle(i, ends, always=True)
    return [done[i] for i in range(len(targets))]


def shard(df: DataFrame, shards: int = 16, tolerance: float = 0.001, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """df with size, shard, slot: every row in one of the shards, slots gapless from 0, and the bytes of shards near equal.

    `tolerance` is the share of a shard's bytes by which a boundary may miss its place; a row is never cut, so the
    largest row can make it more.
    """
    size = (F.octet_length(text_of(df)) + 1).cast("long")
    rows = clashing(df, ["size", "shard", "slot", "_h", "_d", "_row", "_range", "_at"])
    rows = rows.withColumn("size", size).withColumn("_h", F.xxhash64(F.encode(text_of(df), "UTF-8"))).withColumn("_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")))
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "shards")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count("*").alias("n")).first()
    per_shard = max(4, -(-total["size"] // (shards * range_bytes)))
    parts = shards * int(min(per_shard, max(4, RANGES // shards)))
    found = splitters(rows, (total["size"], total["n"]), parts, tolerance) if total["n"] else []
    among = Sorted([k for k, _ in found])
    starts = np.array([0, *(n for _, n in found)], np.int64) if found else np.zeros(parts, np.int64)
    shard_of = np.arange(parts) * shards // parts
    begins = starts - starts[np.searchsorted(shard_of, shard_of)]  # rows of the shard before the range

    @F.pandas_udf("range int, shard int, begin long")
    def placed_in(h: pd.Series, d: pd.Series, row: pd.Series) -> pd.DataFrame:
        at = among.not_above(*(x.to_numpy(np.int64) for x in (h, d, row)))
        return pd.DataFrame({"range": at.astype(np.int32), "shard": shard_of[at].astype(np.int32), "begin": begins[at]})

    order = Window.partitionBy("_range").orderBy("_h", "_d", "_row")
    placed = rows.withColumn("_at", placed_in("_h", "_d", "_row")).withColumn("_range", F.col("_at.range"))
    placed = placed.withColumn("slot", F.col("_at.begin") + F.row_number().over(order) - 1).withColumn("shard", F.col("_at.shard"))
    return placed.drop("_h", "_d", "_row", "_range", "_at")

"""Minimax contiguous sharding in built-in DataFrame functions only.

Rows of one group (here: equal texts) are atomic; groups are ordered by a 64-bit hash key.  The smallest feasible
shard capacity is found by binary search with a greedy check over ordered group sizes.  Spark sums the sizes of key
ranges (at most ``max_units`` rows); the driver's search over these sums leaves windows in which a cut can lie, and only
the windows (one key range per cut at most) are summed again in finer ranges, until every range in a window is a single
group.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY_BITS = 64


class Units:
    """Ordered ranges of groups: first and last key, bytes; a range of one key can't be cut."""

    def __init__(self, rows: list[tuple[int, int, int]]):
        self.rows = sorted(rows)
        self.ends = list(accumulate(r[2] for r in self.rows))
        self.total = self.ends[-1] if self.rows else 0
        self.single = [r[0] == r[1] for r in self.rows]

    def reach(self, start: int, capacity: int, inside: bool) -> int:
        """Furthest position that a shard from ``start`` can end at; ``inside``: also within a range of many keys."""
        target = start + capacity
        i = bisect_right(self.ends, target)
        if i == len(self.ends):
            return self.total
        if inside and not self.single[i]:
            return target
        return max(start, self.ends[i - 1] if i else 0)

    def cuts(self, capacity: int, shards: int, inside: bool) -> list[int]:
        out, at = [], 0
        for _ in range(shards):
            at = self.reach(at, capacity, inside)
            out.append(at)
        return out

    def smallest(self, shards: int, inside: bool) -> int:
        low, high = -(-self.total // shards), self.total
        while low < high:
            mid = (low + high) // 2
            if self.cuts(mid, shards, inside)[-1] >= self.total:
                high = mid
            else:
                low = mid + 1
        return low

    def balanced(self, capacity: int, shards: int) -> list[int]:
        """Cut positions under the capacity, each as near to an equal split of the rest as feasibility allows.

        The greedy cut fills every shard to the capacity, which starves the last shards when one group sets it.
        """
        earliest, at = [self.total], self.total
        for _ in range(shards):  # from the right: where a shard may start at the earliest, so that the rest fits
            i = bisect_left(self.ends, at - capacity) if at > capacity else -1
            at = self.ends[i] if 0 <= i else 0
            earliest.append(at)
        out, at = [], 0
        for j in range(1, shards):
            furthest, ideal = self.reach(at, capacity, False), at + (self.total - at) / (shards - j + 1)
            least = max(at, earliest[shards - j])
            i = bisect_left(self.ends, ideal)
            near = [self.ends[k] for k in (i - 1, i) if 0 <= k < len(self.ends)] + [least, furthest]
            near = [x for x in near if max(least, at + 1) <= x <= furthest] or [furthest]  # no empty shard while rows are left
            at = min(near, key=lambda x: abs(x - ideal))
            out.append(at)
        return out

    def key_after(self, position: int) -> int | None:
        """First key of the range that begins at ``position``."""
        i = bisect_right(self.ends, position)
        return self.rows[i][0] if i < len(self.rows) else None


def _sums(groups: DataFrame, bits: int, ranges: list[tuple[int, int]] | None) -> list[tuple[int, int, int]]:
    where = None
    for lo, hi in ranges or []:
        inside = F.col("key").between(F.lit(lo), F.lit(hi))
        where = inside if where is None else where | inside
    rows = groups if where is None else groups.where(where)
    unit = F.shiftright("key", KEY_BITS - bits) if bits < KEY_BITS else F.col("key")
    out = rows.groupBy(unit.alias("unit")).agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.sum("size").alias("b"))
    return [(r.lo, r.hi, r.b) for r in out.collect()]


def plan_cuts(groups: DataFrame, shards: int, max_units: int = 1 << 16) -> tuple[int, list[int]]:
    """Smallest feasible capacity, and the keys at which shards 1, 2, ... begin (fewer if the last shards are empty).

    ``groups``: ``key`` long, ``size`` long, any number of rows per key.  The driver holds at most about
    ``2 * max_units`` range sums.
    """
    bits = max(1, max_units.bit_length() - 1)
    units = Units(_sums(groups, bits, None))
    if not units.total:
        return 0, []
    while True:
        high, low = units.smallest(shards, False), units.smallest(shards, True)
        first, last = units.cuts(low, shards, False), units.cuts(high, shards, True)
        spans: list[list[int]] = []
        for a, b in zip(first, last, strict=True):  # both ascend; one span of units per window, so at most ``shards`` ranges
            window = range(bisect_left(units.ends, a), min(len(units.ends), bisect_right(units.ends, b) + 1))
            open_ = [i for i in window if not units.single[i]]
            if open_ and spans and open_[0] <= spans[-1][1] + 1:
                spans[-1][1] = max(spans[-1][1], open_[-1])
            elif open_:
                spans.append([open_[0], open_[-1]])
        if not spans or high == low:
            break
        many = sum(not units.single[i] for lo, hi in spans for i in range(lo, hi + 1))
        bits = min(KEY_BITS, bits + max(1, (max_units // many).bit_length() - 1))
        # single groups inside a span are summed again with their neighbours
        gone = {i for lo, hi in spans for i in range(lo, hi + 1)}
        finer = _sums(groups, bits, [(units.rows[lo][0], units.rows[hi][1]) for lo, hi in spans])
        units = Units([r for i, r in enumerate(units.rows) if i not in gone] + finer)
    keys = [units.key_after(p) for p in units.balanced(high, shards)]
    return high, [k for k in keys if k is not None]


def assign(key: Column, cuts: list[int]) -> Column:
    return sum((F.when(key >= F.lit(c), 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")


def number_slots(rows: DataFrame, order: list[str], total: int, per_bucket: int = 20_000) -> DataFrame:
    """Add ``slot``: gapless from 0 within each ``shard``.

    Rows of a shard are numbered bucket by bucket (buckets by a hash of all of ``order``), so that no task orders a whole
    shard; only the buckets' counts, about ``total / per_bucket`` rows, are summed up per shard.
    """
    buckets = max(1, total // per_bucket)
    rows = rows.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy("shard", "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("shard", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    within = Window.partitionBy("shard", "_b").orderBy(*order)
    numbered = rows.withColumn("_at", F.row_number().over(within) - 1)
    return numbered.join(starts, ["shard", "_b"]).withColumn("slot", (F.col("_start") + F.col("_at")).cast("long")).drop("_b", "_at", "_start")


def shard_rows(rows: DataFrame, shards: int, order: list[str], max_units: int = 1 << 16) -> DataFrame:
    """Add ``shard`` (0 to shards - 1) and ``slot`` to ``rows``, which hold ``key`` (rows of a key stay together) and ``size``.

    Null sizes count as 0; null keys form one group, ordered before all others.  Equal rows get different slots.  One
    group larger than an equal share takes a shard of its own and sets the capacity.  ``rows`` is read several times.
    """
    total = rows.count()
    keyed = rows.withColumn("key", F.coalesce("key", F.lit(-(1 << 63)))).withColumn("size", F.coalesce("size", F.lit(0)))
    _, cuts = plan_cuts(keyed.select("key", "size"), shards, max_units)
    return number_slots(keyed.withColumn("shard", assign(F.col("key"), cuts)), order, total)

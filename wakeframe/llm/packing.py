"""Best-fit packing by minimum bin slack.

Only the number of items of each length matters for the choice of bins, and lengths are at most the
capacity. So Spark counts items by length, the driver fills bins from that table (never longer than the
capacity, whatever the data), and Spark deals the items out: each item's rank among the items of its
length says which bin and which place it gets.

A bin takes the longest length left, then the fullest feasible combination of the others: a subset-sum
over the available lengths, as bitsets, longest lengths first, that stops when the bin is full. The
combination is taken out as many times as the counts allow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from wakeframe.llm.stored import in_batches
from wakeframe.session import checkpoint

# Items of one length that are ranked together; more are dealt to several groups first.
RANK_GROUP = 2000


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """The combination of available lengths (with repeats up to their counts) that leaves the least of ``room``.

    ``lengths`` is in descending order. Bit s of a set says that sum s can be reached.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        for _ in range(min(counts[length], room // length)):
            grown = reach | (reach << length) & mask
            if grown == reach:
                break
            steps.append((length, reach))
            reach = grown
            if reach >> room:
                break
        if reach >> room:
            break
    total, out = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        if not before >> total & 1:
            total -= length
            out.append(length)
    return out


def fill_bins(counts: dict[int, int], capacity: int) -> Iterator[tuple[list[int], int]]:
    """(lengths in one bin, number of such bins) until every item is placed."""
    left = {n: c for n, c in counts.items() if c}
    order = sorted(left, reverse=True)
    while order:
        top = order[0]
        left[top] -= 1
        others = [n for n in order if left[n]]
        bin_ = [top, *fullest(left, others, capacity - top)]
        left[top] += 1
        need = {n: bin_.count(n) for n in set(bin_)}
        times = min(left[n] // k for n, k in need.items())
        for n, k in need.items():
            left[n] -= k * times
        yield bin_, times
        order = [n for n in order if left[n]]


class Plan:
    """For each length, runs of ranks with the bin and the place that they get."""

    def __init__(self, counts: dict[int, int], capacity: int):
        used: dict[int, int] = {}
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        self.bins = 0
        for lengths, times in fill_bins(counts, capacity):
            place = 0
            for n in sorted(set(lengths), reverse=True):
                k = lengths.count(n)
                runs.setdefault(n, []).append((used.get(n, 0), k, self.bins, place))
                used[n] = used.get(n, 0) + k * times
                place += k * n
            self.bins += times
        self.runs = {n: tuple(np.array(x, np.int64) for x in zip(*v)) for n, v in runs.items()}

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bin, offset in it) of items by their length and rank."""
        bins, offsets = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            first, k, base, place = self.runs[int(n)]
            i = np.searchsorted(first, rank[at], "right") - 1
            beyond = rank[at] - first[i]
            bins[at] = base[i] + beyond // k[i]
            offsets[at] = place[i] + beyond % k[i] * n
        return bins, offsets


def ranks(items: DataFrame, length: str, counts: dict[int, int], order: list[str], name: str = "rank") -> DataFrame:
    """0-based rank among the items of a length, by groups of about RANK_GROUP so that no length is one task's."""
    groups = F.lit(1)
    large = {n: -(-c // RANK_GROUP) for n, c in counts.items() if c > RANK_GROUP}
    if large:  # at most one entry a length
        table = F.create_map(*[x for n, g in large.items() for x in (F.lit(n).cast("bigint"), F.lit(g))])
        groups = F.coalesce(F.try_element_at(table, F.col(length).cast("bigint")), F.lit(1))
    tagged = items.withColumn("_group", F.pmod(F.xxhash64(*order), groups).cast("int"))
    sizes = tagged.groupBy(length, "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(length).orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(length, "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(length, "_group").orderBy(*order)
    numbered = tagged.withColumn("_at", F.row_number().over(inside) - 1)
    return numbered.join(starts, [length, "_group"]).withColumn(name, F.col("_before") + F.col("_at")).drop("_group", "_at", "_before")


def pack(items: DataFrame, capacity: int, order: list[str], length: str = "length", carry: list[str] | None = None) -> DataFrame:
    """(order columns, length, carried columns, sequence_id BIGINT, offset BIGINT): each item's bin and place in it.

    ``items`` has a length from 1 to ``capacity`` (else the job fails; a null length too) and ``order``
    columns that tell items apart; rows that repeat them are items of their own, placed in either order.
    Offsets are gapless from 0 in each bin. The items are checkpointed, as their counts steer the rest.
    Columns that are neither named in ``order`` nor in ``carry`` are not read. Without items, no rows.
    """
    carry = carry or []
    bad = F.col(length).isNull() | (F.col(length) < 1) | (F.col(length) > capacity)
    checked = F.when(bad, F.raise_error(F.lit(f"an item's length is not from 1 to {capacity}")).cast("bigint")).otherwise(F.col(length).cast("bigint"))
    base = checkpoint(items.select(*order, checked.alias("length"), *carry))
    counts = {r[0]: r[1] for r in base.groupBy("length").count().collect()}
    plan = Plan(counts, capacity)
    ranked = ranks(base, "length", counts, order)

    def place(batches):
        for batch in batches:
            n, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (-2, -1))
            bins, offsets = plan.place(n, rank)
            kept = batch.columns[:-2]
            yield pa.RecordBatch.from_arrays([*kept, batch.column(-2), pa.array(bins), pa.array(offsets)], out.names)

    rows = ranked.select(*order, *carry, "length", "rank")
    out = rows.drop("rank").schema.add("sequence_id", LongType()).add("offset", LongType())
    return in_batches(rows, place, out)


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """(sequence_id, n_tokens, ids BINARY): the pieces of each bin joined in their places.

    A bin holds at most ``capacity`` tokens, so a group is bounded.
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", F.col(ids).alias("part")))), lambda p: p["part"])
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))

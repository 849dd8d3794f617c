"""A reproducible shuffle: global row numbers through a Feistel permutation, dealt to shards.

DataFrame functions only. Row n of N goes to place p = permutation(n); its shard is p modulo the number of
shards and its slot p divided by it, so shards differ by one row at most and any row's place can be computed
from (n, N, shards, seed) without the data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from wakeframe.llm.stored import stored

ROUNDS = 6
WALK = 64


def permuted(n: Column, total: int, seed: int = 0) -> Column:
    """The place of number ``n`` in a permutation of 0 .. total - 1.

    An alternating Feistel network on pairs (left < a, right < b) with a * b >= total permutes 0 .. a*b - 1;
    a result of ``total`` or more goes through again (cycle walking). Fewer than a = ceil(sqrt(total)) numbers
    lie beyond ``total``, so a walk goes on with a chance of about 1 in sqrt(total) a step; one that needs more than
    WALK steps fails the job rather than give a wrong place.
    """
    a = max(1, math.isqrt(max(0, total - 1)) + 1)
    b = max(1, -(-total // a))

    def moved(x: Column, by: Column, k: Column, size: int) -> Column:
        return ((x + F.pmod(F.xxhash64(by, k, F.lit(seed)), F.lit(size))) % size).cast("bigint")

    def one_round(s: Column, k: Column) -> Column:
        left, right = s["l"], s["r"]
        return F.when(k % 2 == 0, F.struct(moved(left, right, k, a).alias("l"), right.alias("r"))).otherwise(
            F.struct(left.alias("l"), moved(right, left, k, b).alias("r"))
        )

    def network(x: Column) -> Column:
        start = F.struct(F.floor(x / F.lit(b)).cast("bigint").alias("l"), (x % b).cast("bigint").alias("r"))
        if total >= 1 << 52:  # beyond the exact doubles
            start = F.struct(((x - x % b) / F.lit(b)).cast("bigint").alias("l"), (x % b).cast("bigint").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, one_round, lambda s: s["l"] * b + s["r"])

    number = n.cast("bigint")
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), network(number), lambda x, _: F.when(x < total, x).otherwise(network(x)))
    stuck = F.raise_error(F.lit(f"a cycle walk took more than {WALK} steps")).cast("bigint")
    return F.transform(F.array(walked), lambda x: F.when(x < total, x).otherwise(stuck))[0]


def number_rows(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """((row STRUCT, number BIGINT), number of rows): rows with a global 0-based number by ``order``.

    Rows are ranged over the partitions, sorted inside and written once with their place in the partition;
    counts by partition (one row each) give the places before it. Nulls come first; rows that agree in
    ``order`` are numbered in either order.
    """
    keys = [f"key{i}" for i in range(len(order))]
    rows = df.select(F.struct("*").alias("row"), *[F.col(c).alias(k) for c, k in zip(order, keys)])
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    base = stored(ranged.select("row", F.monotonically_increasing_id().alias("place")), "numbered")
    part = F.shiftright("place", 33)
    counts = base.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"))
    local = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = base.withColumn("part", part).join(starts, "part")
    return numbered.select("row", (F.col("before") + local).alias("number")), base.count()


def shard(df: DataFrame, order: list[str], shards: int, seed: int = 0) -> DataFrame:
    """``df`` with ``shard`` INT (0 .. shards - 1) and ``slot`` BIGINT (gapless from 0 in each shard).

    ``order`` names the columns that fix the row numbers, such as a unique id: rows, seed and number of
    shards decide the result, partitioning does not. Shards differ by at most one row. A row without an id
    counts as the smallest; rows that repeat an id share consecutive numbers. An empty table gives no rows.
    Columns of ``df`` named shard or slot are replaced.
    """
    numbered, total = number_rows(df.drop("shard", "slot"), order)
    placed = numbered.select("row", permuted(F.col("number"), total, seed).alias("to"))
    home = F.col("to") % shards
    return placed.select("row.*", home.cast("int").alias("shard"), ((F.col("to") - home) / shards).cast("bigint").alias("slot"))

"""Order-dependent primitives that survive a hot key.

A window over ``partitionBy(channel)`` puts a whole channel into one task. The
helpers here cut a key into blocks (time buckets, or equal slices of the sample
number), work per block in parallel, and carry the little that crosses a block
border (a count, a sum, a last row) through a table with one row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

BLOCK = 65536


def index_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str = "n"
) -> DataFrame:
    """Exact 0-based row number inside ``keys`` by ``order``.

    ``block`` must grow with ``order`` (for example the hour of a timestamp), so
    it is bounded by the sampling rate and no key is ever sorted in one task.
    """
    keys = list(keys)
    tagged = df.withColumn("_blk", block)
    counts = tagged.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_cnt"))
    before = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_blk", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    local = W.partitionBy(*keys, "_blk").orderBy(*order)
    return (
        tagged.withColumn("_rn", F.row_number().over(local) - 1)
        .join(offsets, [*keys, "_blk"])
        .withColumn(name, (F.col("_off") + F.col("_rn")).cast("bigint"))
        .drop("_blk", "_rn", "_off")
    )


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    values: Sequence[str],
    prefix: str = "prev_",
) -> DataFrame:
    """``lag(1)`` of ``values`` inside ``keys`` by ``order``, block by block.

    The first row of a block takes its predecessor from the last row of the nearest earlier
    block that has rows. Those last rows, one per block, come from the same sorted blocks as the
    lags do, so the rows are shuffled once.
    """
    keys, order, values = list(keys), list(order), list(values)
    tagged = df.withColumn("_blk", block)
    local = W.partitionBy(*keys, "_blk").orderBy(*order)
    lagged = tagged.withColumns(
        {"_lag": F.lag(F.struct(*values)).over(local), "_last": F.lead(F.lit(False), 1, True).over(local)}
    )
    tail = lagged.filter("_last").select(*keys, "_blk", F.struct(*values).alias("_tail"))
    carried = tail.select(
        *keys, "_blk", F.lag("_tail").over(W.partitionBy(*keys).orderBy("_blk")).alias("_carry")
    )
    out = lagged.join(carried, [*keys, "_blk"])
    prev = F.coalesce(F.col("_lag"), F.col("_carry"))
    return out.select(*df.columns, *[prev[v].alias(prefix + v) for v in values])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    sums: dict[str, Column],
) -> DataFrame:
    """Inclusive running sums inside ``keys`` by ``order``; ``sums`` maps names to columns."""
    keys, order = list(keys), list(order)
    tagged = df.withColumn("_blk", block)
    totals = tagged.groupBy(*keys, "_blk").agg(*[F.sum(c).alias("_t_" + s) for s, c in sums.items()])
    before = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_blk", *[F.coalesce(F.sum("_t_" + s).over(before), F.lit(0)).alias("_c_" + s) for s in sums]
    )
    local = W.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = tagged.select("*", *[F.coalesce(F.sum(c).over(local), F.lit(0)).alias("_l_" + s) for s, c in sums.items()])
    return out.join(carried, [*keys, "_blk"]).select(
        *df.columns, *[(F.col("_c_" + s) + F.col("_l_" + s)).alias(s) for s in sums]
    )


def with_halo(df: DataFrame, n: str, before: int, after: int, size: int = BLOCK) -> DataFrame:
    """Slice a dense sample number into blocks and copy the border rows to their neighbours.

    Adds ``blk`` (the block a copy serves) and ``own`` (true on the one copy that
    must be kept). A window over ``(key, blk)`` then sees ``before`` / ``after``
    rows past the block's edges.
    """
    if max(before, after) > size:
        raise ValueError("halo wider than a block")
    home = F.floor(F.col(n) / size).cast("bigint")
    pos = F.col(n) % size
    copies = F.filter(
        F.array(
            F.struct(home.alias("blk"), F.lit(True).alias("own")),
            F.when(pos >= size - before, F.struct((home + 1).alias("blk"), F.lit(False).alias("own"))),
            F.when(pos < after, F.struct((home - 1).alias("blk"), F.lit(False).alias("own"))),
        ),
        lambda c: c.isNotNull(),
    )
    return df.select("*", F.inline(copies))


def windowed(
    df: DataFrame,
    keys: Sequence[str],
    n: str,
    before: int,
    after: int,
    build,
    size: int = BLOCK,
) -> DataFrame:
    """Run ``build(window) -> {name: Column}`` over ``keys`` by ``n`` in haloed blocks."""
    haloed = with_halo(df, n, before, after, size)
    w = W.partitionBy(*keys, "blk").orderBy(n)
    cols = build(w)
    out = haloed.select("*", *[c.alias(name) for name, c in cols.items()])
    return out.filter("own").drop("blk", "own")

"""Expressions over one bounded series held as ``ARRAY<DOUBLE>`` on its row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeframe.functions.grid import let


def present(arr: Column) -> Column:
    return F.filter(arr, lambda v: v.isNotNull() & ~F.isnan(v))


def total(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)


def mean(arr: Column) -> Column:
    return let(present(arr), lambda a: total(a) / F.nullif(F.size(a), F.lit(0)))


def max_abs(arr: Column) -> Column:
    return F.array_max(F.transform(present(arr), lambda v: F.abs(v)))


def zero_mean(arr: Column) -> Column:
    """Subtract the mean of the present samples; a series without any is left alone."""
    return let(mean(arr), lambda m: F.when(m.isNull(), arr).otherwise(F.transform(arr, lambda v: v - m)))


def scale(arr: Column) -> Column:
    """Largest magnitude, or 1 when it is 0 or missing."""
    return F.coalesce(F.nullif(max_abs(arr), F.lit(0.0)), F.lit(1.0))


def normalise(arr: Column) -> Column:
    return let(scale(arr), lambda s: F.transform(arr, lambda v: v / s))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _interpolate(rows: pd.Series) -> pd.Series:
    out = []
    for r in rows:
        x = np.asarray(r, float)
        good = np.flatnonzero(np.isfinite(x))
        out.append(np.interp(np.arange(len(x)), good, x[good]) if len(good) else np.zeros(len(x)))
    return pd.Series(out, dtype=object)


def fill_gaps(arr: Column) -> Column:
    """Linear interpolation over missing samples, edges held; all missing gives zeros."""
    return _interpolate(arr)


def resample_linear(arr: Column, length: Column) -> Column:
    """Resample to ``length`` points on [0, 1]; one sample repeats, none gives zeros."""

    def run(a: Column) -> Column:
        size = F.size(a)

        def point(i):
            at = i * (size - 1) / (length - 1)
            return let(
                F.least(F.floor(at), size - 2).cast("int"),
                lambda lo: F.get(a, lo) + (F.get(a, lo + 1) - F.get(a, lo)) * (at - lo),
            )

        flat = F.transform(F.sequence(F.lit(1), length), lambda i: F.coalesce(F.get(a, F.lit(0)), F.lit(0.0)))
        return (
            F.when(size == length, a)
            .when(size <= 1, flat)
            .when(length == 1, F.slice(a, 1, 1))
            .otherwise(F.transform(F.sequence(F.lit(0), length - 1), point))
        )

    return let(arr, run)


def tail_spike(arr: Column, fraction: float, ratio: float, min_tail: int) -> Column:
    """True when the tail's largest magnitude exceeds ``ratio`` times the body's."""
    n = F.size(arr)
    tail = F.least(F.greatest(F.bround(n * fraction).cast("int"), F.lit(min_tail)), n - 1)
    body_max = max_abs(F.slice(arr, 1, F.greatest(n - tail, F.lit(0))))
    tail_max = max_abs(F.slice(arr, n - tail + 1, tail))
    verdict = tail_max > ratio * F.greatest(body_max, F.lit(1e-9))
    return F.when(n < 2, F.lit(False)).otherwise(F.coalesce(verdict, F.lit(False)))


def roll(arr: Column, shift: Column) -> Column:
    """Rotate so that element 0 moves to position ``shift`` (negative turns it back)."""
    bound = F.struct(arr.alias("a"), shift.cast("int").alias("s"))
    return let(bound, lambda b: F.transform(b["a"], lambda v, i: F.get(b["a"], F.pmod(i - b["s"], F.size(b["a"])).cast("int"))))


def difference(arr: Column) -> Column:
    """Forward differences with the last one repeated; up to one sample gives zeros."""

    def run(a: Column) -> Column:
        n = F.size(a)
        return F.when(n <= 1, F.transform(a, lambda v: F.lit(0.0))).otherwise(
            F.transform(a, lambda v, i: let(F.least(i, n - 2), lambda k: F.get(a, k + 1) - F.get(a, k)))
        )

    return let(arr, run)

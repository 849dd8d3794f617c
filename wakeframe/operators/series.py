"""Sensor-series operators: scaling, gaps, resampling, windows, event windows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from wakeframe.functions import arrays
from wakeframe.functions.filters import natural_spline
from wakeframe.functions.grid import let
from wakeframe.operators.ordering import BLOCK, running, windowed
from wakeframe.session import written

# --- scaling ------------------------------------------------------------------------------


def global_min_max(df: DataFrame, col: str, low: float, high: float, out: str | None = None) -> DataFrame:
    """Map a column to [low, high] by its extremes over the whole table (one broadcast row)."""
    ext = df.agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    span = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return df.join(F.broadcast(ext)).withColumn(out or col, low + (high - low) * (F.col(col) - F.col("_lo")) / span).drop("_lo", "_hi")


def standardise_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row of means and population deviations (0 becomes 1), NULL and NaN left out."""
    clean = lambda c: F.nanvl(F.col(c), F.lit(None).cast("double"))
    return df.agg(
        *[F.avg(clean(c)).alias(c + "_mean") for c in cols],
        *[F.coalesce(F.nullif(F.stddev_pop(clean(c)), F.lit(0.0)), F.lit(1.0)).alias(c + "_std") for c in cols],
    )


def standardise(df: DataFrame, cols: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """Standardise with own or given (train) statistics; missing values become the mean."""
    stats = standardise_stats(df, cols) if stats is None else stats
    j = df.join(F.broadcast(stats))
    out = {}
    for c in cols:
        v = F.coalesce(F.nanvl(F.col(c), F.lit(None).cast("double")), F.col(c + "_mean"))
        out[c] = (v - F.col(c + "_mean")) / F.col(c + "_std")
    return j.withColumns(out).select(*df.columns)


def pressure_from_cp(cp: Column, speed: Column, rho: float = 1000.0, half: bool = True) -> Column:
    """Pa from a pressure coefficient: half rho U^2 Cp, or rho U^2 Cp."""
    return (0.5 if half else 1.0) * rho * speed * speed * cp


def speed_from_pixels(v: Column) -> Column:
    """px/s at 25 fps to m/s."""
    return v * 0.5145 / 0.4 * 4


def solver_seconds(t: Column, re: Column, n: int = 128, nu: float = 1e-6) -> Column:
    """Solver time to seconds with h = 1/n and viscosity (n / 20) / Re."""
    h = 1.0 / n
    return t * h * h * ((n / 20) / re) / nu


def adc_to_pascal(v: Column, low: float = -500.0, high: float = 500.0) -> Column:
    """16-bit counts to a pressure range."""
    return (v + 32768) * (high - low) / 65536 + low


# 6 x 6 calibration of the force sensor (fixed values).
TRANSFER = [
    [-0.00325, 0.00015, 0.09822, -1.82505, -0.09847, 1.94002],
    [-0.10322, 2.17422, 0.05485, -1.05390, 0.05019, -1.12259],
    [3.34623, -0.19080, 3.40461, -0.09898, 3.34600, -0.15760],
    [-0.07841, 1.03241, -3.81689, -0.40255, 3.85454, -0.69811],
    [4.36689, -0.24081, -2.30034, 0.92527, -2.13793, -0.81700],
    [0.11835, -2.30599, 0.10847, -2.24479, 0.12206, -2.39381],
]
LBF_TO_N, PSI_TO_PA = 4.44822162, 6894.76
PRESSURE_CHANNELS = range(17, 22)


def force_and_pressure(df: DataFrame, col: str) -> DataFrame:
    """``force`` (three forces in N, three torques) and ``pressure`` (channels 17..21 in Pa)."""
    read = lambda k: F.get(F.col(col), F.lit(k))
    force = []
    for i, row in enumerate(TRANSFER):
        dot = sum((F.lit(m) * read(k) for k, m in enumerate(row)), F.lit(0.0))
        force.append(dot * LBF_TO_N if i < 3 else dot)
    return df.withColumns(
        {"force": F.array(*force), "pressure": F.array(*[read(k) * PSI_TO_PA / 5 for k in PRESSURE_CHANNELS])}
    )


# --- ragged snapshots -----------------------------------------------------------------------


def resample_cubic(col: Column, length: int) -> Column:
    """Natural cubic spline to ``length`` points; linear under 4 samples, constant under 2.

    Series of equal length in an Arrow batch are solved together.
    """

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series) -> pd.Series:
        out: list = [None] * len(rows)
        sizes = rows.map(len).to_numpy()
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            block = np.stack([np.asarray(rows.iloc[i], float) for i in at])
            if n == length:
                y = block
            elif n <= 1:
                y = np.repeat(block if n else np.zeros((len(at), 1)), length, axis=1)
            elif n < 4:
                grid = np.linspace(0, n - 1, length)
                lo = np.minimum(grid.astype(int), n - 2)
                y = block[:, lo] + (block[:, lo + 1] - block[:, lo]) * (grid - lo)
            else:
                y = natural_spline(block, length)
            for i, r in zip(at, y):
                out[i] = r
        return pd.Series(out, dtype=object)

    return run(col)


def resample_group(df: DataFrame, col: str, method: str = "linear") -> DataFrame:
    """Fill gaps, resample every series to the longest length, zero the mean, scale to max 1."""
    longest = df.agg(F.max(F.size(col)).alias("_len"))
    d = df.withColumn(col, arrays.fill_gaps(F.col(col)))
    if method == "cubic":
        target = longest.first()["_len"]
        d = d.withColumn(col, resample_cubic(F.col(col), int(target or 1)))
    else:
        d = d.join(F.broadcast(longest)).withColumn(col, arrays.resample_linear(F.col(col), F.col("_len"))).drop("_len")
    return d.withColumn(col, arrays.normalise(arrays.zero_mean(F.col(col))))


def mean_by_class(df: DataFrame, by: str, col: str) -> DataFrame:
    return df.select(by, F.posexplode(col).alias("pos", "_v")).groupBy(by, "pos").agg(F.avg("_v").alias("mean"))


def split_tail_spikes(df: DataFrame, col: str, fraction: float = 0.15, ratio: float = 5.0, min_tail: int = 5) -> DataFrame:
    return df.withColumn("spiky", arrays.tail_spike(arrays.fill_gaps(F.col(col)), fraction, ratio, min_tail))


def energy_cumulative(df: DataFrame, keys: Sequence[str], value: str, target: float) -> DataFrame:
    """Rank, share and cumulative share of each mode's energy, and the count that reaches ``target``.

    The window holds one row per mode of a basis, bounded by the snapshot count.
    """
    order = W.partitionBy(*keys).orderBy(F.col(value).desc())
    whole = W.partitionBy(*keys)
    d = df.withColumns({"rank": F.row_number().over(order), "_total": F.sum(value).over(whole), "_modes": F.count(value).over(whole)})
    d = d.withColumn("cumulative", F.sum(value).over(order.rowsBetween(W.unboundedPreceding, 0)) / F.nullif("_total", F.lit(0.0)))
    reach = F.min(F.when(F.col("cumulative") >= target, F.col("rank"))).over(whole)
    return d.withColumn("needed", F.least(F.coalesce(reach, F.col("_modes")), F.col("_modes"))).drop("_total", "_modes")


def ring_subset(df: DataFrame, col: str, picks: int) -> DataFrame:
    """Regular subset of a ring after turning it by the position of its smallest value."""
    low = F.array_position(F.col(col), F.array_min(col)).cast("int") - 1

    def take(ring):
        at = lambda k: F.get(ring, F.bround(k * (F.size(ring) - 1) / picks).cast("int"))
        return F.transform(F.sequence(F.lit(0), F.lit(picks - 1)), lambda k: F.struct(k.alias("k"), at(k).alias("v")))

    return df.withColumn("subset", let(arrays.roll(F.col(col), low), take))


# --- spines ---------------------------------------------------------------------------------


def heading_and_tail(df: DataFrame, unit: bool = False) -> DataFrame:
    """``heading`` of nose from centre and signed ``tail`` angle, as turns when ``unit``."""
    dx, dy = F.col("nose_x") - F.col("com_x"), F.col("nose_y") - F.col("com_y")
    tx, ty = F.col("tail_x3") - F.col("tail_x1"), F.col("tail_y3") - F.col("tail_y1")
    turn = 2 * F.pi()
    heading = F.atan2(dy, dx)
    tail = F.when((F.hypot(dx, dy) > 0) & (F.hypot(tx, ty) > 0), F.pmod(F.atan2(dx * ty - dy * tx, dx * tx + dy * ty), turn)).otherwise(0.0)
    if unit:
        heading, tail = F.pmod(heading, turn) / turn, tail / turn
    return df.withColumns({"heading": heading, "tail": tail})


def motion(x: Column, y: Column) -> Column:
    """Speed and acceleration of a bounded path: differences with the last value repeated."""
    steps = lambda a, b: F.zip_with(arrays.difference(a), arrays.difference(b), lambda p, q: F.sqrt(p * p + q * q))
    return let(steps(x, y), lambda v: F.arrays_zip(v.alias("speed"), arrays.difference(v).alias("accel")))


# --- long channels ----------------------------------------------------------------------------


def cumulative_mean(df: DataFrame, keys: Sequence[str], order: str, block: Column, col: str) -> DataFrame:
    """Running mean per key, then one more row per key with the overall mean (order = last + 1)."""
    ones = F.when(F.col(col).isNotNull(), 1)
    r = running(df.select(*keys, order, col), keys, [order], block, {"_s": F.col(col), "_n": ones})
    rows = r.select(*keys, order, (F.col("_s") / F.col("_n")).alias("mean"))
    last = df.groupBy(*keys).agg((F.max(order) + 1).alias(order), F.avg(col).alias("mean"))
    return rows.unionByName(last)


def trailing_baseline(df: DataFrame, keys: Sequence[str], n: str, col: str, rows: int = 20, divisor: float = 4.0, size: int = BLOCK) -> DataFrame:
    """Mean of the last ``rows`` samples, and the sample minus it over ``divisor``."""
    out = windowed(df, keys, n, rows - 1, 0, lambda w: {"baseline": F.avg(col).over(w.rowsBetween(-(rows - 1), 0))}, size)
    return out.withColumn("corrected", (F.col(col) - F.col("baseline")) / divisor)


def every_nth(df: DataFrame, n: str, step: int) -> DataFrame:
    """One row out of ``step``, the first at step - 1."""
    return df.filter(F.col(n) % step == step - 1)


def turns(df: DataFrame, keys: Sequence[str], n: str, col: str, size: int = BLOCK) -> DataFrame:
    """Samples where the displacement changes sign against the one before; zeros do not count."""

    def build(w):
        d1, d0 = F.col(col) - F.lag(col).over(w), F.lag(col).over(w) - F.lag(col, 2).over(w)
        return {"turn": F.coalesce(((d1 < 0) & (d0 > 0)) | ((d1 > 0) & (d0 < 0)), F.lit(False))}

    return windowed(df, keys, n, 2, 0, build, size).filter("turn").drop("turn")


def upsample(df: DataFrame, keys: Sequence[str], n: str, col: str, factor: int, size: int = BLOCK) -> DataFrame:
    """Linear interpolation on a clock ``factor`` times faster; the last sample stays alone."""
    d = windowed(df, keys, n, 0, 1, lambda w: {"_next": F.lead(col).over(w)}, size)
    steps = F.when(F.col("_next").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(factor - 1)))
    d = d.withColumn("_k", F.explode(steps))
    value = F.col(col) + F.coalesce((F.col("_next") - F.col(col)) * F.col("_k") / factor, F.lit(0.0))
    return d.select(*keys, (F.col(n) * factor + F.col("_k")).alias(n), value.alias(col))


def trim_by_trigger(df: DataFrame, keys: Sequence[str], state: Column, t: str) -> DataFrame:
    """Rows whose trigger is set, time counted from the first of them."""
    on = df.filter(state)
    start = on.groupBy(*keys).agg(F.min(t).alias("_t0"))
    return on.join(written(start), list(keys)).withColumn(t, F.col(t) - F.col("_t0")).drop("_t0")


def periodic_lookup(queries: DataFrame, tables: DataFrame, key: str, t: str, dt: float, rows: int) -> DataFrame:
    """Linear interpolation in a table that repeats every ``rows`` rows.

    ``tables`` holds (key, row, value); each query takes its two rows by one equi-join.
    """
    span = dt * rows
    index = F.pmod(F.floor(F.col(t) / dt), F.lit(rows)).cast("int")
    nxt = F.pmod(F.ceil(F.col(t) / dt), F.lit(rows)).cast("int")
    q = queries.withColumns({"_i": index, "_j": nxt, "_id": F.struct(*queries.columns)})
    hits = q.select("*", F.explode(F.array_distinct(F.array("_i", "_j"))).alias("row")).join(tables, [key, "row"])
    at = hits.groupBy("_id", "_i", "_j").agg(
        F.max(F.when(F.col("row") == F.col("_i"), F.col("value"))).alias("a"),
        F.max(F.when(F.col("row") == F.col("_j"), F.col("value"))).alias("b"),
    )
    time = F.col("_id")[t]
    frac = time - F.floor(time / span) * span - F.col("_i") * dt
    value = F.when(F.col("_i") == F.col("_j"), F.col("a")).otherwise(F.col("a") + frac * (F.col("b") - F.col("a")) / dt)
    return at.select("_id.*", value.alias("value"))


def position_at(queries: DataFrame, table: DataFrame, key: str, t: str, dt: float, sx: float, sy: float) -> DataFrame:
    """Row ``int(t / dt - 1)`` of a key's table, clamped to it, with rescaled coordinates."""
    size = table.groupBy(key).agg((F.max("row") + 1).alias("_n"))
    raw = (F.col(t) / dt - 1).cast("bigint")
    q = queries.join(size, key).withColumn("row", F.greatest(F.lit(0), F.least(raw, F.col("_n") - 1)).cast("int"))
    return q.join(table, [key, "row"]).withColumns({"x": F.col("x") * sx, "y": F.col("y") * sy}).drop("_n")


# --- windows around events ------------------------------------------------------------------


def comparison_window(df: DataFrame, half: float = 1.0, fs: int = 500, dt: float = 0.01) -> DataFrame:
    """Window around a passage at ``t`` inside a simulation, shrunk at the simulation's limits.

    Needs (t, start_s, start_frame, end_frame); adds the reach before and after in
    seconds, the simulation frames and the sensor samples, both ends included.
    """
    t, s = F.col("t"), F.col("start_s")
    room_before = t - (s + F.col("start_frame") * dt)
    room_after = (s + F.col("end_frame") * dt) - t
    before, after = F.least(room_before, F.lit(half)), F.least(room_after, F.lit(half))
    trunc = lambda c: c.cast("bigint")
    d = df.withColumns({"before": before, "after": after})
    return d.withColumns(
        {
            "sim_start": F.when(room_before < half, F.col("start_frame")).otherwise(trunc((t - s - F.col("before")) / dt)),
            "sim_end": F.when(room_after < half, F.col("end_frame")).otherwise(trunc((t - s + F.col("after")) / dt)),
            "first_sample": trunc(t * fs) - trunc(F.col("before") * fs),
            "last_sample": trunc(t * fs) + trunc(F.col("after") * fs),
        }
    )


def frame_to_sample(frame: Column, frame_rate: float, fs: float) -> Column:
    return F.bround(frame * fs / frame_rate).cast("bigint")


def segment_bounds(df: DataFrame, fs: float, frame_rate: float, offset: int = 0) -> DataFrame:
    """Sample range of a segment after two crops: the video window, then the skip, then the frames.

    Needs (start_s, end_s, skip_frame, start_frame, end_frame); drops empty segments.
    """
    base, stop = (F.col("start_s") * fs).cast("bigint"), (F.col("end_s") * fs).cast("bigint")
    begin = base + F.greatest(F.lit(0), frame_to_sample(F.col("skip_frame"), frame_rate, fs))
    first = F.greatest(F.lit(0), F.col("start_frame") - offset)
    lo = begin + frame_to_sample(first, frame_rate, fs)
    hi = F.least(stop, begin + frame_to_sample(F.col("end_frame") - offset + 1, frame_rate, fs))
    d = df.withColumns({"first_sample": lo, "stop_sample": hi})
    return d.filter((F.col("end_frame") - offset >= first) & (F.col("first_sample") < F.col("stop_sample")))


def seconds(hms: Column) -> Column:
    """``hh:mm:ss`` on the four-times slow clock, in seconds."""
    parts = F.split(hms, ":")
    part = lambda i: F.element_at(parts, i).cast("int")
    return (part(1) * 3600 + part(2) * 60 + part(3)) / 4.0


# --- comparing frames with a run's last frame -------------------------------------------------


def against_last(df: DataFrame, col: str) -> DataFrame:
    """Each frame beside the last frame of its run (one row per run on the small side)."""
    last = df.groupBy("run").agg(F.max_by(F.struct("frame", col), "frame").alias("_l"))
    return df.join(last, "run").withColumns({"last_frame": F.col("_l.frame"), "last": F.col("_l")[col]}).drop("_l")


def period_start(df: DataFrame, col: str, exact: bool = False, min_back: int = 100) -> DataFrame:
    """Frame where the final period starts: the latest equal frame, or the closest one.

    The closest frame is moved back so that at least ``min_back`` frames remain.
    """
    d = against_last(df, col).filter(F.col("frame") < F.col("last_frame"))
    diff = F.aggregate(F.zip_with(col, "last", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    if exact:
        same = F.forall(F.zip_with(col, "last", lambda a, b: a == b), lambda v: v)
        return d.filter(same).groupBy("run").agg(F.max("frame").alias("start"))
    best = d.withColumn("_d", diff).groupBy("run").agg(F.min(F.struct("_d", "frame")).alias("b"), F.max("last_frame").alias("_last"))
    return best.select("run", F.least(F.col("b.frame"), F.col("_last") + 1 - min_back).alias("start"), F.col("b._d").alias("difference"))


def correlation_with_last(df: DataFrame, col: str, eps: float = 1e-10) -> DataFrame:
    """Dot product of each z-scored frame with the z-scored final frame (not averaged)."""
    d = against_last(df, col)

    def zscore(a):
        return let(
            F.struct(arrays.mean(a).alias("m"), a.alias("a")),
            lambda s: let(
                F.sqrt(F.aggregate(s["a"], F.lit(0.0), lambda t, v: t + (v - s["m"]) * (v - s["m"])) / F.size(s["a"])),
                lambda sd: F.transform(s["a"], lambda v: (v - s["m"]) / (sd + eps)),
            ),
        )

    dot = F.aggregate(F.zip_with(zscore(F.col(col)), zscore(F.col("last")), lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)
    return d.select("run", "frame", dot.alias("correlation"))


def locate(full: DataFrame, piece: DataFrame, key: str, col: str, tolerance: float = 1e-6) -> DataFrame:
    """First frame of ``full`` equal to the piece's first frame, and the matching end."""
    head = piece.groupBy(key, "run").agg(F.min_by(col, "frame").alias("_head"), F.count(F.lit(1)).alias("_len"))
    j = full.select("run", "frame", F.col(col).alias("_v")).join(head, "run")
    gap = F.aggregate(F.zip_with("_v", "_head", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v)
    hit = j.filter(gap < tolerance).groupBy(key, "run").agg(F.min("frame").alias("start"), F.max("_len").alias("_len"))
    return hit.withColumn("stop", F.col("start") + F.col("_len") - 1).drop("_len")


"""Recursive filters over long channels, split into chunks without approximation.

A recursive filter is linear in its state: a chunk's final state is the state it
would reach from zero plus ``A^length`` times the state it starts from. So each
chunk is run once from zero in parallel, the starting states are carried over one
small row per chunk, and each chunk is run again from its true state.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeframe.functions.filters import advance, both_ways, butterworth, run_rows, state_space, steady_state
from wakeframe.session import written

CHUNK = 65536


def design(df: DataFrame, rate: str, order: int, fraction: float, kind: str) -> DataFrame:
    """``taps``: Butterworth coefficients per row, the cutoff a fraction of the row's sampling rate."""

    @F.pandas_udf("array<struct<tap:int,b:double,a:double>>")
    def taps(rates: pd.Series) -> pd.Series:
        out = []
        for fs in rates:
            b, a = butterworth(order, fraction * fs, kind, fs)
            out.append([{"tap": i, "b": p, "a": q} for i, (p, q) in enumerate(zip(b, a))])
        return pd.Series(out, dtype=object)

    return df.withColumn("taps", taps(rate))


def _states(df: DataFrame, keys: list[str], b, a, backward: bool, from_steady: bool) -> DataFrame:
    """(keys, chunk, s0): the true state at which each chunk starts.

    Only (chunk, length, zero-start final state, edge sample) reach the per-key
    carry, 65536 times fewer rows than samples.
    """
    order = len(state_space(b, a)[1])
    turn = -1 if backward else 1

    @F.pandas_udf("array<double>")
    def from_zero(col: pd.Series) -> pd.Series:
        rows = [np.asarray(r, float)[::turn] for r in col]
        return pd.Series(list(run_rows(rows, np.zeros((len(rows), order)), b, a)[1])) if rows else pd.Series([], dtype=object)

    edge = F.element_at("x", -1) if backward else F.get("x", F.lit(0))
    summary = df.select(*keys, "chunk", F.size("x").alias("len"), edge.alias("edge"), from_zero("x").alias("zs"))
    zi = steady_state(b, a)
    schema = ", ".join(f"{k} {dict(df.dtypes)[k]}" for k in keys) + ", chunk bigint, s0 array<double>"

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk", ascending=not backward)
        s = zi * pdf["edge"].iloc[0] if from_steady else np.zeros(order)
        jump = {int(n): advance(b, a, int(n)) for n in pdf["len"].unique()}
        starts = []
        for n, zs in zip(pdf["len"], pdf["zs"]):
            starts.append(s)
            s = jump[int(n)] @ s + np.asarray(zs, float)
        return pdf[[*keys, "chunk"]].assign(s0=starts)

    return summary.groupBy(*keys).applyInPandas(carry, schema)


def _pass(df: DataFrame, keys: list[str], b, a, backward: bool, from_steady: bool) -> DataFrame:
    turn = -1 if backward else 1

    @F.pandas_udf("array<double>")
    def run(col: pd.Series, state: pd.Series) -> pd.Series:
        if not len(col):
            return pd.Series([], dtype=object)
        rows = [np.asarray(r, float)[::turn] for r in col]
        out, _ = run_rows(rows, np.stack(state.to_numpy()).astype(float), b, a)
        return pd.Series([np.ascontiguousarray(r[::turn]) for r in out])

    starts = written(_states(df, keys, b, a, backward, from_steady), "states")
    return df.join(starts, [*keys, "chunk"]).select(*keys, "chunk", run("x", "s0").alias("x"))


def _chunks(df: DataFrame, keys: list[str], n: str, value: str, size: int) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct(F.col(n).alias("n"), F.col(value).alias("v"))))
    return (
        df.withColumn("chunk", F.floor(F.col(n) / size).cast("bigint"))
        .groupBy(*keys, "chunk")
        .agg(F.transform(rows, lambda r: r["v"]).alias("x"))
    )


def _rows(df: DataFrame, keys: list[str], n: str, value: str, size: int, pad: int) -> DataFrame:
    long = df.select(*keys, "chunk", F.posexplode("x").alias("_i", value))
    return long.select(*keys, (F.col("chunk") * size + F.col("_i") - pad).alias(n), value)


def causal(df: DataFrame, keys: Sequence[str], b, a, n: str = "n", value: str = "p", size: int = CHUNK) -> DataFrame:
    """One forward pass from zero state over a dense sample number ``n``."""
    keys = list(keys)
    return _rows(_pass(_chunks(df, keys, n, value, size), keys, b, a, False, False), keys, n, value, size, 0)


def _edges(chunks: DataFrame, keys: list[str], size: int, pad: int) -> DataFrame:
    """(keys, _last, _before, _after): each channel's last chunk and the odd extension at both of its ends.

    Only the chunks that hold the outer ``pad`` + 1 samples are opened.
    """
    ends = chunks.groupBy(*keys).agg(F.max(F.struct("chunk", F.size("x").alias("len"))).alias("_e"))
    ends = ends.select(*keys, F.col("_e.chunk").alias("_last"), (F.col("_e.chunk") * size + F.col("_e.len")).alias("_size"))
    outer = chunks.join(ends, keys).filter((F.col("chunk") * size <= pad) | ((F.col("chunk") + 1) * size >= F.col("_size") - pad))
    rows = outer.select(*keys, "_last", "_size", "chunk", F.posexplode("x").alias("_i", "v")).withColumn("n", F.col("chunk") * size + F.col("_i"))
    part = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("n", "v")))), lambda r: r["v"])
    g = rows.groupBy(*keys, "_last", "_size").agg(part(F.col("n") <= pad).alias("_h"), part(F.col("n") >= F.col("_size") - 1 - pad).alias("_t"))
    error = F.raise_error(F.lit("channel shorter than the filter's edge extension")).cast("array<double>")
    mirrored = lambda inner, edge: F.transform(F.reverse(inner), lambda v: 2 * edge - v)
    before = F.when(F.col("_size") > pad, mirrored(F.slice("_h", 2, pad), F.get("_h", F.lit(0)))).otherwise(error)
    return g.select(*keys, "_last", before.alias("_before"), mirrored(F.slice("_t", 1, pad), F.element_at("_t", -1)).alias("_after"))


def zero_phase(df: DataFrame, keys: Sequence[str], b, a, n: str = "n", value: str = "p", size: int = CHUNK) -> DataFrame:
    """Forward-backward filter with odd extension at both ends and steady initial states.

    Samples are packed into chunks once; the chunks are written, extended at the channel's ends, run
    both ways and unpacked, without moving samples again. Raises when a channel is shorter than the padding.
    """
    keys = list(keys)
    pad = 3 * max(len(a), len(b))
    chunks = written(_chunks(df, keys, n, value, size), "chunks")
    edges = written(_edges(chunks, keys, size, pad), "edges")
    first, last = F.col("chunk") == 0, F.col("chunk") == F.col("_last")
    none = F.array().cast("array<double>")
    longer = F.concat(F.when(first, F.col("_before")).otherwise(none), F.col("x"), F.when(last, F.col("_after")).otherwise(none))
    forward = written(_pass(chunks.join(edges, keys).select(*keys, "chunk", longer.alias("x")), keys, b, a, False, True), "forward")
    back = _pass(forward, keys, b, a, True, True).join(edges.select(*keys, "_last"), keys)
    skip, cut = F.when(first, pad).otherwise(0), F.when(last, pad).otherwise(0)
    own = F.slice("x", skip + 1, F.size("x") - skip - cut)
    return _rows(back.select(*keys, "chunk", own.alias("x")), keys, n, value, size, 0)


def high_pass_by_speed(df: DataFrame, keys: Sequence[str], re: float, fs: float, **kw) -> DataFrame:
    """Zero-phase high-pass of order 4 whose cutoff follows the Reynolds number."""
    b, a = butterworth(4, 0.004 * re / 1000, "high", fs)
    return zero_phase(df, keys, b, a, **kw)


def filter_prefixed(df: DataFrame, prefix: str, index: str, b, a, size: int = CHUNK) -> DataFrame:
    """Filter every column whose name starts with ``prefix``; the others stay, coefficients are added."""
    wanted = [c for c in df.columns if c.startswith(prefix)]
    rest = [c for c in df.columns if c not in wanted]
    long = df.select(index, F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("p")) for c in wanted])).alias("_s"))
    long = long.select(F.col(index).alias("n"), "_s.channel", "_s.p")
    out = zero_phase(long, ["channel"], b, a, size=size)
    wide = out.groupBy("n").pivot("channel", wanted).agg(F.first("p"))
    coef = {f"b{i}": F.lit(float(v)) for i, v in enumerate(b)} | {f"a{i}": F.lit(float(v)) for i, v in enumerate(a)}
    return df.select(*rest).join(wide.withColumnRenamed("n", index), index).withColumns(coef)


# --- spectra of bounded series ----------------------------------------------------------


def amplitude_spectrum(col: Column, fs: float) -> Column:
    """Array of (freq, amp): 2/N |FFT| of the mean-removed series, positive half; NULL for NULL."""

    @F.pandas_udf("array<struct<freq:double,amp:double>>")
    def run(rows: pd.Series) -> pd.Series:
        out = []
        for r in rows:
            if r is None:
                out.append(None)
                continue
            x = np.asarray(r, float)
            n, half = len(x), len(x) // 2
            amp = 2.0 / n * np.abs(np.fft.fft(x - x.mean())[:half]) if n else np.empty(0)
            out.append([{"freq": f, "amp": v} for f, v in zip(np.arange(half) * fs / max(n, 1), amp)])
        return pd.Series(out, dtype=object)

    return run(col)


def dominant(spectrum: Column) -> Column:
    """Frequency of the largest amplitude (lowest on a tie) and the highest one above a tenth of it."""
    peak = F.array_max(F.transform(spectrum, lambda s: F.struct(s["amp"].alias("amp"), (-s["freq"]).alias("nf"))))
    top = F.array_max(F.transform(spectrum, lambda s: s["amp"]))
    high = F.array_max(F.transform(F.filter(spectrum, lambda s: s["amp"] > top / 10), lambda s: s["freq"]))
    return F.struct((-peak["nf"]).alias("freq"), peak["amp"].alias("amp"), high.alias("cutoff"))


def detrend_adaptive(col: Column, cutoff: Column, fs: float) -> Column:
    """Subtract the series' own low-passed form, the cutoff given per row."""

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series, cut: pd.Series) -> pd.Series:
        out: list = [None] * len(rows)
        for i, (r, fc) in enumerate(zip(rows, cut)):
            x = np.asarray(r, float)
            if fc is None or not 0 < fc < fs / 2 or len(x) <= 9:
                continue
            b, a = butterworth(2, fc, "low", fs)
            out[i] = x - both_ways(x[None], b, a)[0]
        return pd.Series(out, dtype=object)

    return run(col, cutoff)

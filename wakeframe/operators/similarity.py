"""Similarity of series pairs, correlation matrices and sweep metrics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from wakeframe.functions import alignment

def dtw_distance(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(alignment.dtw(x.tolist(), y.tolist()))

    return F.nanvl(run(a, b), F.lit(None).cast("double"))


def frechet_distance(a: Column, b: Column, reach: float = 1.0) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(alignment.frechet(x.tolist(), y.tolist(), reach))

    return F.nanvl(run(a, b), F.lit(None).cast("double"))


def cross_correlation(a: Column, b: Column) -> Column:
    """Struct (best, lag) of the normalised cross-correlation over all lags."""

    @F.pandas_udf("best double, lag double")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        best, lag = alignment.correlate(x.tolist(), y.tolist())
        return pd.DataFrame({"best": best, "lag": lag})

    null = F.lit(None).cast("double")
    r = run(a, b)
    return F.struct(F.nanvl(r["best"], null).alias("best"), F.nanvl(r["lag"], null).alias("lag"))


def pair_matrix(df: DataFrame, keys: Sequence[str], item: str, col: str, metric=alignment.best_correlations, block: int = 256) -> DataFrame:
    """Upper triangle (a <= b) of a pair metric between all series of a key.

    The matrix is the result, so every pair is computed once; the work is tiled:
    ``item`` numbers fall into blocks, each block travels to the tiles it takes part
    in, and a task holds two blocks at most, however many series a key has.
    """
    keys = list(keys)
    types = dict(df.dtypes)
    tagged = df.select(*keys, F.col(item).alias("item"), F.col(col).alias("x"), F.floor(F.col(item) / block).cast("int").alias("_b"))
    blocks = tagged.select(*keys, "_b").distinct()
    # One partner row per tile of the matrix: an equi-join on the keys over block numbers only.
    tiles = blocks.join(blocks.withColumnRenamed("_b", "_c"), keys).filter("_b <= _c")
    ends = tiles.select(*keys, "_b", "_c", F.explode(F.array_distinct(F.array("_b", "_c"))).alias("_home"))
    placed = tagged.withColumnRenamed("_b", "_home").join(ends, [*keys, "_home"])

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        b, c = pdf["_b"].iloc[0], pdf["_c"].iloc[0]
        left = pdf[pdf["_home"] == b].sort_values("item")
        right = pdf[pdf["_home"] == c].sort_values("item")
        m = metric(np.stack(left["x"].to_numpy()).astype(float), np.stack(right["x"].to_numpy()).astype(float))
        i, j = np.nonzero(left["item"].to_numpy()[:, None] <= right["item"].to_numpy()[None, :])
        out = pd.DataFrame({"a": left["item"].to_numpy()[i], "b": right["item"].to_numpy()[j], "value": m[i, j]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "a", "b", "value"]]

    schema = ", ".join([f"{k} {types[k]}" for k in keys] + [f"a {types[item]}", f"b {types[item]}", "value double"])
    return placed.groupBy(*keys, "_b", "_c").applyInPandas(tile, schema)


def symmetrise(df: DataFrame) -> DataFrame:
    """Both triangles of a matrix given as (.., a, b, value) with a <= b."""
    mirror = df.filter("a < b").withColumnsRenamed({"a": "_t"}).withColumnsRenamed({"b": "a"}).withColumnsRenamed({"_t": "b"})
    return df.unionByName(mirror)


def matrix_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population deviation of a matrix (the root of a mean signed residual is always 0)."""
    return df.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("spread"), F.count("value").alias("entries"))


def remaining_work(items: DataFrame, done: DataFrame, sensors: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Every (item, sensor, model) not yet done."""
    combos = items.withColumn("sensor", F.explode(F.array(*map(F.lit, sensors)))).withColumn("model", F.explode(F.array(*map(F.lit, models))))
    return combos.join(done, [*items.columns, "sensor", "model"], "left_anti")


def pick_one(df: DataFrame, seed: int) -> DataFrame:
    """One pseudo-random row, the same for the same seed and rows."""
    return df.orderBy(F.xxhash64(*[F.col(c) for c in df.columns], F.lit(seed)), *df.columns).limit(1)


def windows_from_channels(windows: DataFrame, channels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples of a channel between ``first_sample`` and ``last_sample`` of each window, as an array.

    A window is bounded (a second or two), so its sample numbers are written out and
    meet the channel by an equi-join on (channel, n).
    """
    want = windows.withColumn("n", F.explode(F.sequence("first_sample", "last_sample")))
    hits = want.join(channels, ["channel", "n"])
    return hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "p"))).alias("_s")).select(
        *keys, F.transform("_s", lambda s: s["p"]).alias("x")
    )


# --- sweep metrics --------------------------------------------------------------------------


def peak_to_peak(df: DataFrame, run: Sequence[str], sensor: str, value: str) -> DataFrame:
    """Mean over the sensors of log10(amplitude^-4), and the mean amplitude."""
    per = df.groupBy(*run, sensor).agg((F.max(value) - F.min(value)).alias("amp"))
    log = F.log10(F.pow(F.nullif(F.abs("amp"), F.lit(0.0)), F.lit(-4.0)))
    return per.groupBy(*run).agg(F.avg("amp").alias("amplitude"), F.avg(log).alias("f_h"))


def time_of_minimum(df: DataFrame, run: Sequence[str], sensor: str, t: str, value: str, floor: float | None = None) -> DataFrame:
    """Mean over the sensors of log10(time of the first minimum), floored when asked."""
    per = df.groupBy(*run, sensor).agg(F.min(F.struct(value, t)).alias("_m"))
    out = per.groupBy(*run).agg(F.avg(F.log10(F.col("_m")[t])).alias("f_re"))
    return out if floor is None else out.withColumn("f_re", F.greatest("f_re", F.lit(floor)))


def _t_quantile(n: Column, lost: int, confidence: float) -> Column:
    """Two-sided Student quantile for n observations less ``lost`` degrees of freedom, once for each distinct n."""

    @F.pandas_udf("double")
    def run(counts: pd.Series) -> pd.Series:
        known = {k: alignment.t_quantile(1 - (1 - confidence) / 2, k - lost) for k in counts.unique() if k > lost}
        return counts.map(known).astype(float)

    return F.nanvl(run(n), F.lit(None).cast("double"))


def log_regression(df: DataFrame, position: str, x: str, y: str, confidence: float = 0.99) -> DataFrame:
    """Least-squares line per position with the slope's confidence interval."""
    g = df.groupBy(position).agg(
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
        F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"), F.regr_count(y, x).alias("n"),
    )
    rest = F.greatest(F.col("_syy") - F.col("_sxy") * F.col("_sxy") / F.col("_sxx"), F.lit(0.0))
    g = g.withColumn("std_err", F.sqrt(rest / (F.col("n") - 2) / F.col("_sxx")))
    half = _t_quantile(F.col("n"), 2, confidence) * F.col("std_err")
    return g.withColumns({"low": F.col("slope") - half, "high": F.col("slope") + half}).drop("_sxx", "_syy", "_sxy")


def mean_slope(df: DataFrame, confidence: float = 0.99) -> DataFrame:
    """Mean of the positions' slopes with its confidence interval."""
    g = df.agg(F.avg("slope").alias("mean_slope"), F.avg("intercept").alias("mean_intercept"), (F.stddev_pop("slope") / F.sqrt(F.count("slope"))).alias("_se"), F.count("slope").alias("n"))
    half = _t_quantile(F.col("n"), 1, confidence) * F.col("_se")
    return g.withColumns({"low": F.col("mean_slope") - half, "high": F.col("mean_slope") + half}).drop("_se")


def sweep_margins(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Value per (a, b) with the means over a for each b, over b for each a, and over all.

    The margins average the cells, so a cell with many rows weighs no more than another.
    """
    cells = df.groupBy(a, b).agg(F.avg(value).alias("_v"))
    return cells.cube(a, b).agg(F.avg("_v").alias("mean"), F.count("_v").alias("cells"))


def distance_table(df: DataFrame, value: str, width: int, nu: float = 1e-6) -> DataFrame:
    """Distances, pressure and time of a probe while a body passes; needs (re, h, seconds)."""
    speed = F.col("re") * nu / 0.05
    y = (F.col("h") - width / 8 / 2) / width
    x = -(0.5 - F.col("seconds") * speed)
    return df.withColumns(
        {"pressure": F.col(value) * 1000 * speed * speed, "vertical": y, "horizontal": x, "euclidean": F.sqrt(x * x + y * y)}
    )


# --- distributions --------------------------------------------------------------------------


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Density histogram between the extremes; the last bin includes the maximum."""
    ext = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    g = df.join(F.broadcast(ext)).groupBy(b.alias("bin"), "_lo", "_hi", "_n").agg(F.count(F.lit(1)).alias("n"))
    return g.select("bin", "n", (F.col("n") / (F.col("_n") * width)).alias("density"))


def density_curve(df: DataFrame, value: str, points: int = 1000, margin: float = 1.0) -> DataFrame:
    """Gaussian kernel density on an even grid past the extremes, Scott bandwidth.

    Each Arrow batch adds its share of the curve before the shuffle, so ``points``
    rows a batch travel whatever the size of the data.
    """
    stats = df.agg(
        F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n"), F.stddev_samp(value).alias("sd")
    )
    tagged = df.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL").join(F.broadcast(stats))

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            lo, hi, n, sd = pdf[["lo", "hi", "n", "sd"]].iloc[0]
            width = sd * n ** (-1 / 5)
            grid = np.linspace(lo - margin, hi + margin, points)
            total = np.zeros(points)
            for part in np.array_split(pdf["v"].to_numpy(), max(1, len(pdf) // 500)):
                total += np.exp(-0.5 * ((grid[:, None] - part[None, :]) / width) ** 2).sum(axis=1)
            yield pd.DataFrame({"k": np.arange(points), "x": grid, "part": total / (n * width * np.sqrt(2 * np.pi))})

    parts = tagged.mapInPandas(share, "k int, x double, part double")
    return parts.groupBy("k").agg(F.first("x").alias("x"), F.sum("part").alias("density"))


def curve_modes(curve: DataFrame) -> DataFrame:
    """Strict local maxima of a density curve (its grid is of fixed size)."""
    w = W.orderBy("k").partitionBy(F.lit(0))
    d = curve.withColumns({"_p": F.lag("density").over(w), "_n": F.lead("density").over(w)})
    return d.filter((F.col("density") > F.col("_p")) & (F.col("density") > F.col("_n"))).drop("_p", "_n")


# --- ordering and picks ----------------------------------------------------------------------


def natural_key(name: Column) -> Column:
    """First integer of a name, NULL (sorted last) when there is none."""
    return F.regexp_extract(name, "([0-9]+)", 1).try_cast("bigint")


def best_unused(df: DataFrame, used: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """The highest score whose keys are not in ``used``."""
    return df.join(used, list(keys), "left_anti").orderBy(F.col(score).desc(), *keys).limit(1)


def sweep_parameters(path: Column) -> Column:
    """(re, h) of a path that names ``Re<number>`` and ``h<number>``, whole or decimal."""
    number = lambda tag: F.regexp_extract(path, tag + r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.struct(number("Re").alias("re"), number("_h").alias("h"))

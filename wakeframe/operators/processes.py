"""Gaussian processes with fitted length scales, from sums over the experiments.

At the smallest scales allowed, a few inducing points fix every function of the box up to the noise. A function's
values at the experiments are then ``W f``, with ``f`` its values at the inducing points, and ``W`` does not depend
on the scales that are tried: ``W'W`` and ``W'y``, added up in one pass, are all that the likelihood needs. Where every
experiment is an inducing point this is the plain likelihood.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeframe.operators.learn import GP_NOISE, training_basis

# Partial sums that a task adds up at most, in the first of two rounds.
SUM_GROUPS = 64


def _covariance(p: np.ndarray, q: np.ndarray, scales) -> np.ndarray:
    return np.exp(-0.5 * sum(((p[:, [k]] - q[None, :, k]) / s) ** 2 for k, s in enumerate(scales)))


def _factor(s: np.ndarray) -> np.ndarray:
    """Cholesky factor; the diagonal grows by as little as it takes where rounding left a negative eigenvalue."""
    extra = 0.0
    while True:
        try:
            return np.linalg.cholesky(s + extra * np.eye(len(s)))
        except np.linalg.LinAlgError:
            extra = max(1e-14 * float(np.trace(s)), 10 * extra)


def log_likelihood(scales, z: np.ndarray, seen: np.ndarray, noise: np.ndarray) -> float:
    """Of values ``seen`` at ``z`` (a column a target), with the covariance ``noise`` added to a unit kernel's."""
    low = _factor(_covariance(z, z, scales) + noise)
    half = np.linalg.solve(low, seen)
    return float(-0.5 * (half * half).sum() - seen.shape[1] * (np.log(np.diag(low)).sum() + 0.5 * len(z) * math.log(2 * math.pi)))


def _climb(value, start: np.ndarray, low: np.ndarray, high: np.ndarray, width: float = 0.5, tol: float = 1e-7) -> tuple[np.ndarray, float]:
    """A local maximum inside a box by a simplex (two dimensions or more, a smooth function)."""
    n = len(start)
    inside = lambda x: np.clip(x, low, high)
    corners = [inside(start)] + [inside(start + width * np.where(np.arange(n) == k, np.where(start + width > high, -1, 1), 0)) for k in range(n)]
    found = [(value(x), x) for x in corners]
    for _ in range(400):
        found.sort(key=lambda f: -f[0])
        worst, middle = found[-1], np.mean([x for _, x in found[:-1]], axis=0)
        if max(np.abs(x - found[0][1]).max() for _, x in found[1:]) < tol:
            break
        move = lambda by: (lambda x: (value(x), x))(inside(middle + by * (middle - worst[1])))  # noqa: B023
        new = move(1.0)
        if new[0] > found[0][0]:
            found[-1] = max(new, move(2.0), key=lambda f: f[0])
        elif new[0] > found[-2][0]:
            found[-1] = new
        else:
            near = move(0.5) if new[0] > worst[0] else move(-0.5)
            if near[0] > max(new[0], worst[0]):
                found[-1] = near
            else:
                best = found[0]
                found = [best] + [(lambda x: (value(x), x))(0.5 * (best[1] + x)) for _, x in found[1:]]
    best = max(found, key=lambda f: f[0])
    return best[1], best[0]


def _sums(training: DataFrame, targets: Sequence[str], z: np.ndarray, smallest: tuple[float, float]) -> np.ndarray:
    """``[W'W, W'y]``: one partial sum a task, added up row by row in two rounds."""
    low, points = _factor(_covariance(z, z, smallest)), z

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                x = pdf[["a", "b"]].to_numpy(float)
                w = np.linalg.solve(low.T, np.linalg.solve(low, _covariance(points, x, smallest)))
                own = w @ np.hstack([w.T, pdf[list(targets)].to_numpy(float)])
                total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(points)), "v": list(total)})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.iloc[:1].assign(v=[np.sum(np.stack(pdf["v"].to_numpy()), axis=0)])

    rows = training.mapInPandas(partial, "i int, v array<double>").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SUM_GROUPS)))
    some = rows.groupBy("i", "part").applyInPandas(add, "i int, v array<double>, part int")
    whole = some.groupBy("i").applyInPandas(add, "i int, v array<double>, part int").select("i", "v")
    return np.stack([r["v"] for r in sorted(whole.collect(), key=lambda r: r["i"])])


class Process:
    """A fitted process: ``scales``, ``value`` (log likelihood of the values at the inducing points), ``predict``."""

    def __init__(self, scales: tuple[float, float], value: float | None, targets: Sequence[str], z: np.ndarray, seen: np.ndarray, noise: np.ndarray):
        self.scales, self.value, self.targets = scales, value, list(targets)
        self._z, self._low = z, None
        if len(z):
            self._low = _factor(_covariance(z, z, scales) + noise)
            self._half = np.linalg.solve(self._low, seen)

    def predict(self, candidates: DataFrame, std: str = "std", means: bool = True) -> DataFrame:
        """Posterior deviation, and the mean of each target (``mean_<target>``), for every candidate where it is."""
        z, low, scales, names = self._z, self._low, self.scales, [f"mean_{t}" for t in self.targets] if means else []
        seen = self._half if low is not None else None

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if low is None:
                    yield pdf.assign(**{n: 0.0 for n in names}, **{std: 1.0})
                    continue
                half = np.linalg.solve(low, _covariance(z, pdf[["a", "b"]].to_numpy(float), scales))
                mean = half.T @ seen
                yield pdf.assign(**{n: mean[:, k] for k, n in enumerate(names)}, **{std: np.sqrt(np.maximum(1 - (half * half).sum(0), 0.0))})

        schema = ", ".join([f"`{n}` {t}" for n, t in candidates.dtypes] + [f"`{n}` double" for n in [*names, std]])
        return candidates.mapInPandas(score, schema)


def fit_process(
    training: DataFrame, targets: Sequence[str], start: tuple[float, float], bounds: Sequence[tuple[float, float]],
    restarts: int = 9, seed: int = 42, noise: float = GP_NOISE,
) -> Process:
    """Length scales of a unit squared-exponential kernel over (a, b) by maximum marginal likelihood of ``targets``.

    One climb from ``start`` and ``restarts`` more from log-uniform draws between ``bounds``, each a task; the highest
    end wins, the first of equals. Experiments may repeat a point; those with a gap do not count, and without any the
    scales are ``start``, the deviation 1 and the mean 0. The inducing points, which are all that reaches the driver, are
    bounded by the numerical rank of the kernel at the smallest scales over the box: some ten for each square of them.
    """
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c)
    known = training.select(value("a"), value("b"), *[value(t) for t in targets]).dropna()
    smallest = tuple(b[0] for b in bounds)
    z = training_basis(known, smallest) * np.asarray(smallest)
    if not len(z):
        return Process(start, None, targets, z, np.empty((0, len(targets))), np.empty((0, 0)))
    sums = _sums(known, targets, z, smallest)
    gram = sums[:, : len(z)]
    # Values at the inducing points by least squares, and the covariance of their errors.
    spread = np.linalg.inv(0.5 * (gram + gram.T))
    seen, error = spread @ sums[:, len(z) :], noise * 0.5 * (spread + spread.T)

    low, high = np.log(np.asarray(bounds, float)).T
    draws = np.random.default_rng(seed).uniform(low, high, (restarts, len(low)))
    starts = [(k, [float(v) for v in x]) for k, x in enumerate([np.log(start), *draws])]
    spark = training.sparkSession
    given = spark.sparkContext.broadcast((z, seen, error))

    def climb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points, values, err = given.value
        for pdf in batches:
            ends = [_climb(lambda x: log_likelihood(np.exp(x), points, values, err), np.asarray(x), low, high) for x in pdf["x"]]
            yield pd.DataFrame({"k": pdf["k"], "x": [e[0] for e in ends], "value": [e[1] for e in ends]})

    each = spark.createDataFrame(starts, "k int, x array<double>").repartitionByRange(len(starts), "k")
    ends = each.mapInPandas(climb, "k int, x array<double>, value double").collect()
    best = max(ends, key=lambda r: (r["value"], -r["k"]))
    return Process(tuple(float(v) for v in np.exp(best["x"])), best["value"], targets, z, seen, error)


def fitted_disagreement(candidates: DataFrame, one: Process, two: Process) -> DataFrame:
    """|deviation by one process - deviation by the other| per candidate."""
    d = two.predict(one.predict(candidates, "s1", means=False), "s2", means=False)
    return d.withColumn("gap", F.abs(F.col("s1") - F.col("s2")))

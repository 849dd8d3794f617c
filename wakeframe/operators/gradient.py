"""Linear classifiers by mini-batch gradients with early stopping, and a Parzen-estimator search of their settings.

The network is two linear layers without an activation between them, so for the data it is one linear map: a batch
gives the sums of its errors and of errors times features, and the gradients of both layers follow from these.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeframe.operators.learn import Features
from wakeframe.session import scratch, written

# Batch number of the rows that only judge.
HELD = -1
# Rows that the search of settings is run on at most: those whose id hashes lowest.
SEARCH_ROWS = 10_000


class Setting(NamedTuple):
    """How a classifier is fitted: ``loss`` is mse or bce."""

    loss: str
    lr: float = 1e-2
    decay: float = 1e-4
    hidden: int = 16
    epochs: int = 100
    patience: int = 10
    min_delta: float = 0.0
    batches: int = 4
    seed: int = 42


class Outcome(NamedTuple):
    weights: np.ndarray
    bias: float
    best_epoch: int
    stop_epoch: int
    best_loss: float


def batch_sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray, bias: float, loss: str) -> np.ndarray:
    """[rows, loss, errors, errors times features], summed over the rows."""
    z = x @ weights + bias
    if loss == "mse":
        value, error = (z - y) ** 2, 2 * (z - y)
    else:
        value, error = np.logaddexp(0.0, z) - y * z, 0.5 * (1 + np.tanh(0.5 * z)) - y
    return np.concatenate([[len(y), value.sum(), error.sum()], error @ x])


def learner(size: int, s: Setting) -> Generator[tuple[int, np.ndarray, float, str], np.ndarray, Outcome]:
    """One fit as a conversation: asks for the sums of a batch at some weights, is sent them, steps (Adam), asks on.

    After each epoch it asks for the held rows. It stops after ``patience`` epochs without a loss below the best one less
    ``min_delta``, and ends with the weights of the best epoch.
    """
    rng = np.random.default_rng(s.seed)
    wide, deep = 1 / math.sqrt(max(1, size)), 1 / math.sqrt(s.hidden)
    p = [rng.uniform(-wide, wide, (s.hidden, size)), rng.uniform(-wide, wide, s.hidden), rng.uniform(-deep, deep, s.hidden), rng.uniform(-deep, deep, 1)]
    first, second, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    joined = lambda: (p[2] @ p[0], float(p[2] @ p[1] + p[3][0]))
    best, at, epoch = Outcome(*joined(), 0, 0, math.inf), 0, 0
    for epoch in range(1, s.epochs + 1):
        for b in rng.permutation(s.batches).tolist():
            n, _, e, *g = yield (b, *joined(), s.loss)
            if not n:
                continue
            e, g, t = e / n, np.asarray(g) / n, t + 1
            slopes = [np.outer(p[2], g), p[2] * e, p[0] @ g + p[1] * e, np.array([e])]
            for k, slope in enumerate(slopes):
                slope = slope + s.decay * p[k]
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope * slope
                p[k] = p[k] - s.lr * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
        n, value, *_ = yield (HELD, *joined(), s.loss)
        value = value / n if n else math.inf
        if value < best.best_loss - s.min_delta:
            best, at = Outcome(*joined(), epoch, epoch, value), epoch
        elif epoch - at >= s.patience:
            break
    return best._replace(stop_epoch=epoch)


def _converse(fits: list[Generator], answer) -> list[Outcome]:
    """Run fits side by side; ``answer`` gets what they all ask for at one time."""
    ends: list[Outcome | None] = [None] * len(fits)
    asked = {k: next(f) for k, f in enumerate(fits)}
    while asked:
        told = dict(zip(asked, answer(list(asked.values()))))
        asked = {}
        for k, sums in told.items():
            try:
                asked[k] = fits[k].send(sums)
            except StopIteration as end:
                ends[k] = end.value
    return ends  # type: ignore[return-value]


class Linear:
    """A fitted map with the features it was fitted on."""

    def __init__(self, features: Features, outcome: Outcome, loss: str):
        self.features, self.outcome, self.loss = features, outcome, loss

    def probability(self) -> Column:
        x = vector_to_array(self.features.vector())
        w = F.array(*[F.lit(float(v)) for v in self.outcome.weights]) if len(self.outcome.weights) else F.array().cast("array<double>")
        z = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(float(self.outcome.bias)), lambda s, v: s + v)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), z)) if self.loss == "mse" else 1 / (1 + F.exp(-z))

    def transform(self, df: DataFrame) -> DataFrame:
        d = df.withColumn("prob", self.probability())
        return d.withColumns({"pred": (F.col("prob") >= 0.5).cast("int"), "best_epoch": F.lit(self.outcome.best_epoch), "stop_epoch": F.lit(self.outcome.stop_epoch)})


def batch_number(item: str, batches: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.col(item), F.lit(seed)), F.lit(batches)).cast("int")


def fit_linear(train: DataFrame, held: DataFrame, item: str, features: Sequence[str] | str, label: str, settings: Sequence[Setting]) -> list[Linear]:
    """One classifier for each setting; all rows of ``train`` are used, those of ``held`` decide when to stop.

    Rows are dealt to the batches of an epoch by a hash of ``item``, so a batch is a fixed share of the rows whatever their
    number, and batches come in another order every epoch. A step is one job over its batch for all settings, each task
    sending one row of sums. Gaps get the training mean. Settings must agree in ``batches`` and ``seed``.
    """
    b, seed = settings[0].batches, settings[0].seed
    if any((s.batches, s.seed) != (b, seed) for s in settings):
        raise ValueError("settings fitted together need the same batches and seed")
    spark, own = train.sparkSession, Features(train, features)
    rows = lambda df, batch: df.select(vector_to_array(own.vector()).alias("x"), F.col(label).cast("double").alias("y"), batch.alias("batch"))
    path, size = scratch(spark, "batches"), len(own.means)
    dealt = rows(train, batch_number(item, b, seed)).unionByName(rows(held, F.lit(HELD)))
    # Files of a good size: a small batch is one task, a large one many.
    dealt.hint("rebalance", "batch").write.partitionBy("batch").parquet(path)
    table = spark.read.schema("x array<double>, y double, batch int").parquet(path)
    parts = {k: table.filter(F.col("batch") == k).select("x", "y") for k in (*range(b), HELD)}

    def answer(asked: list[tuple]) -> list[np.ndarray]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(asked), 3 + size))
            for pdf in batches:
                if len(pdf):
                    x, y = np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy()
                    total += [batch_sums(x, y, w, c, loss) for _, w, c, loss in asked]
            yield pd.DataFrame({"s": [total.ravel()]})

        got = parts[asked[0][0]].mapInPandas(run, "s array<double>").collect()
        return list(np.sum([r["s"] for r in got], axis=0).reshape(len(asked), -1)) if got else list(np.zeros((len(asked), 3 + size)))

    ends = _converse([learner(size, s) for s in settings], answer)
    return [Linear(own, o, s.loss) for o, s in zip(ends, settings)]


def fit_in_memory(x: np.ndarray, y: np.ndarray, batch: np.ndarray, setting: Setting) -> Outcome:
    """The same fit on arrays (``batch`` is HELD for the rows that judge)."""
    own = {k: (x[batch == k], y[batch == k]) for k in (*range(setting.batches), HELD)}
    return _converse([learner(x.shape[1], setting)], lambda asked: [batch_sums(*own[k], w, c, loss) for k, w, c, loss in asked])[0]


# --- search ----------------------------------------------------------------------------------------


class Parzen:
    """A density over [low, high]: a normal around each point, as wide as the gaps beside it, and a wide one in the middle."""

    def __init__(self, points: np.ndarray, low: float, high: float):
        self.low, self.high = low, high
        self.mu = np.sort(np.append(points, 0.5 * (low + high)))
        gaps = np.diff(np.concatenate([[low], self.mu, [high]]))
        least = (high - low) / min(100.0, 1.0 + len(self.mu))
        self.sigma = np.clip(np.maximum(gaps[:-1], gaps[1:]), least, high - low)
        self.sigma[np.searchsorted(self.mu, 0.5 * (low + high))] = high - low

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        out = np.empty(0)
        while len(out) < n:
            k = rng.integers(0, len(self.mu), n)
            x = rng.normal(self.mu[k], self.sigma[k])
            out = np.append(out, x[(x >= self.low) & (x <= self.high)])
        return out[:n]

    def log_density(self, x: np.ndarray) -> np.ndarray:
        below = np.vectorize(lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2))))
        inside = below((self.high - self.mu) / self.sigma) - below((self.low - self.mu) / self.sigma)
        each = np.exp(-0.5 * ((x[:, None] - self.mu) / self.sigma) ** 2) / (self.sigma * inside)
        return np.log(each.mean(axis=1) + 1e-300)


def propose(tried: np.ndarray, losses: np.ndarray, bounds: Sequence[tuple[float, float]], rng: np.random.Generator, candidates: int = 24) -> np.ndarray:
    """The next setting: for each parameter, of draws near the best tenth the one likeliest there against the rest."""
    order = np.argsort(losses, kind="stable")
    top = max(1, math.ceil(0.1 * len(losses)))
    out = []
    for k, (low, high) in enumerate(bounds):
        good, rest = Parzen(tried[order[:top], k], low, high), Parzen(tried[order[top:], k], low, high)
        x = good.draw(rng, candidates)
        out.append(x[np.argmax(good.log_density(x) - rest.log_density(x))])
    return np.array(out)


def search_linear(
    df: DataFrame, item: str, features: Sequence[str] | str, label: str, held: Column, base: Setting,
    lr: tuple[float, float], decay: tuple[float, float], trials: int = 30, first: int = 10, rows: int = SEARCH_ROWS,
) -> list[tuple[int, float, float, float, int]]:
    """(trial, lr, decay, best loss, best epoch) of a tree-structured Parzen search, both parameters on a log scale.

    The ``first`` trials are drawn evenly and run at once, a task each; every later one follows from all before it. A trial
    is a whole fit, on at most ``rows`` rows (a documented sample: the ids that hash lowest), which bounds its task.
    """
    some = df.withColumn("_held", held).orderBy(F.xxhash64(F.col(item), F.lit(base.seed)), item).limit(rows)
    some = written(some.select(item, "_held", label, *([features] if isinstance(features, str) else features)), "sample")
    own = Features(some.filter(~F.col("_held")), features)
    batch = F.when(F.col("_held"), HELD).otherwise(batch_number(item, base.batches, base.seed))
    row = F.struct(F.col(item).alias("i"), vector_to_array(own.vector()).alias("x"), F.col(label).cast("double").alias("y"), batch.alias("b"))
    packed = written(some.agg(F.array_sort(F.collect_list(row)).alias("rows")).select("rows.x", "rows.y", "rows.b"), "packed")
    spark, size = df.sparkSession, len(own.means)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf.itertuples():
                x = np.stack(t.x) if len(t.x) else np.empty((0, size))
                out.append(fit_in_memory(x, np.asarray(t.y), np.asarray(t.b), base._replace(lr=t.lr, decay=t.decay)))
            yield pd.DataFrame({"trial": pdf["trial"], "loss": [o.best_loss for o in out], "epoch": [o.best_epoch for o in out]})

    bounds = np.log([lr, decay])
    rng = np.random.default_rng(base.seed)
    tried, found = rng.uniform(bounds[:, 0], bounds[:, 1], (min(first, trials), 2)), []
    while True:
        new = [(k, *map(float, np.exp(tried[k]))) for k in range(len(found), len(tried))]
        asked = spark.createDataFrame(new, "trial int, lr double, decay double").repartitionByRange(len(new), "trial")
        got = asked.join(F.broadcast(packed)).mapInPandas(run, "trial int, loss double, epoch int").collect()
        found += [(r["trial"], *new[i][1:], r["loss"], r["epoch"]) for i, r in enumerate(sorted(got, key=lambda r: r["trial"]))]
        if len(found) >= trials:
            return found
        tried = np.vstack([tried, propose(tried, np.array([f[3] for f in found]), bounds.tolist(), rng)])

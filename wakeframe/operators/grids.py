"""Whole parameter grids of tree ensembles by cross-validation, on one shared binned table.

Settings that differ only in the number of trees, or in the depth of a forest's trees, are read off one ensemble: its
first trees, or its trees cut at a depth. What is left are chains (one setting of the other parameters, one fold)
that do not need each other, so each is a task. Trees grow level by level from histograms of all nodes of a
level at once. A chain needs the whole training table: that is a bounded sample (``rows``) of the labelled rows,
binned to a byte a value and packed once for all tasks.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeframe.operators.learn import Features
from wakeframe.session import written

# Labelled rows that a grid is judged on, at most: those whose id hashes lowest.
GRID_ROWS = 10_000
BINS = 32

# The grids (fixed values): 108 settings of boosting, 36 of a forest.
BOOST = {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 0.2], "max_depth": [3, 5, 7], "min_samples_split": [2, 5], "subsample": [1.0, 0.8]}
FOREST = {"n_estimators": [50, 100, 200], "max_depth": [None, 5, 10], "min_samples_split": [2, 5], "max_features": ["sqrt", "log2"]}


def binned(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Values as the number of quantiles that lie below them."""
    cuts = np.quantile(x, np.arange(1, bins) / bins, axis=0)
    return np.column_stack([np.searchsorted(np.unique(c), col, "left") for c, col in zip(cuts.T, x.T)]).astype(np.uint8)


def grow(b: np.ndarray, target: np.ndarray, weight: np.ndarray, depth: int | None, min_split: int, others: np.ndarray, pick=None) -> Iterator[tuple]:
    """Nodes of a tree level by level: (node of each training row, node of each other row, nodes), before the first cut as well.

    Cuts take the largest drop of the squared error of ``target`` (for labels that is the Gini index too). ``weight`` counts a row that
    often; ``pick(nodes)`` names the features that each node may use. A node that is not cut keeps its rows in
    all further levels. Nodes are numbered anew at each level.
    """
    n, width = b.shape
    node, far = np.zeros(n, np.int64), np.zeros(len(others), np.int64)
    nodes, level = 1, 0
    yield node, far, nodes
    open_ = np.ones(1, bool)
    while open_.any() and (depth is None or level < depth):
        live = np.flatnonzero(open_)
        slot = np.full(nodes, -1)
        slot[live] = np.arange(len(live))
        rows = np.flatnonzero((slot[node] >= 0) & (weight > 0))
        own = slot[node[rows]]
        features = pick(len(live)) if pick else np.broadcast_to(np.arange(width), (len(live), width))
        k = features.shape[1]
        code = ((own[:, None] * k + np.arange(k)) * BINS + b[rows[:, None], features[own]]).ravel()
        shape = (len(live), k, BINS)
        count = np.bincount(code, np.repeat(weight[rows], k), minlength=np.prod(shape)).reshape(shape)
        total = np.bincount(code, np.repeat(weight[rows] * target[rows], k), minlength=np.prod(shape)).reshape(shape)
        count, total = count.cumsum(axis=2), total.cumsum(axis=2)
        all_n, all_t = count[:, :1, -1:], total[:, :1, -1:]
        right_n, right_t = all_n - count, all_t - total
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = total**2 / count + right_t**2 / right_n - all_t**2 / all_n
        gain[(count < 0.5) | (right_n < 0.5)] = -np.inf
        flat = gain.reshape(len(live), -1)
        best = flat.argmax(axis=1)
        good = (flat[np.arange(len(live)), best] > 1e-12) & (all_n.ravel() >= min_split)
        feature, cut = features[np.arange(len(live)), best // BINS], best % BINS
        # A cut node gives two; the others stay as they are.
        parts = np.ones(nodes, np.int64)
        parts[live[good]] = 2
        first = np.cumsum(parts) - parts

        def move(at: np.ndarray, values: np.ndarray) -> np.ndarray:
            s = slot[at]
            split = np.flatnonzero((s >= 0) & good[s])
            out = first[at]
            out[split] += values[split, feature[s[split]]] > cut[s[split]]  # noqa: B023
            return out

        node, far = move(node, b), move(far, others)
        open_ = np.zeros(int(parts.sum()), bool)
        halves = first[live[good]]
        open_[halves] = open_[halves + 1] = True
        nodes, level = len(open_), level + 1
        yield node, far, nodes


def boosted(b: np.ndarray, y: np.ndarray, others: np.ndarray, trees: Sequence[int], rate: float, depth: int, min_split: int, subsample: float, rng) -> dict[int, np.ndarray]:
    """{number of trees: chance of label 1 of each other row}: logistic boosting, a Newton step per leaf."""
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    near, far, out = np.full(len(y), np.log(share / (1 - share))), np.full(len(others), np.log(share / (1 - share))), {}
    for t in range(1, max(trees) + 1):
        p = 1 / (1 + np.exp(-near))
        rest = y - p
        weight = np.ones(len(y)) if subsample >= 1 else np.isin(np.arange(len(y)), rng.permutation(len(y))[: max(1, int(subsample * len(y)))]).astype(float)
        for node, other, nodes in grow(b, rest, weight, depth, min_split, others):
            pass
        top = np.bincount(node, weight * rest, minlength=nodes)
        low = np.bincount(node, weight * p * (1 - p), minlength=nodes)
        value = rate * np.where(low > 1e-150, top / np.maximum(low, 1e-150), 0.0)
        near, far = near + value[node], far + value[other]
        if t in trees:
            out[t] = 1 / (1 + np.exp(-far))
    return out


def forest(b: np.ndarray, y: np.ndarray, others: np.ndarray, trees: Sequence[int], depths: Sequence[int | None], min_split: int, k: int, rng) -> dict[tuple, np.ndarray]:
    """{(number of trees, depth): mean share of label 1}: full trees on rows drawn with replacement, cut at each depth."""
    total, out = {d: np.zeros(len(others)) for d in depths}, {}
    width = b.shape[1]
    for t in range(1, max(trees) + 1):
        weight = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
        pick = lambda m: rng.random((m, width)).argpartition(min(k, width) - 1, axis=1)[:, : min(k, width)]
        for level, (node, other, nodes) in enumerate(grow(b, y, weight, None, min_split, others, pick)):
            if level in depths:
                total[level] += _share(node, y, weight, nodes)[other]
        last = _share(node, y, weight, nodes)[other]
        for d in depths:
            if d is None or d > level:
                total[d] += last
        if t in trees:
            out |= {(t, d): total[d] / t for d in depths}
    return out


def _share(node: np.ndarray, y: np.ndarray, weight: np.ndarray, nodes: int) -> np.ndarray:
    return np.bincount(node, weight * y, minlength=nodes) / np.maximum(np.bincount(node, weight, minlength=nodes), 1e-300)


def _settings(grid: dict, chain: dict, *shared) -> str:
    return ", ".join(f"{k}={v}" for k, v in sorted((chain | dict(zip(("n_estimators", "max_depth"), shared))).items()))


def chains(boost: dict = BOOST, forest_grid: dict = FOREST, folds: int = 5) -> list[tuple[str, dict, int]]:
    """(kind, parameters that are not shared, fold) of each independent chain."""
    out = []
    for kind, grid, shared in (("boost", boost, {"n_estimators"}), ("forest", forest_grid, {"n_estimators", "max_depth"})):
        names = [n for n in grid if n not in shared]
        out += [(kind, dict(zip(names, v)), f) for v in itertools.product(*[grid[n] for n in names]) for f in range(folds)]
    return out


def run_chain(kind: str, own: dict, fold: int, b: np.ndarray, y: np.ndarray, folds: np.ndarray, boost: dict, forest_grid: dict, seed: int) -> list[tuple[str, int, int]]:
    """(params, right, rows) of every setting that a chain answers, on its held-out fold."""
    held = folds == fold
    if not held.any() or held.all():
        return []
    rng = np.random.default_rng(zlib.crc32(f"{kind} {sorted(own.items())} {fold} {seed}".encode()))
    if kind == "boost":
        chance = boosted(b[~held], y[~held], b[held], boost["n_estimators"], own["learning_rate"], own["max_depth"], own["min_samples_split"], own["subsample"], rng)
        made = {_settings(boost, own, t): p for t, p in chance.items()}
    else:
        k = max(1, int(np.sqrt(b.shape[1]) if own["max_features"] == "sqrt" else np.log2(b.shape[1])))
        chance = forest(b[~held], y[~held], b[held], forest_grid["n_estimators"], forest_grid["max_depth"], own["min_samples_split"], k, rng)
        made = {_settings(forest_grid, own, *key): p for key, p in chance.items()}
    return [(params, int(((p >= 0.5) == (y[held] > 0.5)).sum()), int(held.sum())) for params, p in made.items()]


def search(train: DataFrame, id_col: str, features: Sequence[str] | str, label: str, boost: dict = BOOST, forest_grid: dict = FOREST, folds: int = 5, seed: int = 42, rows: int = GRID_ROWS) -> DataFrame:
    """(kind, params, accuracy): mean accuracy over the folds of every setting of both grids, labels 0 and 1.

    Folds go by a hash of the id. Gaps in features get their mean.
    """
    picked = written(train.orderBy(F.xxhash64(F.lit(seed), id_col), id_col).limit(rows), "sample")
    one = F.struct(
        F.col(id_col).alias("id"), F.pmod(F.xxhash64(F.lit(seed + 1), id_col), F.lit(folds)).cast("int").alias("fold"),
        F.col(label).cast("double").alias("y"), vector_to_array(Features(picked, features).vector()).alias("x"),
    )
    # One row of at most ``rows`` vectors, for all tasks.
    packed = written(picked.agg(F.array_sort(F.collect_list(one)).alias("all")).select(F.col("all.fold").alias("fold"), F.col("all.y").alias("y"), F.flatten("all.x").alias("x")), "packed")
    work = chains(boost, forest_grid, folds)
    todo = train.sparkSession.range(len(work)).withColumnRenamed("id", "chain").repartition(len(work), "chain")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                kind, own, fold = work[r.chain]
                y = np.asarray(r.y, float)
                if not len(y):
                    continue
                b = binned(np.asarray(r.x, float).reshape(len(y), -1))
                got = run_chain(kind, own, fold, b, y, np.asarray(r.fold), boost, forest_grid, seed)
                if got:
                    params, right, n = zip(*got)
                    yield pd.DataFrame({"kind": kind, "params": params, "right": right, "n": n})

    scored = todo.join(F.broadcast(packed)).mapInPandas(run, "kind string, params string, right bigint, n bigint")
    return scored.groupBy("kind", "params").agg(F.avg(F.col("right") / F.col("n")).alias("accuracy"))

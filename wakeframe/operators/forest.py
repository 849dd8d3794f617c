"""Random forests grown in pieces: no tree, and no table, is held whole by the driver or a task.

Rows are binned to a byte a value and packed some thousands to a row. A node of more rows than a task may hold is cut from
histograms that all tasks add up; only these first cuts are known to the driver. The rows of every node below then
meet in one task, which grows the rest of that branch. The branches are a table in the shared folder, and rows to be
scored are routed to them in the same way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeframe.session import written

BINS = 32
# Drawn rows of a branch that one task grows, nodes of a level whose histograms are held at once, and open nodes of one pass.
BRANCH_ROWS, LEVEL_NODES, PASS_NODES = 1 << 16, 1024, 4096
# Chances that a row is drawn at most 0, 1, 2, ... times (Poisson, as drawing with replacement has it).
_DRAWN = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit integers whose bits all depend on all bits of ``x`` (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row: a hash of its id, so a task that runs again draws the same."""
    own = _mixed(np.array([tree + (seed << 32)], np.int64).view(np.uint64))
    u = (_mixed(ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + own) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(_DRAWN, u, "right").astype(np.uint8)


def _picked(rng: np.random.Generator, nodes: int, width: int, k: int) -> np.ndarray:
    return rng.random((nodes, width)).argpartition(k - 1, axis=1)[:, :k] if k < width else np.broadcast_to(np.arange(width), (nodes, width))


def _histogram(b: np.ndarray, y: np.ndarray, w: np.ndarray, slot: np.ndarray, features: np.ndarray, classes: int) -> np.ndarray:
    """Drawn rows by (node, feature, bin, class)."""
    nodes, k = features.shape
    code = ((slot[:, None] * k + np.arange(k)) * BINS + np.take_along_axis(b, features[slot], 1)) * classes + y[:, None]
    return np.bincount(code.ravel(), np.repeat(w, k), minlength=nodes * k * BINS * classes).reshape(nodes, k, BINS, classes)


def _cuts(hist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature's place, last bin of the left side, gain) of the best cut of each node by the Gini index."""
    left = hist.cumsum(axis=2)
    right = left[:, :, -1:] - left
    squares = lambda h: (h * h).sum(-1) / np.maximum(h.sum(-1), 1.0)
    gain = squares(left) + squares(right) - squares(left[:, :1, -1:])
    gain[(left.sum(-1) < 0.5) | (right.sum(-1) < 0.5)] = -np.inf
    flat = gain.reshape(len(hist), -1)
    best = flat.argmax(axis=1)
    return best // BINS, best % BINS, flat[np.arange(len(hist)), best]


def branch(b: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, depth: int, k: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """(feature or -1, cut, left child, class counts) of the nodes of a tree grown level by level; the right child follows the left."""
    width, slot, level, total = b.shape[1], np.zeros(len(b), np.int64), 0, 1
    rows, opened = np.arange(len(b)), np.zeros(1, np.int64)
    feature, cut, child, counts = [], [], [], []
    while len(opened):
        m = len(opened)
        seen = np.bincount(slot * classes + y[rows], w[rows], minlength=m * classes).reshape(m, classes)
        f, c, to = np.full(m, -1, np.int32), np.zeros(m, np.uint8), np.zeros(m, np.int32)
        live = np.flatnonzero((seen > 0).sum(1) > 1) if level < depth else np.zeros(0, np.int64)
        features = _picked(rng, len(live), width, k)
        # Rows are in the order of their nodes.
        first, last = np.searchsorted(slot, live, "left"), np.searchsorted(slot, live, "right")
        for low in range(0, len(live), LEVEL_NODES):
            part = slice(low, min(low + LEVEL_NODES, len(live)))
            at = np.concatenate([np.arange(s, e) for s, e in zip(first[part], last[part])])
            own = np.repeat(np.arange(part.stop - low), last[part] - first[part])
            place, bin_, gain = _cuts(_histogram(b[rows[at]], y[rows[at]], w[rows[at]], own, features[part], classes))
            good = gain > 1e-9
            f[live[part][good]] = features[part][np.arange(len(place)), place][good]
            c[live[part][good]] = bin_[good]
        split = f >= 0
        to[split] = total + 2 * np.arange(split.sum())
        feature.append(f), cut.append(c), child.append(to), counts.append(seen)
        keep = split[slot]
        rows, slot = rows[keep], slot[keep]
        slot = 2 * (np.cumsum(split) - 1)[slot] + (b[rows, f[slot]] > c[slot])
        order = np.argsort(slot, kind="stable")
        rows, slot = rows[order], slot[order]
        opened = np.arange(total, total + 2 * split.sum())
        total, level = total + len(opened), level + 1
    return np.concatenate(feature), np.concatenate(cut), np.concatenate(child), np.concatenate(counts).astype(np.float64)


def _leaf(feature: np.ndarray, cut: np.ndarray, child: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of the leaf that each row comes to."""
    node, moving = np.zeros(len(b), np.int64), np.arange(len(b))
    while len(moving := moving[feature[node[moving]] >= 0]):
        at = node[moving]
        node[moving] = child[at] + (b[moving, feature[at]] > cut[at])
    return node


def _top(top: dict[int, tuple[int, int]], b: np.ndarray) -> np.ndarray:
    """Node below the first cuts of a tree: the root is 1, the halves of n are 2n and 2n + 1."""
    node = np.ones(len(b), np.int64)
    for n in sorted(top):
        at = np.flatnonzero(node == n)
        node[at] = 2 * n + (b[at, top[n][0]] > top[n][1])
    return node


def _pieces(node: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(node, kind="stable")
    names, starts = np.unique(node[order], return_index=True)
    yield from zip(names.tolist(), np.split(order, starts[1:]))


class Forest:
    """Trees on rows drawn with replacement, each node cut by the best of ceil(sqrt(features)) features drawn for it.

    Rows are (_id, x ARRAY<DOUBLE>, y class number). Values are told apart by up to 31 quantiles of the training rows.
    """

    def __init__(self, rows: DataFrame, trees: int, depth: int, seed: int, branch_rows: int = BRANCH_ROWS):
        self.trees, self.depth, self.seed, self.branch_rows = trees, depth, seed, branch_rows
        fair = F.coalesce((F.col("y") >= 0) & (F.col("y") == F.floor("y")), F.lit(False))
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width"), F.max("y").alias("y"), F.count_if(~fair).alias("bad")).first()
        if not size["n"] or not size["width"] or size["bad"]:
            raise ValueError(f"a forest needs rows with features and class numbers: {size['n']} rows, {size['width']} features, {size['bad']} without a class")
        self.classes, self.k = int(size["y"]) + 1, math.ceil(math.sqrt(size["width"]))
        self.steps = []
        for low in range(0, size["width"], 64):
            at = [F.percentile_approx(F.get("x", F.lit(i)), [q / BINS for q in range(1, BINS)], 10000) for i in range(low, min(low + 64, size["width"]))]
            self.steps += [np.unique(np.asarray(c, float)) for c in rows.agg(*at).first()]
        packed = written(self._packed(rows), "packed")
        self.top: list[dict[int, tuple[int, int]]] = [{} for _ in range(trees)]
        leaves = self._first_cuts(packed, size["n"])
        self.branches = written(self._branches(packed, leaves), "branches")

    def _packed(self, rows: DataFrame) -> DataFrame:
        """(ids, y, b): the rows of a batch as bytes."""
        steps = self.steps

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    x = np.stack(pdf["x"].to_numpy()).astype(float)
                    b = np.column_stack([np.searchsorted(s, x[:, j], "left") for j, s in enumerate(steps)]).astype(np.uint8)
                    yield pd.DataFrame({"ids": [pdf["_id"].to_numpy(np.int64).tobytes()], "y": [pdf["y"].to_numpy(np.int32).tobytes()], "b": [b.tobytes()]})

        return rows.select(F.col("_id").cast("bigint").alias("_id"), "x", F.col("y").cast("int").alias("y")).mapInPandas(pack, "ids binary, y binary, b binary")

    def _rng(self, tree: int, node: int) -> np.random.Generator:
        return np.random.default_rng([self.seed, tree, node])

    def _state(self):
        """What tasks need of the forest: nothing that holds a session."""
        own = object.__new__(Forest)
        own.__dict__ = {k: v for k, v in self.__dict__.items() if k != "branches"}
        return own

    def _unpack(self, r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(r.ids, np.int64), np.frombuffer(r.y, np.int32), np.frombuffer(r.b, np.uint8).reshape(-1, len(self.steps))

    def _first_cuts(self, packed: DataFrame, n: int) -> list[tuple]:
        """Cuts every node of more drawn rows than ``branch_rows``; returns the large nodes that cannot be cut."""
        leaves, pending = [], [(t, 1) for t in range(self.trees)] if n > self.branch_rows else []
        while pending:
            now, pending = pending[:PASS_NODES], pending[PASS_NODES:]
            own, asked = self._state(), {}
            for t, node in now:
                asked.setdefault(t, []).append(node)

            def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                sums = {}
                for pdf in batches:
                    for r in pdf.itertuples(index=False):
                        ids, y, b = own._unpack(r)
                        for t, nodes in asked.items():
                            w = draws(ids, t, own.seed)
                            at = _top(own.top[t], b)
                            for node in nodes:
                                i = np.flatnonzero((at == node) & (w > 0))
                                features = _picked(own._rng(t, node), 1, b.shape[1], own.k)
                                h = _histogram(b[i], y[i], w[i], np.zeros(len(i), np.int64), features, own.classes).ravel()
                                sums[t, node] = sums[t, node] + h if (t, node) in sums else h
                if sums:
                    yield pd.DataFrame({"tree": [t for t, _ in sums], "node": [m for _, m in sums], "h": list(sums.values())})

            def pick(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
                t, node = key
                hist = np.sum(np.stack(pdf["h"].to_numpy()), axis=0).reshape(1, own.k, BINS, own.classes)
                place, cut, gain = _cuts(hist)
                left = hist[0, place[0], : cut[0] + 1].sum()
                seen = hist[0, 0].sum(axis=0)
                good = bool(gain[0] > 1e-9) and int(node).bit_length() <= own.depth
                feature = int(_picked(own._rng(t, node), 1, len(own.steps), own.k)[0, place[0]]) if good else -1
                return pd.DataFrame({"tree": [t], "node": [node], "feature": [feature], "cut": [int(cut[0])], "n_left": [left], "n_right": [seen.sum() - left], "counts": [seen]})

            hists = packed.mapInPandas(count, "tree int, node bigint, h array<double>")
            found = hists.groupBy("tree", "node").applyInPandas(pick, "tree int, node bigint, feature int, cut int, n_left double, n_right double, counts array<double>")
            for r in found.collect():
                if r["feature"] < 0:
                    leaves.append((r["tree"], r["node"], list(r["counts"])))
                    continue
                self.top[r["tree"]][r["node"]] = (r["feature"], r["cut"])
                pending += [(r["tree"], 2 * r["node"] + side) for side, m in enumerate((r["n_left"], r["n_right"])) if m > self.branch_rows]
        return leaves

    def _tasks(self, df: DataFrame) -> int:
        """Partitions of the nodes below the first cuts: one each, up to a bound."""
        return min(4096, max(df.sparkSession.sparkContext.defaultParallelism, sum(len(t) + 1 for t in self.top)))

    def _branches(self, packed: DataFrame, leaves: list[tuple]) -> DataFrame:
        own, kind = self._state(), "tree int, node bigint, feature binary, cut binary, child binary, counts binary"
        done = {(t, n) for t, n, _ in leaves}

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    ids, y, b = own._unpack(r)
                    for t in range(own.trees):
                        w = draws(ids, t, own.seed)
                        drawn = np.flatnonzero(w)
                        parts = [(n, drawn[i]) for n, i in _pieces(_top(own.top[t], b[drawn])) if (t, n) not in done]
                        if parts:
                            yield pd.DataFrame([(t, n, y[i].tobytes(), w[i].tobytes(), b[i].tobytes()) for n, i in parts], columns=["tree", "node", "y", "w", "b"])

        def rest(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            t, node = key
            y, w = np.frombuffer(b"".join(pdf["y"]), np.int32), np.frombuffer(b"".join(pdf["w"]), np.uint8)
            b = np.frombuffer(b"".join(pdf["b"]), np.uint8).reshape(len(y), -1)
            made = branch(b, y, w, own.classes, own.depth - int(node).bit_length() + 1, own.k, own._rng(t, node))
            return pd.DataFrame([(t, node, *(a.tobytes() for a in made))], columns=["tree", "node", "feature", "cut", "child", "counts"])

        routed = packed.mapInPandas(route, "tree int, node bigint, y binary, w binary, b binary")
        grown = routed.repartition(self._tasks(packed), "tree", "node").groupBy("tree", "node").applyInPandas(rest, kind)
        if not leaves:
            return grown
        end = lambda c: (np.int32([-1]).tobytes(), np.uint8([0]).tobytes(), np.int32([0]).tobytes(), np.array(c, float).tobytes())
        return grown.unionByName(packed.sparkSession.createDataFrame([(t, n, *map(bytearray, end(c))) for t, n, c in leaves], kind))

    def scores(self, rows: DataFrame) -> DataFrame:
        """(_id, p ARRAY<DOUBLE>): sum over the trees of the class shares of the leaf that a row (_id, x) comes to."""
        own = self._state()
        packed = written(self._packed(rows.withColumn("y", F.lit(0))), "scored")
        parts = max(1, math.ceil(rows.count() / self.branch_rows))

        def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    ids, _, b = own._unpack(r)
                    group = _mixed(ids.view(np.uint64)) % np.uint64(parts)
                    for t in range(own.trees):
                        node = _top(own.top[t], b)
                        yield pd.DataFrame(
                            [(t, n, p, ids[i][j].tobytes(), b[i][j].tobytes()) for n, i in _pieces(node) for p, j in _pieces(group[i])],
                            columns=["tree", "node", "part", "ids", "b"],
                        )

        def score(key: tuple, trees: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
            if not len(pdf):
                return pd.DataFrame({"_id": np.zeros(0, np.int64), **{f"p{c}": np.zeros(0) for c in range(own.classes)}})
            tree = trees.iloc[0]
            ids = np.frombuffer(b"".join(pdf["ids"]), np.int64)
            b = np.frombuffer(b"".join(pdf["b"]), np.uint8).reshape(len(ids), -1)
            leaf = _leaf(np.frombuffer(tree["feature"], np.int32), np.frombuffer(tree["cut"], np.uint8), np.frombuffer(tree["child"], np.int32), b)
            counts = np.frombuffer(tree["counts"]).reshape(-1, own.classes)[leaf]
            share = counts / counts.sum(axis=1, keepdims=True)
            return pd.DataFrame({"_id": ids, **{f"p{c}": share[:, c] for c in range(own.classes)}})

        keys, n = ["tree", "node", "part"], self._tasks(packed)
        asking = packed.mapInPandas(route, "tree int, node bigint, part bigint, ids binary, b binary").repartition(n, *keys)
        known = self.branches.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))).repartition(n, *keys)
        names = [f"p{c}" for c in range(self.classes)]
        each = known.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(score, ", ".join(["_id bigint", *[f"{c} double" for c in names]]))
        return each.groupBy("_id").agg(*[F.sum(c).alias(c) for c in names]).select("_id", F.array(*names).alias("p"))


class FittedForest:
    """A forest with the features it was fitted on."""

    def __init__(self, features, forest: Forest):
        self.features, self.forest = features, forest

    def transform(self, df: DataFrame) -> DataFrame:
        rows = written(df.withColumn("features", self.features.vector()).withColumn("_id", F.monotonically_increasing_id()), "rows")
        found = self.forest.scores(rows.select("_id", vector_to_array("features").alias("x")))
        top = F.array_position("p", F.array_max("p")) - 1
        scored = rows.join(found, "_id").withColumn("rawPrediction", array_to_vector("p"))
        chance = array_to_vector(F.transform("p", lambda v: v / float(self.forest.trees)))
        return scored.withColumns({"probability": chance, "prediction": top.cast("double")}).drop("_id", "p")

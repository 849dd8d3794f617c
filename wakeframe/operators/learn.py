"""Splits, balancing, scores, linear and tree models, active sampling."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeframe.operators.forest import FittedForest, Forest
from wakeframe.operators.ordering import index_rows
from wakeframe.session import written

# --- order and splits ----------------------------------------------------------------------


def shuffled_rank(df: DataFrame, ids: Sequence[str], seed: int, keys: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Rank of a seeded permutation, from a hash of the ids; no key is sorted in one task.

    The first five digits of the hash are the blocks: a million even ones, whatever the data.
    """
    h = F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in ids], F.lit(str(seed))))
    tagged = df.withColumns({"_h": h, "_all": F.lit(0)})
    return index_rows(tagged, [*keys, "_all"], ["_h", *ids], F.substring("_h", 1, 5), name).drop("_h", "_all")


def split_three(df: DataFrame, ids: Sequence[str], train: float, validate: float, seed: int) -> DataFrame:
    """``part``: train / validate / test by permutation rank, each part at least one row."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    d = shuffled_rank(df, ids, seed).join(F.broadcast(n))
    first = F.greatest(F.lit(1), F.least(F.bround(F.col("_n") * train).cast("bigint"), F.col("_n") - 2))
    second = F.greatest(F.lit(1), F.least(F.bround(F.col("_n") * validate).cast("bigint"), F.col("_n") - first - 1))
    part = F.when(F.col("rank") < first, "train").when(F.col("rank") < first + second, "validate").otherwise("test")
    return d.withColumn("part", part).drop("_n", "rank")


def split_stratified(df: DataFrame, ids: Sequence[str], label: str, test: float, seed: int) -> DataFrame:
    """``part``: test holds the rounded share of every class."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    d = shuffled_rank(df, ids, seed, [label]).join(written(n), label)
    return d.withColumn("part", F.when(F.col("rank") < F.bround(F.col("_n") * test), "test").otherwise("train")).drop("_n", "rank")


def balance(df: DataFrame, label: str, order: Sequence[Column], block: Column) -> DataFrame:
    """Keep the first ``min(class sizes)`` rows of every class by ``order``.

    ``block`` must grow with ``order``; ranks are exact without sorting a class whole.
    """
    names = [f"_o{i}" for i in range(len(order))]
    tagged = df.withColumns(dict(zip(names, order)))
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).agg(F.min("_n").alias("_target"))
    ranked = index_rows(tagged, [label], names, block, "_rank").join(F.broadcast(sizes))
    return ranked.filter(F.col("_rank") < F.col("_target")).drop("_rank", "_target", *names)


# --- class decisions and scores ---------------------------------------------------------------


def confidence_class(prob: Column, threshold) -> Column:
    """cylinder at or above the threshold, fish at or below its complement, else none."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), prob))
    return F.when(p >= threshold, "cylinder").when(p <= 1.0 - threshold, "fish").otherwise("none")


def binary_label(label: Column) -> Column:
    return F.when(F.lower(F.trim(label)).isin("match", "semi match"), 1).otherwise(0)


def decision_counts(df: DataFrame, keys: Sequence[str], prob: str, threshold: float) -> DataFrame:
    c = confidence_class(F.col(prob), threshold)
    count = lambda k: F.count_if(c == k).alias(k)
    return df.groupBy(*keys).agg(count("fish"), count("none"), count("cylinder"), F.count(F.lit(1)).alias("total"))


def threshold_curve(df: DataFrame, keys: Sequence[str], prob: str, thresholds: Sequence[float]) -> DataFrame:
    """Class shares at every threshold in one pass: one counter per threshold and class."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(prob)))
    counters = []
    for i, t in enumerate(thresholds):
        counters += [F.count_if(p <= 1.0 - t).alias(f"_f{i}"), F.count_if(p >= t).alias(f"_c{i}")]
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *counters)
    rows = [
        F.struct(F.lit(float(t)).alias("threshold"), (F.col(f"_f{i}") / F.col("_n")).alias("fish"),
                 ((F.col("_n") - F.col(f"_f{i}") - F.col(f"_c{i}")) / F.col("_n")).alias("none"), (F.col(f"_c{i}") / F.col("_n")).alias("cylinder"))
        for i, t in enumerate(thresholds)
    ]
    return g.select(*keys, F.inline(F.array(*rows)))


def binary_scores(df: DataFrame, keys: Sequence[str], truth: str, pred: str) -> DataFrame:
    """Accuracy, confusion counts, precision, recall and F1 (0 when undefined)."""
    t, p = F.col(truth) == 1, F.col(pred) == 1
    g = df.groupBy(*keys).agg(
        F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(t & p).alias("tp")
    )
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    g = g.withColumns(
        {
            "accuracy": ratio(F.col("tn") + F.col("tp"), F.col("tn") + F.col("tp") + F.col("fn") + F.col("fp")),
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        }
    )
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return g.withColumn("f1", f1)


def class_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support of every class."""
    pairs = df.groupBy(F.col(truth).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    long = pairs.select("*", F.explode(F.array_distinct(F.array("t", "p"))).alias("label"))
    t, p = F.col("t") == F.col("label"), F.col("p") == F.col("label")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    g = long.groupBy("label").agg(total(t & p).alias("_hit"), total(t).alias("support"), total(p).alias("_said"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    g = g.withColumns({"precision": ratio(F.col("_hit"), F.col("_said")), "recall": ratio(F.col("_hit"), F.col("support"))})
    return g.withColumn(
        "f1", F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    ).drop("_hit", "_said")


# --- matching predictions to snapshots ----------------------------------------------------------


def match_exact_or_first(df: DataFrame, meta: DataFrame, keys: Sequence[str], exact: Sequence[str], order: str) -> DataFrame:
    """Meta row equal on ``keys`` and ``exact``, else the first with the same ``keys``.

    Each fallback is one partial aggregate, so no key's rows are sorted or paired up.
    """
    rest = [c for c in meta.columns if c not in (*keys, *exact)]
    best = lambda by: meta.groupBy(*by).agg(F.min(F.struct(order, *[F.col(c).alias("_" + c) for c in meta.columns])).alias("_m"))
    hit = best([*keys, *exact]).withColumnRenamed("_m", "_exact")
    first = best(list(keys)).withColumnRenamed("_m", "_first")
    j = df.join(hit, [*keys, *exact], "left").join(first, list(keys), "left")
    m = F.coalesce("_exact", "_first")
    out = j.withColumn("_pick", m).filter(F.col("_pick").isNotNull())
    return out.select(*df.columns, F.col("_exact").isNotNull().alias("exact"), *[F.col("_pick")["_" + c].alias("meta_" + c) for c in [*exact, *rest]])


def match_nearest_interval(df: DataFrame, meta: DataFrame, keys: Sequence[str], ids: Sequence[str], order: str, reach: int = 64) -> DataFrame:
    """Meta interval closest to each prediction: least |start gap| + |end gap|, first on a tie.

    An exact match has cost 0, so it wins by itself. A prediction is joined with the windows of its keys
    that start in its own or a neighbouring bucket of ``reach`` frames. All others start further away than
    ``reach``, so a cost up to that is final; the rest look again in buckets eight times as wide, until one
    bucket holds everything. ``ids`` tell predictions apart.
    """
    m = meta.select(*keys, order, F.col("start_frame").alias("meta_start"), F.col("end_frame").alias("meta_end"))
    low, high = df.select("start_frame").unionByName(meta.select("start_frame")).agg(F.min("start_frame"), F.max("start_frame")).first()
    cost = F.abs(F.col("meta_start") - F.col("start_frame")) + F.abs(F.col("meta_end") - F.col("end_frame"))
    pick = F.min(F.struct(cost.alias("cost"), F.col(order).alias("idx"), "meta_start", "meta_end"))
    pending, found = df, None
    while True:
        last = low is None or reach > high - low
        bucket = F.floor(F.col("start_frame") / reach)
        near = pending.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
        best = near.join(m.withColumn("_b", F.floor(F.col("meta_start") / reach)), [*keys, "_b"]).groupBy(*ids).agg(pick.alias("_m"))
        seen = written(pending.join(best, list(ids), "left"), "nearest")
        done = seen.filter(F.col("_m").isNotNull() & (F.lit(last) | (F.col("_m.cost") <= reach)))
        done = done.select(*df.columns, "_m.cost", "_m.idx", "_m.meta_start", "_m.meta_end")
        found = done if found is None else found.unionByName(done)
        pending = seen.filter(F.col("_m").isNull() | (F.col("_m.cost") > reach)).select(*df.columns)
        if last or pending.isEmpty():
            return found
        reach *= 8


# --- linear models --------------------------------------------------------------------------------


def linear_scores(df: DataFrame, features: Sequence[str], weights: Sequence[float], bias: float, loss: str) -> DataFrame:
    """``score``, ``prob`` (logistic for bce, clipped raw for mse) and ``pred`` at 0.5."""
    score = F.lit(float(bias))
    for f, w in zip(features, weights):
        score = score + F.col(f) * float(w)
    raw = 1 / (1 + F.exp(-score)) if loss == "bce" else score
    prob = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    return df.withColumns({"score": score, "prob": prob}).withColumn("pred", (F.col("prob") >= 0.5).cast("int"))


def linear_shap(df: DataFrame, ids: Sequence[str], features: Sequence[str], weights: Sequence[float]) -> DataFrame:
    """(ids, feature, shap): (x - mean) w / std per row and feature; a zero deviation counts as 1."""
    stats = df.agg(
        *[F.avg(f).alias("_m" + f) for f in features],
        *[F.coalesce(F.nullif(F.stddev_pop(f), F.lit(0.0)), F.lit(1.0)).alias("_s" + f) for f in features],
    )
    rows = F.array(
        *[F.struct(F.lit(f).alias("feature"), ((F.col(f) - F.col("_m" + f)) * float(w) / F.col("_s" + f)).alias("shap")) for f, w in zip(features, weights)]
    )
    return df.join(F.broadcast(stats)).select(*ids, F.inline(rows))


class Features:
    """Feature columns, or one array column, as a vector; gaps (NULL or NaN) get the training mean.

    No row is dropped, in fitting or in scoring. A feature without any value in training counts as 0.
    """

    def __init__(self, train: DataFrame, features: Sequence[str] | str):
        self.features = features
        known = lambda c: F.nanvl(c.cast("double"), F.lit(None).cast("double"))
        if isinstance(features, str):
            size = train.agg(F.max(F.size(features))).first()[0] or 0
            parts = [F.get(features, F.lit(i)) for i in range(max(0, size))]
        else:
            parts = [F.col(c) for c in features]
        # Means in slices, so that a long array does not make one huge row expression.
        self.means = []
        for low in range(0, len(parts), 200):
            row = train.agg(*[F.avg(known(c)) for c in parts[low : low + 200]]).first()
            self.means += [0.0 if m is None else float(m) for m in row]

    def vector(self) -> Column:
        means = F.array(*[F.lit(m) for m in self.means])
        # A missing end of an array is a gap as well; what lies beyond the fitted length has no weight.
        values = F.slice(F.col(self.features), 1, len(self.means)) if isinstance(self.features, str) else F.array(*[F.col(c).cast("double") for c in self.features])
        fill = lambda v, m: F.coalesce(F.nanvl(v.cast("double"), F.lit(None).cast("double")), m)
        return array_to_vector(F.transform(means, lambda m, i: fill(F.get(values, i), m)))

    def rows(self, train: DataFrame, label: str) -> DataFrame:
        return train.select(self.vector().alias("features"), label)


class Fitted:
    """A model with the features it was fitted on."""

    def __init__(self, features: Features, model):
        self.features, self.model = features, model

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df.withColumn("features", self.features.vector()))


def _training(train: DataFrame, features: Sequence[str] | str, label: str) -> DataFrame:
    """Fitting reads the rows many times, so they are computed once into the shared folder."""
    return written(train.select(*([features] if isinstance(features, str) else features), label), "training")


def train_linear(train: DataFrame, features: Sequence[str] | str, label: str, loss: str, reg: float = 0.0) -> Fitted:
    """One linear map fitted by mean squared error or by logistic loss."""
    est = (
        LinearRegression(labelCol=label, regParam=reg, solver="normal", predictionCol="prediction")
        if loss == "mse"
        else LogisticRegression(labelCol=label, regParam=reg, maxIter=100)
    )
    data = _training(train, features, label)
    own = Features(data, features)
    return Fitted(own, est.fit(own.rows(data, label)))


def apply_linear(model: Fitted, df: DataFrame, loss: str) -> DataFrame:
    out = model.transform(df)
    prob = F.col("prediction") if loss == "mse" else vector_to_array("probability")[1]
    prob = F.greatest(F.lit(0.0), F.least(F.lit(1.0), prob))
    out = out.withColumn("prob", prob).withColumn("pred", (F.col("prob") >= 0.5).cast("int"))
    return out.drop("features", "rawPrediction", "probability", "prediction")


# Depth to which trees grow when no other is asked for.
FULL_DEPTH = 30


def train_forest(train: DataFrame, features: Sequence[str] | str, label: str, trees: int = 200, depth: int = FULL_DEPTH, seed: int = 42, item: str | None = None) -> FittedForest:
    """A forest grown in pieces (see ``forest``). Rows are drawn by ``item``, or by their place if that is None."""
    columns = [features] if isinstance(features, str) else list(features)
    draw = F.monotonically_increasing_id() if item is None else F.xxhash64(item)
    data = written(train.select(*columns, F.col(label).cast("double").alias("y"), draw.alias("_id")), "training")
    own = Features(data, features)
    rows = written(data.select("_id", vector_to_array(own.vector()).alias("x"), "y"), "rows")
    return FittedForest(own, Forest(rows, trees, depth, seed))


# --- over-sampling ----------------------------------------------------------------------------------


# Rows of a bucket in which neighbours are looked for, and buckets' centres at most.
BUCKET_ROWS, CENTRES = 1024, 1024


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0.0)


def _closest(a: np.ndarray, a_ids: np.ndarray, b: np.ndarray, b_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances) of the k rows of ``b`` closest to each row of ``a``, itself excepted (distance infinite)."""
    middle = b.mean(axis=0)
    a, b, take = a - middle, b - middle, min(k, len(b))
    d2 = _squares(a, b)
    d2[a_ids[:, None] == b_ids[None]] = np.inf
    at = np.argpartition(d2, take - 1, axis=1)[:, :take]
    # From differences, so that copies are at 0 exactly.
    exact = np.where(np.isfinite(np.take_along_axis(d2, at, 1)), ((a[:, None] - b[at]) ** 2).sum(-1), np.inf)
    order = np.lexsort((b_ids[at], exact))
    return np.take_along_axis(b_ids[at], order, 1), np.take_along_axis(exact, order, 1)


def bucketed_neighbours(df: DataFrame, item: str, vec: str, k: int, seed: int = 42, rows: int = BUCKET_ROWS) -> DataFrame:
    """(item, neighbours ARRAY<item>): the k nearest of each row, nearest first; exact at every size.

    A bucket holds the rows closest to one of some centres, which are rows drawn by hash, so a dense group gets
    many; one of more than twice ``rows`` rows is cut into parts. Each part is searched by itself, which bounds
    the distance of a row's k-th neighbour. A row then needs another bucket only if the plane between the two
    centres is closer than that, and parts of which some row needs a bucket are searched against it, part by
    part. Rows with k copies need no other. The work follows what the planes leave: few buckets where the rows
    lie in groups, all pairs of buckets where distances hardly differ. Ties go by rounding.
    """
    d = written(df.select(F.col(item).cast("bigint").alias("item"), F.col(vec).cast("array<double>").alias("x")), "points")
    n = d.count()
    drawn = d.orderBy(F.xxhash64("item", F.lit(seed)), "item").limit(max(1, min(CENTRES, math.ceil(n / rows)))).collect()
    centres = np.array([r["x"] for r in drawn], float)
    apart = np.array([np.sqrt(((centres - c) ** 2).sum(-1)) for c in centres])

    @F.arrow_udf("int")
    def closest_centre(x: pa.Array) -> pa.Array:
        return pa.array(_squares(x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1), centres).argmin(axis=1).astype(np.int32))

    keyed = d.withColumn("bucket", closest_centre("x")) if len(centres) > 1 else d.withColumn("bucket", F.lit(0))
    keyed = written(keyed, "keyed")
    sizes = written(keyed.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / (2 * rows)).cast("int").alias("parts")), "buckets")
    place = lambda part: F.col("bucket").cast("bigint") * (1 << 32) + part
    placed = keyed.join(sizes, "bucket").withColumn("own", place(F.pmod(F.xxhash64("item"), F.col("parts"))))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids, bucket = np.stack(pdf["x"].to_numpy()).astype(float), pdf["item"].to_numpy(), int(pdf["bucket"].iloc[0])
        near, d2 = _closest(x, ids, x, ids, k)
        reach = np.sqrt(d2[:, k - 1]) if d2.shape[1] == k else np.full(len(x), np.inf)
        to = _squares(x, centres)
        slack = 1e-12 * ((x * x).sum(1).max() + (centres * centres).sum(1).max())
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart[bucket] > 0, (to - to[:, [bucket]] - slack) / (2 * apart[bucket]), 0.0)
        needed = np.flatnonzero(((plane < reach[:, None] * (1 + 1e-9)) & (reach > 0)[:, None]).any(axis=0))
        there = np.isfinite(d2)
        found = {"near": [a[t] for a, t in zip(near, there)], "d2": [a[t] for a, t in zip(d2, there)]}
        return pdf[["own", "item", "x"]].assign(**found, needs=[needed] + [needed[:0]] * (len(x) - 1))

    kind = "own bigint, item bigint, x array<double>, near array<bigint>, d2 array<double>, needs array<int>"
    first = written(placed.select("own", "bucket", "item", "x").groupBy("own").applyInPandas(inside, kind), "inside")
    each = first.select("item", F.inline(F.arrays_zip("near", "d2")))
    if n > rows:
        parts = sizes.select("bucket", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select("bucket", place(F.col("part")).alias("other"))
        tiles = written(first.select("own", F.explode("needs").alias("bucket")).join(parts, "bucket").filter("own <> other").select("own", "other"), "tiles")

        def across(pdf: pd.DataFrame) -> pd.DataFrame:
            a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
            x, y = np.stack(a["x"].to_numpy()).astype(float), np.stack(b["x"].to_numpy()).astype(float)
            near, d2 = _closest(x, a["item"].to_numpy(), y, b["item"].to_numpy(), k)
            row, col = np.nonzero(d2 < a["reach"].fillna(np.inf).to_numpy()[:, None])
            return pd.DataFrame({"item": a["item"].to_numpy()[row], "near": near[row, col], "d2": d2[row, col]})

        asking = first.select("own", "item", "x", F.get("d2", F.lit(k - 1)).alias("reach"), F.lit(0).alias("side")).join(tiles, "own")
        asked = first.select(F.col("own").alias("other"), "item", "x", F.lit(None).cast("double").alias("reach"), F.lit(1).alias("side")).join(tiles, "other")
        each = each.unionByName(asking.unionByName(asked).groupBy("own", "other").applyInPandas(across, "item bigint, near bigint, d2 double"))
    ranked = F.slice(F.array_sort(F.collect_list(F.struct("d2", "near"))), 1, k)
    return each.groupBy("item").agg(F.transform(ranked, lambda s: s["near"]).alias("neighbours"))


def oversample(df: DataFrame, item: str, vec: str, label: str, minority, deficit: int, k: int, seed: int) -> DataFrame:
    """Synthetic minority rows: each a blend of a row and one of its k nearest of the same class.

    Rows take turns by number; neighbour and blend come from a hash, so a re-run agrees.
    """
    own = df.filter(F.col(label) == minority)
    ranked = shuffled_rank(own.select(F.col(item).alias("item"), F.col(vec).alias("x")), ["item"], seed, name="turn")
    count = own.agg(F.count(F.lit(1)).alias("_n"))
    near = bucketed_neighbours(own, item, vec, k, seed)
    # The only row of its class is copied as it is.
    alone = F.coalesce("neighbours", F.array("item"))
    base = ranked.join(near, "item", "left").withColumn("neighbours", alone).join(F.broadcast(count))
    copies = F.floor((F.lit(deficit) - F.col("turn") - 1) / F.col("_n")) + 1
    rows = base.filter(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), (copies - 1).cast("int"))))
    h = F.pmod(F.xxhash64("item", "copy", F.lit(seed)), F.lit(1 << 40))
    rows = rows.withColumns({"_u": F.pmod(h, F.lit(1 << 20)) / float(1 << 20), "_pick": F.pmod(F.floor(h / (1 << 20)), F.size("neighbours")).cast("int")})
    rows = rows.withColumn("near", F.get("neighbours", F.col("_pick")))
    other = own.select(F.col(item).alias("near"), F.col(vec).alias("y"))
    u = F.col("_u")
    return rows.join(other, "near").select(
        F.col("item").alias("base"), "copy", "near", F.zip_with("x", "y", lambda a, b: a + (b - a) * u).alias(vec), F.lit(minority).alias(label)
    )


# --- active sampling ---------------------------------------------------------------------------------


def candidate_grid(bounds: DataFrame, na: int, nb: int) -> DataFrame:
    """Even grid over the (lo, hi) ranges of two parameters given as one row, dealt to all tasks."""
    step = lambda axis, i, n: F.col(axis + "_lo") + (F.col(axis + "_hi") - F.col(axis + "_lo")) * i / (n - 1)
    ids = bounds.sparkSession.range(na * nb).select(F.col("id").cast("int").alias("idx")).join(F.broadcast(bounds))
    i, j = F.floor(F.col("idx") / nb), F.col("idx") % nb
    return ids.select("idx", step("a", i, na).alias("a"), step("b", j, nb).alias("b"))


def grid_index(points: DataFrame, bounds: DataFrame, na: int, nb: int) -> DataFrame:
    """(idx) of the grid candidates nearest to finished experiments (a, b), each once."""
    nearest = lambda axis, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.round(F.coalesce((F.col(axis) - F.col(axis + "_lo")) * (n - 1) / F.nullif(F.col(axis + "_hi") - F.col(axis + "_lo"), F.lit(0.0)), F.lit(0.0)))))
    one = bounds.select(*[F.col(c).cast("double").alias(c) for c in ("a_lo", "a_hi", "b_lo", "b_hi")])
    return points.join(F.broadcast(one)).select((nearest("a", na) * nb + nearest("b", nb)).cast("int").alias("idx")).distinct()


# Variance below which a training point adds nothing: as much as the noise.
GP_NOISE = 1e-10


def _kernel(x: np.ndarray, z: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * ((x[:, None] - z[None]) ** 2).sum(-1))


class _Basis:
    """Training points chosen one by one (pivoted Cholesky) until all others are determined up to the noise."""

    def __init__(self):
        self.z, self.low = np.empty((0, 2)), np.empty((0, 0))

    def take(self, x: np.ndarray) -> None:
        half = np.linalg.solve(self.low, _kernel(self.z, x)) if len(self.z) else np.empty((0, len(x)))
        left = 1 - (half * half).sum(0)
        while len(x) and left.max() > GP_NOISE:
            p = int(left.argmax())
            root = math.sqrt(left[p])
            row = (_kernel(x[p : p + 1], x)[0] - half[:, p] @ half) / root
            grown = np.zeros((len(self.z) + 1, len(self.z) + 1))
            grown[:-1, :-1], grown[-1, :-1], grown[-1, -1] = self.low, half[:, p], root
            self.low, self.z = grown, np.vstack([self.z, x[p]])
            half = np.vstack([half, row])
            left = np.maximum(left - row * row, 0.0)
            left[p] = 0.0


def training_basis(training: DataFrame, scales: tuple[float, float]) -> np.ndarray:
    """Few training points (in units of ``scales``) that fix the posterior deviation, up to the noise.

    Each task thins its own points, then one task thins what they kept. What is left is bounded by the
    kernel's numerical rank over the box of the parameters, some ten points for each square of the length
    scales, however many experiments there are.
    """

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _Basis()
        for pdf in batches:
            own.take(np.unique(pdf[["a", "b"]].to_numpy(float), axis=0))
        yield pd.DataFrame(own.z, columns=["a", "b"])

    scaled = training.select((F.col("a").cast("double") / scales[0]).alias("a"), (F.col("b").cast("double") / scales[1]).alias("b")).dropna()
    kept = scaled.mapInPandas(thin, "a double, b double").repartition(1).sortWithinPartitions("a", "b").mapInPandas(thin, "a double, b double")
    return np.array([(r["a"], r["b"]) for r in kept.collect()], float).reshape(-1, 2)


def predictive_deviation(candidates: DataFrame, training: DataFrame, scales: tuple[float, float], name: str = "std", noise: float = GP_NOISE) -> DataFrame:
    """Posterior deviation of a unit Gaussian process with a squared-exponential kernel.

    The candidates are scored where they are; they need only the training points of
    :func:`training_basis`. Without training points the deviation is 1. Points with a gap do not count.
    """
    z = training_basis(training, scales)
    low = np.linalg.cholesky(_kernel(z, z) + noise * np.eye(len(z))) if len(z) else None

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            q = pdf[["a", "b"]].to_numpy(float) / np.asarray(scales)
            half = np.linalg.solve(low, _kernel(z, q)) if len(z) else np.zeros((0, len(q)))
            yield pdf.assign(**{name: np.sqrt(np.maximum(1 - (half * half).sum(0), 0.0))})

    schema = ", ".join(f"{n} {t}" for n, t in candidates.dtypes) + f", {name} double"
    return candidates.mapInPandas(score, schema)


def next_parameters(scored: DataFrame, used: DataFrame, score: str) -> DataFrame:
    """The unused candidate with the highest score, lowest index on a tie."""
    return scored.join(used.select("idx"), "idx", "left_anti").orderBy(F.col(score).desc(), "idx").limit(1)


def next_or_random(scored: DataFrame, used: DataFrame, score: str, seed: int = 42) -> DataFrame:
    """The candidate with the highest score; if that was used already, a random unused one (``fallback``).

    The draw is by a seeded hash of the index. No row if all candidates were used.
    """
    best = scored.orderBy(F.col(score).desc(), "idx").limit(1).join(used.select("idx"), "idx", "left_anti")
    free = scored.join(used.select("idx"), "idx", "left_anti").orderBy(F.xxhash64("idx", F.lit(seed)), "idx").limit(1)
    both = best.withColumn("fallback", F.lit(False)).unionByName(free.withColumn("fallback", F.lit(True)))
    return both.orderBy("fallback").limit(1)

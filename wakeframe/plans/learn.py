"""Splits, scores, matching, models and active-sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeframe.functions import arrays
from wakeframe.operators import contours as rings, filters, gradient, grids, learn as ops, modal, processes, series, similarity, tracks as trk
from wakeframe.plans.filters import BAND, CHUNK
from wakeframe.plans.modal import snapshots
from wakeframe.plans.registry import query
from wakeframe.plans.similarity import SWEEP, sweep
from wakeframe.plans.tracks import WIN, a10, windows
from wakeframe.plans.views import contours, frames, segments, signal, sql, table, tracks
from wakeframe.session import written

# The whole embedding, as one array feature.
VEC = "x"


def vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", (F.col("label") % 2).cast("double").alias("y"), F.col("embedding").cast("array<double>").alias(VEC))


def ranked(src, ids, seed, part=""):
    key = " || ':' || ".join(f"CAST({c} AS VARCHAR)" for c in ids)
    return f"rk AS (SELECT *, row_number() OVER ({part} ORDER BY md5({key} || ':{seed}'), {', '.join(ids)}) - 1 AS rank, count(*) OVER ({part}) AS n FROM {src})"


@query(
    "L01_three_way_split",
    "vec_id:i part:s",
    sql("", "SELECT vec_id, CASE WHEN rank < round_even(n * 0.7, 0) THEN 'train' WHEN rank < round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'validate' ELSE 'test' END AS part FROM rk", ranked("embeddings", ["vec_id"], 42)),
)
def l01(spark, sf):
    return ops.split_three(table(spark, sf, "embeddings").select("vec_id"), ["vec_id"], 0.7, 0.15, 42)


@query(
    "L02_stratified_split",
    "vec_id:i label:i part:s",
    sql("", "SELECT vec_id, label, CASE WHEN rank < round_even(n * 0.2, 0) THEN 'test' ELSE 'train' END AS part FROM rk", ranked("embeddings", ["vec_id"], 42, "PARTITION BY label")),
)
def l02(spark, sf):
    return ops.split_stratified(table(spark, sf, "embeddings").select("vec_id", "label"), ["vec_id"], "label", 0.2, 42)


@query(
    "L03_file_split",
    "doc_id:i test:b",
    sql("", "SELECT doc_id, rank < trunc(n * 0.2) AS test FROM rk", ranked("documents", ["doc_id"], 7)),
)
def l03(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    n = d.agg(F.floor(F.count(F.lit(1)) * 0.2).alias("k"))
    test = ops.shuffled_rank(d, ["doc_id"], 7).join(F.broadcast(n)).filter("rank < k").select("doc_id")
    train = d.join(test, "doc_id", "left_anti").withColumn("test", F.lit(False))
    return train.unionByName(test.withColumn("test", F.lit(True)))


def parted(spark, sf):
    return ops.split_three(vectors(spark, sf), ["vec_id"], 0.7, 0.15, 42)


@query("L04_linear_classifier", "vec_id:i loss:s part:s prob:4 pred:i best_epoch:i stop_epoch:i")
def l04(spark, sf):
    """Two linear layers by either loss, stopped early on the validation part, with the weights of the best epoch."""
    d = written(parted(spark, sf), "parted")
    settings = [gradient.Setting("mse"), gradient.Setting("bce")]
    models = gradient.fit_linear(d.filter("part = 'train'"), d.filter("part = 'validate'"), "vec_id", VEC, "y", settings)
    scored = [m.transform(d).withColumn("loss", F.lit(m.loss)) for m in models]
    return scored[0].unionByName(scored[1])


@query("L05_feature_classifier", "run:i track_id:i part:s prob:4 pred:i")
def l05(spark, sf):
    """Fitted on the training part, whose statistics scale the others too; the part tells what is held out."""
    d = ops.split_three(a10(spark, sf).withColumn("y", (F.col("run") % 2).cast("double")), ["run", "track_id"], 0.7, 0.15, 42)
    d = written(d, "track-features")
    train = d.filter("part = 'train'")
    scaled = series.standardise(d, trk.FEATURES, series.standardise_stats(train, trk.FEATURES))
    model = ops.train_linear(scaled.filter("part = 'train'"), trk.FEATURES, "y", "mse", 1e-3)
    return ops.apply_linear(model, scaled, "mse")


# Bounds of the searched learning rate and weight decay.
RATES, DECAYS = (1e-4, 1e-1), (1e-6, 1e-2)


@query("L06_penalty_search", "trial:i lr:8 decay:8 val_loss:5 best_epoch:i")
def l06(spark, sf):
    d = parted(spark, sf).filter("part <> 'test'")
    trials = gradient.search_linear(d, "vec_id", VEC, "y", F.col("part") == "validate", gradient.Setting("bce"), RATES, DECAYS)
    return spark.createDataFrame(trials, "trial int, lr double, decay double, val_loss double, best_epoch int")


LIN = ["l_quantity", "l_extendedprice", "l_discount"]
LW = [0.05, -0.00003, 4.0]
LKEY = "l_orderkey:i l_partkey:i l_linenumber:i "


@query(
    "L07_linear_scores",
    LKEY + "score:6 prob:6 pred:i raw:6",
    sql(
        "",
        """SELECT *, (prob >= 0.5)::INT AS pred, greatest(0, least(1, score)) AS raw FROM (SELECT *, 1 / (1 + exp(-score)) AS prob FROM
        (SELECT *, -0.4 + 0.05 * l_quantity - 0.00003 * l_extendedprice + 4 * l_discount AS score FROM lineitem))""",
    ),
)
def l07(spark, sf):
    d = ops.linear_scores(table(spark, sf, "lineitem"), LIN, LW, -0.4, "mse").withColumnRenamed("prob", "raw")
    return ops.linear_scores(d, LIN, LW, -0.4, "bce")


@query("L08_apply_to_real_signals", "energy:2 run:i frame:i channel:s samples:i modes:i prob:3 pred:i")
def l08(spark, sf):
    """Train on simulated snapshots, score filtered sensor windows on the same modes; all modes of either energy."""
    d = snapshots(spark, sf).withColumn("p", arrays.normalise(F.col("p")))
    f = frames(spark, sf)
    n0 = F.col("run") * 120 + F.col("frame") * 2 + 25
    spans = f.select(
        "run", "frame",
        F.element_at(F.array(*map(F.lit, ["view", "signup", "purchase", "click", "error"])), (F.col("label") % 5 + 1).cast("int")).alias("channel"),
        (n0 - 20).cast("bigint").alias("first_sample"), (n0 + 20).cast("bigint").alias("last_sample"),
    )
    real = filters.zero_phase(signal(spark, sf), ["channel"], *BAND, size=CHUNK)
    win = similarity.windows_from_channels(spans, real, ["run", "frame", "channel"])
    win = win.withColumn("samples", F.size("x")).withColumn("p", series.resample_cubic(F.col("x"), 64))
    win = written(win.withColumn("p", arrays.normalise(arrays.zero_mean(F.col("p")))).drop("x"), "windows")
    sim = d.withColumn("y", (F.col("model") == "cylinder").cast("double"))
    # The modes of the lower energy are the first of those of the higher one: one basis, one projection.
    basis = written(modal.pressure_modes(d, [], "p", 0.99), "basis")
    fewer = basis.filter(F.col("cumulative") < 0.95 - 1e-12).count() + 1
    sim = written(modal.project_array(sim, [], "p", basis).select("coef", "y"), "simulated")
    win = written(modal.project_array(win, [], "p", basis).drop("p"), "projected")
    out = None
    for energy, modes in ((0.95, fewer), (0.99, None)):
        cut = lambda df: df if modes is None else df.withColumn("coef", F.slice("coef", 1, modes))  # noqa: B023, E731
        scored = ops.apply_linear(ops.train_linear(cut(sim), "coef", "y", "mse", 1e-3), cut(win), "mse")
        scored = scored.withColumns({"energy": F.lit(energy), "modes": F.size("coef")})
        out = scored if out is None else out.unionByName(scored)
    return out


# --- matching ---------------------------------------------------------------------------

# Predictions: one per window, with a probability from its numbers. Meta: the window itself
# for fish, a shifted one for cylinder.
PRED = """prd AS (SELECT run, sensor_id, start_frame, end_frame, ((start_frame // 60 * 37 + sensor_id * 11) % 101) / 100 AS prob FROM win),
  met AS (SELECT run, sensor_id, 'fish' AS model, start_frame, end_frame, start_frame AS idx FROM win
    UNION ALL SELECT run, sensor_id, 'cylinder', start_frame + 30, end_frame + 30, start_frame + 1 FROM win)"""


def predictions(w):
    prob = ((F.floor(F.col("start_frame") / 60) * 37 + F.col("sensor_id") * 11) % 101) / 100
    return w.withColumn("prob", prob)


def metadata(w):
    fish = w.select("run", "sensor_id", F.lit("fish").alias("model"), "start_frame", "end_frame", F.col("start_frame").alias("idx"))
    cyl = w.select("run", "sensor_id", F.lit("cylinder").alias("model"), (F.col("start_frame") + 30).alias("start_frame"), (F.col("end_frame") + 30).alias("end_frame"), (F.col("start_frame") + 1).alias("idx"))
    return fish.unionByName(cyl)


@query(
    "J12_exact_or_first",
    "run:i sensor_id:i start_frame:i end_frame:i exact:b meta_idx:i meta_start_frame:i",
    sql(
        "trk",
        """SELECT p.run, p.sensor_id, p.start_frame, p.end_frame, m.start_frame = p.start_frame AND m.end_frame = p.end_frame AS exact, m.idx AS meta_idx, m.start_frame AS meta_start_frame
        FROM (SELECT run, sensor_id, start_frame + 30 * (sensor_id % 2) + 7 * (sensor_id // 2) AS start_frame, end_frame + 30 * (sensor_id % 2) AS end_frame FROM win) p JOIN met m USING (run, sensor_id)
        QUALIFY row_number() OVER (PARTITION BY p.run, p.sensor_id, p.start_frame, p.end_frame ORDER BY (m.start_frame = p.start_frame AND m.end_frame = p.end_frame) DESC, m.idx) = 1""",
        WIN, PRED,
    ),
)
def j12(spark, sf):
    w = windows(tracks(spark, sf))
    odd = F.col("sensor_id") % 2
    p = w.select("run", "sensor_id", (F.col("start_frame") + 30 * odd + 7 * F.floor(F.col("sensor_id") / 2)).alias("start_frame"), (F.col("end_frame") + 30 * odd).alias("end_frame"))
    return ops.match_exact_or_first(p, metadata(w), ["run", "sensor_id"], ["start_frame", "end_frame"], "idx")


CHOSEN = """cls AS (SELECT *, CASE WHEN prob >= 0.7 THEN 'cylinder' WHEN prob <= 1.0::DOUBLE - 0.7::DOUBLE THEN 'fish' ELSE 'none' END AS model FROM prd),
  sel AS (SELECT p.run, p.sensor_id, p.model, p.prob, p.start_frame AS pred_start, p.end_frame AS pred_end, m.start_frame, m.end_frame, m.idx,
    abs(m.start_frame - p.start_frame) + abs(m.end_frame - p.end_frame) AS cost FROM cls p JOIN met m ON m.run = p.run AND m.sensor_id = p.sensor_id AND m.model = p.model
    QUALIFY row_number() OVER (PARTITION BY p.run, p.sensor_id, p.start_frame ORDER BY cost, m.idx) = 1)"""


def selected(w):
    p = predictions(w).withColumn("model", ops.confidence_class(F.col("prob"), 0.7)).filter("model <> 'none'")
    return ops.match_nearest_interval(p, metadata(w), ["run", "sensor_id", "model"], ["run", "sensor_id", "start_frame"], "idx")


@query(
    "J13_nearest_interval",
    "run:i sensor_id:i model:s start_frame:i cost:i meta_start:i meta_end:i",
    sql("trk", "SELECT run, sensor_id, model, pred_start AS start_frame, cost, start_frame AS meta_start, end_frame AS meta_end FROM sel", WIN, PRED, CHOSEN),
)
def j13(spark, sf):
    return selected(windows(tracks(spark, sf)))


@query(
    "J15_class_conditional_meta",
    "run:i sensor_id:i start_frame:i model:s metas:i",
    sql("trk", "SELECT p.run, p.sensor_id, p.start_frame, p.model, count(*) AS metas FROM cls p JOIN met m ON m.run = p.run AND m.sensor_id = p.sensor_id AND m.model = p.model GROUP BY ALL", WIN, PRED, CHOSEN),
)
def j15(spark, sf):
    w = windows(tracks(spark, sf))
    p = predictions(w).withColumn("model", ops.confidence_class(F.col("prob"), 0.7))
    m = metadata(w).groupBy("run", "sensor_id", "model").agg(F.count(F.lit(1)).alias("metas"))
    return p.join(m, ["run", "sensor_id", "model"])


@query(
    "L09_matching_dataset",
    "run:i win_sensor:i model:s track_id:i start_frame:i end_frame:i duration:i ratio:6 frame:i event_id:i core_x:6",
    sql(
        "trk",
        """SELECT r.*, duration, ratio FROM rows_ r JOIN kept USING (run, win_sensor, model, track_id, start_frame, end_frame)""",
        WIN, PRED, CHOSEN,
        """rows_ AS (SELECT t.run, s.sensor_id AS win_sensor, s.model, t.track_id, s.start_frame, s.end_frame, t.frame, t.event_id, t.core_x FROM trk t JOIN sel s ON s.run = t.run
          AND t.frame BETWEEN s.start_frame AND s.end_frame WHERE t.visible AND (t.sensor_id < 0 OR t.sensor_id = s.sensor_id)),
          ent AS (SELECT run, win_sensor, model, track_id, start_frame, end_frame, count(DISTINCT frame) AS duration, count(DISTINCT frame) / (end_frame - start_frame + 1) AS ratio FROM rows_ GROUP BY ALL),
          kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY -ratio, -duration, run, win_sensor, track_id, start_frame) AS rn FROM ent WHERE ratio >= 0.002)
          WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM ent WHERE ratio >= 0.002 GROUP BY model)))""".replace(
            "count(DISTINCT frame) / (end_frame - start_frame + 1) AS ratio FROM rows_ GROUP BY ALL", "count(DISTINCT frame) / (end_frame - start_frame + 1) AS ratio FROM rows_ GROUP BY run, win_sensor, model, track_id, start_frame, end_frame"
        ),
    ),
)
def l09(spark, sf):
    t = tracks(spark, sf)
    sel = selected(windows(t)).select("run", "sensor_id", "model", F.col("meta_start").alias("start_frame"), F.col("meta_end").alias("end_frame"))
    hit = trk.rows_in_windows(t, sel, ["run"], 360)
    keys = ["run", "win_sensor", "model", "track_id", "start_frame", "end_frame"]
    ent = trk.persistence(hit, keys, F.col("end_frame") - F.col("start_frame") + 1, 0.002)
    order = [-F.col("ratio"), -F.col("duration"), F.col("run"), F.col("win_sensor"), F.col("track_id"), F.col("start_frame")]
    kept = ops.balance(ent, "model", order, F.struct((-F.col("ratio")).alias("r"), (-F.col("duration")).alias("d"), "run", "win_sensor"))
    return hit.join(kept.select(*keys, "duration", "ratio"), keys)


# --- balancing, scores, decisions ------------------------------------------------------------


@query(
    "A15_class_balance",
    "snapshot:i model:s length:i",
    sql(
        "seg",
        "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY length DESC, snapshot) AS rn FROM seg) WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM seg GROUP BY model))",
    ),
)
def a15(spark, sf):
    block = F.struct((-F.col("length")).alias("l"), F.floor(F.col("snapshot") / 1048576).alias("s"))
    return ops.balance(segments(spark, sf), "model", [-F.col("length"), F.col("snapshot")], block)


@query(
    "O03_longest_first",
    "snapshot:i model:s length:i",
    sql("seg", "SELECT * FROM seg QUALIFY row_number() OVER (PARTITION BY model ORDER BY length DESC, snapshot) <= 25"),
)
def o03(spark, sf):
    d = segments(spark, sf)
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("length")).alias("nl"), "snapshot"))), 1, 25)
    # Two steps: the best 25 of each slice, then of the slices, so no class is gathered whole.
    part = d.groupBy("model", F.pmod(F.col("snapshot"), F.lit(64)).alias("slice")).agg(top.alias("t"))
    best = part.groupBy("model").agg(F.slice(F.array_sort(F.flatten(F.collect_list("t"))), 1, 25).alias("t"))
    return best.select("model", F.inline("t")).withColumn("length", -F.col("nl"))


PROB = "pr AS (SELECT *, l_discount * 10 AS prob, (l_linestatus = 'F')::INT AS truth FROM lineitem)"


def probs(spark, sf):
    return table(spark, sf, "lineitem").withColumns({"prob": F.col("l_discount") * 10, "truth": (F.col("l_linestatus") == "F").cast("int")})


@query(
    "P17_confidence_class",
    LKEY + "cls:s",
    sql("", "SELECT *, CASE WHEN least(1, prob) >= 0.8 THEN 'cylinder' WHEN prob <= 1.0::DOUBLE - 0.8::DOUBLE THEN 'fish' ELSE 'none' END AS cls FROM pr", PROB),
)
def p17(spark, sf):
    return probs(spark, sf).withColumn("cls", ops.confidence_class(F.col("prob"), 0.8))


@query(
    "A16_decision_counts",
    "l_returnflag:s fish:i none:i cylinder:i total:i",
    sql("", "SELECT l_returnflag, count_if(prob <= 1.0::DOUBLE - 0.8::DOUBLE) AS fish, count_if(prob > 1.0::DOUBLE - 0.8::DOUBLE AND prob < 0.8) AS \"none\", count_if(prob >= 0.8) AS cylinder, count(*) AS total FROM pr GROUP BY 1", PROB),
)
def a16(spark, sf):
    return ops.decision_counts(probs(spark, sf), ["l_returnflag"], "prob", 0.8)


THR = [0.5, 0.6, 0.7, 0.8, 0.9, 0.95]


@query(
    "A17_threshold_curve",
    "l_returnflag:s threshold:3 fish:6 none:6 cylinder:6",
    sql(
        "",
        """SELECT l_returnflag, t AS threshold, avg((prob <= 1.0::DOUBLE - t)::INT) AS fish, avg((prob > 1.0::DOUBLE - t AND prob < t)::INT) + avg((prob <= 1.0::DOUBLE - t AND prob >= t)::INT) * -1 AS "none", avg((prob >= t)::INT) AS cylinder
        FROM pr, (VALUES (0.5::DOUBLE), (0.6), (0.7), (0.8), (0.9), (0.95)) v(t) GROUP BY 1, 2""",
        PROB,
    ),
)
def a17(spark, sf):
    return ops.threshold_curve(probs(spark, sf), ["l_returnflag"], "prob", THR)


@query(
    "A18_binary_scores",
    "l_returnflag:s tn:i fp:i fn:i tp:i accuracy:6 precision:6 recall:6 f1:6",
    sql(
        "",
        """SELECT *, 2 * "precision" * recall / ("precision" + recall) AS f1 FROM (SELECT *, (tn + tp) / (tn + tp + fp + fn) AS accuracy, tp / (tp + fp) AS "precision", tp / (tp + fn) AS recall FROM
        (SELECT l_returnflag, count_if(truth = 0 AND prob < 0.5) AS tn, count_if(truth = 0 AND prob >= 0.5) AS fp, count_if(truth = 1 AND prob < 0.5) AS fn, count_if(truth = 1 AND prob >= 0.5) AS tp FROM pr GROUP BY 1))""",
        PROB,
    ),
)
def a18(spark, sf):
    d = probs(spark, sf).withColumn("pred", (F.col("prob") >= 0.5).cast("int"))
    return ops.binary_scores(d, ["l_returnflag"], "truth", "pred")


@query(
    "A18_class_report",
    "label:s support:i precision:6 recall:6 f1:6",
    sql(
        "",
        """SELECT label, support, hit / said AS "precision", hit / support AS recall, 2 * (hit / said) * (hit / support) / (hit / said + hit / support) AS f1 FROM
        (SELECT label, sum((t = label)::INT) AS support, sum((p = label)::INT) AS said, sum((t = label AND p = label)::INT) AS hit
        FROM (SELECT l_returnflag AS t, CASE WHEN l_quantity > 40 THEN 'A' WHEN l_quantity > 20 THEN 'N' ELSE 'R' END AS p FROM lineitem), (VALUES ('A'), ('N'), ('R')) v(label) GROUP BY label)""",
    ),
)
def a18r(spark, sf):
    p = F.when(F.col("l_quantity") > 40, "A").when(F.col("l_quantity") > 20, "N").otherwise("R")
    return ops.class_report(table(spark, sf, "lineitem").withColumn("p", p), "l_returnflag", "p")


@query("A19_label_counts", "event_type:s is_match:i n:i", sql("", "SELECT event_type, (event_type IN ('view', 'click'))::INT AS is_match, count(*) AS n FROM events GROUP BY 1, 2"))
def a19(spark, sf):
    label = F.when(F.col("event_type") == "view", " Match").when(F.col("event_type") == "click", "semi match").otherwise("no match")
    return table(spark, sf, "events").groupBy("event_type", ops.binary_label(label).alias("is_match")).agg(F.count(F.lit(1)).alias("n"))


@query("L14_binary_label", "event_id:i y:i", sql("", "SELECT event_id, (event_type IN ('view', 'click'))::INT AS y FROM events"))
def l14(spark, sf):
    label = F.when(F.col("event_type") == "view", " Match").when(F.col("event_type") == "click", "semi match").otherwise("no match")
    return table(spark, sf, "events").select("event_id", ops.binary_label(label).alias("y"))


@query(
    "L10_linear_shap",
    LKEY + "feature:s shap:6",
    sql(
        "",
        " UNION ALL ".join(
            f"SELECT l_orderkey, l_partkey, l_linenumber, '{c}' AS feature, ({c} - (SELECT avg({c}) FROM lineitem)) * {w!r} / (SELECT stddev_pop({c}) FROM lineitem) AS shap FROM lineitem"
            for c, w in zip(LIN, LW)
        ),
    ),
)
def l10(spark, sf):
    return ops.linear_shap(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_linenumber"], LIN, LW)


@query("L11_random_forest", "vec_id:i pred:i")
def l11(spark, sf):
    d = parted(spark, sf)
    model = ops.train_forest(d.filter("part = 'train'"), VEC, "y", trees=200, item="vec_id")
    return model.transform(d.filter("part = 'test'")).withColumn("pred", F.col("prediction"))


@query("L12_grid_search", "kind:s params:s accuracy:4")
def l12(spark, sf):
    return grids.search(vectors(spark, sf), "vec_id", VEC, "y")


@query("L13_oversample", "base:i copy:i near:i x0:6 x63:6 label:i")
def l13(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("label") == 3).cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    counts = {r["label"]: r["n"] for r in e.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = ops.oversample(e, "vec_id", "v", "label", 1, max(0, counts.get(0, 0) - counts.get(1, 0)), 5, 42)
    return out.withColumns({"x0": F.col("v")[0], "x63": F.col("v")[63]})


BOUNDS = "bnd AS (SELECT min(re) AS a_lo, max(re) AS a_hi, min(h) AS b_lo, max(h) AS b_hi FROM swp)"


GRID_SIZE = (100, 220)


def sweep_bounds(runs):
    return runs.agg(F.min("re").alias("a_lo"), F.max("re").alias("a_hi"), F.min("h").alias("b_lo"), F.max("h").alias("b_hi"))


def bounds(spark, sf):
    return sweep_bounds(sweep(spark, sf))


def grid(spark, sf):
    return ops.candidate_grid(bounds(spark, sf), *GRID_SIZE)


@query(
    "L16_candidate_grid",
    "idx:i a:6 b:6",
    sql("", "SELECT idx, a_lo + (a_hi - a_lo) * (idx // 220) / 99 AS a, b_lo + (b_hi - b_lo) * (idx % 220) / 219 AS b FROM bnd, range(22000) r(idx)", SWEEP, BOUNDS),
)
def l16(spark, sf):
    return grid(spark, sf)


# Length scales (re, h) from which a fit starts, and their bounds.
SCALES, SCALE_BOUNDS = (2.0, 8.0), ((0.5, 100.0), (1.0, 1000.0))


def experiments(spark, sf, *flags):
    """Finished experiments (a, b) of the named sources with their metrics: all their sweep cells."""
    d = sweep(spark, sf).filter(F.col("flag").isin(*flags))
    metrics = similarity.time_of_minimum(d, ["re", "h"], "sensor", "t", "p", floor=-1.0).join(similarity.peak_to_peak(d, ["re", "h"], "sensor", "p"), ["re", "h"])
    return metrics.select(F.col("re").alias("a"), F.col("h").alias("b"), "f_re", "f_h")


def fitted(done):
    return processes.fit_process(done, ["f_re", "f_h"], SCALES, SCALE_BOUNDS)


@query("L15_active_sampling", "idx:i a:6 b:6 mean_f_re:3 mean_f_h:3 std:4 pick:b")
def l15(spark, sf):
    """Mean and deviation of every candidate given all experiments, with fitted scales, and the next one to try."""
    done = written(experiments(spark, sf, "A", "N", "R"), "experiments")
    scored = written(fitted(done).predict(grid(spark, sf)), "scored")
    pick = ops.next_parameters(scored, ops.grid_index(done, bounds(spark, sf), *GRID_SIZE), "std")
    return scored.join(F.broadcast(pick.select("idx", F.lit(True).alias("pick"))), "idx", "left").withColumn("pick", F.coalesce("pick", F.lit(False)))


@query("L17_disagreement_pick", "idx:i a:6 b:6 gap:4 fallback:b")
def l17(spark, sf):
    """The candidate on which two sources, fitted each, disagree most; a random one if it was measured already."""
    one, two = written(experiments(spark, sf, "A"), "one"), written(experiments(spark, sf, "R"), "two")
    scored = written(processes.fitted_disagreement(grid(spark, sf), fitted(one), fitted(two)), "scored")
    return ops.next_or_random(scored, ops.grid_index(one.unionByName(two), bounds(spark, sf), *GRID_SIZE), "gap")


# --- what every fit must keep: rows, keys and bounds ------------------------------------------

# Sizes of the three parts of a permutation split of n rows.
PARTS = """pt AS (SELECT n, round_even(n * 0.7, 0) AS tr, round_even(n * 0.15, 0) AS va FROM cnt),
  parts AS (SELECT 'train' AS part, tr AS n FROM pt UNION ALL SELECT 'validate', va FROM pt UNION ALL SELECT 'test', n - tr - va FROM pt)"""


def outside(c, low=0.0, high=1.0):
    """Rows whose value is missing or out of bounds."""
    return F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | ~F.col(c).between(low, high))


@query("L04_coverage", "loss:s part:s n:i bad:i", sql("", "SELECT loss, part, n, 0 AS bad FROM parts, (VALUES ('mse'), ('bce')) l(loss)", "cnt AS (SELECT count(*) AS n FROM embeddings)", PARTS))
def l04_coverage(spark, sf):
    """Every row is scored by either loss; a fit ends ``patience`` epochs after its best one, or with its last epoch."""
    s = gradient.Setting("mse")
    fair = F.col("prob").between(0, 1) & ((F.col("stop_epoch") == F.col("best_epoch") + s.patience) | (F.col("stop_epoch") == s.epochs)) & (F.col("best_epoch") >= 1)
    return l04(spark, sf).groupBy("loss", "part").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(fair, F.lit(False))).alias("bad"))


@query("L05_coverage", "part:s n:i bad:i", sql("trk", "SELECT part, n, 0 AS bad FROM parts", "cnt AS (SELECT count(*) AS n FROM (SELECT DISTINCT run, track_id FROM trk))", PARTS))
def l05_coverage(spark, sf):
    return l05(spark, sf).groupBy("part").agg(F.count(F.lit(1)).alias("n"), outside("prob").alias("bad"))


@query("L06_coverage", "trials:i bad:i", "SELECT 30 AS trials, 0 AS bad")
def l06_coverage(spark, sf):
    """Both parameters lie in their ranges, and no trial's best loss is far above that of a coin."""
    ok = F.col("lr").between(*RATES) & F.col("decay").between(*DECAYS) & F.col("val_loss").between(0.0, 1.5) & (F.col("best_epoch") >= 1)
    return l06(spark, sf).agg(F.count_distinct("trial").alias("trials"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("bad"))


@query("L08_coverage", "energy:2 n:i bad:i", "SELECT energy, n, 0 AS bad FROM (SELECT count(*) AS n FROM embeddings), (VALUES (0.95), (0.99)) e(energy)")
def l08_coverage(spark, sf):
    """Every window is scored with either basis, by no more modes than a snapshot has samples."""
    ok = F.col("prob").between(0, 1) & F.col("modes").between(1, 64)
    return l08(spark, sf).groupBy("energy").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok.isNull() | ~ok).alias("bad"))


@query("L12_coverage", "settings:i bad:i", "SELECT 144 AS settings, 0 AS bad FROM (SELECT count(*) FROM embeddings)")
def l12_coverage(spark, sf):
    return l12(spark, sf).agg(F.count_distinct("kind", "params").alias("settings"), outside("accuracy").alias("bad"))


@query("L11_coverage", "n:i bad:i", sql("", "SELECT n, 0 AS bad FROM parts WHERE part = 'test'", "cnt AS (SELECT count(*) AS n FROM embeddings)", PARTS))
def l11_coverage(spark, sf):
    return l11(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("pred").isin(0.0, 1.0)).alias("bad"))


@query(
    "L13_coverage",
    "n:i bases:i bad:i",
    """SELECT deficit AS n, least(deficit, minority) AS bases, 0 AS bad FROM (SELECT count(*) FILTER (label <> 3) - count(*) FILTER (label = 3) AS deficit,
    count(*) FILTER (label = 3) AS minority FROM embeddings)""",
)
def l13_coverage(spark, sf):
    """As many new rows as the minority lacks, every base in turn, none blended with itself."""
    return l13(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("base").alias("bases"), F.count_if(F.col("base") == F.col("near")).alias("bad"))


@query("L15_coverage", "n:i picks:i bad:i", "SELECT 22000 AS n, 1 AS picks, 0 AS bad FROM (SELECT count(*) FROM lineitem)")
def l15_coverage(spark, sf):
    d = l15(spark, sf)
    known = F.coalesce(F.col("std").between(0, 1), F.lit(False)) & ~F.isnan("mean_f_re") & ~F.isnan("mean_f_h")
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if("pick").alias("picks"), F.count_if(~known).alias("bad"))


@query("L17_coverage", "n:i bad:i", "SELECT 1 AS n, 0 AS bad FROM (SELECT count(*) FROM lineitem)")
def l17_coverage(spark, sf):
    """One choice, on the grid, that no source has measured."""
    used = ops.grid_index(experiments(spark, sf, "A", "R"), bounds(spark, sf), *GRID_SIZE).withColumn("used", F.lit(True))
    d = l17(spark, sf).join(used, "idx", "left")
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("used").isNotNull() | ~F.col("idx").between(0, 21999)).alias("bad"))


# --- pictures and labels ----------------------------------------------------------------------


@query(
    "J20_image_label_join",
    "page_id:i image:s label:s",
    sql("", "SELECT p.page_id, 'frame-' || p.page_id || CASE WHEN p.page_id % 2 = 0 THEN '.png' ELSE '.jpg' END AS image, coalesce('frame-' || d.doc_id || '.txt', 'empty') AS label FROM pages p LEFT JOIN labels d ON d.doc_id = p.page_id"),
)
def j20(spark, sf):
    ext = F.when(F.col("page_id") % 2 == 0, ".png").otherwise(".jpg")
    images = table(spark, sf, "pages").select("page_id", F.concat(F.lit("frame-"), F.col("page_id").cast("string"), ext).alias("image"))
    labels = table(spark, sf, "labels").select(F.concat(F.lit("frame-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("label"))
    stem = F.regexp_replace("image", r"\.(png|jpg)$", ".txt")
    return images.join(labels, stem == F.col("label"), "left").withColumn("label", F.coalesce("label", F.lit("empty")))


@query("O05_first_frames", "run:i frame:i total:6", sql("fr", "SELECT run, frame, list_sum(v) AS total FROM fr WHERE frame < 10"))
def o05(spark, sf):
    return frames(spark, sf).filter("frame < 10").withColumn("total", arrays.total(F.col("v")))


@query(
    "O06_largest_polygon",
    "run:i frame:i area:6",
    sql(
        "edge",
        "SELECT run, arg_max(frame, (area, -frame)) AS frame, max(area) AS area FROM (SELECT run, frame, sum(x1 * y2 - x2 * y1) / 2 AS area FROM edge GROUP BY 1, 2) GROUP BY run",
    ),
)
def o06(spark, sf):
    area = -rings.area_and_moment(F.col("poly"))["area"]
    d = contours(spark, sf).select("run", "frame", area.alias("area"))
    best = d.groupBy("run").agg(F.max(F.struct("area", (-F.col("frame")).alias("nf"))).alias("b"))
    return best.select("run", (-F.col("b.nf")).alias("frame"), F.col("b.area").alias("area"))


@query(
    "F20_safe_statistics",
    "user_id:i mean:6 top:6",
    sql("", "SELECT user_id, coalesce(avg(value) FILTER (value > 100), 0) AS mean, coalesce(max(value) FILTER (value > 100), 0) AS top FROM events GROUP BY user_id"),
)
def f20(spark, sf):
    v = F.nanvl(F.when(F.col("value") > 100, F.col("value")).otherwise(F.lit(float("nan"))), F.lit(None).cast("double"))
    return table(spark, sf, "events").groupBy("user_id").agg(trk.safe(F.avg(v)).alias("mean"), trk.safe(F.max(v)).alias("top"))

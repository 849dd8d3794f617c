"""Modal analysis and identification queries.

Eigenvectors have no unique sign, so the oracles test what the decomposition must
preserve: traces, squared norms per cell, per frame and per series.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeframe.functions import arrays
from wakeframe.operators import modal as ops, series
from wakeframe.operators.learn import balance
from wakeframe.plans.registry import query
from wakeframe.plans.views import frames, segments, sql, velocity
from wakeframe.session import written

CENT = "cen AS (SELECT run, frame, cell, v - avg(v) OVER (PARTITION BY run, cell) AS v FROM cells)"
COV = "cov AS (SELECT a.run, a.frame AS i, b.frame AS j, sum(a.v * b.v) / 49 AS v FROM cen a JOIN cen b ON a.run = b.run AND a.cell = b.cell GROUP BY 1, 2, 3)"


def covariance(spark, sf):
    return ops.snapshot_covariance(frames(spark, sf))


@query("M01_snapshot_covariance", "run:i i:i j:i v:6", sql("cells", "SELECT * FROM cov", CENT, COV))
def m01(spark, sf):
    return covariance(spark, sf).entries()


@query("M02_pod_modes", "run:i cell:i norm:6", sql("cells", "SELECT run, cell, sum(v * v) AS norm FROM cen GROUP BY 1, 2", CENT))
def m02(spark, sf):
    rows = ops.cell_blocks(frames(spark, sf))
    phi = ops.project_cells(rows, ops.Covariance(rows).eigen())
    return phi.select("run", "cell", arrays.total(F.transform("phi", lambda p: p * p)).alias("norm"))


@query("M02_pod_coefficients", "run:i mode:i frame:i magnitude:5")
def m02c(spark, sf):
    return ops.mode_coefficients(covariance(spark, sf)).withColumn("magnitude", F.abs("a"))


@query(
    "M03_energy_spectrum",
    "run:i total:6 squares:6 energy:6 modes:i",
    sql("cells", "SELECT run, sum(v) FILTER (i = j) AS total, sum(v * v) AS squares, 1 AS energy, 50 AS modes FROM cov GROUP BY run", CENT, COV),
)
def m03(spark, sf):
    s = ops.mode_energy(covariance(spark, sf).eigen())
    return s.groupBy("run").agg(
        F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"), F.sum("energy").alias("energy"), F.count("mode").alias("modes")
    )


@query("M03_modes_needed", "run:i needed:i first_energy:6 printed:i")
def m03n(spark, sf):
    s = ops.mode_energy(covariance(spark, sf).eigen())
    printed = ops.modes_needed(s, ["run"], 0.95, False).select("run", F.col("needed").alias("printed"))
    return ops.modes_needed(s, ["run"], 0.95).join(printed, "run")


@query("M04_reconstruction_error", "run:i kept:i error:6 raw_error:5")
def m04(spark, sf):
    d = frames(spark, sf)
    cov, cells = ops.snapshot_covariance(d), ops.cell_counts(d)
    raw = ops.reconstruction_error(cov, cells, 0.9, normalised=False).select("run", F.col("error").alias("raw_error"))
    return ops.reconstruction_error(cov, cells, 0.9).join(raw, "run")


@query("M05_pod_sweep", "re:i h:i n99:4 n95:4 first_energy:6 error:6 runs:i")
def m05(spark, sf):
    d = frames(spark, sf).withColumns({"re": 1000 * (1 + F.col("run") % 3), "h": 1 + F.floor(F.col("run") / 3)})
    return ops.sweep(d, "re", "h")


def shift_basis(spark, sf):
    f = frames(spark, sf)
    return f, ops.shift_mode_basis(f, series.period_start(f, "v", min_back=20), 8)


@query("M06_shift_mode_basis", "run:i mode:i norm:6 energy:5")
def m06(spark, sf):
    f, basis = shift_basis(spark, sf)
    norm = ops.block_cells(basis, "phi").select("run", F.posexplode("phi").alias("mode", "c")).groupBy("run", "mode").agg(F.sum(F.col("c") * F.col("c")).alias("norm"))
    a = ops.project_frames(f, basis).groupBy("run", "mode").agg(F.sum(F.col("a") * F.col("a")).alias("energy"))
    return norm.join(a, ["run", "mode"])


@query("M06_orthonormal", "run:i i:i j:i dot:6", sql("fr", "SELECT run, i, j, (i = j)::INT AS dot FROM (SELECT DISTINCT run FROM fr), range(8) a(i), range(8) b(j)"))
def m06o(spark, sf):
    """Products of the basis' columns over all cells of a run."""
    _, basis = shift_basis(spark, sf)
    phi = ops.block_cells(basis, "phi").select("run", F.posexplode("phi").alias("i", "x"), "phi")
    return phi.select("run", "i", F.posexplode("phi").alias("j", "y"), "x").groupBy("run", "i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))


@query("M04_bounds", "run:i bad:i", sql("fr", "SELECT DISTINCT run, 0 AS bad FROM fr"))
def m04_bounds(spark, sf):
    """A projection on part of the modes leaves something, and less than scaling the modes by their energy."""
    d = m04(spark, sf)
    ok = F.col("kept").between(1, 49) & (F.col("error") > 0) & (F.col("error") < F.col("raw_error"))
    return d.select("run", F.when(ok, 0).otherwise(1).alias("bad"))


@query(
    "A42_modal_energy",
    "run:i frame:i energy:5",
    sql("cells", "SELECT run, i AS frame, sum(pow(49 * v, 2)) AS energy FROM cov GROUP BY 1, 2", CENT, COV),
)
def a42(spark, sf):
    return ops.modal_energy(ops.mode_coefficients(covariance(spark, sf)))


RES = "rs AS (SELECT vec_id, CASE WHEN label % 2 = 0 THEN 'fish' ELSE 'cylinder' END AS model, i, v - avg(v) OVER (PARTITION BY vec_id) AS p FROM smp)"


def snapshots(spark, sf):
    d = frames(spark, sf)
    return d.select(
        (F.col("run") * 50 + F.col("frame")).alias("vec_id"),
        F.when(F.col("label") % 2 == 0, "fish").otherwise("cylinder").alias("model"),
        arrays.zero_mean(F.col("v")).alias("p"),
    )


@query("M07_pressure_modes", "model:s total:5 energy:6", sql("smp", "SELECT model, sum(p * p) AS total, 1 AS energy FROM rs GROUP BY 1", RES))
def m07(spark, sf):
    m = ops.pressure_modes(snapshots(spark, sf), ["model"], "p", 1.0)
    return m.groupBy("model").agg(F.sum(F.col("value") * F.col("value")).alias("total"), F.max("cumulative").alias("energy"))


@query("M08_mode_job", "energy:2 model:s mode:i value:5 cumulative:5 k:i")
def m08(spark, sf):
    d = segments(spark, sf).filter(F.col("length") >= 8)
    d = series.split_tail_spikes(d, "p").filter(~F.col("spiky"))
    d = balance(d, "model", [F.lit(-1) * F.col("length"), F.col("snapshot")], F.struct((-F.col("length")).alias("l"), F.floor(F.col("snapshot") / 1048576).alias("s")))
    d = series.resample_group(d, "p", "cubic")
    jobs = [ops.pressure_modes(d, ["model"], "p", e).withColumn("energy", F.lit(e)) for e in (0.95, 0.99)]
    return jobs[0].unionByName(jobs[1])


@query("M09_project_series", "vec_id:i energy:6", sql("smp", "SELECT vec_id, sum(p * p) AS energy FROM rs GROUP BY 1", RES))
def m09(spark, sf):
    d = snapshots(spark, sf)
    c = ops.project_series(d, ["model"], "p", ops.pressure_modes(d, ["model"], "p", 1.0))
    return c.groupBy("vec_id").agg(F.sum(F.col("coef") * F.col("coef")).alias("energy"))


@query("M10_singular_values", "run:i squares:6 count:i", sql("cells", "SELECT run, sum(v * v) AS squares, 50 AS \"count\" FROM cells GROUP BY run"))
def m10(spark, sf):
    s = ops.singular_values(frames(spark, sf))
    return s.groupBy("run").agg(F.sum(F.col("sigma") * F.col("sigma")).alias("squares"), F.count("sigma").alias("count"))


@query("M11_dynamic_modes", "run:i mode:i re:4 im:4 frequency:4 growth:4 error:5")
def m11(spark, sf):
    return ops.dynamic_modes(frames(spark, sf), 10, 0.01)


@query(
    "M12_delay_stack",
    "run:i frame:i pos:i v:6",
    sql("cells", "SELECT a.run, a.frame, k * 64 + b.cell AS pos, b.v FROM fr a, range(3) r(k) JOIN cells b ON true WHERE b.run = a.run AND b.frame = a.frame + k AND a.frame + 2 <= 49"),
)
def m12(spark, sf):
    return ops.delay_stack(frames(spark, sf), 3).select("run", "frame", F.posexplode("v").alias("pos", "v"))


STATES = ["a", "b", "c"]


# Cells 0-20, 21-41 and 42-63 of a frame make its three states.
THIRDS = [(1, 21), (22, 21), (43, 22)]


def states(spark, sf):
    return frames(spark, sf).select("run", "frame", *[arrays.total(F.slice("v", i, n)).alias(s) for s, (i, n) in zip(STATES, THIRDS)])


ST = "st AS (SELECT run, frame, list_sum(v[1:21]) AS a, list_sum(v[22:42]) AS b, list_sum(v[43:64]) AS c FROM fr)"
TERM_SQL = ", ".join(" * ".join(t) if t else "1" for t in ops.terms(STATES, 2))


@query(
    "M13_polynomial_library",
    "run:i frame:i k:i theta:6",
    sql("fr", f"SELECT run, frame, k, [{TERM_SQL}][k + 1] AS theta FROM st, range({len(ops.terms(STATES, 2))}) r(k)", ST),
)
def m13(spark, sf):
    return ops.library(states(spark, sf), STATES, 2).select("run", "frame", F.posexplode("theta").alias("k", "theta"))


def training(spark, sf, degree=2):
    return ops.library(ops.derivatives(states(spark, sf), ["run"], "frame", STATES, 0.02), STATES, degree)


@query("M14_sparse_regression", "threshold:3 term:s state:s coef:5 mse:4")
def m14(spark, sf):
    return ops.sparse_fit(training(spark, sf), STATES, 2, [0.5])


@query("M15_threshold_scan", "threshold:3 state:s active:i mse:4")
def m15(spark, sf):
    fit = ops.sparse_fit(training(spark, sf), STATES, 2, [k / 2 for k in range(10)])
    return fit.groupBy("threshold", "state").agg(F.sum((F.col("coef") != 0).cast("int")).alias("active"), F.max("mse").alias("mse"))


@query("M16_ensemble_fit", "kind:s term:s state:s mean:4 spread:4")
def m16(spark, sf):
    d = training(spark, sf)
    key = F.struct("run", "frame")
    boot = ops.ensemble_fit(d, key, STATES, 2, 0.5, 20, 42).withColumn("kind", F.lit("rows"))
    drop = ops.ensemble_fit(d, key, STATES, 2, 0.5, 0, 42, drop_terms=True).withColumn("kind", F.lit("library"))
    return boot.unionByName(drop)


def predicted(spark, sf):
    d = training(spark, sf)
    fit = ops.sparse_fit(d, STATES, 2, [0.5])
    return ops.predict_derivatives(d, fit, STATES, 2)


@query("M17_predict_derivatives", "run:i frame:i d_a:4 p_a:4 r_a:4 r_b:4 r_c:4")
def m17(spark, sf):
    return predicted(spark, sf)


@query(
    "M17_derivatives",
    "run:i frame:i d_a:5 d_b:5 d_c:5",
    sql(
        "fr",
        "SELECT x.run, x.frame, (z.a - y.a) / 0.04 AS d_a, (z.b - y.b) / 0.04 AS d_b, (z.c - y.c) / 0.04 AS d_c FROM st x JOIN st y ON y.run = x.run AND y.frame = x.frame - 1 JOIN st z ON z.run = x.run AND z.frame = x.frame + 1",
        ST,
    ),
)
def m17d(spark, sf):
    return ops.derivatives(states(spark, sf), ["run"], "frame", STATES, 0.02)


@query(
    "A41_relative_errors",
    "run:i frobenius:6 mean_relative:5",
    sql("uv", "SELECT run, sqrt(sum(pow(u - w, 2)) / sum(u * u)) AS frobenius, avg(d / s) AS mean_relative FROM (SELECT run, u, w, pow(u - w, 2) AS d, u * u AS s FROM uv) GROUP BY run"),
)
def a41(spark, sf):
    d = velocity(spark, sf).select("run", F.inline(F.arrays_zip("u", "w")))
    return ops.relative_errors(d, ["run"], ["u"], ["w"])


# --- what must hold of decompositions and fits ---------------------------------------------------

ALL_RUNS = "SELECT DISTINCT run, 0 AS bad FROM fr"
EACH_STATE = "SELECT state, 0 AS bad FROM (VALUES ('a'), ('b'), ('c')) s(state)"


@query("M02_coefficient_energy", "run:i energy:4", sql("cells", "SELECT run, sum(pow(49 * v, 2)) AS energy FROM cov GROUP BY 1", CENT, COV))
def m02_energy(spark, sf):
    """The squares of all coefficients add up to those of the covariance's entries."""
    return m02c(spark, sf).groupBy("run").agg(F.sum(F.col("a") * F.col("a")).alias("energy"))


@query("M03_needed_bounds", "run:i bad:i", sql("fr", ALL_RUNS))
def m03_bounds(spark, sf):
    """The count with the crossing mode is the printed one plus 1, and the modes before it do not reach the target."""
    s = ops.mode_energy(covariance(spark, sf).eigen())
    d = s.join(m03n(spark, sf), "run").groupBy("run").agg(
        F.max(F.when(F.col("mode") == F.col("needed") - 1, F.col("cumulative"))).alias("at"),
        F.coalesce(F.max(F.when(F.col("mode") == F.col("needed") - 2, F.col("cumulative"))), F.lit(0.0)).alias("below"),
        F.max(F.col("needed") - F.col("printed")).alias("step"),
    )
    return d.select("run", F.when((F.col("at") >= 0.95 - 1e-9) & (F.col("below") < 0.95) & (F.col("step") == 1), 0).otherwise(1).alias("bad"))


@query("M05_sweep_cells", "re:i h:i runs:i bad:i", sql("fr", "SELECT re, h, count(*) AS runs, 0 AS bad FROM (SELECT DISTINCT 1000 * (1 + run % 3) AS re, 1 + run // 3 AS h FROM fr) GROUP BY CUBE (re, h)"))
def m05_cells(spark, sf):
    ok = (F.col("n99") >= F.col("n95")) & F.col("first_energy").between(0, 1) & (F.col("error") >= 0)
    return m05(spark, sf).withColumn("bad", F.when(ok, 0).otherwise(1))


@query("M08_mode_bounds", "energy:2 model:s bad:i", "SELECT energy, model, 0 AS bad FROM (VALUES (0.95), (0.99)) e(energy), (VALUES ('fish'), ('cylinder')) m(model)")
def m08_bounds(spark, sf):
    """As many modes as it says, values that fall, and the target reached by the last mode only."""
    e = F.col("energy")
    d = m08(spark, sf).groupBy("energy", "model").agg(
        F.count(F.lit(1)).alias("n"), F.max("k").alias("k"), F.max("cumulative").alias("top"),
        F.max(F.when(F.col("mode") < F.col("k") - 1, F.col("cumulative"))).alias("below"),
        F.max(F.struct("mode", "value"))["value"].alias("last"), F.min("value").alias("least"),
    )
    ok = (F.col("n") == F.col("k")) & (F.col("top") >= e - 1e-9) & (F.coalesce("below", F.lit(0.0)) < e) & (F.col("last") == F.col("least"))
    return d.select("energy", "model", F.when(ok, 0).otherwise(1).alias("bad"))


@query("M11_conjugates", "run:i modes:i bad:i", sql("fr", "SELECT DISTINCT run, 10 AS modes, 0 AS bad FROM fr"))
def m11_conjugates(spark, sf):
    """Eigenvalues of a real operator: their imaginary parts cancel, and the one-step error is a share."""
    d = m11(spark, sf).groupBy("run").agg(F.count(F.lit(1)).alias("modes"), F.abs(F.sum("im")).alias("im"), F.min("error").alias("low"), F.max("error").alias("high"))
    return d.select("run", "modes", F.when((F.col("im") < 1e-8) & F.col("low").between(0, 1.01) & F.col("high").between(0, 1.01), 0).otherwise(1).alias("bad"))


def kept_terms(fit):
    """The coefficients of a fit as one array per state, in the order of the terms."""
    order = {ops.term_name(t): i for i, t in enumerate(ops.terms(STATES, 2))}
    rank = F.element_at(F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))]), F.col("term"))
    return fit.select("state", rank.alias("k"), "coef")


@query("M14_normal_equations", "state:s bad:i", EACH_STATE)
def m14_normal(spark, sf):
    """The residual is orthogonal to every kept term, and kept coefficients are no smaller than the threshold."""
    d = written(training(spark, sf), "library")
    fit = ops.sparse_fit(d, STATES, 2, [0.5])
    rest = F.array(*[F.struct(F.lit(s).alias("state"), F.col(f"r_{s}").alias("r"), F.col(f"d_{s}").alias("d")) for s in STATES])
    long = ops.predict_derivatives(d, fit, STATES, 2).select("theta", F.explode(rest).alias("s")).select("s.*", F.posexplode("theta").alias("k", "t"))
    g = long.groupBy("state", "k").agg(F.sum(F.col("t") * F.col("r")).alias("tr"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("d") * F.col("d")).alias("dd"))
    j = g.join(kept_terms(fit), ["state", "k"])
    kept = F.col("coef") != 0
    wrong = kept & ((F.abs("coef") < 0.5) | (F.abs("tr") > 1e-7 * F.sqrt(F.col("tt") * F.col("dd"))))
    return j.groupBy("state").agg(F.count_if(wrong).alias("bad"))


@query("M15_scan_order", "state:s bad:i", EACH_STATE)
def m15_order(spark, sf):
    """Without a threshold all terms stay, and no sparser model has a smaller error."""
    d = m15(spark, sf)
    full = d.filter("threshold = 0").select("state", F.col("mse").alias("least"), F.col("active").alias("all"))
    wrong = (F.col("mse") < F.col("least") * (1 - 1e-9)) | (F.col("active") > F.col("all")) | (F.col("all") != len(ops.terms(STATES, 2)))
    return d.join(full, "state").groupBy("state").agg(F.count_if(wrong).alias("bad"))


@query("M16_coverage", "kind:s n:i bad:i", "SELECT kind, 30 AS n, 0 AS bad FROM (VALUES ('rows'), ('library')) k(kind)")
def m16_coverage(spark, sf):
    ok = F.col("mean").isNotNull() & (F.col("spread") >= 0)
    return m16(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("bad"))


@query("M17_residuals", "run:i n:i bad:i", sql("fr", "SELECT run, count(*) - 2 AS n, 0 AS bad FROM fr GROUP BY run"))
def m17_residuals(spark, sf):
    """A row for every frame with both neighbours; derivative = prediction + residual."""
    off = sum((F.abs(F.col(f"d_{c}") - F.col(f"p_{c}") - F.col(f"r_{c}")) for c in STATES), F.lit(0.0))
    return predicted(spark, sf).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.count_if(off.isNull() | (off > 1e-9)).alias("bad"))

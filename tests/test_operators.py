"""Operators on small frames against pandas, numpy or plain loops."""

import math
import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import SF
from wakeframe.functions import arrays, geometry as geo, text
from wakeframe.functions.filters import butterworth, both_ways
from wakeframe.functions.grid import Grid
from wakeframe.operators import contours, fields, filters, gradient, grids, learn, linking, modal, ordering, processes, similarity, tracks
from wakeframe.plans import views
from wakeframe.plans.vortices import raw_regions
from wakeframe.session import scratch, written
from wakeframe.sources import growing, scans, sinks
from wakeframe.streaming import live

RNG = np.random.default_rng(11)


@pytest.fixture(scope="module")
def skewed(spark):
    """A key that holds two thirds of the rows."""
    n = 600
    pdf = pd.DataFrame(
        {"k": np.where(np.arange(n) % 3 < 2, "hot", "cold"), "t": RNG.permutation(n) * 7.0, "v": RNG.normal(size=n)}
    )
    return pdf, spark.createDataFrame(pdf)


def ordered(pdf):
    return pdf.sort_values(["k", "t"]).reset_index(drop=True)


def test_index_rows_under_skew(skewed):
    pdf, df = skewed
    got = ordered(ordering.index_rows(df, ["k"], ["t"], F.floor(F.col("t") / 100)).toPandas())
    want = ordered(pdf)
    np.testing.assert_array_equal(got["n"], want.groupby("k").cumcount())


def test_previous_row_crosses_empty_blocks(skewed):
    pdf, df = skewed
    got = ordered(ordering.previous_row(df, ["k"], ["t"], F.floor(F.col("t") / 3), ["v"]).toPandas())
    want = ordered(pdf)
    np.testing.assert_allclose(got["prev_v"], want.groupby("k")["v"].shift(1))


def test_running_sums(skewed):
    pdf, df = skewed
    got = ordered(ordering.running(df, ["k"], ["t"], F.floor(F.col("t") / 50), {"s": F.col("v")}).toPandas())
    np.testing.assert_allclose(got["s"], ordered(pdf).groupby("k")["v"].cumsum())


def test_windowed_blocks_see_their_halo(skewed):
    pdf, df = skewed
    d = ordering.index_rows(df, ["k"], ["t"], F.floor(F.col("t") / 100))
    got = ordered(ordering.windowed(d, ["k"], "n", 4, 2, lambda w: {"m": F.avg("v").over(w.rowsBetween(-4, 2))}, size=16).toPandas())
    full = ordered(pdf).groupby("k")["v"].transform(lambda s: pd.Series([s.iloc[max(0, i - 4) : i + 3].mean() for i in range(len(s))], index=s.index))
    np.testing.assert_allclose(got["m"], full)


@pytest.mark.parametrize("size", [7, 64, 100000])
def test_chunked_zero_phase_equals_whole_channel(spark, size):
    x = {"a": RNG.normal(size=331), "b": RNG.normal(size=60)}
    rows = [(k, i, float(v)) for k, s in x.items() for i, v in enumerate(s)]
    b, a = butterworth(2, (0.3, 9.0), "band", 100.0)
    got = filters.zero_phase(spark.createDataFrame(rows, "channel string, n bigint, p double"), ["channel"], b, a, size=size).toPandas()
    for k, s in x.items():
        y = got[got["channel"] == k].sort_values("n")["p"].to_numpy()
        np.testing.assert_allclose(y, both_ways(s[None], b, a)[0], atol=1e-9)


def test_zero_phase_rejects_short_channels(spark):
    df = spark.createDataFrame([("a", i, 1.0) for i in range(9)], "channel string, n bigint, p double")
    with pytest.raises(Exception, match="edge extension"):
        filters.zero_phase(df, ["channel"], *butterworth(2, 5.0, "low", 100.0)).collect()


def plane(spark, fu, fw, n=8):
    x, y = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    return spark.createDataFrame([(0, 0, fu(x, y).ravel().astype(float).tolist(), fw(x, y).ravel().astype(float).tolist())], "run int, frame int, u array<double>, w array<double>")


def test_q_of_rotation_and_shear(spark):
    grid = Grid(8, 8)
    spin = fields.q_criterion(plane(spark, lambda x, y: -y, lambda x, y: x), grid).first()["q"]
    assert np.allclose(spin, 1.0)
    shear = fields.q_criterion(plane(spark, lambda x, y: y, lambda x, y: 0 * x), grid).first()["q"]
    assert np.allclose(shear, 0.0)


def test_islands_partition_the_active_frames(spark):
    act = [(0, f) for f in (1, 2, 3, 7, 9, 10)] + [(1, 0)]
    got = tracks.islands(spark.createDataFrame(act, "run int, frame int"), ["run"]).collect()
    assert sorted((r["run"], r["start_frame"], r["end_frame"], r["length"]) for r in got) == [(0, 1, 3, 3), (0, 7, 7, 1), (0, 9, 10, 2), (1, 0, 0, 1)]


def link_loop(dets, max_distance, max_gap):
    """Detections {frame: [(region, x, y)]} linked one by one."""
    live_tracks, fresh, out = {}, 0, {}
    for frame in sorted(dets):
        rows = dets[frame]
        offers = []
        for tid, (f, x, y) in sorted(live_tracks.items()):
            if frame - f > max_gap:
                continue
            d = [np.hypot(x - a, y - b) for _, a, b in rows]
            k = int(np.argmin(d))
            if d[k] < max_distance:
                offers.append((d[k], tid, k))
        taken = {}
        for d, tid, k in sorted(offers):
            if k not in taken and tid not in taken.values():
                taken[k] = tid
        for k, (region, x, y) in enumerate(rows):
            if k not in taken:
                taken[k] = fresh
                fresh += 1
        for k, (region, x, y) in enumerate(rows):
            out[(frame, region)] = taken[k]
            live_tracks[taken[k]] = (frame, x, y)
    return out


def test_tracking_matches_loop_batch_and_stream(spark):
    rows = []
    for run in range(3):
        for frame in [f for f in range(30) if not 10 <= f < 10 + 3 * run]:
            for region in range(RNG.integers(1, 5)):
                rows.append((run, frame, region, float(RNG.integers(0, 12)), float(RNG.integers(0, 12))))
    df = spark.createDataFrame(rows, "run int, frame int, region int, core_x double, core_y double")
    want = {}
    for run in range(3):
        dets = {}
        for r, f, region, x, y in rows:
            if r == run:
                dets.setdefault(f, []).append((region, x, y))
        want |= {(run, *k): v for k, v in link_loop(dets, 3.0, 2).items()}
    key = lambda r: (r["run"], r["frame"], r["region"])
    got = {key(r): r["track_id"] for r in linking.assign_tracks(df, 3.0, 2).collect()}
    assert got == want
    timed = df.withColumn("ts", live.frame_time(F.col("frame")))
    # In one batch, and in one of many files: a frame's rows may come in two of them while the watermark waits.
    for parts, delay in (([timed], "0 seconds"), ([timed.filter(f"frame DIV 4 = {k}") for k in range(8)], "0 seconds")):
        folder = scratch(spark, "test")
        for part in parts:
            part.coalesce(1).write.parquet(folder + "/in", mode="append")
        feed = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
        with live.state_in_rocksdb(spark):
            out = live.run_to_table(live.track_stream(feed, 3.0, 2, delay=delay), folder + "/out", folder + "/state")
        assert {key(r): r["track_id"] for r in out.collect()} == want


def test_frames_in_parts_and_silent_runs_of_a_stream(spark):
    """Frames come in halves and out of order within the delay; run 0 falls silent and leaves the state."""
    rows = [(run, f, k, float(10 * k + f % 3), float(run)) for run in (0, 1) for f in range(40) for k in range(3) if run or f < 12]
    df = spark.createDataFrame(rows, "run int, frame int, region int, core_x double, core_y double").withColumn("ts", live.frame_time(F.col("frame")))
    folder = scratch(spark, "test")
    for low in range(0, 40, 5):
        part = df.filter(F.col("frame").between(low, low + 4))
        for half in (part.filter("(region + frame) % 2 = 0"), part.filter("(region + frame) % 2 = 1")):
            half.orderBy(F.desc("frame")).coalesce(1).write.parquet(folder + "/in", mode="append")
    end = spark.createDataFrame([(9, 60, 0, 0.0, 0.0)], "run int, frame int, region int, core_x double, core_y double").withColumn("ts", live.frame_time(F.col("frame")))
    end.coalesce(1).write.parquet(folder + "/in", mode="append")
    feed = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    with live.state_in_rocksdb(spark):
        out = live.run_to_table(live.track_stream(feed, 3.0, 2, delay="6 seconds"), folder + "/out", folder + "/state")
        live_rows = spark.read.format("statestore").option("path", folder + "/state").option("stateVarName", "live").load()
        waiting = spark.read.format("statestore").option("path", folder + "/state").option("stateVarName", "waiting").load()
        told = spark.read.format("statestore").option("path", folder + "/state").option("stateVarName", "told").load()
        assert live_rows.count() == 0 and waiting.count() == 1 and told.count() == 2
    assert {(r["run"], r["frame"], r["region"]): r["track_id"] for r in out.collect()} == {(r, f, k): k for r, f, k, _, _ in rows}


@pytest.mark.parametrize("frames", [1, 3, 50])
def test_tracks_of_a_recording_without_silences_in_slices(spark, frames):
    """Whole coordinates, so that equal distances between tracks of unknown order come up; one crowded run, one sparse."""
    rng, rows = np.random.default_rng(12), []
    for run, per, box in ((0, 6, 9), (1, 2, 30)):
        for frame in range(150):
            for region in range(rng.integers(1, per + 1)):
                rows.append((run, frame, region, float(rng.integers(0, box)), float(rng.integers(0, box))))
    want = {}
    for run in (0, 1):
        dets = {}
        for r, f, region, x, y in rows:
            if r == run:
                dets.setdefault(f, []).append((region, x, y))
        want |= {(run, *k): v for k, v in link_loop(dets, 4.0, 3).items()}
    df = spark.createDataFrame(rows, "run int, frame int, region int, core_x double, core_y double")
    got = {(r["run"], r["frame"], r["region"]): r["track_id"] for r in linking.assign_tracks(df, 4.0, 3, frames).collect()}
    assert got == want


def test_tracks_outlive_empty_slices(spark):
    rows = [(0, f, 0, 1.0, 1.0) for f in (0, 1, 40, 41, 80, 200, 201)] + [(0, f, 1, 5.0, 5.0) for f in (41, 200)]
    df = spark.createDataFrame(rows, "run int, frame int, region int, core_x double, core_y double")
    got = {(r["frame"], r["region"]): r["track_id"] for r in linking.assign_tracks(df, 2.0, 50, 3).collect()}
    assert got == {(0, 0): 0, (1, 0): 0, (40, 0): 0, (41, 0): 0, (41, 1): 1, (80, 0): 0, (200, 0): 2, (200, 1): 3, (201, 0): 2}
    assert linking.assign_tracks(df.limit(0), 2.0, 50, 3).collect() == []


def test_tracking_in_order_matches_loop(spark):
    rows = [(0, f, int(RNG.integers(0, 10)), int(RNG.integers(0, 10)), float(RNG.choice([-1, 1]) * (i + 1))) for f in range(12) for i in range(RNG.integers(0, 4))]
    df = spark.createDataFrame(rows, "run int, frame int, x int, y int, value double")
    got = {(r["frame"], r["x"], r["y"], r["value"]): r["track_id"] for r in tracks.assign_tracks_in_order(df, 4.0).collect()}
    heads, want = [], {}
    for f in sorted({r[1] for r in rows}):
        here = sorted([r for r in rows if r[1] == f], key=lambda r: (r[4] < 0, r[2], r[3]))
        used, start = {}, len(heads)
        for t in range(start):
            d = [np.hypot(heads[t][0] - r[2], heads[t][1] - r[3]) for r in here]
            k = int(np.argmin(d))
            if d[k] < 4.0 and k not in used:
                used[k] = t
        for k, r in enumerate(here):
            if k not in used:
                used[k] = len(heads)
                heads.append(None)
            heads[used[k]] = (r[2], r[3])
            want[(f, r[2], r[3], r[4])] = used[k]
    assert got == want


@pytest.fixture(scope="module")
def flow(spark):
    data = RNG.normal(size=(2, 6, 12))
    rows = [(r, f, data[r, f].tolist()) for r in range(2) for f in range(6)]
    return data, spark.createDataFrame(rows, "run int, frame int, v array<double>")


def test_pod_matches_numpy(flow):
    data, df = flow
    cov = modal.Covariance(modal.cell_blocks(df, size=5, span=4))
    spec = modal.mode_energy(cov.eigen()).toPandas()
    errors = {r["run"]: r for r in modal.reconstruction_error(cov, modal.cell_counts(df), 0.8).collect()}
    needed = {r["run"]: r for r in modal.modes_needed(modal.mode_energy(cov.eigen()), ["run"], 0.8).collect()}
    for run in range(2):
        y = (data[run] - data[run].mean(axis=0)).T
        values, vectors = np.linalg.eigh(y.T @ y / 5)
        values, vectors = values[::-1], vectors[:, ::-1]
        one = spec[spec["run"] == run].sort_values("mode")
        np.testing.assert_allclose(one["value"], np.maximum(values, 0), atol=1e-10)
        assert one["energy"].sum() == pytest.approx(1)
        k = int(np.argmax(np.cumsum(values) / values.sum() >= 0.8))
        assert needed[run]["needed"] == k + 1 and errors[run]["kept"] == k
        rest = y - y @ vectors[:, :k] @ vectors[:, :k].T
        assert errors[run]["error"] == pytest.approx(np.sqrt((rest**2).mean(axis=0)).mean())


def test_shift_mode_basis_is_orthonormal(spark, flow):
    data, df = flow
    starts = spark.createDataFrame([(0, 1), (1, 2)], "run int, start int")
    basis = modal.shift_mode_basis(df, starts, 4)
    coef = modal.project_frames(df, basis).toPandas()
    for run, part in modal.block_cells(basis, "phi").toPandas().groupby("run"):
        m = np.stack(part.sort_values("cell")["phi"].to_numpy())
        np.testing.assert_allclose(m.T @ m, np.eye(4), atol=1e-8)
        a = coef[coef["run"] == run].sort_values(["frame", "mode"])["a"].to_numpy().reshape(6, 4)
        np.testing.assert_allclose(a, data[run] @ m, atol=1e-9)


def test_pressure_modes_match_svd(spark):
    x = RNG.normal(size=(40, 10))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, p array<double>")
    got = modal.pressure_modes(df, [], "p", 0.9).toPandas().sort_values("mode")
    s = np.linalg.svd(x.T, compute_uv=False)
    k = int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), 0.9) + 1)
    assert len(got) == k
    np.testing.assert_allclose(got["value"], s[:k])


def test_modes_of_a_recording_longer_than_a_task(spark):
    """5000 frames in spans, a short run beside them; no row holds all frames of the long one."""
    rng = np.random.default_rng(31)
    shapes = {0: rng.normal(size=(5000, 60)) * 0.8 ** np.arange(60) @ rng.normal(size=(60, 40)) + 3, 1: rng.normal(size=(30, 40))}
    df = spark.createDataFrame(pd.DataFrame([(r, f, v.tolist()) for r, m in shapes.items() for f, v in enumerate(m)], columns=["run", "frame", "v"]), "run int, frame int, v array<double>")
    rows = written(modal.cell_blocks(df, size=16), "test-blocks")
    assert rows.agg(F.max(F.size("frames"))).first()[0] == modal.FRAME_BLOCK
    cov = modal.Covariance(rows)
    assert cov.tiles.agg(F.max(F.size("g"))).first()[0] <= modal.FRAME_BLOCK**2
    pairs = cov.eigen(20).toPandas()
    cells = modal.project_cells(rows, cov.eigen(20)).toPandas()
    for run, m in shapes.items():
        y = m - m.mean(axis=0)
        u, s, vt = np.linalg.svd(y, full_matrices=False)
        value = s**2 / (len(m) - 1)
        own = pairs[(pairs["run"] == run) & (pairs["mode"] < 20)]
        got = own.drop_duplicates("mode").sort_values("mode")["value"].to_numpy()
        np.testing.assert_allclose(got, value[:20], atol=1e-8 * value[0])
        vectors = np.column_stack([np.concatenate(own[own["mode"] == k].sort_values("span")["u"].tolist()) for k in range(20)])
        np.testing.assert_allclose(np.abs((vectors * u[:, :20]).sum(axis=0)), 1, atol=1e-6)
        phi = np.stack(cells[cells["run"] == run].sort_values("cell")["phi"].tolist())[:, :20]
        np.testing.assert_allclose(np.abs(phi), np.abs(y.T @ u[:, :20]), atol=1e-5 * s[0])
    errors = {r["run"]: r for r in modal.reconstruction_error(cov, modal.cell_counts(df), 0.9).collect()}
    y = shapes[0] - shapes[0].mean(axis=0)
    u, s, vt = np.linalg.svd(y, full_matrices=False)
    k = int(np.argmax(np.cumsum(s**2) / (s**2).sum() >= 0.9))
    rest = y - u[:, :k] @ (u[:, :k].T @ y)
    assert errors[0]["kept"] == k and errors[0]["error"] == pytest.approx(np.sqrt((rest**2).mean(axis=1)).mean(), rel=1e-6)


def test_dynamic_modes_of_a_long_recording(spark):
    t = np.arange(2600)[:, None]
    data = np.cos(0.3 * t) * np.arange(1, 9) + np.sin(0.3 * t) * np.arange(8, 0, -1)
    df = spark.createDataFrame(pd.DataFrame({"run": 0, "frame": t.ravel() + 7, "v": list(data)}), "run int, frame int, v array<double>")
    got = modal.dynamic_modes(df, 2, 0.1).toPandas()
    np.testing.assert_allclose(np.sort(got["frequency"]), np.array([-3.0, 3.0]) / (2 * np.pi), atol=1e-6)
    assert got["error"].max() < 1e-5


def test_dynamic_modes_find_the_eigenvalues(spark):
    a = np.array([[0.9, -0.3], [0.3, 0.9]])
    x, frames = np.array([1.0, 0.5]), []
    lift = RNG.normal(size=(12, 2))
    for f in range(8):
        frames.append((0, f, (lift @ x).tolist()))
        x = a @ x
    got = modal.dynamic_modes(spark.createDataFrame(frames, "run int, frame int, v array<double>"), 2, 0.1).toPandas()
    np.testing.assert_allclose(sorted(got["im"]), [-0.3, 0.3], atol=1e-6)
    np.testing.assert_allclose(got["re"], 0.9, atol=1e-6)
    assert got["error"].max() < 1e-5


def test_identification_recovers_a_rotation(spark):
    t = np.arange(400) * 0.01
    rows = [(r, i, float(np.cos(2 * v + r)), float(np.sin(2 * v + r))) for r in range(2) for i, v in enumerate(t)]
    df = spark.createDataFrame(rows, "run int, n int, x double, y double")
    d = modal.library(modal.derivatives(df, ["run"], "n", ["x", "y"], 0.01), ["x", "y"], 1)
    fit = {(r["term"], r["state"]): r["coef"] for r in modal.sparse_fit(d, ["x", "y"], 1, [0.5]).collect()}
    assert fit[("y", "x")] == pytest.approx(-2, abs=1e-3) and fit[("x", "y")] == pytest.approx(2, abs=1e-3)
    assert fit[("x", "x")] == 0 and fit[("1", "y")] == 0
    ens = {(r["term"], r["state"]): r for r in modal.ensemble_fit(d, F.struct("run", "n"), ["x", "y"], 1, 0.5, 5, 1).collect()}
    assert ens[("y", "x")]["mean"] == pytest.approx(-2, abs=1e-2) and ens[("y", "x")]["spread"] < 0.01
    pred = modal.predict_derivatives(d, modal.sparse_fit(d, ["x", "y"], 1, [0.5]), ["x", "y"], 1).toPandas()
    assert pred["r_x"].abs().max() < 1e-2


def test_pair_matrix_tiles_cover_the_triangle(spark):
    x = RNG.normal(size=(11, 5))
    df = spark.createDataFrame([("k", i, r.tolist()) for i, r in enumerate(x)], "key string, id int, v array<double>")
    got = similarity.symmetrise(similarity.pair_matrix(df, ["key"], "id", "v", metric=lambda a, b: a @ b.T, block=3)).toPandas()
    m = np.full((11, 11), np.nan)
    m[got["a"], got["b"]] = got["value"]
    assert len(got) == 121
    np.testing.assert_allclose(m, x @ x.T)


def test_neighbours_and_oversampling(spark):
    x = RNG.normal(size=(30, 3))
    rows = [(i, int(i >= 20), r.tolist()) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id bigint, y int, v array<double>")
    near = {r["item"]: r["neighbours"] for r in learn.bucketed_neighbours(df, "id", "v", 4).collect()}
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    for i in range(30):
        assert sorted(near[i]) == sorted(np.argsort(d[i])[:4].tolist())
    assert learn.oversample(df, "id", "v", "y", 7, 5, 4, 5).collect() == [] and learn.oversample(df, "id", "v", "y", 1, 0, 4, 5).collect() == []
    extra = learn.oversample(df, "id", "v", "y", 1, 10 + 3, 4, 5).collect()
    assert len(extra) == 13 and {r["base"] for r in extra} == set(range(20, 30))
    for r in extra:
        a, b, v = x[r["base"]], x[r["near"]], np.array(r["v"])
        u = (v - a)[0] / (b - a)[0]
        assert 0 <= u < 1 and np.allclose(v, a + u * (b - a))


def test_predictive_deviation_matches_dense(spark):
    cand = spark.createDataFrame([(i, float(i), float(i % 3)) for i in range(9)], "idx int, a double, b double")
    train = spark.createDataFrame([(0.0, 0.0), (4.0, 1.0), (8.0, 2.0)], "a double, b double")
    got = learn.predictive_deviation(cand, train, (2.0, 1.0)).toPandas()
    z = np.array([[0, 0], [2, 1], [4, 2]], float)
    k = lambda p, q: np.exp(-0.5 * ((p[:, None] - q[None]) ** 2).sum(-1))
    q = got[["a", "b"]].to_numpy() / [2, 1]
    want = np.sqrt(np.maximum(1 - np.einsum("ij,jk,ik->i", k(q, z), np.linalg.inv(k(z, z) + 1e-10 * np.eye(3)), k(q, z)), 0))
    np.testing.assert_allclose(got["std"], want, atol=1e-5)
    used = cand.filter("idx = 2")
    best = learn.next_parameters(learn.predictive_deviation(cand, train, (2.0, 1.0)), used, "std").first()
    assert best["idx"] == got[got["idx"] != 2].sort_values(["std", "idx"], ascending=[False, True])["idx"].iloc[0]


def test_bucketed_neighbours_find_most(spark):
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(60, 1, 6)) * 4 + rng.normal(size=(60, 40, 6))).reshape(-1, 6)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>").repartition(6)
    true = np.argsort(((x[:, None] - x[None]) ** 2).sum(-1) + np.diag(np.full(len(x), np.inf)), axis=1)[:, :5]
    for rows, least in ((4000, 1.0), (300, 0.9)):
        got = {r["item"]: r["neighbours"] for r in learn.bucketed_neighbours(df, "id", "v", 5, rows=rows).collect()}
        assert len(got) == len(x) and all(len(v) == 5 and i not in v for i, v in got.items())
        recall = np.mean([len(set(got[i]) & set(true[i])) / 5 for i in range(len(x))])
        assert recall >= least - 1e-9, (rows, recall)
    same = spark.range(90).selectExpr("id", "array(1.0D, 2.0D) AS v")
    assert learn.bucketed_neighbours(same, "id", "v", 3, rows=10).count() == 90
    assert learn.bucketed_neighbours(same.limit(0), "id", "v", 3).count() == 0


def test_bucketed_neighbours_miss_none(spark):
    """64 dimensions, one hot cluster, one group of copies, and many buckets: what all pairs give."""
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(size=(1500, 64)), 3 + 0.05 * rng.normal(size=(1200, 64)), rng.normal(size=(30, 1, 64)).repeat(30, 1).reshape(-1, 64) * 4 + 0.2 * rng.normal(size=(900, 64)), np.full((300, 64), -2.0)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, v array<double>").repartition(6)
    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, np.inf)
    want = np.sort(d, axis=1)[:, :5]
    got = {r["item"]: r["neighbours"] for r in learn.bucketed_neighbours(df, "id", "v", 5, rows=128).collect()}
    assert len(got) == len(x) and all(len(set(v)) == 5 and i not in v for i, v in got.items())
    np.testing.assert_allclose([np.sqrt(((x[got[i]] - x[i]) ** 2).sum(1)) for i in range(len(x))], want, atol=1e-5)


def test_classifiers_read_the_whole_embedding(spark, tmp_path):
    """Labels follow from the last of 64 values alone."""
    from wakeframe.plans import learn as plans

    x = np.random.default_rng(6).normal(size=(400, 64))
    x[:, 63] += np.where(x[:, 63] > 0, 1.0, -1.0)
    rows = [(i, int(v[63] > 0), v.tolist()) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = plans.l04(spark, str(tmp_path)).filter("part <> 'train'").select((F.col("pred") == F.col("label")).alias("right"), "loss").collect()
    assert {r.loss for r in got} == {"mse", "bce"} and np.mean([r.right for r in got]) > 0.9
    assert min(r.val_loss for r in plans.l06(spark, str(tmp_path)).collect()) < 0.3


def test_a_frame_in_parts_is_linked_once():
    linker = tracks.Linker(3.0, 2)
    first, _ = linker.step(0, np.array([[0.0, 0.0], [5.0, 5.0]]))
    one, _ = linker.step(1, np.array([[0.1, 0.0]]))
    two, _ = linker.step(1, np.array([[0.2, 0.0], [5.1, 5.0]]))
    assert one[0] == first[0] and two[1] == first[1] and two[0] not in first


def test_nearest_interval_widens_until_found(spark):
    rng = np.random.default_rng(8)
    spot = lambda n, wide: [(int(k % 3), i, int(s), int(s + rng.integers(1, 50))) for i, (k, s) in enumerate(zip(rng.integers(0, 4, n), rng.integers(0, wide, n)))]
    preds, metas = spot(120, 5000), [m for m in spot(40, 100_000) if m[0] != 2] + [(0, 900, 10, 20), (0, 901, 10, 20)]
    p = spark.createDataFrame(preds, "key int, id int, start_frame int, end_frame int")
    m = spark.createDataFrame(metas, "key int, idx int, start_frame int, end_frame int")
    got = {r.id: (r.cost, r.idx) for r in learn.match_nearest_interval(p, m, ["key"], ["id"], "idx", reach=4).collect()}
    want = {}
    for key, i, s, e in preds:
        own = [(abs(ms - s) + abs(me - e), j) for k, j, ms, me in metas if k == key]
        if own:
            want[i] = min(own)
    assert got == want and len(want) < len(preds)


def test_deviation_from_many_experiments_needs_few(spark):
    """Any number of training points: the thinned basis gives what the dense formula gives on a part of them."""
    rng = np.random.default_rng(5)
    points = rng.uniform(0, 6, (3000, 2))
    train = spark.createDataFrame([(float(a), float(b)) for a, b in points] + [(None, 1.0)], "a double, b double").repartition(5)
    basis = learn.training_basis(train, (2.0, 2.0))
    assert 20 < len(basis) < 200
    cand = spark.createDataFrame([(i, 5.5 + 0.6 * (i % 3), 1.5 * (i // 3)) for i in range(9)], "idx int, a double, b double")
    got = learn.predictive_deviation(cand, train, (2.0, 2.0)).orderBy("idx").toPandas()
    z, q = points / 2, got[["a", "b"]].to_numpy() / 2
    k = lambda p, r: np.exp(-0.5 * ((p[:, None] - r[None]) ** 2).sum(-1))
    want = np.sqrt(np.maximum(1 - np.einsum("ij,ji->i", k(q, z), np.linalg.solve(k(z, z) + 1e-8 * np.eye(len(z)), k(q, z).T)), 0))
    np.testing.assert_allclose(got["std"], want, atol=0.02)
    assert learn.predictive_deviation(cand, train.limit(0), (2.0, 2.0)).filter("std <> 1").count() == 0


def test_used_candidates_and_the_random_one(spark):
    bounds = spark.createDataFrame([(0.0, 9.0, 0.0, 19.0)], "a_lo double, a_hi double, b_lo double, b_hi double")
    grid = learn.candidate_grid(bounds, 10, 20)
    assert grid.count() == 200 and grid.rdd.getNumPartitions() > 1
    done = spark.createDataFrame([(3.2, 4.6), (2.9, 5.4), (100.0, -3.0)], "a double, b double")
    used = learn.grid_index(done, bounds, 10, 20)
    assert sorted(r.idx for r in used.collect()) == [65, 180]
    scored = grid.withColumn("s", F.when(F.col("idx") == 65, 9.0).when(F.col("idx") == 7, 5.0).otherwise(1.0))
    assert learn.next_parameters(scored, used, "s").first().idx == 7
    drawn = learn.next_or_random(scored, used, "s").first()
    assert drawn.fallback and drawn.idx not in (65, 180)
    assert not learn.next_or_random(scored, used.filter("idx = 180"), "s").first().fallback
    assert learn.next_or_random(scored, grid, "s").count() == 0


def test_closed_loop_makes_whole_runs_of_parts(spark):
    """A run spread over two batches gets the metrics of all of its rows."""
    rows = [(re, 1, sensor, float(t), float((re * 7 + sensor * 3 + t * t) % 11)) for re in (1, 2) for sensor in (0, 1) for t in range(12)]
    folder, source = scratch(spark, "loop"), scratch(spark, "loop-in")
    for part in (0, 1):
        some = [r for r in rows if r[3] % 2 == part]
        spark.createDataFrame(some, "re int, h int, sensor int, t double, p double").coalesce(1).write.mode("append").parquet(source)
    feed = spark.readStream.schema("re int, h int, sensor int, t double, p double").option("maxFilesPerTrigger", 1).parquet(source)
    bounds = spark.createDataFrame([(1.0, 2.0, 0.0, 2.0)], "a_lo double, a_hi double, b_lo double, b_hi double")
    grid = learn.candidate_grid(bounds, 3, 3)
    fit = lambda d: processes.fit_process(d, ["f_re", "f_h"], (1.0, 1.0), ((0.1, 10.0), (0.1, 10.0)), restarts=2)
    index = lambda d: learn.grid_index(d, bounds, 3, 3)
    live.closed_loop(feed, grid, index, folder, fit, 1e-9, scratch(spark, "loop-state")).awaitTermination()
    got = live.latest_metrics(spark, folder)
    whole = spark.createDataFrame(rows, "re int, h int, sensor int, t double, p double")
    want = similarity.time_of_minimum(whole, ["re", "h"], "sensor", "t", "p").join(similarity.peak_to_peak(whole, ["re", "h"], "sensor", "p"), ["re", "h"])
    assert spark.read.parquet(folder + "/next").select("batch").distinct().count() == 2
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    # Of each sensor and batch, the first minimum and the maximum; nothing after the threshold is passed.
    assert spark.read.parquet(folder + "/rows").groupBy("batch", "re", "h", "sensor").count().filter("count > 2").isEmpty()
    short = scratch(spark, "loop-short")
    live.closed_loop(feed, grid, index, short, fit, 1.5, scratch(spark, "loop-short-state")).awaitTermination()
    assert [r.batch for r in spark.read.parquet(short + "/next").collect()] == [0]


def dense_fit(x, y, bounds, noise):
    """Scales of highest likelihood by a grid that closes in on the best cell, and that likelihood."""

    def value(la, lb):
        d = (x[:, None] - x[None]) / np.array([la, lb])
        k = np.exp(-0.5 * (d * d).sum(-1)) + noise * np.eye(len(x))
        return -0.5 * np.einsum("ij,ij->", y, np.linalg.solve(k, y)) - 0.5 * y.shape[1] * (np.linalg.slogdet(k)[1] + len(x) * np.log(2 * np.pi))

    (a0, a1), (b0, b1) = np.log(np.array(bounds))
    low, high = np.array([a0, b0]), np.array([a1, b1])
    lo, hi, best = low, high, None
    for _ in range(16):
        cells = [np.linspace(lo[k], hi[k], 9) for k in (0, 1)]
        best = max((value(np.exp(p), np.exp(q)), p, q) for p in cells[0] for q in cells[1])
        half = (hi - lo) / 5
        lo, hi = np.maximum(low, best[1:] - half), np.minimum(high, best[1:] + half)
    return np.exp(best[1:]), best[0]


@pytest.mark.parametrize("copies", [1, 4])
def test_fitted_scales_and_mean_match_a_dense_fit(spark, copies):
    """200 experiments, each measured once or four times with some error, against the plain formulas."""
    rng, noise, bounds = np.random.default_rng(3), 1e-4, ((0.4, 20.0), (0.4, 20.0))
    x = rng.uniform(0, 6, (200 // copies, 2)).repeat(copies, axis=0)
    y = np.stack([np.sin(x[:, 0]) + 0.3 * x[:, 1] / 6, np.cos(0.6 * x[:, 1]) * x[:, 0] / 6], 1) + 1e-2 * rng.standard_normal((len(x), 2))
    rows = [(*map(float, p), *map(float, q)) for p, q in zip(x, y)] + [(1.0, 1.0, None, 0.0), (float("nan"), 1.0, 1.0, 1.0)]
    train = spark.createDataFrame(rows, "a double, b double, u double, v double").repartition(5)
    got = processes.fit_process(train, ["u", "v"], (1.0, 1.0), bounds, noise=noise)
    scales, _ = dense_fit(x, y, bounds, noise)
    np.testing.assert_allclose(got.scales, scales, rtol=1e-4)
    cand = spark.createDataFrame([(i, 0.7 * (i % 9), 0.9 * (i // 9)) for i in range(63)], "idx int, a double, b double")
    d = got.predict(cand).orderBy("idx").toPandas()
    k = lambda p, q: np.exp(-0.5 * (((p[:, None] - q[None]) / scales) ** 2).sum(-1))
    q = d[["a", "b"]].to_numpy()
    solved = np.linalg.solve(k(x, x) + noise * np.eye(len(x)), np.hstack([y, k(x, q)]))
    np.testing.assert_allclose(d[["mean_u", "mean_v"]], k(q, x) @ solved[:, :2], atol=1e-4)
    np.testing.assert_allclose(d["std"], np.sqrt(np.maximum(1 - np.einsum("ij,ji->i", k(q, x), solved[:, 2:]), 0)), atol=1e-3)


def test_many_experiments_are_fitted_from_few_points(spark):
    """What the thinned points miss is below the noise: the scales are those of the dense fit."""
    rng, noise, bounds = np.random.default_rng(8), 1e-3, ((0.8, 10.0), (0.8, 10.0))
    x = rng.uniform(0, 2, (300, 2))
    y = np.stack([np.sin(1.5 * x[:, 0]) * np.cos(x[:, 1])], 1) + np.sqrt(noise) * rng.standard_normal((300, 1))
    train = spark.createDataFrame([(float(a), float(b), float(v)) for (a, b), (v,) in zip(x, y)], "a double, b double, v double").repartition(4)
    got = processes.fit_process(train, ["v"], (1.0, 1.0), bounds, restarts=4, noise=noise)
    assert len(got._z) < 200
    np.testing.assert_allclose(got.scales, dense_fit(x, y, bounds, noise)[0], rtol=1e-3)


def test_a_process_without_experiments(spark):
    cand = spark.createDataFrame([(0, 1.0, 1.0)], "idx int, a double, b double")
    none = spark.createDataFrame([], "a double, b double, v double")
    got = processes.fit_process(none, ["v"], (2.0, 3.0), ((1.0, 9.0), (1.0, 9.0)))
    assert got.scales == (2.0, 3.0) and got.predict(cand).first()[3:] == (0.0, 1.0)


def test_overlap_areas_are_exact(spark):
    def ring(points):
        return F.array(*[contours.point(F.lit(float(x)), F.lit(float(y))) for x, y in points])

    def octagon(x, y, r):
        return [(x + r * math.cos(k * math.pi / 4), y + r * math.sin(k * math.pi / 4)) for k in range(8)]

    quad = [(1.1, 1.2), (6.3, 1.4), (6.1, 5.9), (1.4, 6.2)]
    # Octagons of circumradius 100 whose centres lie 2 * apothem - 10 apart along a normal share a strip cut off both.
    r, angle = 100.0, math.pi / 8
    side, apart = 2 * r * math.sin(angle), 2 * r * math.cos(angle) - 10
    moved = octagon(apart * math.cos(angle), apart * math.sin(angle), r)
    # Beyond the side the neighbouring sides slope at 45 degrees: a hexagon of two trapezoids of height 5.
    strip = 2 * (side * 5 + 25)
    bow = [(0, 0), (4, 4), (4, 0), (0, 4)]
    cases = [(quad, quad, None), (octagon(0, 0, r), moved, strip), (bow, [(0, 0), (2, 0), (2, 4), (0, 4)], 4.0), (quad, [(50, 50), (60, 50), (60, 60)], 0.0)]
    for p, q, want in cases:
        d = spark.range(1).select(contours.overlap_areas(ring(p), ring(q)).alias("n"), F.abs(geo.shoelace(ring(p))).alias("area"))
        got = contours.overlap_scores(d, "n").first()
        assert got["intersection"] == pytest.approx(got["area"] if want is None else want, rel=1e-9, abs=1e-9)
        if want is None:
            assert got["iou"] == pytest.approx(1)


def test_gaps_in_features_keep_their_rows(spark):
    rows = [(i, None if i % 4 == 0 else float(i % 7), float("nan") if i % 5 == 0 else float(i % 3), [float(i % 3)] * (2 + i % 2), float(i % 2)) for i in range(100)]
    d = spark.createDataFrame(rows, "id int, a double, b double, v array<double>, y double")
    for loss in ("mse", "bce"):
        for features in (["a", "b"], "v"):
            model = learn.train_linear(d, features, "y", loss, 1e-3)
            out = learn.apply_linear(model, d, loss)
            assert out.count() == 100 and out.filter("prob IS NULL OR isnan(prob)").count() == 0
    assert learn.train_forest(d, ["a", "b"], "y", trees=5).transform(d).count() == 100
    means = learn.Features(d, ["a", "b"]).means
    assert means[0] == pytest.approx(np.mean([r[1] for r in rows if r[1] is not None])) and means[1] == pytest.approx(np.mean([r[2] for r in rows if r[2] == r[2]]))


def test_segment_gap_agrees_with_sampling():
    rng = np.random.default_rng(3)
    t = np.linspace(0, 1, 201)
    for _ in range(200):
        a, b, c, d = rng.integers(-4, 5, (4, 2)).astype(float)
        p, q = a + (b - a) * t[:, None], c + (d - c) * t[:, None]
        brute = np.hypot(*(p[:, None] - q[None]).transpose(2, 0, 1)).min()
        gap = float(geo.segment_gap(*a, *b, *c, *d, geo.ARRAYS))
        assert gap <= brute + 1e-9 and brute <= gap + 0.05


def test_line_numbers_do_not_depend_on_later_splits(spark):
    folder = scratch(spark, "lines")
    spark.range(20_000).selectExpr("cast(id as string) AS value").coalesce(1).write.text(folder)
    keys = {"spark.sql.files.openCostInBytes": "1024", "spark.sql.files.minPartitionNum": "2"}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        lines = scans.read_lines(spark, folder)
        spark.conf.set("spark.sql.files.minPartitionNum", "7")
        assert lines.filter("cast(value as bigint) = line").count() == 20_000
    finally:
        for k in keys:
            spark.conf.unset(k)


def test_line_numbers_survive_many_splits(spark):
    folder = scratch(spark, "lines")
    spark.range(5000).selectExpr("cast(id * 7 as string) AS value").coalesce(1).write.text(folder)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        lines = scans.read_lines(spark, folder)
        assert lines.filter("cast(value as bigint) <> line * 7").count() == 0
        assert lines.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_bad_grids_and_contours_raise(spark):
    cells = spark.createDataFrame([("f", i, 0, 1.0) for i in range(5)], "file string, cell bigint, frame int, v double")
    assert scans.valid_shape(cells, 5).count() == 5
    assert scans.valid_shape(cells, 6, "skip").count() == 0
    with pytest.raises(PySparkException):
        scans.valid_shape(cells, 6).collect()
    lines = lambda n: spark.createDataFrame([("f", i, "1,2") for i in range(n)], "file string, line bigint, value string")
    assert scans.contour_pair(lines(3), lines(3), F.lit(0)).count() == 6
    with pytest.raises(PySparkException):
        scans.contour_pair(lines(3), lines(2), F.lit(0)).collect()


def test_count_emission_across_batches(spark):
    folder = scratch(spark, "emit")
    rows = [("a", i, float(i), float(i * i % 17)) for i in range(53)]
    for part in (rows[:20], rows[20:31], rows[31:]):
        spark.createDataFrame(part, "channel string, id bigint, t double, p double").coalesce(1).write.parquet(folder + "/in", mode="append")
    feed = spark.readStream.schema("channel string, id bigint, t double, p double").option("maxFilesPerTrigger", 1).parquet(folder + "/in")
    live.emit_every(feed, 10, folder + "/out", folder + "/state").awaitTermination()
    got = live.emitted(spark, folder + "/out").toPandas().sort_values("n")
    assert spark.read.parquet(folder + "/out/state").select("batch").distinct().count() == 3
    p = np.array([r[3] for r in rows])
    assert got["n"].tolist() == [9, 19, 29, 39, 49]
    np.testing.assert_allclose(got["baseline"], [p[max(0, n - 19) : n + 1].mean() for n in got["n"]])
    np.testing.assert_allclose(got["corrected"], (got["p"] - got["baseline"]) / 4)


def test_a_growing_file_is_read_line_by_line(spark, tmp_path):
    """Rows appended between two runs are read, each once, and a row only when its line is complete."""
    folder = scratch(spark, "grow")
    path = tmp_path / "feed" / "a.csv"
    path.parent.mkdir()

    def add(text):
        with path.open("a") as f:
            f.write(text)
        return live.run_to_table(live.tail_csv(spark, str(path.parent), 2), folder + "/out", folder + "/state")

    times = lambda df: sorted(r.timestamp for r in df.collect())
    assert times(add("1,0.5,0.6\n2,0.1,0.2\nbad,1,2\n3,0.1")) == [1.0, 2.0]
    assert times(add(",0.7\n4,1,1\n5,1")) == [1.0, 2.0, 3.0, 4.0]
    assert times(add(",2\n")) == [1.0, 2.0, 3.0, 4.0, 5.0]


def test_ranges_of_a_growing_file_split_no_line(tmp_path, monkeypatch):
    monkeypatch.setattr(growing, "SPLIT_BYTES", 7)
    monkeypatch.setattr(growing, "LOOK_BYTES", 3)
    lines = ["", "a", "bcd" * 5, "", "éü", "x" * 20]
    (tmp_path / "f.csv").write_text("\n".join(lines) + "\nrest")
    reader = growing._Reader(str(tmp_path), ".csv")
    end = reader.latestOffset()
    got = [v for part in reader.partitions({}, end) for batch in reader.read(part) for v in batch.column(1).to_pylist()]
    assert got == lines and reader.partitions(end, end)[0].path == ""


def test_gap_fill_and_tail_spike(spark):
    d = spark.createDataFrame([([None, 1.0, None, 3.0, None],), ([None, None],)], "v array<double>")
    got = [r[0] for r in d.select(arrays.fill_gaps(F.col("v"))).collect()]
    assert got == [[1.0, 1.0, 2.0, 3.0, 3.0], [0.0, 0.0]]
    s = spark.createDataFrame([([1.0] * 20 + [9.0],), ([1.0] * 21,), ([5.0],)], "v array<double>")
    assert [r[0] for r in s.select(arrays.tail_spike(F.col("v"), 0.15, 5.0, 5)).collect()] == [True, False, False]


def test_append_new_and_pick(spark):
    path = scratch(spark, "inc")
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, s string")
    for _ in range(2):
        sinks.append_new(spark, a, path, ["k"])
    assert spark.read.parquet(path).count() == 2
    assert similarity.pick_one(a, 3).collect() == similarity.pick_one(a.repartition(3), 3).collect()


def test_regions_cover_the_mask(spark):
    r = raw_regions(spark, SF).agg(F.sum("area")).first()[0]
    m = views.cells(spark, SF).filter("v > 0.05").count()
    assert r == m


def test_annotation_files_span_lines(spark, tmp_path):
    doc = """{
  "shapes": [{"label": "fish", "points": [[1.5, 2.0], [3.0, 4.5]], "group_id": null, "shape_type": "polygon", "flags": {}}],
  "imagePath": "frame-0001.png", "imageData": null, "imageHeight": 64, "imageWidth": 64
}"""
    (tmp_path / "frame-0001.json").write_text(doc)
    rows = scans.read_annotations(spark, str(tmp_path)).orderBy("vertex").collect()
    assert [(r["imagePath"], r["label"], r["x"], r["y"]) for r in rows] == [("frame-0001.png", "fish", 1.5, 2.0), ("frame-0001.png", "fish", 3.0, 4.5)]


def test_decimal_comma_files(spark):
    path = scratch(spark, "comma")
    sinks.write_decimal_comma(spark.createDataFrame([(1, 2.5)], "k int, v double").coalesce(1), path)
    assert [r[0] for r in spark.read.text(path).collect()] == ["k;v", "1;2,500000"]


# --- whole parameter grids ------------------------------------------------------------------------------


def plain_tree(b, target, weight, depth, min_split, at):
    """Value at each row of ``at`` of the best tree, cut by cut."""

    def build(rows, level):
        w, t = weight[rows], target[rows]
        mean = (w * t).sum() / w.sum()
        best, cut = 1e-12, None
        if (depth is None or level < depth) and w.sum() >= min_split:
            for f in range(b.shape[1]):
                for c in range(grids.BINS):
                    left = b[rows, f] <= c
                    wl, wr = w[left].sum(), w[~left].sum()
                    if wl > 0 and wr > 0:
                        gain = (w * t)[left].sum() ** 2 / wl + (w * t)[~left].sum() ** 2 / wr - (w * t).sum() ** 2 / w.sum()
                        if gain > best + 1e-9:
                            best, cut = gain, (f, c)
        if cut is None:
            return lambda row: mean
        left = b[rows, cut[0]] <= cut[1]
        low, high = build(rows[left], level + 1), build(rows[~left], level + 1)
        return lambda row: (low if row[cut[0]] <= cut[1] else high)(row)

    tree = build(np.flatnonzero(weight > 0), 0)
    return np.array([tree(r) for r in at])


@pytest.mark.parametrize("depth,min_split", [(1, 2), (3, 2), (None, 2), (None, 9)])
def test_trees_grow_as_cut_by_cut(depth, min_split):
    rng = np.random.default_rng(5)
    b = rng.integers(0, 12, (60, 3)).astype(np.uint8)
    y, weight = rng.normal(size=60), rng.integers(0, 3, 60).astype(float)
    others = rng.integers(0, 12, (20, 3)).astype(np.uint8)
    *_, (node, far, nodes) = grids.grow(b, y, weight, depth, min_split, others)
    mean = np.bincount(node, weight * y, nodes) / np.maximum(np.bincount(node, weight, nodes), 1e-300)
    np.testing.assert_allclose(mean[far], plain_tree(b, y, weight, depth, min_split, others), atol=1e-9)


def test_settings_read_off_one_chain_are_those_of_their_own(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    b, folds = grids.binned(x), np.arange(200) % 5
    own = {"learning_rate": 0.2, "max_depth": 3, "min_samples_split": 2, "subsample": 0.8}
    run = lambda trees: {p: r for p, r, _ in grids.run_chain("boost", own, 1, b, y, folds, grids.BOOST | {"n_estimators": trees}, grids.FOREST, 3)}
    assert run([5, 20])["learning_rate=0.2, max_depth=3, min_samples_split=2, n_estimators=5, subsample=0.8"] == list(run([5]).values())[0]
    held = folds == 1
    make = lambda depths: grids.forest(b[~held], y[~held], b[held], [1], depths, 2, 4, np.random.default_rng(1))
    both = make([None, 2])
    # All four features in every cut: a tree cut at depth 2 is a tree grown to it.
    weight = np.bincount(np.random.default_rng(1).integers(0, 160, 160), minlength=160).astype(float)
    np.testing.assert_allclose(both[1, 2], plain_tree(b[~held], y[~held], weight, 2, 2, b[held]), atol=1e-9)
    np.testing.assert_allclose(both[1, None], plain_tree(b[~held], y[~held], weight, None, 2, b[held]), atol=1e-9)


def test_grid_finds_what_single_cuts_miss(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 3))
    rows = [(i, x[i].tolist(), float(x[i, 0] * x[i, 1] > 0)) for i in range(300)] + [(300, None, 1.0), (301, [None, 1.0], 0.0)]
    df = spark.createDataFrame(rows, "id bigint, x array<double>, y double")
    boost = {"n_estimators": [10, 40], "learning_rate": [0.2], "max_depth": [1, 3], "min_samples_split": [2], "subsample": [1.0]}
    trees = {"n_estimators": [40], "max_depth": [None, 1], "min_samples_split": [2], "max_features": ["sqrt"]}
    got = {r.params: r.accuracy for r in grids.search(df, "id", "x", "y", boost, trees).collect()}
    assert len(got) == 4 + 2
    deep = "learning_rate=0.2, max_depth=3, min_samples_split=2, n_estimators=40, subsample=1.0"
    assert got[deep] > 0.85 and got[deep] > got[deep.replace("max_depth=3", "max_depth=1")] + 0.2
    assert got["max_depth=None, max_features=sqrt, min_samples_split=2, n_estimators=40"] > 0.75
    assert got == {r.params: r.accuracy for r in grids.search(df, "id", "x", "y", boost, trees).collect()}
    assert grids.search(df.limit(0), "id", "x", "y", boost, trees).collect() == []
    assert len(grids.chains()) == 5 * (36 + 4)


def test_range_lists_as_a_table_function(spark):
    spark.udtf.register("range_values", text.RangeValues)
    spark.createDataFrame([(1, "1,2,5-8"), (2, "8 - 6, 7,"), (3, ""), (4, None), (5, "-3"), (6, "3-3")], "id int, spec string").createOrReplaceTempView("specs")
    got = spark.sql("SELECT id, r.k, r.v FROM specs, LATERAL range_values(spec) r").collect()
    want = {1: [1, 2, 5, 6, 7, 8], 2: [6, 7, 8], 6: [3]}
    assert {i: [r.v for r in sorted(got, key=lambda r: r.k) if r.id == i] for i in want} == want and {r.id for r in got} == set(want)
    with pytest.raises(PySparkException):
        spark.sql("SELECT * FROM range_values('1,x')").collect()


def plain_loop(x, y, batch, s):
    """Both layers by hand, sample by sample of a batch; (stop epoch, best epoch, best loss, scores of all rows)."""
    rng = np.random.default_rng(s.seed)
    wide, deep = 1 / np.sqrt(x.shape[1]), 1 / np.sqrt(s.hidden)
    p = {"w1": rng.uniform(-wide, wide, (s.hidden, x.shape[1])), "b1": rng.uniform(-wide, wide, s.hidden), "w2": rng.uniform(-deep, deep, s.hidden), "b2": rng.uniform(-deep, deep, 1)}
    m, v, t = {k: 0 * a for k, a in p.items()}, {k: 0 * a for k, a in p.items()}, 0
    forward = lambda q: (q @ p["w1"].T + p["b1"]) @ p["w2"] + p["b2"][0]
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    best, seen, epoch = (np.inf, 0, None), 0, 0
    for epoch in range(1, s.epochs + 1):
        for b in rng.permutation(s.batches):
            q, z = x[batch == b], forward(x[batch == b])
            e = (2 * (z - y[batch == b]) if s.loss == "mse" else sigmoid(z) - y[batch == b]) / len(q)
            back = e[:, None] * p["w2"]
            grads = {"w1": back.T @ q, "b1": back.sum(0), "w2": (e[:, None] * (q @ p["w1"].T + p["b1"])).sum(0), "b2": np.array([e.sum()])}
            t += 1
            for k, g in grads.items():
                g = g + s.decay * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - s.lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        z, want = forward(x[batch == gradient.HELD]), y[batch == gradient.HELD]
        loss = ((z - want) ** 2).mean() if s.loss == "mse" else -(want * np.log(sigmoid(z)) + (1 - want) * np.log(sigmoid(-z))).mean()
        if loss < best[0]:
            best, seen = (loss, epoch, forward(x)), 0
        else:
            seen += 1
            if seen == s.patience:
                break
    return epoch, best[1], best[0], best[2]


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(240, 5))
    y = (x @ [1.0, -2.0, 0.5, 0.0, 0.0] + rng.normal(size=240) > 0).astype(float)
    return x, y, written(spark.createDataFrame([(i, a.tolist(), b) for i, (a, b) in enumerate(zip(x, y.tolist()))], "item long, v array<double>, y double"), "labelled")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_gradient_fit_stops_where_a_plain_loop_stops(spark, labelled, seed):
    x, y, d = labelled
    numbered = d.withColumn("b", F.when(F.col("item") % 4 == 0, gradient.HELD).otherwise(gradient.batch_number("item", 3, seed)))
    batch = np.array([r.b for r in numbered.orderBy("item").select("b").collect()])
    settings = [gradient.Setting(loss, lr=0.05, hidden=4, epochs=30, patience=3, batches=3, seed=seed) for loss in ("mse", "bce")]
    models = gradient.fit_linear(d.filter("item % 4 <> 0"), d.filter("item % 4 = 0"), "item", "v", "y", settings)
    for model, s in zip(models, settings):
        stop, best, loss, scores = plain_loop(x, y, batch, s)
        own = gradient.fit_in_memory(x, y, batch, s)
        for end in (model.outcome, own):
            assert (end.stop_epoch, end.best_epoch) == (stop, best)
            np.testing.assert_allclose(end.best_loss, loss, rtol=1e-9)
        got = model.transform(d).orderBy("item").toPandas()
        np.testing.assert_allclose(got["prob"], np.clip(scores, 0, 1) if s.loss == "mse" else 1 / (1 + np.exp(-scores)), atol=1e-9)
        assert (got["stop_epoch"] == stop).all()


def test_gradient_fit_of_odd_inputs(spark, labelled):
    """Gaps get the mean, nothing to judge by means the first weights, and settings must go together."""
    _, _, d = labelled
    gaps = d.withColumn("v", F.when(F.col("item") == 7, F.array(F.lit(None).cast("double"), F.lit(float("nan")))).when(F.col("item") == 8, None).otherwise(F.col("v")))
    one = gradient.Setting("bce", epochs=2, batches=2)
    model = gradient.fit_linear(gaps, gaps.limit(0), "item", "v", "y", [one])[0]
    assert (model.outcome.best_epoch, model.outcome.stop_epoch) == (0, 2)
    assert model.transform(gaps).filter("prob between 0 and 1").count() == 240
    with pytest.raises(ValueError):
        gradient.fit_linear(gaps, gaps, "item", "v", "y", [one, one._replace(batches=3)])


def test_parzen_search_closes_in_on_the_best(spark, labelled):
    """On a known bowl later proposals gather round its bottom; a search of fits repeats itself by seed."""
    bounds, rng = [(-9.0, 0.0), (-12.0, -4.0)], np.random.default_rng(4)
    bowl = lambda p: (p[0] + 3.0) ** 2 + 0.3 * (p[1] + 7.0) ** 2
    tried = np.column_stack([rng.uniform(*b, 10) for b in bounds])
    while len(tried) < 60:
        tried = np.vstack([tried, gradient.propose(tried, np.array([bowl(p) for p in tried]), bounds, rng)])
    away = [bowl(p) for p in tried]
    assert np.median(away[30:]) < 0.4 * np.median(away[:10]) and min(away[10:]) < min(away[:10])
    assert ((tried >= [-9, -12]) & (tried <= [0, -4])).all()
    x = np.linspace(-9, 0, 4001)
    assert abs(np.exp(gradient.Parzen(tried[:5, 0], -9.0, 0.0).log_density(x)).sum() * (x[1] - x[0]) / math.sqrt(2 * math.pi) - 1) < 1e-2
    _, _, d = labelled
    base = gradient.Setting("bce", epochs=5, patience=2, batches=3)
    run = lambda: gradient.search_linear(d, "item", "v", "y", F.col("item") % 4 == 0, base, (1e-4, 1e-1), (1e-6, 1e-2), trials=13)
    one = run()
    assert one == run() and [t[0] for t in one] == list(range(13))


@pytest.mark.parametrize("n", [3, 5, 6, 40])
def test_smoothing_spline_matches_a_dense_solve(n):
    """Residual on the target, curvatures and values of the dense equations, and no bend at the ends of the range."""
    rng = np.random.default_rng(n)
    turn = np.sort(rng.uniform(0, 2 * np.pi, n))
    v = np.stack([20 * np.cos(turn), 12 * np.sin(turn)], 1) + rng.normal(scale=0.8, size=(n, 2))
    target, i = float(max(1, n // 4)), np.arange(n)
    h = np.hypot(*(np.roll(v, -1, 0) - v).T)
    h = h / h.sum()
    hats, second = np.zeros((n, n)), np.zeros((n, n))
    for k in range(n):
        for a, b, w in ((k, k, h[k - 1] / 3 + h[k] / 3), (k, (k + 1) % n, h[k] / 6), (k, k - 1, h[k - 1] / 6)):
            hats[a, b] += w
        for b, w in ((k - 1, 1 / h[k - 1]), (k, -1 / h[k - 1] - 1 / h[k]), ((k + 1) % n, 1 / h[k])):
            second[k, b] += w

    def dense(penalty):
        bend = np.linalg.solve(hats + penalty * second @ second.T, second @ v)
        off = penalty * second.T @ bend
        return v - off, (off**2).sum()

    low, high = -18.0, 8.0
    for _ in range(80):
        mid = 0.5 * (low + high)
        low, high = (mid, high) if dense(10**mid)[1] < target else (low, mid)
    want, _ = dense(10**low)
    x, y, residual = contours.smoothing_spline(v[:, 0], v[:, 1], 9, target)
    assert abs(residual - target) < 0.01 * target
    np.testing.assert_allclose([x[0], y[0]], want[0], atol=1e-4)
    np.testing.assert_allclose([x[-1], y[-1]], want[0], atol=1e-4)
    # No allowance: the spline through the vertices; more than their spread: their mean.
    px, py = contours.periodic_spline(v[:, 0], v[:, 1], 9)
    x, y, residual = contours.smoothing_spline(v[:, 0], v[:, 1], 9, 0.0)
    np.testing.assert_allclose([x, y], [px, py], atol=1e-8)
    x, _, residual = contours.smoothing_spline(v[:, 0], v[:, 1], 9, 1e9)
    assert np.allclose(x, v[:, 0].mean()) and residual < 1e9


def test_forest_is_grown_in_pieces(spark):
    """Nodes above the bound are cut from summed histograms; what tasks get stays below it, and nothing but first cuts is on the driver."""
    from wakeframe.operators import forest

    rng = np.random.default_rng(5)
    x = rng.integers(0, 8, (1500, 4)).astype(float)
    y = (x[:, 0] + x[:, 1] > 7).astype(int) + (x[:, 2] > 5)
    d = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, y))], "_id bigint, x array<double>, y int").repartition(3)
    made = forest.Forest(d, trees=8, depth=30, seed=1, branch_rows=200)
    assert made.classes == 3 and all(made.top)
    assert not any(isinstance(v, np.ndarray) and v.size > 31 for v in made.__dict__.values())
    sizes = {}
    for r in made.branches.collect():
        counts = np.frombuffer(r["counts"]).reshape(-1, 3)
        sizes.setdefault(r["tree"], []).append(counts[0].sum())
        assert len(counts) == 1 or counts[0].sum() <= 200
    drawn = {t: forest.draws(np.arange(1500), t, 1).sum() for t in range(8)}
    assert {t: sum(s) for t, s in sizes.items()} == drawn
    assert all(len(s) == len(made.top[t]) + 1 for t, s in sizes.items())
    got = {r["_id"]: r["p"] for r in made.scores(d.select("_id", "x")).collect()}
    assert len(got) == 1500 and all(abs(sum(p) - 8) < 1e-9 for p in got.values())
    assert np.mean([np.argmax(got[i]) == y[i] for i in range(1500)]) > 0.97


def test_forest_branch_matches_plain_cuts():
    """With all features drawn, a branch ends in pure leaves, and its first cut is the best of all."""
    from wakeframe.operators import forest

    rng = np.random.default_rng(6)
    b, w = np.unique(rng.integers(0, 12, (400, 3)), axis=0).astype(np.uint8), None
    y, w = (rng.random(len(b)) < 0.2 + 0.5 * (b[:, 1] > 6)).astype(np.int32), rng.integers(1, 4, len(b)).astype(np.uint8)
    feature, cut, child, counts = forest.branch(b, y, w, 2, 30, 3, rng)
    leaf = forest._leaf(feature, cut, child, b)
    assert (counts[leaf].argmax(1) == y).all() and (np.count_nonzero(counts[feature < 0], axis=1) == 1).all()
    gini = lambda m: sum((w[m & (y == c)].sum() ** 2) / max(w[m].sum(), 1) for c in (0, 1))
    best = max((gini(b[:, j] <= k) + gini(b[:, j] > k), j, k) for j in range(3) for k in range(11))
    assert abs(gini(b[:, feature[0]] <= cut[0]) + gini(b[:, feature[0]] > cut[0]) - best[0]) < 1e-6
    assert np.bincount(leaf, w, minlength=len(feature))[feature < 0].tolist() == counts[feature < 0].sum(1).tolist()
    shallow = forest.branch(b, y, w, 2, 2, 3, rng)
    assert len(shallow[0]) <= 7


def test_short_track_keeps_its_run(spark):
    """A recording of six frames is too short for the tail's filter; its Reynolds number and lengths are still told."""
    ring = lambda f: [(f * 1.0, 0.3 * math.sin(2.1 * f)), (f + 5.0, 0.5 * math.cos(1.7 * f))]
    rows = [(run, f, ring(f)) for run, n in ((0, 50), (1, 6)) for f in range(n)]
    d = spark.createDataFrame(rows, "run int, frame int, poly array<struct<x: double, y: double>>")
    got = {r["run"]: r for r in contours.tailbeat(contours.trajectory_summary(d, 0, 1, 0.004, 100.0), 100.0).collect()}
    assert set(got) == {0, 1} and got[0]["frequency"] > 0
    assert got[1]["frequency"] is None and got[1]["strouhal"] is None and got[1]["beats"] is None
    assert got[1]["reynolds"] > 0 and got[1]["lengths"] == pytest.approx(got[1]["distance"] / got[1]["length"])


def test_recording_has_a_bounded_number_of_files(spark):
    """A long recording is told in no more files, so a replay of some files at a time takes no more batches."""
    from wakeframe.plans import streams

    sf = scratch(spark, "sf")
    v = spark.range(600 * 50).select(F.col("id").alias("vec_id"), F.lit(0).alias("label"), F.array(F.lit(0.5), F.col("id").cast("double")).alias("embedding"))
    v.write.parquet(sf + "/embeddings.parquet")
    rows = spark.read.text(streams.recorded(spark, sf)).select(F.input_file_name().alias("file"), F.split("value", ",")[0].cast("int").alias("t"))
    got = rows.agg(F.count(F.lit(1)), F.count_distinct("t"), F.count_distinct("file")).first()
    assert got[:2] == (30000, 30000) and 128 <= got[2] <= streams.RECORDED_FILES


def test_extremes_without_a_sort(spark):
    """First minimum, maximum and gap of each sensor, as by ordering (value, time) pairs, without sorting a task's rows."""
    rng = np.random.default_rng(9)
    pick = lambda values: values[rng.integers(len(values))]
    rows = [(1, pick([2, 3]), pick([0, 1, 2, None]), pick([0.5, 1.5, 2.5, 2.5, float("nan"), None]), pick([1.0, 2.0, 3.0, None])) for _ in range(60)]
    rows += [(2, 1, 0, None, 4.0), (2, 1, 1, None, None), (2, 1, 1, None, 1.0), (2, 2, 0, 7.0, None), (2, 2, 0, 7.0, 2.0)]
    d = spark.createDataFrame(rows, "re int, h int, sensor int, p double, t double")
    row, known = F.struct("p", "t"), F.col("p").isNotNull()
    ends = F.array(F.min(row), F.min(F.when(known, row)), F.max(F.when(known, row)))
    want = d.groupBy("re", "h", "sensor").agg(F.filter(F.array_distinct(ends), lambda r: r.isNotNull()).alias("e")).select("re", "h", "sensor", F.inline("e"))
    got = live._extremes(d)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "SortAggregate" not in got._jdf.queryExecution().toString()


def test_replayed_parts_are_written_by_many_tasks(spark, monkeypatch):
    """T09's four parts hold every row once and need no exchange to four tasks."""
    from wakeframe.plans import streams

    seen = []
    monkeypatch.setattr(streams.live, "closed_loop", lambda stream, *rest: seen.append(stream) or type("Q", (), {"awaitTermination": lambda self: None})())
    places = []
    monkeypatch.setattr(streams, "scratch", lambda s, name: places.append(scratch(s, name)) or places[-1])
    streams.loop(spark, SF, 1e-9)
    runs = streams.sweep(spark, SF).select("re", "h", "sensor", "p", "t")
    path = next(p for p in places if "t09-in" in p)
    parts = spark.read.parquet(path)
    assert len(seen) == 4 and {r["part"] for r in parts.select("part").distinct().collect()} == {0, 1, 2, 3}
    assert parts.drop("part").exceptAll(runs).isEmpty() and runs.exceptAll(parts.drop("part")).isEmpty()

"""Flow-field operators on frames held as ``ARRAY<DOUBLE>`` rows.

Every operator adds or replaces columns of the frame table; none of them
shuffles, except those that compare frames (joins on run and frame).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wakeframe.functions.grid import Grid, interior, let, shift

# --- stencils -------------------------------------------------------------------------


def gradient(df: DataFrame, grid: Grid, col: str = "v", dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """Central differences inside, one-sided at the edges."""
    return df.withColumns(
        {
            "gx": grid.apply(lambda a: np.gradient(a, dx, axis=1), col),
            "gy": grid.apply(lambda a: np.gradient(a, dy, axis=2), col),
        }
    )


def q_criterion(df: DataFrame, grid: Grid, u: str = "u", w: str = "w", dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """``q``: half of (twice the squared rotation minus the squared strain)."""

    def q(a, b):
        ux, uy = np.gradient(a, dx, dy, axis=(1, 2))
        wx, wy = np.gradient(b, dx, dy, axis=(1, 2))
        shear, spin = 0.5 * (uy + wx), 0.5 * (wx - uy)
        return 0.5 * (2 * spin**2 - (ux**2 + wy**2 + 2 * shear**2))

    return df.withColumn("q", grid.apply(q, u, w))


def q_determinant(df: DataFrame, grid: Grid, u: str = "u", w: str = "w") -> DataFrame:
    """``q`` as the determinant of the velocity gradient, 0 on the border."""

    def q(a, b):
        span = lambda f, dx, dy: shift(f, dx, dy) - shift(f, -dx, -dy)
        return interior(0.25 * (span(a, 1, 0) * span(b, 0, 1) - span(b, 1, 0) * span(a, 0, 1)), a.shape)

    return df.withColumn("q", grid.apply(q, u, w))


def curl(df: DataFrame, grid: Grid, u: str = "u", w: str = "w") -> DataFrame:
    """Vorticity at the cell corner from backward differences."""
    turn = lambda a, b: interior(shift(a, 0, -1) - shift(a, 0, 0) + shift(b, 0, 0) - shift(b, -1, 0), a.shape)
    return df.withColumn("curl", grid.apply(turn, u, w))


def divergence(df: DataFrame, grid: Grid, u: str = "u", w: str = "w") -> DataFrame:
    flux = lambda a, b: interior(shift(a, 1, 0) - shift(a, 0, 0) + shift(b, 0, 1) - shift(b, 0, 0), a.shape)
    return df.withColumn("div", grid.apply(flux, u, w))


def kinetic_energy(df: DataFrame, grid: Grid, u: str = "u", w: str = "w", u0: float = 0.0, w0: float = 0.0) -> DataFrame:
    """Energy density of the flow relative to the background (u0, w0)."""

    def ke(a, b):
        p, q = shift(a, 1, 0) + shift(a, 0, 0) - 2 * u0, shift(b, 0, 1) + shift(b, 0, 0) - 2 * w0
        return interior((p**2 + q**2) * 0.125, a.shape)

    return df.withColumn("ke", grid.apply(ke, u, w))


def stream_function(df: DataFrame, grid: Grid, u: str = "u") -> DataFrame:
    """Trapezoid integral of u along y from both ends, averaged, with the base shifted out.

    The integral from the far end is the one from the near end minus its total.
    """

    def psi(a):
        steps = 0.5 * (a[:, :, 1:] + a[:, :, :-1])
        near = np.concatenate([np.zeros_like(a[:, :, :1]), np.cumsum(steps, axis=2)], axis=2)
        far = near - near[:, :, -1:]
        return 0.5 * (near + far - far[:, :1, :1])

    return df.withColumn("psi", grid.apply(psi, u))


def laplacian(df: DataFrame, grid: Grid, col: str = "v") -> DataFrame:
    five = lambda a: interior(shift(a, 1, 0) + shift(a, -1, 0) + shift(a, 0, 1) + shift(a, 0, -1) - 4 * shift(a, 0, 0), a.shape)
    return df.withColumn("lap", grid.apply(five, col))


def backward_gradient(df: DataFrame, grid: Grid, col: str = "v") -> DataFrame:
    """Backward-difference gradient (gx, gy) and the rotated curl (cx, cy) of a scalar."""
    part = lambda plus, minus: grid.apply(lambda a: interior(shift(a, *plus) - shift(a, *minus), a.shape), col)
    return df.withColumns(
        {
            "gx": part((0, 0), (-1, 0)),
            "gy": part((0, 0), (0, -1)),
            "cx": part((0, 1), (0, 0)),
            "cy": part((0, 0), (1, 0)),
        }
    )


def normal_gradient(df: DataFrame, grid: Grid, col: str, nx: str, ny: str) -> DataFrame:
    """Central-difference gradient projected on the wall-normal arrays ``nx``, ``ny``."""

    def project(a, p, q):
        along = shift(p, 0, 0) * (shift(a, 1, 0) - shift(a, -1, 0)) + shift(q, 0, 0) * (shift(a, 0, 1) - shift(a, 0, -1))
        return interior(0.5 * along, a.shape)

    return df.withColumn("ng", grid.apply(project, col, nx, ny))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def gaussian_smooth(df: DataFrame, grid: Grid, col: str = "v", sigma: float = 1.0, out: str = "smooth") -> DataFrame:
    """Separable Gaussian with half-sample reflected edges."""
    weights = gaussian_weights(sigma)
    radius = len(weights) // 2

    def along(a, axis):
        pad = [(0, 0)] * 3
        pad[axis] = (radius, radius)
        wide = np.pad(a, pad, mode="symmetric")
        total = np.zeros_like(a)
        for k, w in enumerate(weights):
            total += w * np.take(wide, range(k, k + a.shape[axis]), axis=axis)
        return total

    return df.withColumn(out, grid.apply(lambda a: along(along(a, 1), 2), col))


def window_extreme(a: np.ndarray, size: int, highest: bool) -> np.ndarray:
    """Largest (or smallest) value in the ``size`` x ``size`` square around each cell."""
    pick, half = (np.maximum if highest else np.minimum), size // 2
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (half, half)
        wide = np.pad(a, pad, mode="edge")
        best = a
        for k in range(2 * half + 1):
            best = pick(best, np.take(wide, range(k, k + a.shape[axis]), axis=axis))
        a = best
    return a


def local_peaks(df: DataFrame, grid: Grid, col: str, size: int, threshold: float) -> DataFrame:
    """``peak``: 1 for a maximum above the threshold, -1 for a minimum below its negative."""

    def peaks(a):
        top = (a == window_extreme(a, size, True)) & (a > threshold)
        low = (a == window_extreme(a, size, False)) & (a < -threshold)
        return np.where(top, 1, np.where(low, -1, 0))

    return df.withColumn("peak", grid.apply(peaks, col, out="int"))


def strict_peaks(df: DataFrame, grid: Grid, col: str, reference_quirk: bool = False) -> DataFrame:
    """``peak``: interior cell strictly above (1) or below (-1) its four neighbours.

    With ``reference_quirk`` the fourth neighbour is the diagonal (x + 1, y - 1).
    """
    fourth = (1, -1) if reference_quirk else (0, -1)

    def peaks(a):
        near = np.stack([shift(a, *s) for s in ((1, 0), (-1, 0), (0, 1), fourth)])
        me = shift(a, 0, 0)
        return interior(np.where(near.max(0) < me, 1, np.where(near.min(0) > me, -1, 0)), a.shape)

    return df.withColumn("peak", grid.apply(peaks, col, out="int"))


# --- masks, probes and crops ----------------------------------------------------------


def threshold_mask(df: DataFrame, col: str, threshold: float, out: str = "mask") -> DataFrame:
    """Boolean array ``value > threshold``; NaN and NULL count as 0."""
    return df.withColumn(out, F.transform(F.col(col), lambda v: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)) > threshold))


def fill_missing(df: DataFrame, col: str) -> DataFrame:
    """NaN and NULL cells become 0; ``filled`` counts them."""
    bad = lambda v: v.isNull() | F.isnan(v)
    return df.withColumns(
        {
            col: F.transform(F.col(col), lambda v: F.when(bad(v), F.lit(0.0)).otherwise(v)),
            "filled": F.size(F.filter(F.col(col), bad)),
        }
    )


def probe(df: DataFrame, grid: Grid, col: str, sensors: list[tuple[int, float, float]], shifts: list[int] = (0,)) -> DataFrame:
    """Value under each sensor (rounded position), per frame and column shift; NULL outside the grid."""
    picks = []
    for sid, sx, sy in sensors:
        for s in shifts:
            px, py = round(sx) + s, round(sy)
            ok = 0 <= px < grid.nx and 0 <= py < grid.ny
            value = F.get(F.col(col), F.lit(px * grid.ny + py)) if ok else F.lit(None).cast("double")
            picks.append(F.struct(F.lit(sid).alias("sensor_id"), F.lit(s).alias("shift"), value.alias("p")))
    return df.select("run", "frame", F.inline(F.array(*picks)))


def transect(df: DataFrame, grid: Grid, col: str, x: int, ys: list[int]) -> DataFrame:
    """Values of one column at the listed rows."""
    picks = [F.struct(F.lit(y).alias("y"), grid.at(F.col(col), x, y).alias("p")) for y in ys]
    return df.select("run", "frame", F.inline(F.array(*picks)))


def wall_row(df: DataFrame, grid: Grid, col: str, y: int, ref: tuple[int, int]) -> DataFrame:
    """One full row of the frame minus the reference cell."""
    picks = [F.struct(F.lit(x).alias("x"), (grid.at(F.col(col), x, y) - grid.at(F.col(col), *ref)).alias("p")) for x in range(grid.nx)]
    return df.select("run", "frame", F.inline(F.array(*picks)))


def crop(df: DataFrame, grid: Grid, col: str, width: int, height: int, x0: int, middle_y: int) -> DataFrame:
    """Window of ``width`` columns from ``x0`` and ``height`` rows centred on ``middle_y``, clamped."""
    start = max(0, middle_y - height // 2)
    stop = min(grid.ny, start + height)
    pieces = [
        F.slice(F.col(col), x * grid.ny + start + 1, stop - start) for x in range(x0, min(grid.nx, x0 + width))
    ]
    return df.withColumn(col, F.concat(*pieces))


def frame_range(df: DataFrame, start: int, end: int, rebase: bool = False) -> DataFrame:
    """Frames start..end inclusive; raises when the range is empty by construction."""
    if end < start or end < 0:
        raise ValueError(f"empty frame range {start}..{end}")
    out = df.filter(F.col("frame").between(max(0, start), end))
    return out.withColumn("frame", F.col("frame") - max(0, start)) if rebase else out


def _polygon_field(grid: Grid, fn, *cols) -> Column:
    """Frame column from ``fn(points, px, py, values)``: every cell against the row's own polygon."""
    x, y = np.divmod(np.arange(grid.nx * grid.ny), grid.ny)
    points = np.column_stack([x, y]).astype(float)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(px: pd.Series, py: pd.Series, value: pd.Series) -> pd.Series:
        rows = [fn(points, np.asarray(a, float), np.asarray(b, float), np.asarray(v, float)) for a, b, v in zip(px, py, value)]
        return pd.Series(rows, dtype=object)

    return run(*cols)


def _edge_terms(points: np.ndarray, px: np.ndarray, py: np.ndarray):
    """Per (cell, edge): twice the signed area, position along the edge, and the edge's parts."""
    dx, dy = np.roll(px, -1) - px, np.roll(py, -1) - py
    rx, ry = points[:, :1] - px[None], points[:, 1:] - py[None]
    return dx * ry - dy * rx, dx * rx + dy * ry, dx, dy, rx, ry


def winding_numbers(points: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    side = _edge_terms(points, px, py)[0]
    low, high = py[None] <= points[:, 1:], np.roll(py, -1)[None] <= points[:, 1:]
    return ((low & ~high & (side > 0)).astype(int) - (~low & high & (side < 0))).sum(axis=1)


def body_mask(df: DataFrame, grid: Grid, col: str, poly: str) -> DataFrame:
    """Zero the cells inside the frame's polygon (winding number not 0)."""
    inside = lambda pts, px, py, v: np.where(winding_numbers(pts, px, py) != 0, 0.0, v)
    px, py = F.transform(poly, lambda p: p["x"]), F.transform(poly, lambda p: p["y"])
    return df.withColumn(col, _polygon_field(grid, inside, px, py, col))


def body_distance(df: DataFrame, grid: Grid, poly: str, convex: bool = False, along_edge_sum: bool = False) -> DataFrame:
    """``dist``: signed distance of every cell to the frame's polygon, negative inside.

    ``convex`` takes the largest edge-line offset. Otherwise the nearest edge counts;
    ``along_edge_sum`` adds the overshoot past an edge's ends to the normal distance
    instead of taking the Euclidean one.
    """

    def distance(pts, px, py, _):
        side, along, dx, dy, rx, ry = _edge_terms(pts, px, py)
        length = np.hypot(dx, dy)
        if convex:
            return (side / length).max(axis=1)
        if along_edge_sum:
            start = along / length
            near = np.abs(side / length) + np.maximum(0, -start) + np.maximum(0, start - length)
        else:
            t = np.clip(along / length**2, 0, 1)
            near = np.hypot(rx - t * dx, ry - t * dy)
        return np.where(winding_numbers(pts, px, py) == 0, 1, -1) * near.min(axis=1)

    px, py = F.transform(poly, lambda p: p["x"]), F.transform(poly, lambda p: p["y"])
    return df.withColumn("dist", _polygon_field(grid, distance, px, py, px))


def physical_probe(df: DataFrame, grid: Grid, col: str, x_mm: int, y_mm: int, mirrored: bool, rho: float, speed: float) -> DataFrame:
    """Series of one cell given in millimetres (origin mirrored when asked), as pressure in Pa."""
    x, y = (grid.nx - x_mm, grid.ny - y_mm) if mirrored else (x_mm, y_mm)
    if not (0 <= x < grid.nx and 0 <= y < grid.ny):
        raise ValueError("probe outside the grid")
    return df.select("run", "frame", (grid.at(F.col(col), x, y) * (0.5 * rho * speed * speed)).alias("pa"))


# --- algebra, reductions and comparisons ----------------------------------------------


def algebra(a: DataFrame, b: DataFrame, col: str = "v") -> DataFrame:
    """Sum, difference, product and inverse of two aligned fields; raises on unequal shapes."""
    j = a.select("run", "frame", F.col(col).alias("a")).join(b.select("run", "frame", F.col(col).alias("b")), ["run", "frame"])
    checked = F.when(F.size("a") == F.size("b"), F.col("b")).otherwise(F.raise_error(F.lit("fields differ in shape")))
    return j.withColumn("b", checked).select(
        "run",
        "frame",
        F.zip_with("a", "b", lambda p, q: p + q).alias("plus"),
        F.zip_with("a", "b", lambda p, q: p - q).alias("minus"),
        F.zip_with("a", "b", lambda p, q: p * q).alias("times"),
        F.transform("a", lambda p: F.lit(1.0) / F.nullif(p, F.lit(0.0))).alias("inv"),
    )


def reductions(df: DataFrame, grid: Grid, a: str, b: str) -> DataFrame:
    """Interior sum of ``a``, interior inner product with ``b``, and the largest |a| of all cells."""
    inner = grid.apply(lambda p, q: interior(shift(p * q, 0, 0), p.shape), a, b)
    whole = grid.apply(lambda p: interior(shift(p, 0, 0), p.shape), a)
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)
    return df.select(
        "run",
        "frame",
        add(whole).alias("total"),
        add(inner).alias("inner_p"),
        F.array_max(F.transform(F.col(a), lambda v: F.abs(v))).alias("l_inf"),
    )


def minmax_ignoring_zero(df: DataFrame, col: str) -> DataFrame:
    """Per-frame rescale to [0, 1] over the non-zero cells (zeros mark the body)."""

    def rescale(live):
        bound = F.struct(F.array_min(live).alias("lo"), (F.array_max(live) - F.array_min(live)).alias("span"))
        return let(bound, lambda b: F.transform(F.col(col), lambda v: (v - b["lo"]) / F.nullif(b["span"], F.lit(0.0))))

    return df.withColumn(col, let(F.filter(F.col(col), lambda v: v != 0), rescale))


def reference_offset(df: DataFrame, grid: Grid, col: str, switch_frame: int) -> DataFrame:
    """Subtract the mean of two inlet probes, or of two outlet probes after ``switch_frame``."""
    c = F.col(col)
    pair = lambda x: (grid.at(c, x, 1) + grid.at(c, x, grid.ny - 2)) / 2
    ref = F.when(F.col("frame") <= switch_frame, pair(1)).otherwise(pair(grid.nx - 2))
    return df.withColumn("_ref", ref).withColumn(col, F.transform(c, lambda v: v - F.col("_ref"))).drop("_ref")


def steady_change(df: DataFrame, u: str, w: str, p: str) -> DataFrame:
    """Largest velocity or pressure change of any cell since the previous frame of the run.

    The previous frame arrives by an equi-join on (run, frame - 1), so a long run
    is spread over tasks like any other.
    """
    cur = df.select("run", "frame", F.col(u).alias("u1"), F.col(w).alias("w1"), F.col(p).alias("p1"))
    old = df.select("run", (F.col("frame") + 1).alias("frame"), F.col(u).alias("u0"), F.col(w).alias("w0"), F.col(p).alias("p0"))
    zipped = F.arrays_zip("u1", "w1", "p1", "u0", "w0", "p0")
    change = F.transform(
        zipped,
        lambda z: F.greatest(F.hypot(z["u1"] - z["u0"], z["w1"] - z["w0"]), F.abs(z["p1"] - z["p0"])),
    )
    return cur.join(old, ["run", "frame"]).select("run", "frame", F.array_max(change).alias("change"))


def aligned(ref: DataFrame, other: DataFrame, col: str, offset: int = 0) -> DataFrame:
    """Frames of ``ref`` beside frame + offset of ``other``, over the overlap only."""
    b = other.select("run", (F.col("frame") - offset).alias("frame"), F.col(col).alias("b"))
    return ref.select("run", "frame", F.col(col).alias("a")).join(b, ["run", "frame"])


def overlap_code(df: DataFrame, threshold: float) -> DataFrame:
    """Per cell of aligned frames: 0 neither, 1 reference only, 2 other only, 3 both."""
    code = F.zip_with("a", "b", lambda a, b: (a > threshold).cast("int") + 2 * (b > threshold).cast("int"))
    return df.withColumn("code", code)


def overlap_metrics(df: DataFrame) -> DataFrame:
    """IoU, precision, recall and area fractions from the overlap codes; NULL when undefined."""
    count = lambda k: F.size(F.filter("code", lambda c: c == k))
    d = df.select("run", "frame", F.size("code").alias("n"), count(1).alias("ra"), count(2).alias("oa"), count(3).alias("both"))
    ratio = lambda p, q: p / F.nullif(q, F.lit(0))
    return d.select(
        "run",
        "frame",
        ratio(F.col("both"), F.col("ra") + F.col("oa") + F.col("both")).alias("iou"),
        ratio(F.col("both"), F.col("oa") + F.col("both")).alias("precision"),
        ratio(F.col("both"), F.col("ra") + F.col("both")).alias("recall"),
        ((F.col("ra") + F.col("both")) / F.col("n")).alias("ref_fraction"),
        ((F.col("oa") + F.col("both")) / F.col("n")).alias("other_fraction"),
    )


def grey_levels(df: DataFrame, col: str, skip_first: bool = True) -> DataFrame:
    """Map values to 0..255 by the extremes over every frame (frame 0 aside when asked)."""
    src = df.filter(F.col("frame") > 0) if skip_first else df
    ext = src.agg(F.min(F.array_min(col)).alias("_lo"), F.max(F.array_max(col)).alias("_hi"))
    span = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return (
        df.join(F.broadcast(ext))
        .withColumn(col, F.transform(F.col(col), lambda v: 255 * (v - F.col("_lo")) / span))
        .drop("_lo", "_hi")
    )


# --- per-cell and per-run statistics ---------------------------------------------------


def long_cells(df: DataFrame, col: str = "v") -> DataFrame:
    return df.select("run", "frame", F.posexplode(col).alias("cell", "v"))


def temporal_mean(df: DataFrame, col: str = "v", from_frame: int = 0) -> DataFrame:
    return long_cells(df.filter(F.col("frame") >= from_frame), col).groupBy("run", "cell").agg(F.avg("v").alias("mean"))


def fluctuation_rms(df: DataFrame, col: str = "v") -> DataFrame:
    """Per cell: root of the summed squares of the fluctuation, and the root mean square."""
    return long_cells(df, col).groupBy("run", "cell").agg(
        (F.stddev_pop("v") * F.sqrt(F.count("v"))).alias("root_sum"), F.stddev_pop("v").alias("rms")
    )


def field_metrics(df: DataFrame, reference_run: int, col: str = "v") -> DataFrame:
    """Norms of each run and their share of the reference run's, in percent."""
    m = long_cells(df, col).groupBy("run").agg(
        F.avg("v").alias("mean"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
        F.sum(F.abs("v")).alias("l1"),
        F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("l2"),
        F.var_pop("v").alias("var"),
    ).withColumn("linf", F.greatest("hi", -F.col("lo")))
    names = ["mean", "l1", "l2", "linf", "var"]
    ref = m.filter(F.col("run") == reference_run).select(*[F.col(n).alias("_" + n) for n in names])
    pct = [(F.col(n) * 100 / F.nullif(F.col("_" + n), F.lit(0.0))).alias(n + "_pct") for n in names]
    return m.join(F.broadcast(ref)).select("run", "lo", "hi", *names, *pct)


def mse_psnr(df: DataFrame) -> DataFrame:
    """Squared error of aligned frames over the cell count, and the peak signal-to-noise ratio.

    The divisor is the cells of one frame, whatever the number of frames. NULL PSNR
    when the error is 0.
    """
    err = F.aggregate(F.zip_with("a", "b", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)
    d = df.select("run", err.alias("e"), F.size("a").alias("cells")).groupBy("run").agg(
        (F.sum("e") / F.max("cells")).alias("mse")
    )
    return d.withColumn("psnr", 10 * F.log10(255.0 * 255.0 / F.nullif("mse", F.lit(0.0))))


def global_ssim(df: DataFrame) -> DataFrame:
    """Luminance, contrast and structure of aligned frames from population moments per run."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    m = (
        df.select("run", F.inline(F.arrays_zip("a", "b")))
        .groupBy("run")
        .agg(
            F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.var_pop("a").alias("va"),
            F.var_pop("b").alias("vb"), F.covar_pop("a", "b").alias("cov"),
        )
    )
    ma, mb, va, vb, cov = [F.col(c) for c in ("ma", "mb", "va", "vb", "cov")]
    dev = F.sqrt(va) * F.sqrt(vb)
    light = (2 * ma * mb + c1) / (ma * ma + mb * mb + c1)
    return m.select("run", (light * ((2 * dev + c2) / (va + vb + c2)) * ((cov + c2 / 2) / (dev + c2 / 2))).alias("ssim"))


def median_background(df: DataFrame, col: str = "v", low: float = -0.5, high: float = 0.5) -> DataFrame:
    """Per-cell median over the frames as an 8-bit grey level (fraction dropped)."""
    grey = F.floor(F.least(F.greatest((F.col("v") - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * 255)
    return long_cells(df, col).withColumn("g", grey).groupBy("run", "cell").agg(F.floor(F.median("g")).alias("bg"))


def foreground(df: DataFrame, background: DataFrame, col: str, limit: int, low: float = -0.5, high: float = 0.5) -> DataFrame:
    """Foreground cells per frame: grey level further than ``limit`` from the background.

    The background is packed into one array per run before the join, so frames
    meet it by run and are never multiplied by cells in the shuffle.
    """
    packed = background.groupBy("run").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cell", "bg"))), lambda s: s["bg"]).alias("bg")
    )
    grey = lambda v: F.floor(F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * 255)
    fg = F.zip_with(F.col(col), F.col("bg"), lambda v, b: F.abs(grey(v) - b) > limit)
    return df.join(packed, "run").withColumn("fg", fg)


def mean_profile(df: DataFrame, by: str, value: str, divide_by_points: bool = False) -> DataFrame:
    """Mean of ``value`` per position over the snapshots.

    ``divide_by_points`` divides the sum by the number of positions instead of
    the number of snapshots.
    """
    agg = df.groupBy(by).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    if not divide_by_points:
        return agg.select(by, (F.col("_s") / F.col("_n")).alias("mean"))
    points = df.agg(F.count_distinct(by).alias("_points"))
    return agg.join(F.broadcast(points)).select(by, (F.col("_s") / F.col("_points")).alias("mean"))


def sensor_name(sx: Column, sy: Column, idx: Column) -> Column:
    """S1, S2 or S4 by rounded position, else S and the index."""
    xi, yi = F.bround(sx), F.bround(sy)
    return (
        F.when((xi == 198) & (yi == 80), "S1")
        .when((xi == 146) & (yi == 80), "S2")
        .when((xi == 200) & (yi == 39), "S4")
        .otherwise(F.concat(F.lit("S"), idx.cast("string")))
    )


"""Body contours and polygon labels: one closed ring per row as ``ARRAY<STRUCT<x, y>>``."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeframe.functions import arrays, geometry as geo
from wakeframe.functions.grid import Grid, let
from wakeframe.operators import filters
from wakeframe.operators.vortices import line_integrals


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


# --- ring editing ------------------------------------------------------------------------


def rotate(ring: Column, first: Column) -> Column:
    """Turn the ring so that vertex ``first`` comes first."""
    return arrays.roll(ring, -first)


def first_occurrences(ring: Column) -> Column:
    """Ring without repeated points, keeping the first of each."""
    return F.array_distinct(ring)


def close(ring: Column) -> Column:
    return F.concat(ring, F.slice(ring, 1, 1))


def repeats(ring: Column) -> Column:
    """(pos, x, y) of every vertex that repeats an earlier one."""

    def find(r):
        marked = F.transform(r, lambda p, i: F.struct(i.alias("pos"), p["x"].alias("x"), p["y"].alias("y")))
        return F.filter(marked, lambda m: F.array_position(r, point(m["x"], m["y"])) - 1 < m["pos"])

    return let(ring, find)


def neighbour_angles(ring: Column, reach: int) -> Column:
    """Angle in degrees at each vertex between the vertices ``reach`` before and after."""

    def angles(r):
        def at(p, i):
            n = F.size(r)
            a, c = F.get(r, F.pmod(i - reach, n).cast("int")), F.get(r, F.pmod(i + reach, n).cast("int"))
            return geo.angle_degrees(a["x"], a["y"], p["x"], p["y"], c["x"], c["y"])

        return F.transform(r, at)

    return let(ring, angles)


def most_acute(ring: Column, reach: int = 5) -> Column:
    """Index of the smallest angle, first on a tie."""
    return let(neighbour_angles(ring, reach), lambda a: (F.array_position(a, F.array_min(a)) - 1).cast("int"))


def opposite_end(ring: Column, tail: Column) -> Column:
    """First vertex at which the length walked from ``tail`` reaches half the perimeter."""

    length = lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"])

    def walk(q):
        start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("hit"))

        def step(acc, v):
            s = acc["s"] + v
            hit = F.coalesce(acc["hit"], F.when(s >= q["half"], acc["i"] + 1))
            return F.struct(s.alias("s"), (acc["i"] + 1).alias("i"), hit.alias("hit"))

        return F.pmod(F.aggregate(q["lengths"], start, step)["hit"] + tail, F.size(q["lengths"]))

    turned = F.transform(arrays.roll(geo.edges(ring), -tail), length)
    return let(F.struct(turned.alias("lengths"), (geo.perimeter(ring) / 2).alias("half")), walk)


def slopes(ring: Column, vertical: float = 1e10) -> Column:
    """dy/dx of each vertex's neighbours around the ring; equal x gives ``vertical``."""

    def all_slopes(r):
        def at(p, i):
            n = F.size(r)
            a, b = F.get(r, F.pmod(i + 1, n).cast("int")), F.get(r, F.pmod(i - 1, n).cast("int"))
            return F.when(a["x"] == b["x"], F.lit(vertical)).otherwise((a["y"] - b["y"]) / (a["x"] - b["x"]))

        return F.transform(r, at)

    return let(ring, all_slopes)


def smoothed_derivative(arr: Column, step: float, window: int = 11, degree: int = 3) -> Column:
    """Local cubic smoothing (edges use the edge fit), then second-order differences."""
    grid = np.vander(np.arange(window) - window // 2, degree + 1, increasing=True).astype(float)
    hat = grid @ np.linalg.pinv(grid)
    table = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in hat])
    half = window // 2

    def smooth(s):
        a, w = s["a"], s["w"]
        n = F.size(a)

        def at(v, i):
            start = F.greatest(F.lit(0), F.least(i - half, n - window))
            row = F.get(w, (i - start).cast("int"))
            return arrays.total(F.zip_with(F.slice(a, start + 1, window), row, lambda p, q: p * q))

        return F.transform(a, at)

    def differ(a):
        n = F.size(a)
        g = lambda i: F.get(a, F.lit(i) if isinstance(i, int) else i)

        def at(v, i):
            first = (-3 * g(0) + 4 * g(1) - g(2)) / (2 * step)
            last = (3 * g(n - 1) - 4 * g(n - 2) + g(n - 3)) / (2 * step)
            return F.when(i == 0, first).when(i == n - 1, last).otherwise((g(i + 1) - g(i - 1)) / (2 * step))

        return F.transform(a, at)

    body = let(F.struct(arr.alias("a"), table.alias("w")), lambda s: let(smooth(s), differ))
    return F.when(F.size(arr) >= window, body)


def resample_ring(ring: Column, count: int) -> Column:
    """``count`` points at even arc length from the first vertex, piecewise linear, ring closed."""

    def walk(es):
        lengths = F.transform(es, lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))
        start = F.struct(F.lit(0.0).alias("s"), F.array(F.lit(0.0)).alias("all"))
        cum = lambda ls: F.aggregate(
            ls, start, lambda acc, v: F.struct((acc["s"] + v).alias("s"), F.concat(acc["all"], F.array(acc["s"] + v)).alias("all"))
        )["all"]
        return let(lengths, lambda ls: let(F.struct(es.alias("e"), ls.alias("l"), cum(ls).alias("c")), place))

    def place(q):
        def at(k):
            s = F.element_at(q["c"], -1) * k / (count - 1)
            i = F.least(F.size(F.filter(q["c"], lambda v: v <= s)) - 1, F.size(q["e"]) - 1).cast("int")
            seg = F.struct(F.get(q["e"], i).alias("e"), ((s - F.get(q["c"], i)) / F.get(q["l"], i)).alias("t"))
            return let(
                seg,
                lambda g: point(
                    g["e"]["x1"] + (g["e"]["x2"] - g["e"]["x1"]) * g["t"], g["e"]["y1"] + (g["e"]["y2"] - g["e"]["y1"]) * g["t"]
                ),
            )

        return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), at)

    return let(geo.edges(ring), walk)


def periodic_spline(x: np.ndarray, y: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Periodic cubic spline of a ring over arc length, at ``count`` even parameters (closed)."""
    seg = np.hypot(np.diff(np.append(x, x[0])), np.diff(np.append(y, y[0])))
    n, cum = len(x), np.concatenate([[0.0], np.cumsum(seg)])
    prev = np.roll(seg, 1)
    system = np.diag(2 * (prev + seg))
    i = np.arange(n)
    system[i, (i + 1) % n] += seg
    system[i, (i - 1) % n] += prev
    at = np.linspace(0, cum[-1], count)
    k = np.clip(np.searchsorted(cum, at, side="right") - 1, 0, n - 1)
    t, u, h = at - cum[k], cum[k + 1] - at, seg[k]
    out = []
    for v in (x, y):
        nxt = np.roll(v, -1)
        rhs = 6 * ((nxt - v) / seg - (v - np.roll(v, 1)) / prev)
        m = np.linalg.solve(system, rhs)
        mn = np.roll(m, -1)
        out.append((m[k] * u**3 + mn[k] * t**3) / (6 * h) + (v[k] / h - m[k] * h / 6) * u + (nxt[k] / h - mn[k] * h / 6) * t)
    return out[0], out[1]


def resample_ring_cubic(ring: Column, count: int) -> Column:
    """Like ``resample_ring`` with a periodic cubic spline through the distinct vertices."""

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(xs, ys):
            px, py = periodic_spline(np.asarray(x, float), np.asarray(y, float), count)
            out.append([{"x": a, "y": b} for a, b in zip(px, py)])
        return pd.Series(out, dtype=object)

    clean = first_occurrences(ring)
    return run(F.transform(clean, lambda p: p["x"]), F.transform(clean, lambda p: p["y"]))


def _ring_system(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Cyclic bands (diagonal, next, next but one) of R and of Q'Q, and the weights of Q', for steps ``h`` around a ring.

    R holds the products of the hat functions, Q' takes second differences: R g = Q' f for values f and curvatures g.
    """
    ahead, back = 1 / h, 1 / np.roll(h, 1)
    mid = -(ahead + back)
    r = np.stack([(np.roll(h, 1) + h) / 3, h / 6, np.zeros(len(h))])
    q = np.stack([back**2 + mid**2 + ahead**2, mid * np.roll(back, -1) + ahead * np.roll(mid, -1), ahead * np.roll(back, -2)])
    return r, q, (ahead, back)


def _solve_ring(bands: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solutions (k, n, m) of k symmetric cyclic systems, given by bands (k, 3, n), for right sides (n, m).

    The last two unknowns border a banded matrix, which is factored row by row for all k at once. Rings of fewer
    than six points, on which bands overlap, are solved as they are.
    """
    k, _, n = bands.shape
    if n < 6:
        full, i = np.zeros((k, n, n)), np.arange(n)
        for step in (0, 1, 2):
            np.add.at(full, (slice(None), i, (i + step) % n), bands[:, step])
            if step:
                np.add.at(full, (slice(None), (i + step) % n, i), bands[:, step])
        return np.linalg.solve(full, np.broadcast_to(rhs, (k, *rhs.shape)))
    d0, d1, d2 = bands[:, 0], bands[:, 1], bands[:, 2]
    m = n - 2
    border = np.zeros((k, m, 2))
    border[:, m - 2, 0], border[:, m - 1, 0], border[:, 0, 0] = d2[:, m - 2], d1[:, m - 1], d2[:, n - 2]
    border[:, m - 1, 1], border[:, 0, 1], border[:, 1, 1] = d2[:, m - 1], d1[:, n - 1], d2[:, n - 1]
    x = np.concatenate([border, np.broadcast_to(rhs[:m], (k, m, rhs.shape[1]))], axis=2)
    pivot, low1, low2 = np.zeros((k, m)), np.zeros((k, m)), np.zeros((k, m))
    for i in range(m):
        pivot[:, i] = d0[:, i]
        one = d1[:, i].copy()
        if i:
            pivot[:, i] -= pivot[:, i - 1] * low1[:, i - 1] ** 2
            one -= pivot[:, i - 1] * low1[:, i - 1] * low2[:, i - 1]
            x[:, i] -= low1[:, [i - 1]] * x[:, i - 1]
        if i > 1:
            pivot[:, i] -= pivot[:, i - 2] * low2[:, i - 2] ** 2
            x[:, i] -= low2[:, [i - 2]] * x[:, i - 2]
        low1[:, i], low2[:, i] = one / pivot[:, i], d2[:, i] / pivot[:, i]
    for i in range(m - 1, -1, -1):
        x[:, i] /= pivot[:, [i]]
        if i < m - 1:
            x[:, i] -= low1[:, [i]] * x[:, i + 1]
        if i < m - 2:
            x[:, i] -= low2[:, [i]] * x[:, i + 2]
    corner = np.stack([np.stack([d0[:, m], d1[:, m]], 1), np.stack([d1[:, m], d0[:, m + 1]], 1)], 1)
    turned = border.transpose(0, 2, 1)
    tail = np.linalg.solve(corner - turned @ x[:, :, :2], rhs[m:] - turned @ x[:, :, 2:])
    return np.concatenate([x[:, :, 2:] - x[:, :, :2] @ tail, tail], axis=1)


def smoothing_spline(x: np.ndarray, y: np.ndarray, count: int, target: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Periodic cubic smoothing spline of a ring over chord length: ``count`` even points (closed) and its residual.

    Of all closed curves whose squared distances to the vertices sum to ``target``, the one of least integrated squared
    curvature (Reinsch): the penalty is searched in its logarithm, 17 at a time. A target of 0 gives the spline through the
    vertices, one beyond the vertices' spread about their mean that mean.
    """
    v = np.stack([x, y], 1)
    seg = np.hypot(*(np.roll(v, -1, 0) - v).T)
    total = float(((v - v.mean(0)) ** 2).sum())
    if len(v) < 3 or total <= target:
        return np.full(count, x.mean()), np.full(count, y.mean()), total
    h = seg / seg.sum()
    r, q, (ahead, back) = _ring_system(h)
    second = lambda f: (np.roll(f, -1, -2) - f) * ahead[:, None] - (f - np.roll(f, 1, -2)) * back[:, None]
    low, high, best = -18.0, 8.0, None
    for _ in range(7 if target > 0 else 0):
        tried = np.linspace(low, high, 17)
        bend = _solve_ring(r + 10 ** tried[:, None, None] * q, second(v))
        residual = (10 ** (2 * tried)) * (second(bend) ** 2).sum((1, 2))
        k = int(np.clip(np.searchsorted(residual, target), 1, 16))
        best = min((k - 1, k), key=lambda j: abs(residual[j] - target))
        best = (v - 10 ** tried[best] * second(bend[best]), bend[best], float(residual[best]))
        low, high = tried[k - 1], tried[k]
    f, g, left = best if best else (v, _solve_ring(r[None], second(v))[0], 0.0)
    cum = np.concatenate([[0.0], np.cumsum(h)])
    at = np.linspace(0, cum[-1], count)
    k = np.clip(np.searchsorted(cum, at, side="right") - 1, 0, len(h) - 1)
    t, u, w = (at - cum[k])[:, None], (cum[k + 1] - at)[:, None], h[k][:, None]
    after, turn = np.roll(f, -1, 0)[k], np.roll(g, -1, 0)[k]
    p = (g[k] * u**3 + turn * t**3) / (6 * w) + (f[k] / w - g[k] * w / 6) * u + (after / w - turn * w / 6) * t
    return p[:, 0], p[:, 1], left


def smooth_ring(ring: Column, count: int, target: float | None = None) -> Column:
    """STRUCT<points, residual> of a smoothing spline through a ring's distinct vertices, ``count`` points, closed.

    ``target`` is the sum of squared distances that is allowed; without one, a quarter of the points of the closed ring,
    rounded down. A ring without vertices has no points, one of fewer than three distinct ones is its mean.
    """

    @F.pandas_udf("struct<points:array<struct<x:double,y:double>>,residual:double>")
    def run(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        points, residuals = [], []
        for x, y in zip(xs, ys):
            if x is None or not len(x):
                points.append([])
                residuals.append(0.0)
                continue
            px, py, left = smoothing_spline(np.asarray(x, float), np.asarray(y, float), count, (len(x) + 1) // 4 if target is None else target)
            points.append([{"x": a, "y": b} for a, b in zip(px, py)])
            residuals.append(left)
        return pd.DataFrame({"points": points, "residual": residuals})

    clean = first_occurrences(ring)
    return run(F.transform(clean, lambda p: p["x"]), F.transform(clean, lambda p: p["y"]))


# --- measures ------------------------------------------------------------------------------


def area_and_moment(ring: Column) -> Column:
    """(area, moment) about the vertices' mean; positive for clockwise vertices (y up)."""
    cx = arrays.total(F.transform(ring, lambda p: p["x"])) / F.size(ring)
    cy = arrays.total(F.transform(ring, lambda p: p["y"])) / F.size(ring)

    def measure(s):
        centred = F.transform(s["r"], lambda p: point(p["x"] - s["cx"], p["y"] - s["cy"]))

        def terms(e):
            da = e["x1"] * e["y2"] - e["x2"] * e["y1"]
            sq = e["x1"] * e["x1"] + e["x1"] * e["x2"] + e["x2"] * e["x2"] + e["y1"] * e["y1"] + e["y1"] * e["y2"] + e["y2"] * e["y2"]
            return F.struct((-0.5 * da).alias("a"), (-sq * da / 12).alias("m"))

        def measure_edges(es):
            parts = F.transform(es, terms)
            return F.struct(
                arrays.total(F.transform(parts, lambda t: t["a"])).alias("area"),
                arrays.total(F.transform(parts, lambda t: t["m"])).alias("moment"),
            )

        return let(geo.edges(centred), measure_edges)

    return let(F.struct(ring.alias("r"), cx.alias("cx"), cy.alias("cy")), measure)


def _overlap_areas(p: np.ndarray, q: np.ndarray) -> tuple[float, float, float]:
    """Exact areas (of p, of q, of both) of two polygons given as vertex arrays (n, 2); non-zero winding.

    Between neighbouring abscissas of vertices and edge crossings no edge begins, ends or crosses
    another, so every covered length is linear there and its value in the middle times the width is exact.
    """
    start = np.concatenate([p, q])
    step = np.concatenate([np.roll(p, -1, axis=0), np.roll(q, -1, axis=0)]) - start
    first = np.arange(len(start)) < len(p)
    cross = lambda u, v: u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0]
    turn = cross(step[:, None], step[None])
    along = np.divide(cross(start[None] - start[:, None], step[None]), turn, out=np.full_like(turn, -1.0), where=turn != 0)
    meet = (along >= 0) & (along <= 1) & (along.T >= 0) & (along.T <= 1)
    xs = np.unique(np.concatenate([start[:, 0], (start[:, None, 0] + along * step[:, None, 0])[meet]]))
    middle, width = (xs[1:] + xs[:-1])[:, None] / 2, np.diff(xs)
    low, high = np.minimum(start[:, 0], start[:, 0] + step[:, 0]), np.maximum(start[:, 0], start[:, 0] + step[:, 0])
    spans = (low < middle) & (middle < high)
    slope = np.divide(step[:, 1], step[:, 0], out=np.zeros(len(step)), where=step[:, 0] != 0)
    y = np.where(spans, start[:, 1] + (middle - start[:, 0]) * slope, np.inf)
    order = np.argsort(y, axis=1)
    sign = np.take_along_axis(np.where(spans, np.sign(step[:, 0]), 0.0), order, axis=1)
    inside = [np.cumsum(np.where(own[order], sign, 0.0), axis=1)[:, :-1] != 0 for own in (first, ~first)]
    ys = np.take_along_axis(y, order, axis=1)
    gap = np.where(np.isfinite(ys[:, 1:]), ys[:, 1:] - np.where(np.isfinite(ys[:, :-1]), ys[:, :-1], 0.0), 0.0)
    return tuple(float((width[:, None] * np.where(test, gap, 0.0)).sum()) for test in (*inside, inside[0] & inside[1]))


def overlap_areas(a: Column, b: Column) -> Column:
    """(in_a, in_b, both): exact areas of two polygons and of their intersection, wherever they lie."""

    @F.arrow_udf("in_a double, in_b double, both double")
    def run(ps: pa.Array, qs: pa.Array) -> pa.Array:
        ring = lambda v: np.column_stack([v.values.field(c).to_numpy(zero_copy_only=False) for c in ("x", "y")]).astype(float)
        areas = [_overlap_areas(ring(p), ring(q)) for p, q in zip(ps, qs)]
        return pa.StructArray.from_arrays([pa.array(v, pa.float64()) for v in (zip(*areas) if areas else ((), (), ()))], ["in_a", "in_b", "both"])

    return run(a, b)


def overlap_scores(df: DataFrame, areas: str) -> DataFrame:
    """Intersection area, IoU and the intersection's change against the first polygon in percent."""
    c = F.col(areas)
    union = c["in_a"] + c["in_b"] - c["both"]
    return df.withColumns(
        {
            "intersection": c["both"],
            "iou": c["both"] / F.nullif(union, F.lit(0.0)),
            "variation": 100 * (c["both"] - c["in_a"]) / F.nullif(c["in_a"], F.lit(0.0)),
        }
    )


def average_precision(df: DataFrame, iou: str, thresholds: list[float]) -> DataFrame:
    """Hit at 0.5 and mean hit over the thresholds."""
    hits = F.array(*[(F.col(iou) >= t).cast("double") for t in thresholds])
    return df.withColumns({"ap50": (F.col(iou) >= 0.5).cast("double"), "map": arrays.total(hits) / len(thresholds)})


def pressure_load(grid: Grid, field: Column, ring: Column, vx: Column, vy: Column, spin: Column) -> Column:
    """(fx, fy, moment, power) of a pressure field on a closed contour, sampled at edge centres."""
    cx = arrays.total(F.transform(ring, lambda p: p["x"])) / F.size(ring)
    cy = arrays.total(F.transform(ring, lambda p: p["y"])) / F.size(ring)

    def load(s):
        def term(e):
            mx, my = (e["x1"] + e["x2"]) / 2, (e["y1"] + e["y2"]) / 2
            pressure = grid.bilinear(s["f"], mx, my)
            # Edge length times its normal (-ty, tx).
            return F.struct(
                (-pressure * (e["y2"] - e["y1"])).alias("fx"), (pressure * (e["x2"] - e["x1"])).alias("fy"),
                (mx - s["cx"]).alias("rx"), (my - s["cy"]).alias("ry"),
            )

        def collect(ts):
            sum_of = lambda fn: arrays.total(F.transform(ts, fn))
            return F.struct(
                sum_of(lambda t: t["fx"]).alias("fx"),
                sum_of(lambda t: t["fy"]).alias("fy"),
                sum_of(lambda t: t["fy"] * t["rx"] - t["fx"] * t["ry"]).alias("moment"),
                sum_of(lambda t: t["fx"] * (vx - spin * t["ry"]) + t["fy"] * (vy + spin * t["rx"])).alias("power"),
            )

        return let(F.transform(geo.edges(s["r"]), term), collect)

    return let(F.struct(field.alias("f"), ring.alias("r"), cx.alias("cx"), cy.alias("cy")), load)


def mean_translation(df: DataFrame, ring: str = "poly") -> DataFrame:
    """Mean displacement of a contour's vertices since the previous frame."""
    old = df.select("run", (F.col("frame") + 1).alias("frame"), F.col(ring).alias("_old"))
    mean = lambda axis: arrays.mean(F.zip_with(F.col(ring), "_old", lambda p, q: p[axis] - q[axis]))
    return df.join(old, ["run", "frame"]).select("run", "frame", mean("x").alias("dx"), mean("y").alias("dy"))


def bounding_box(df: DataFrame, keys: list[str], ring: str = "poly") -> DataFrame:
    """Extent of all contours of a key; each row gives its own extremes first."""
    ext = lambda fn, axis: fn(F.transform(ring, lambda p: p[axis]))
    return df.groupBy(*keys).agg(
        F.min(ext(F.array_min, "x")).alias("min_x"), F.min(ext(F.array_min, "y")).alias("min_y"),
        F.max(ext(F.array_max, "x")).alias("max_x"), F.max(ext(F.array_max, "y")).alias("max_y"),
    )


def trajectory_summary(df: DataFrame, head: int, tail: int, h: float, fps: float, ring: str = "poly") -> DataFrame:
    """Distance, mean length and duration per run, with the head and tail tracks in frame order.

    The tracks are one number per frame of one recording.
    """
    at = lambda i, axis: F.get(F.col(ring), F.lit(i))[axis]
    length = F.hypot(at(head, "x") - at(tail, "x"), at(head, "y") - at(tail, "y")) * h
    rows = F.array_sort(F.collect_list(F.struct("frame", at(head, "y").alias("h"), at(tail, "y").alias("t"))))
    g = df.groupBy("run").agg(
        (F.abs(F.max_by(at(head, "x"), "frame") - F.min_by(at(head, "x"), "frame")) * h).alias("distance"),
        F.avg(length).alias("length"),
        (F.count(F.lit(1)) / fps).alias("duration"),
        rows.alias("_rows"),
    )
    return g.withColumns({"head": F.transform("_rows", lambda r: r["h"]), "tail": F.transform("_rows", lambda r: r["t"])}).drop("_rows")


def tailbeat(df: DataFrame, fps: float, nu: float = 1e-6) -> DataFrame:
    """Tail-beat frequency, Strouhal and Reynolds numbers from a trajectory summary.

    The tail track loses its own low-passed form, the cutoff being the highest
    frequency of the head track above a tenth of its peak. A track too short or too still for that filter
    has no frequency (NULL, and so the Strouhal number and the beats); its run keeps its other numbers.
    """
    d = df.withColumn("_spec", filters.amplitude_spectrum(F.col("head"), fps))
    d = d.withColumn("_cut", filters.dominant(F.col("_spec"))["cutoff"])
    d = d.withColumn("_swing", filters.detrend_adaptive(F.col("tail"), F.col("_cut"), fps))
    d = d.withColumn("_spec", filters.amplitude_spectrum(F.col("_swing"), fps))
    d = d.withColumn("frequency", filters.dominant(F.col("_spec"))["freq"])
    speed = F.nullif(F.col("distance") / F.col("duration"), F.lit(0.0))
    return d.withColumns(
        {
            "strouhal": F.col("frequency") * F.col("length") / speed,
            "reynolds": speed * F.col("length") / nu,
            "reynolds_printed": F.col("length") * F.col("length") / speed * 1000000,
            "lengths": F.col("distance") / F.col("length"),
            "beats": F.col("duration") * F.col("frequency"),
        }
    ).drop("_cut", "_swing", "_spec")


# --- growing vortex cores -------------------------------------------------------------------


def grow_cores(df: DataFrame, grid: Grid, field: str, r0: float, dr: float, r_max: float, tolerance: float, per_radius: float) -> DataFrame:
    """Radius and rough circulation of each core: it grows while its rim keeps ``tolerance`` of the centre.

    Needs (x, y, w) per core and the frame's array; each core row is on its own.
    """
    radii = [r0 + k * dr for k in range(int(round((r_max - r0) / dr)))]
    lines = line_integrals(grid, field, F.col("x").cast("double"), F.col("y").cast("double"), radii, per_radius)
    rims = F.zip_with(lines, F.array(*[F.lit(r) for r in radii]), lambda v, r: F.struct(v.alias("line"), r.alias("r")))
    start = F.struct(F.lit(float(r0)).alias("r"), F.lit(0.0).alias("g"), F.lit(True).alias("on"))

    def step(acc, t):
        on = acc["on"] & (F.abs(t["line"] / (2 * F.pi() * t["r"])) > tolerance * F.abs(F.col("w")))
        return F.struct(
            F.when(on, t["r"] + dr).otherwise(acc["r"]).alias("r"),
            F.when(on, acc["g"] + t["line"] * dr).otherwise(acc["g"]).alias("g"),
            on.alias("on"),
        )

    d = df.withColumn("_rims", rims).withColumn("_g", F.aggregate("_rims", start, step))
    return d.withColumns({"r": F.col("_g.r"), "rough": F.col("_g.g")}).drop("_g", "_rims")


def suppress_cores(df: DataFrame, dr: float) -> DataFrame:
    """Drop a core when a stronger one of its sign, in its frame, comes within both radii plus 2 dr.

    Order-free form: every core is judged against all others at once. The cores of a
    frame meet as one array, bounded by the grid.
    """
    core = F.struct("x", "y", "w", "r", "rough")
    packed = df.groupBy("run", "frame").agg(F.collect_list(core).alias("_all"))

    def beaten(c):
        return F.exists(
            "_all",
            lambda o: (F.hypot(o["x"] - c["x"], o["y"] - c["y"]) < o["r"] + c["r"] + 2 * dr)
            & (o["w"] * c["w"] > 0)
            & ((F.abs(o["rough"]) > F.abs(c["rough"])) | ((F.abs(o["rough"]) == F.abs(c["rough"])) & (F.struct(o["x"], o["y"]) < F.struct(c["x"], c["y"])))),
        )

    return packed.select("run", "frame", F.inline(F.filter("_all", lambda c: ~beaten(c))))

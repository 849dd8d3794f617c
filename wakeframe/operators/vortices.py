"""Vortex regions: connected components, region statistics, sensors, walls, occlusion.

A frame's regions are an array on its row, cut out of whole batches of frames; a region carries its
boundary as an array, so the geometry is expressions on the row and nothing is shuffled.
``region`` is the smallest raster position (y * nx + x) of the component, which
orders regions as a row-by-row scan meets them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeframe.functions.geometry import ARRAYS, CONTACT, segment_gap
from wakeframe.functions.grid import Grid, blend, shift
from wakeframe.operators import fields

FRAME = ["run", "frame"]


def _run_minimum(labels: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Smallest label along each unbroken stretch of the last axis."""
    width = labels.shape[-1]
    flat, on = labels.ravel(), mask.ravel()
    first = np.ones(flat.size, bool)
    first[1:] = on[1:] != on[:-1]
    first[::width] = True
    starts = np.flatnonzero(first)
    low = np.minimum.reduceat(flat, starts)
    return np.repeat(low, np.diff(np.append(starts, flat.size))).reshape(labels.shape)


def component_ids(masks: np.ndarray) -> np.ndarray:
    """4-connected components of a stack (frames, nx, ny): smallest raster position, or -1."""
    _, nx, ny = masks.shape
    far = nx * ny
    raster = np.arange(ny)[None, :] * nx + np.arange(nx)[:, None]
    labels = np.where(masks, raster[None], far)
    turned = np.ascontiguousarray(masks.transpose(0, 2, 1))
    while True:
        step = np.where(masks, _run_minimum(labels, masks), far)
        back = np.ascontiguousarray(step.transpose(0, 2, 1))
        step = np.where(turned, _run_minimum(back, turned), far).transpose(0, 2, 1)
        if np.array_equal(step, labels):
            return np.where(masks, labels, -1)
        labels = np.ascontiguousarray(step)


def label_components(df: DataFrame, grid: Grid, mask: str = "mask", out: str = "region") -> DataFrame:
    """Add the component id of every cell. Map-only: a frame is one row of an Arrow batch."""
    return df.withColumn(out, grid.apply(lambda m: component_ids(m > 0), mask, out="int"))


REGION = "region int, area bigint, core_x double, core_y double, core_q double, radius double, boundary array<struct<y:int,x:int>>"
_REGIONS = "array<struct<" + ",".join(p.strip().replace(" ", ":", 1) for p in REGION.split(", ")) + ">>"


def _stack(column: pa.Array, grid: Grid) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), grid.nx, grid.ny)


def _edges(labels: np.ndarray) -> np.ndarray:
    """Cells of a region with a 4-neighbour outside it; the grid border counts as outside."""
    wide = np.pad(labels, ((0, 0), (1, 1), (1, 1)), constant_values=-1)
    same = [shift(wide, dx, dy) == labels for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))]
    return (labels >= 0) & ~np.logical_and.reduce(same)


def _region_arrays(masks: np.ndarray, values: np.ndarray) -> pa.Array:
    """For each frame the list of its regions, in the order of their ids."""
    n, nx, ny = masks.shape
    # Raster order, so that a stable sort by region keeps it.
    turn = lambda a: a.transpose(0, 2, 1).reshape(n, nx * ny)
    labels = component_ids(masks)
    by_raster, edge, value = turn(labels), turn(_edges(labels)), turn(values)
    frame, cell = np.nonzero(by_raster >= 0)
    key = frame * (nx * ny) + by_raster[frame, cell]
    order = np.argsort(key, kind="stable")
    key, frame, cell = key[order], frame[order], cell[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, int)
    area = np.diff(np.append(first, len(key)))
    own = value[frame, cell]
    top = np.lexsort((np.arange(len(key)), -own, key))[first]  # of each region the largest value, the first of equals
    on_edge = np.flatnonzero(edge[frame, cell])
    point = pa.StructArray.from_arrays([pa.array(cell[on_edge] // nx, pa.int32()), pa.array(cell[on_edge] % nx, pa.int32())], ["y", "x"])
    bounds = pa.array(np.searchsorted(on_edge, np.append(first, len(key))), pa.int32())
    arrays = [
        pa.array(by_raster[frame[first], cell[first]], pa.int32()),
        pa.array(area, pa.int64()),
        pa.array((cell[top] % nx).astype(float)),
        pa.array((cell[top] // nx).astype(float)),
        pa.array(own[top]),
        pa.array(np.sqrt(area / np.pi)),
        pa.ListArray.from_arrays(bounds, point),
    ]
    rows = pa.StructArray.from_arrays(arrays, [p.split()[0] for p in REGION.split(", ")])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(frame[first], np.arange(n + 1)), pa.int32()), rows)


def frame_regions(df: DataFrame, grid: Grid, value: str, mask: str = "mask", out: str = "regions") -> DataFrame:
    """Add the frame's regions as one array: area, core (first largest value in raster order), radius, boundary.

    Map-only: a frame is one row of an Arrow batch, whole batches are labelled and cut up at once.
    """

    @F.arrow_udf(_REGIONS)
    def found(masks: pa.Array, values: pa.Array) -> pa.Array:
        return _region_arrays(_stack(masks, grid), _stack(values, grid))

    return df.withColumn(out, found(F.transform(mask, lambda m: m.cast("boolean")), F.col(value)))


def regions(df: DataFrame, grid: Grid, value: str, mask: str = "mask") -> DataFrame:
    """One row per component, without a shuffle."""
    return frame_regions(df, grid, value, mask).select(*FRAME, F.inline("regions"))


def _extended(array: Column, names: list[str], new) -> Column:
    """The array with more fields in its structs; ``new`` maps a field getter to named columns."""
    return F.transform(
        array, lambda r: F.struct(*[r[n].alias(n) for n in names], *[c.alias(n) for n, c in new(lambda n: r[n]).items()])
    )


def sensor_array(sensors: list[tuple[int, float, float]]) -> Column:
    return F.array(
        *[F.struct(F.lit(i).alias("id"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for i, x, y in sensors]
    )


def _sensor(get, sensors: list[tuple[int, float, float]]) -> Column:
    """(d, id, x, y) of the nearest sensor, lowest id on a tie."""
    gap = lambda s: F.hypot(get("core_x") - s["x"], get("core_y") - s["y"])
    return F.array_min(F.transform(sensor_array(sensors), lambda s: F.struct(gap(s).alias("d"), s["id"].alias("id"), s["x"].alias("x"), s["y"].alias("y"))))


def _sensor_fields(get) -> dict[str, Column]:
    return {"sensor_id": get("_s")["id"], "sensor_x": get("_s")["x"], "sensor_y": get("_s")["y"], "sensor_distance": get("_s")["d"]}


def _no_sensor(get) -> dict[str, Column]:
    none = F.lit(None).cast("double")
    return {"sensor_id": F.lit(-1), "sensor_x": none, "sensor_y": none, "sensor_distance": none}


def closest_sensor(df: DataFrame, sensors: list[tuple[int, float, float]], max_distance: float = 0.0) -> DataFrame:
    """Nearest sensor of each core (lowest id on a tie); drops cores further than ``max_distance``."""
    if not sensors:
        return df.withColumns(_no_sensor(F.col))
    out = df.withColumn("_s", _sensor(F.col, sensors)).withColumns(_sensor_fields(F.col)).drop("_s")
    return out.filter(F.col("sensor_distance") <= max_distance) if max_distance > 0 else out


def _edge_point(get) -> Column:
    """(d, y, x) of the boundary point nearest to the region's sensor, first in raster order on a tie."""
    sx, sy = get("sensor_x"), get("sensor_y")
    square = lambda p: (p["x"] - sx) * (p["x"] - sx) + (p["y"] - sy) * (p["y"] - sy)
    return F.array_min(F.transform(get("boundary"), lambda p: F.struct(square(p).alias("d"), p["y"].alias("y"), p["x"].alias("x"))))


def _edge_fields(get) -> dict[str, Column]:
    return {"edge_x": get("_e")["x"].cast("double"), "edge_y": get("_e")["y"].cast("double")}


def closest_edge(df: DataFrame) -> DataFrame:
    """Boundary point nearest to the region's sensor, first in raster order on a tie."""
    return df.withColumn("_e", _edge_point(F.col)).withColumns(_edge_fields(F.col)).drop("_e")


def _wall_names(name: str) -> list[str]:
    return [f"wall_{name}_{c}" for c in ("x1", "y1", "x2", "y2")]


def _wall_fields(get, wall_y: float | None, tol: float, name: str) -> dict[str, Column]:
    if wall_y is None:
        return {c: F.lit(None).cast("double") for c in _wall_names(name)}
    near = F.filter(get("boundary"), lambda p: F.abs(p["y"] - wall_y) <= tol)
    left = F.array_min(F.transform(near, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    right = F.array_max(F.transform(near, lambda p: F.struct(p["x"].alias("x"), (-p["y"]).alias("y"))))
    two = F.size(near) > 1
    values = [left["x"], left["y"], F.when(two, right["x"]), F.when(two, -right["y"])]
    return {c: v.cast("double") for c, v in zip(_wall_names(name), values)}


def wall_intersections(df: DataFrame, wall_y: float | None, tol: float, name: str) -> DataFrame:
    """Leftmost and rightmost boundary points within ``tol`` of a wall; one point leaves the second NULL."""
    return df.withColumns(_wall_fields(F.col, wall_y, tol, name))


def _links(owner: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Unit links between 8-neighbouring points of one owner as rows (point, dx, dy), each once from the smaller (x, y).

    Points get one code each, so a neighbour is a code at a fixed distance.
    """
    if not len(x):
        return np.empty((0, 3), int)
    high = int(y.max()) + 3
    code = (owner.astype(np.int64) * (int(x.max()) + 3) + x + 1) * high + y + 1
    found = []
    for dx, dy in ((0, 1), (1, -1), (1, 0), (1, 1)):
        at = np.flatnonzero(np.isin(code + dx * high + dy, code))
        found.append(np.column_stack([at, np.full(len(at), dx), np.full(len(at), dy)]))
    return np.concatenate(found)


def boundary_segments(points: Column) -> Column:
    """Unit links between 8-neighbouring boundary points, each once from the smaller (x, y)."""

    @F.arrow_udf("array<struct<x0:int,y0:int,x1:int,y1:int>>")
    def run(lists: pa.Array) -> pa.Array:
        x, y = (lists.flatten().field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("x", "y"))
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        link = _links(owner, x, y)
        link = link[np.argsort(owner[link[:, 0]], kind="stable")]
        at, dx, dy = link.T
        ends = [pa.array(v, pa.int32()) for v in (x[at], y[at], x[at] + dx, y[at] + dy)]
        bounds = pa.array(np.searchsorted(owner[at], np.arange(len(lists) + 1)), pa.int32())
        return pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(ends, ["x0", "y0", "x1", "y1"]))

    return run(points)


def _last_contour(df: DataFrame, contours: DataFrame) -> DataFrame:
    """``poly`` of the frame; frames after the run's last contour use that one."""
    last = contours.groupBy("run").agg(F.max("frame").alias("_last"))
    poly = contours.select("run", F.col("frame").alias("_f"), "poly")
    return df.join(last, "run").withColumn("_f", F.least("frame", "_last")).join(poly, ["run", "_f"]).drop("_last", "_f")


def _to_body(get, poly: Column) -> Column:
    return F.array_min(F.transform(poly, lambda p: F.hypot(p["x"] - get("core_x"), p["y"] - get("core_y"))))


def body_distance(df: DataFrame, contours: DataFrame, minimum: float = 0.0) -> DataFrame:
    """Distance of each core to the nearest contour vertex; later frames use the last contour."""
    out = _last_contour(df, contours).withColumn("body_distance", _to_body(F.col, F.col("poly"))).drop("poly")
    return out.filter(F.col("body_distance") >= minimum) if minimum > 0 else out


def frame_visibility(array: Column, sensors: list[tuple[int, float, float]], eps: float) -> Column:
    """For an array of a frame's regions, whether at least one sensor sees each core.

    A sensor does not see a core if a boundary link of a nearer region crosses its ray or comes within
    ``eps``; equally near regions count in raster order. Each ray is tested against all links at once.
    """
    cores = [F.transform(array, _field(c)) for c in ("core_x", "core_y", "boundary")]

    @F.arrow_udf("array<boolean>")
    def seen(xs: pa.Array, ys: pa.Array, boundaries: pa.Array) -> pa.Array:
        at = np.array([s[1:] for s in sensors], float)
        sx, sy = at[:, 0][:, None, None], at[:, 1][:, None, None]
        flags = [np.empty(0, bool)]
        for cx, cy, lists in zip(xs, ys, boundaries):
            x, y = (c.values.to_numpy(zero_copy_only=False) for c in (cx, cy))
            if not len(x):
                continue
            sizes = lists.values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            px, py = (lists.values.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            owner = np.repeat(np.arange(len(x)), sizes)
            link, dx, dy = _links(owner, px, py).T
            # Rank of each region by distance from each sensor; ties keep raster order.
            rank = np.argsort(np.argsort(np.hypot(x[None] - at[:, :1], y[None] - at[:, 1:]), axis=1, kind="stable"), axis=1, kind="stable")
            x0, y0 = px[link], py[link]
            gap = segment_gap(sx, sy, x[None, :, None], y[None, :, None], x0, y0, x0 + dx, y0 + dy, ARRAYS)
            hidden = ((gap <= max(eps, CONTACT)) & (rank[:, owner[link]][:, None, :] < rank[:, :, None])).any(axis=2)
            flags.append(~hidden.all(axis=0))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(xs.value_lengths().fill_null(0))), pa.int32()), pa.array(np.concatenate(flags)))

    return seen(*cores)


def _field(name: str):
    return lambda r: r[name]


def occlusion(df: DataFrame, sensors: list[tuple[int, float, float]], eps: float) -> DataFrame:
    """``visible`` of region rows: no nearer region of the frame hides the core from every sensor.

    The regions of a frame meet as one row (bounded by the grid). Where they still are one row, as in
    :func:`detect`, no shuffle is needed.
    """
    if not sensors:
        return df.withColumn("visible", F.lit(True))
    # The struct starts with the region, so sorting the array gives raster order.
    cols = ["region", *[c for c in df.columns if c not in (*FRAME, "region")]]
    packed = df.groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("d"))
    flags = packed.withColumn("_f", frame_visibility(F.col("d"), sensors, eps))
    rows = flags.select(*FRAME, F.inline(F.arrays_zip("d", "_f")))
    return rows.select(*FRAME, "d.*", F.col("_f").alias("visible"))


def detect(
    df: DataFrame,
    grid: Grid,
    value: str,
    threshold: float,
    min_area: int = 1,
    sigma: float = 0.0,
    contours: DataFrame | None = None,
    body_distance_min: float = 0.0,
    sensors: list[tuple[int, float, float]] = (),
    sensor_max_distance: float = 0.0,
    wall_top: float | None = None,
    wall_bottom: float | None = None,
    wall_tol: float = 0.5,
    occlusion_eps: float | None = None,
) -> DataFrame:
    """Smooth, mask, label, then area, body, sensor, edge, wall and occlusion steps, in that order.

    A frame stays one row until the end; its regions are an array that the steps filter and extend, so
    only the contours are joined.
    """
    d = fields.fill_missing(df, value).drop("filled")
    if sigma > 0:
        d = fields.gaussian_smooth(d, grid, value, sigma, value)
    d = frame_regions(fields.threshold_mask(d, value, threshold), grid, value, out="found").select(*FRAME, "found")
    names = [p.split()[0] for p in REGION.split(", ")]

    def extend(d, new, fields_: list[str], drop: str | None = None):
        nonlocal names
        out = d.withColumn("found", _extended(F.col("found"), [n for n in names if n != drop], new))
        names = [n for n in names if n != drop] + fields_
        return out

    def keep(d, test):
        return d.withColumn("found", F.filter("found", test)).filter(F.size("found") > 0)

    d = keep(d, lambda r: r["area"] >= min_area)
    if contours is not None:
        d = extend(_last_contour(d, contours), lambda get: {"body_distance": _to_body(get, F.col("poly"))}, ["body_distance"]).drop("poly")
        if body_distance_min > 0:
            d = keep(d, lambda r: r["body_distance"] >= body_distance_min)
    else:
        d = extend(d, lambda get: {"body_distance": F.lit(None).cast("double")}, ["body_distance"])
    sensors = list(sensors)
    at_sensor = ["sensor_id", "sensor_x", "sensor_y", "sensor_distance"]
    if sensors:
        d = extend(d, lambda get: {"_s": _sensor(get, sensors)}, ["_s"])
        d = extend(d, _sensor_fields, at_sensor, "_s")
        if sensor_max_distance > 0:
            d = keep(d, lambda r: r["sensor_distance"] <= sensor_max_distance)
    else:
        d = extend(d, _no_sensor, at_sensor)
    d = extend(d, lambda get: {"_e": _edge_point(get)}, ["_e"])
    rest = lambda get: {**_edge_fields(get), **_wall_fields(get, wall_top, wall_tol, "top"), **_wall_fields(get, wall_bottom, wall_tol, "bottom")}
    d = extend(d, rest, ["edge_x", "edge_y", *_wall_names("top"), *_wall_names("bottom")], "_e")
    if occlusion_eps is None or not sensors:
        return d.select(*FRAME, F.inline("found")).withColumn("visible", F.lit(True))
    flags = d.withColumn("_f", frame_visibility(F.col("found"), sensors, occlusion_eps))
    return flags.select(*FRAME, F.inline(F.arrays_zip("found", "_f"))).select(*FRAME, "found.*", F.col("_f").alias("visible"))


def detect_peaks(
    df: DataFrame,
    grid: Grid,
    value: str,
    threshold: float,
    size: int = 15,
    sigma: float = 1.0,
    minima_only: bool = False,
    poly: str | None = None,
    distance_min: float = 5.0,
) -> DataFrame:
    """Smoothed local extremes as vortex centres, away from the contour's vertices.

    Distances are measured from the surviving peaks only, never for a whole map.
    """
    d = fields.gaussian_smooth(df, grid, value, sigma, "_s")
    d = fields.local_peaks(d, grid, "_s", size, threshold)
    keep = [poly] if poly else []
    zipped = F.arrays_zip(F.col("peak"), F.col("_s").alias("v"))
    long = d.select(*FRAME, *keep, F.posexplode(zipped).alias("cell", "_z"))
    wanted = F.col("_z.peak") == -1 if minima_only else F.col("_z.peak") != 0
    x, y = grid.xy(F.col("cell"))
    out = long.filter(wanted).withColumns({"x": x, "y": y, "value": F.col("_z.v")})
    if poly:
        near = F.array_min(F.transform(poly, lambda p: F.hypot(p["x"] - F.col("x"), p["y"] - F.col("y"))))
        out = out.withColumn("distance", near).filter(F.col("distance") >= distance_min)
    else:
        out = out.withColumn("distance", F.lit(None).cast("double"))
    return out.select(*FRAME, "x", "y", "value", "distance")


# --- circulation around cores -----------------------------------------------------------


def _bilinear(a: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Samples of stacked frames (k, nx, ny) at points (k, n), clamped half a cell inside."""
    x, y = (np.clip(c, 0.5, n - 1.5) for c, n in zip((x, y), a.shape[1:]))
    x0, y0 = (np.minimum(c.astype(int), n - 2) for c, n in zip((x, y), a.shape[1:]))
    frame = np.arange(len(a))[:, None]
    return blend(lambda p, q: a[frame, x0 + p, y0 + q], x - x0, y - y0)


def _circle(r: float, per_radius: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Offsets of the samples on a circle and their angular step."""
    points = max(1, int(r * per_radius + 0.5))
    angle = np.arange(points) * 2 * np.pi / points
    return r * np.cos(angle), r * np.sin(angle), 2 * np.pi / points


def _around(grid: Grid, fn, *cols) -> Column:
    """Column from ``fn(arrays..., cx, cy)`` over stacked frames; the last two columns are centres."""

    @F.pandas_udf("array<double>")
    def run(*series: pd.Series) -> pd.Series:
        if not len(series[0]):
            return pd.Series([], dtype=object)
        stacks = [np.stack(c.to_numpy()).astype(float).reshape(len(c), grid.nx, grid.ny) for c in series[:-2]]
        cx, cy = [c.to_numpy(float)[:, None] for c in series[-2:]]
        return pd.Series(list(fn(*stacks, cx, cy)), dtype=object)

    return run(*cols)


def rim_integrals(a: np.ndarray, cx: np.ndarray, cy: np.ndarray, radii: list[float], per_radius: float, same_sign: bool = True) -> np.ndarray:
    """Line integral of a scalar on circles (k, radii); optionally only samples with the centre's sign."""
    mid, out = _bilinear(a, cx, cy), []
    for r in radii:
        dx, dy, step = _circle(r, per_radius)
        f = _bilinear(a, cx + dx, cy + dy)
        out.append((np.where(f * mid > 0, f, 0.0) if same_sign else f).sum(axis=1) * r * step)
    return np.stack(out, axis=1)


def line_integrals(grid: Grid, arr: str, cx: Column, cy: Column, radii: list[float], per_radius: float, same_sign: bool = True) -> Column:
    return _around(grid, lambda a, x, y: rim_integrals(a, x, y, radii, per_radius, same_sign), arr, cx, cy)


def circulation_integral(grid: Grid, u: str, w: str, cx: Column, cy: Column, r: float, per_radius: float) -> Column:
    """Velocity circulation: u dx + w dy summed along a circle."""

    def walk(a, b, x, y):
        dx, dy, step = _circle(r, per_radius)
        back = np.arange(len(dx)) * step - step
        along = _bilinear(a, x + dx, y + dy) * (dx - r * np.cos(back)) + _bilinear(b, x + dx, y + dy) * (dy - r * np.sin(back))
        return along.sum(axis=1, keepdims=True)

    return _around(grid, walk, u, w, cx, cy)[0]


def area_integral(grid: Grid, arr: str, cx: Column, cy: Column, radii: list[float], dr: float, per_radius: float) -> Column:
    """Same-sign area integral on concentric rings, plus the centre disc."""

    def area(a, x, y):
        total = _bilinear(a, x, y)[:, 0] * np.pi * dr * dr / 4
        rims = rim_integrals(a, x, y, radii, per_radius)
        for k, r in enumerate(radii):
            top = r if r == radii[-1] else r + dr / 2
            total = total + rims[:, k] / r * (top**2 - (r - dr / 2) ** 2) / 2
        return total[:, None]

    return _around(grid, area, arr, cx, cy)[0]

"""Plane-geometry expressions on columns: orientation, segments, angles, polygons."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# What the formulas below need of columns and of numpy arrays. A ratio with a zero divisor is 0.
COLUMNS = SimpleNamespace(
    unit=lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)),
    ratio=lambda p, q: F.coalesce(p / F.nullif(q, F.lit(0.0)), F.lit(0.0)),
    hypot=F.hypot,
)
ARRAYS = SimpleNamespace(
    unit=lambda v: np.clip(v, 0.0, 1.0),
    ratio=lambda p, q: np.where(q == 0, 0.0, p / np.where(q == 0, 1.0, q)),
    hypot=np.hypot,
)
# Gaps up to this length count as contact.
CONTACT = 1e-9


def distance(ax, ay, bx, by) -> Column:
    return F.hypot(ax - bx, ay - by)


def orient(ax, ay, bx, by, cx, cy) -> Column:
    """Twice the signed area of the triangle a, b, c."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def on_segment(ax, ay, bx, by, cx, cy, eps: float = CONTACT) -> Column:
    """c lies in the box around segment ab, grown by ``eps``: no further from its middle than half its sides."""
    inside = lambda p, q, r: F.abs(2 * r - p - q) <= F.abs(q - p) + 2 * eps
    return inside(ax, bx, cx) & inside(ay, by, cy)


def segment_gap(ax, ay, bx, by, cx, cy, dx, dy, on: SimpleNamespace = COLUMNS):
    """Distance of two segments, 0 where they cross; either may be a point.

    Both are written with a parameter from 0 to 1. The first parameter solves for the lines' closest
    points and is clamped; then each parameter follows from the other by projection, clamped again.
    """
    ux, uy, vx, vy, wx, wy = bx - ax, by - ay, dx - cx, dy - cy, ax - cx, ay - cy
    uu, vv, uv = ux * ux + uy * uy, vx * vx + vy * vy, ux * vx + uy * vy
    uw, vw = ux * wx + uy * wy, vx * wx + vy * wy
    first = on.unit(on.ratio(uv * vw - uw * vv, uu * vv - uv * uv))
    other = on.unit(on.ratio(uv * first + vw, vv))
    first = on.unit(on.ratio(uv * other - uw, uu))
    return on.hypot(wx + first * ux - other * vx, wy + first * uy - other * vy)


def segments_cross(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """The segments have a point in common: a crossing, a touch or an overlap."""
    return segment_gap(ax, ay, bx, by, cx, cy, dx, dy) <= CONTACT


def point_segment_distance(px, py, ax, ay, bx, by) -> Column:
    return segment_gap(ax, ay, bx, by, px, py, px, py)


def segments_cross_or_close(ax, ay, bx, by, cx, cy, dx, dy, eps: float) -> Column:
    """Segments no further apart than ``eps``, crossing ones included."""
    return segment_gap(ax, ay, bx, by, cx, cy, dx, dy) <= max(eps, CONTACT)


def angle_degrees(ax, ay, bx, by, cx, cy) -> Column:
    """Angle at b between a and c, with the cosine clamped to [-1, 1]; NULL for a zero side."""
    ux, uy, vx, vy = ax - bx, ay - by, cx - bx, cy - by
    norm = F.hypot(ux, uy) * F.hypot(vx, vy)
    cosine = (ux * vx + uy * vy) / F.nullif(norm, F.lit(0.0))
    return F.when(
        cosine.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    )


def square_window(cx, cy, size, width, height) -> Column:
    """Square crop of side ``size`` around (cx, cy), shifted to stay inside the image."""

    def place(c, limit):
        low = F.floor(c - size / 2)
        return F.greatest(F.lit(0), F.least(low, F.lit(limit) - size)).cast("int")

    x0, y0 = place(cx, width), place(cy, height)
    return F.struct(
        x0.alias("x0"), y0.alias("y0"), (x0 + size).cast("int").alias("x1"), (y0 + size).cast("int").alias("y1")
    )


# --- polygons as ARRAY<STRUCT<x, y>> on one row ---------------------------------------


def edges(poly: Column) -> Column:
    """Directed edges of a closed polygon, last vertex joined to the first."""
    nxt = F.concat(F.slice(poly, 2, F.size(poly)), F.slice(poly, 1, 1))
    return F.zip_with(
        poly,
        nxt,
        lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")),
    )


def _sum(arr: Column, term) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, e: acc + term(e))


def perimeter(poly: Column) -> Column:
    return _sum(edges(poly), lambda e: F.hypot(e["x2"] - e["x1"], e["y2"] - e["y1"]))


def shoelace(poly: Column) -> Column:
    """Signed area, positive for counter-clockwise vertices (y up)."""
    return _sum(edges(poly), lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]) * 0.5

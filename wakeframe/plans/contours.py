"""Contour and polygon queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from wakeframe.functions import geometry as geo
from wakeframe.operators import contours as ops, fields
from wakeframe.plans.filters import smooth_pass
from wakeframe.plans.registry import query
from wakeframe.plans.fields import UVW, inner, nb
from wakeframe.plans.views import GRID, OCTAGON, contours, frames, sql, velocity
from wakeframe.plans.vortices import bil

K = ["run", "frame"]
KF = "run:i frame:i "


def poly():
    return F.col("poly")


# Ring of frame pairs and a coarse ring with repeated points.
COARSE = "crs AS (SELECT run, frame, vertex, round(x) AS x, round(y) AS y FROM ring)"


def coarse(spark, sf):
    return contours(spark, sf).withColumn("poly", F.transform("poly", lambda p: ops.point(F.round(p["x"]), F.round(p["y"]))))


@query(
    "W17_rotate_ring",
    KF + "vertex:i x:6 y:6",
    sql("ring", "SELECT run, frame, (vertex - label % 8 + 8) % 8 AS vertex, x, y FROM ring"),
)
def w17(spark, sf):
    d = contours(spark, sf)
    return d.select(*K, F.posexplode(ops.rotate(poly(), F.col("label") % 8)).alias("vertex", "p")).select(*K, "vertex", "p.*")


@query(
    "W18_distinct_closed_ring",
    KF + "vertex:i x:6 y:6",
    sql(
        "ring",
        """SELECT run, frame, k AS vertex, x, y FROM dst UNION ALL SELECT run, frame, (SELECT max(k) + 1 FROM dst e WHERE e.run = d.run AND e.frame = d.frame), x, y FROM dst d WHERE k = 0""",
        COARSE,
        "dst AS (SELECT *, row_number() OVER (PARTITION BY run, frame ORDER BY vertex) - 1 AS k FROM (SELECT run, frame, min(vertex) AS vertex, x, y FROM crs GROUP BY run, frame, x, y))",
    ),
)
def w18(spark, sf):
    ring = ops.close(ops.first_occurrences(poly()))
    return coarse(spark, sf).select(*K, F.posexplode(ring).alias("vertex", "p")).select(*K, "vertex", "p.*")


@query(
    "W21_repeated_points",
    KF + "pos:i x:6 y:6",
    sql("ring", "SELECT run, frame, vertex AS pos, x, y FROM crs QUALIFY row_number() OVER (PARTITION BY run, frame, x, y ORDER BY vertex) > 1", COARSE),
)
def w21(spark, sf):
    return coarse(spark, sf).select(*K, F.inline(ops.repeats(poly())))


# An uneven ring: the octagon's radius varies with the frame's values.
BUMPY = """bmp AS (SELECT run, frame, vertex, 4 + (2 + 6 * v[vertex + 11]) * c AS x, 4 + (2 + 6 * v[vertex + 11]) * s AS y FROM fr, oct),
  bedge AS (SELECT a.run, a.frame, a.vertex, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, hypot(b.x - a.x, b.y - a.y) AS len
  FROM bmp a JOIN bmp b ON a.run = b.run AND a.frame = b.frame AND b.vertex = (a.vertex + 1) % 8)"""


def bumpy(spark, sf):
    ring = F.array(
        *[ops.point(4 + (2 + 6 * F.col("v")[10 + i]) * c, 4 + (2 + 6 * F.col("v")[10 + i]) * s) for i, (c, s) in enumerate(OCTAGON)]
    )
    return frames(spark, sf).withColumn("poly", ring)


def angle_sql(reach):
    return f"""ang{reach} AS (SELECT p.run, p.frame, p.vertex, degrees(acos(greatest(-1, least(1, ((a.x - p.x) * (c.x - p.x) + (a.y - p.y) * (c.y - p.y)) /
      (hypot(a.x - p.x, a.y - p.y) * hypot(c.x - p.x, c.y - p.y)))))) AS angle FROM bmp p JOIN bmp a ON a.run = p.run AND a.frame = p.frame AND a.vertex = (p.vertex - {reach} + 8) % 8
      JOIN bmp c ON c.run = p.run AND c.frame = p.frame AND c.vertex = (p.vertex + {reach}) % 8)"""


@query(
    "W19_most_acute_vertex",
    KF + "one:i three:i",
    sql(
        "fr oct",
        "SELECT run, frame, arg_min(vertex, (round(a.angle, 9), vertex)) AS one, arg_min(vertex, (round(b.angle, 9), vertex)) AS three FROM ang1 a JOIN ang3 b USING (run, frame, vertex) GROUP BY run, frame",
        BUMPY, angle_sql(1), angle_sql(3),
    ),
)
def w19(spark, sf):
    return bumpy(spark, sf).select(*K, ops.most_acute(poly(), 1).alias("one"), ops.most_acute(poly(), 3).alias("three"))


@query(
    "W20_opposite_end",
    KF + "tail:i head:i",
    sql(
        "fr oct",
        """SELECT run, frame, any_value(tail) AS tail, (min(step) FILTER (walked >= half) + any_value(tail)) % 8 AS head FROM (SELECT e.run, e.frame, tail, (vertex - tail + 8) % 8 + 1 AS step,
        sum(len) OVER (PARTITION BY e.run, e.frame ORDER BY (vertex - tail + 8) % 8) AS walked, sum(len) OVER (PARTITION BY e.run, e.frame) / 2 AS half
        FROM bedge e JOIN (SELECT run, frame, arg_min(vertex, (round(angle, 9), vertex)) AS tail FROM ang1 GROUP BY run, frame) t ON t.run = e.run AND t.frame = e.frame) GROUP BY run, frame""",
        BUMPY, angle_sql(1),
    ),
)
def w20(spark, sf):
    d = bumpy(spark, sf).withColumn("tail", ops.most_acute(poly(), 1))
    return d.withColumn("head", ops.opposite_end(poly(), F.col("tail")))


@query(
    "W12_contour_slope",
    KF + "vertex:i slope:4",
    sql(
        "ring",
        """SELECT p.run, p.frame, p.vertex, CASE WHEN a.x = b.x THEN 1e10 ELSE (a.y - b.y) / (a.x - b.x) END AS slope FROM crs p JOIN crs a ON a.run = p.run AND a.frame = p.frame
        AND a.vertex = (p.vertex + 1) % 8 JOIN crs b ON b.run = p.run AND b.frame = p.frame AND b.vertex = (p.vertex + 7) % 8""",
        COARSE,
    ),
)
def w12(spark, sf):
    return coarse(spark, sf).select(*K, F.posexplode(ops.slopes(poly())).alias("vertex", "slope"))


_G = np.vander(np.arange(11) - 5, 4, increasing=True).astype(float)
_HAT = "[" + ", ".join("[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in r) + "]" for r in _G @ np.linalg.pinv(_G)) + "]"


@query(
    "W13_smoothed_derivative",
    KF + "pos:i d:6",
    sql(
        "fr",
        """SELECT run, frame, pos, CASE WHEN pos = 0 THEN -3 * s[1] + 4 * s[2] - s[3] WHEN pos = 63 THEN 3 * s[64] - 4 * s[63] + s[62] ELSE s[pos + 2] - s[pos] END AS d FROM
        (SELECT run, frame, list_transform(range(64), lambda i: list_sum(list_transform(range(1, 12), lambda k: hat[(i - greatest(0, least(i - 5, 53)) + 1)::INT][k] * v[greatest(0, least(i - 5, 53)) + k]))) AS s
        FROM fr, (SELECT $H AS hat)), range(64) r(pos)""".replace("$H", _HAT),
    ),
)
def w13(spark, sf):
    return frames(spark, sf).select(*K, F.posexplode(ops.smoothed_derivative(F.col("v"), 0.5)).alias("pos", "d"))


ARC = """arc AS (SELECT run, frame, k, whole * k / 23 AS s FROM (SELECT run, frame, sum(len) AS whole FROM bedge GROUP BY 1, 2), range(24) r(k)),
  cumu AS (SELECT *, sum(len) OVER (PARTITION BY run, frame ORDER BY vertex) - len AS lo FROM bedge)"""


@query(
    "Q17_resample_contour",
    KF + "k:i x:5 y:5",
    sql(
        "fr oct",
        """SELECT a.run, a.frame, k, x1 + (x2 - x1) * (s - lo) / len AS x, y1 + (y2 - y1) * (s - lo) / len AS y FROM arc a JOIN cumu c ON c.run = a.run AND c.frame = a.frame
        QUALIFY row_number() OVER (PARTITION BY a.run, a.frame, k ORDER BY CASE WHEN lo <= s + 1e-12 THEN 0 ELSE 1 END, lo DESC) = 1""",
        BUMPY, ARC,
    ),
)
def q17(spark, sf):
    return bumpy(spark, sf).select(*K, F.posexplode(ops.resample_ring(poly(), 24)).alias("k", "p")).select(*K, "k", "p.*")


@query("Q17_resample_contour_cubic", KF + "k:i x:5 y:5")
def q17c(spark, sf):
    return bumpy(spark, sf).select(*K, F.posexplode(ops.resample_ring_cubic(poly(), 24)).alias("k", "p")).select(*K, "k", "p.*")


@query("Q17_cubic_start", KF + "n:i x:6 y:6", sql("fr oct", "SELECT run, frame, 24 AS n, x, y FROM bmp WHERE vertex = 0", BUMPY))
def q17_start(spark, sf):
    """The spline is closed and passes through the first vertex, where the first point lies."""
    d = q17c(spark, sf)
    first = lambda c: F.max(F.when(F.col("k") == 0, F.col(c))).alias(c)
    return d.groupBy(*K).agg(F.count(F.lit(1)).alias("n"), first("x"), first("y"))


@query("Q17_resample_contour_smooth", KF + "k:i x:4 y:4")
def q17s(spark, sf):
    return bumpy(spark, sf).select(*K, F.posexplode(ops.smooth_ring(poly(), 24)["points"]).alias("k", "p")).select(*K, "k", "p.*")


@query(
    "Q17_smooth_residual",
    KF + "n:i residual:2 closed:b",
    sql(
        "fr oct",
        """SELECT run, frame, 24 AS n, least((count(*) + 1) // 4, sum(pow(x - mx, 2) + pow(y - my, 2))) AS residual, true AS closed
        FROM (SELECT *, avg(x) OVER (PARTITION BY run, frame) AS mx, avg(y) OVER (PARTITION BY run, frame) AS my FROM bmp) GROUP BY run, frame""",
        BUMPY,
    ),
)
def q17_residual(spark, sf):
    """The spline keeps to the residual it was allowed, or to the vertices' spread where that is less, and is closed."""
    s = bumpy(spark, sf).select(*K, ops.smooth_ring(poly(), 24).alias("s"))
    first, last = F.get("s.points", F.lit(0)), F.element_at("s.points", -1)
    return s.select(*K, F.size("s.points").alias("n"), "s.residual", (F.hypot(first["x"] - last["x"], first["y"] - last["y"]) < 1e-6).alias("closed"))


@query("A29_perimeter", KF + "perimeter:6", sql("fr oct", "SELECT run, frame, sum(len) AS perimeter FROM bedge GROUP BY run, frame", BUMPY))
def a29(spark, sf):
    return bumpy(spark, sf).select(*K, geo.perimeter(poly()).alias("perimeter"))


@query(
    "A30_area_moment",
    KF + "area:6 moment:5",
    sql(
        "fr oct",
        """SELECT run, frame, -sum(da) / 2 AS area, -sum((x1 * x1 + x1 * x2 + x2 * x2 + y1 * y1 + y1 * y2 + y2 * y2) * da) / 12 AS moment FROM
        (SELECT *, x1 * y2 - x2 * y1 AS da FROM (SELECT run, frame, x1 - cx AS x1, x2 - cx AS x2, y1 - cy AS y1, y2 - cy AS y2 FROM
        (SELECT *, avg(x1) OVER (PARTITION BY run, frame) AS cx, avg(y1) OVER (PARTITION BY run, frame) AS cy FROM bedge))) GROUP BY run, frame""",
        BUMPY,
    ),
)
def a30(spark, sf):
    return bumpy(spark, sf).select(*K, ops.area_and_moment(poly()).alias("m")).select(*K, "m.*")


# Exact areas by slabs between the abscissas of vertices and edge crossings, with non-zero winding.
OVER = """pair AS (SELECT run, frame, 0 AS src, vertex, x1, y1, x2, y2 FROM edge UNION ALL SELECT run, frame, 1, vertex, x1, y1, x2, y2 FROM bedge),
  crs AS (SELECT a.run, a.frame, a.x1, a.x2, (a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1) AS d,
    (b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1) AS na, (b.x1 - a.x1) * (a.y2 - a.y1) - (b.y1 - a.y1) * (a.x2 - a.x1) AS nb
    FROM pair a JOIN pair b ON a.run = b.run AND a.frame = b.frame AND (a.src < b.src OR (a.src = b.src AND a.vertex < b.vertex))),
  xs AS (SELECT run, frame, x1 AS x FROM pair UNION SELECT run, frame, x1 + na / d * (x2 - x1) FROM crs WHERE d <> 0 AND na / d BETWEEN 0 AND 1 AND nb / d BETWEEN 0 AND 1),
  slab AS (SELECT run, frame, x AS lo, lead(x) OVER (PARTITION BY run, frame ORDER BY x) AS hi FROM xs),
  hit AS (SELECT s.run, s.frame, lo, hi - lo AS width, src, sign(x2 - x1) AS way, y1 + ((lo + hi) / 2 - x1) * (y2 - y1) / (x2 - x1) AS y
    FROM slab s JOIN pair b ON s.run = b.run AND s.frame = b.frame AND least(x1, x2) < (lo + hi) / 2 AND greatest(x1, x2) > (lo + hi) / 2 WHERE hi IS NOT NULL),
  wound AS (SELECT run, frame, width, lead(y) OVER w - y AS gap, sum(CASE WHEN src = 0 THEN way ELSE 0 END) OVER w <> 0 AS in_a, sum(CASE WHEN src = 1 THEN way ELSE 0 END) OVER w <> 0 AS in_b
    FROM hit WINDOW w AS (PARTITION BY run, frame, lo ORDER BY y, src)),
  areas AS (SELECT run, frame, sum(CASE WHEN in_a THEN width * gap ELSE 0 END) AS a, sum(CASE WHEN in_b THEN width * gap ELSE 0 END) AS b, sum(CASE WHEN in_a AND in_b THEN width * gap ELSE 0 END) AS c
    FROM wound GROUP BY run, frame),
  ovl AS (SELECT run, frame, c AS intersection, c / nullif(a + b - c, 0) AS iou, 100 * (c - a) / nullif(a, 0) AS variation FROM areas)"""


def overlap(spark, sf):
    a = contours(spark, sf).select(*K, poly().alias("a"))
    b = bumpy(spark, sf).select(*K, poly().alias("b"))
    return ops.overlap_scores(a.join(b, K).withColumn("n", ops.overlap_areas(F.col("a"), F.col("b"))), "n")


@query("A31_polygon_overlap", KF + "intersection:4 iou:6 variation:4", sql("edge fr oct", "SELECT * FROM ovl", BUMPY, OVER))
def a31(spark, sf):
    return overlap(spark, sf)


THR = [0.5 + 0.05 * i for i in range(10)]


@query(
    "A32_average_precision",
    "run:i ap50:6 map:6 mean_iou:6",
    sql(
        "edge fr oct",
        f"SELECT run, avg((iou >= 0.5)::INT) AS ap50, avg({' + '.join(f'(iou >= {t!r}::DOUBLE)::INT' for t in THR)}) / 10 AS \"map\", avg(iou) AS mean_iou FROM ovl GROUP BY run",
        BUMPY, OVER,
    ),
)
def a32(spark, sf):
    d = ops.average_precision(overlap(spark, sf), "iou", THR)
    return d.groupBy("run").agg(F.avg("ap50").alias("ap50"), F.avg("map").alias("map"), F.avg("iou").alias("mean_iou"))


@query(
    "A33_pressure_load",
    KF + "fx:6 fy:6 moment:6 power:6",
    sql(
        "edge",
        f"""SELECT run, frame, sum(-p * (y2 - y1)) AS fx, sum(p * (x2 - x1)) AS fy, sum(p * (x2 - x1) * (mx - cx) + p * (y2 - y1) * (my - cy)) AS moment,
        sum(-p * (y2 - y1) * (v[9] - v[11] * (my - cy)) + p * (x2 - x1) * (v[10] + v[11] * (mx - cx))) AS power FROM
        (SELECT *, {bil('v', 'mx', 'my')} AS p FROM (SELECT e.*, f.v, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my, avg(x1) OVER (PARTITION BY e.run, e.frame) AS cx,
        avg(y1) OVER (PARTITION BY e.run, e.frame) AS cy FROM edge e JOIN fr f ON f.run = e.run AND f.frame = e.frame)) GROUP BY run, frame""",
    ),
)
def a33(spark, sf):
    v = F.col("v")
    load = ops.pressure_load(GRID, v, poly(), v[8], v[9], v[10])
    return contours(spark, sf).select(*K, load.alias("l")).select(*K, "l.*")


@query(
    "A38_mean_translation",
    KF + "dx:6 dy:6",
    sql("ring", "SELECT a.run, a.frame, avg(a.x - b.x) AS dx, avg(a.y - b.y) AS dy FROM ring a JOIN ring b ON a.run = b.run AND a.frame = b.frame + 1 AND a.vertex = b.vertex GROUP BY 1, 2"),
)
def a38(spark, sf):
    return ops.mean_translation(contours(spark, sf))


@query(
    "A39_bounding_box",
    "run:i min_x:6 min_y:6 max_x:6 max_y:6",
    sql("ring", "SELECT run, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM ring GROUP BY run"),
)
def a39(spark, sf):
    return ops.bounding_box(contours(spark, sf), ["run"])


TRAJECTORY = """SELECT a.run, abs(arg_max(a.x, a.frame) - arg_min(a.x, a.frame)) * 0.004 AS distance, avg(hypot(a.x - b.x, a.y - b.y)) * 0.004 AS length, count(*) / 100 AS duration
        FROM ring a JOIN ring b ON a.run = b.run AND a.frame = b.frame AND a.vertex = 0 AND b.vertex = 4 GROUP BY a.run"""


@query("A37_trajectory_summary", "run:i distance:6 length:6 duration:6", sql("ring", TRAJECTORY))
def a37(spark, sf):
    return ops.trajectory_summary(contours(spark, sf), 0, 4, 0.004, 100.0)


def track_spectrum(name: str, src: str) -> str:
    """Amplitudes of 50-frame tracks (run, i, y) at 100 frames a second."""
    part = lambda fn: f"pow(sum((y - mu) * {fn}(2 * pi() * k * i / 50)), 2)"
    return f"""{name} AS (SELECT run, k, k * 2.0 AS freq, 2.0 / 50 * sqrt({part('cos')} + {part('sin')}) AS amp FROM
      (SELECT *, avg(y) OVER (PARTITION BY run) AS mu FROM {src}), range(25) r(k) GROUP BY run, k)"""


BEAT = [
    "head AS (SELECT run, frame AS i, y FROM ring WHERE vertex = 0)",
    "tail AS (SELECT run, list(y ORDER BY frame) AS v FROM ring WHERE vertex = 4 GROUP BY run)",
    track_spectrum("hsp", "head"),
    """tap AS (SELECT run, 0 AS frame, k * k / d AS b0, 2 * k * k / d AS b1, 2 * (k * k - 1) / d AS a1, (1 - sqrt(2) * k + k * k) / d AS a2 FROM
      (SELECT run, k, 1 + sqrt(2) * k + k * k AS d FROM (SELECT run, tan(pi() * max(freq) FILTER (amp > top / 10) / 100) AS k FROM
      (SELECT *, max(amp) OVER (PARTITION BY run) AS top FROM hsp) GROUP BY run)))""",
    """ext AS (SELECT t.*, list_concat(list_concat(list_transform(range(9, 0, -1), lambda i: 2 * v[1] - v[i + 1]), v),
      list_transform(range(1, 10), lambda i: 2 * v[50] - v[50 - i])) AS e FROM tap t JOIN tail USING (run))""",
    smooth_pass("fwd", "ext"),
    "turned AS (SELECT run, frame, b0, b1, a1, a2, list(y ORDER BY m DESC) AS e FROM fwd GROUP BY ALL)",
    smooth_pass("bwd", "turned"),
    "swing AS (SELECT b.run, 68 - m - 9 AS i, t.v[68 - m - 9 + 1] - b.y AS y FROM bwd b JOIN tail t USING (run) WHERE 68 - m - 9 BETWEEN 0 AND 49)",
    track_spectrum("ssp", "swing"),
    "beat AS (SELECT run, arg_max(freq, (amp, -k)) AS frequency FROM ssp GROUP BY run)",
    f"trj AS ({TRAJECTORY})",
]


@query(
    "A37_tailbeat",
    "run:i frequency:4 strouhal:4 reynolds:3 reynolds_printed:1 lengths:4 beats:4",
    sql(
        "ring",
        """SELECT run, frequency, frequency * length / (distance / duration) AS strouhal, distance / duration * length / 1e-6 AS reynolds,
        length * length / (distance / duration) * 1000000 AS reynolds_printed, distance / length AS lengths, duration * frequency AS beats FROM trj JOIN beat USING (run)""",
        *BEAT,
    ),
)
def a37t(spark, sf):
    return ops.tailbeat(ops.trajectory_summary(contours(spark, sf), 0, 4, 0.004, 100.0), 100.0)


CORES = f"""cw AS (SELECT run, frame, x, y, cell, {inner(nb('u', 0, -1) + ' - u + w - ' + nb('w', -1))} AS v FROM uv {UVW}),
  ca AS (SELECT run, frame, list(v ORDER BY cell) AS a FROM cw GROUP BY run, frame),
  pk AS (SELECT * FROM (SELECT *, {nb('v', 1)} AS e, {nb('v', -1)} AS f, {nb('v', 0, 1)} AS g, {nb('v', 0, -1)} AS h FROM cw {UVW})
    WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 AND (greatest(e, f, g, h) < v OR least(e, f, g, h) > v) AND abs(v) > 0.2),
  rim AS (SELECT p.run, p.frame, p.x, p.y, p.v AS w, r, sum(CASE WHEN s * m > 0 THEN s ELSE 0 END) * r * 2 * pi() / floor(r * 6 + 0.5) / (2 * pi() * r) AS rim FROM
    (SELECT p.*, r, {bil('a', 'x + r * cos(i * 2 * pi() / floor(r * 6 + 0.5))', 'y + r * sin(i * 2 * pi() / floor(r * 6 + 0.5))')} AS s, {bil('a', 'x', 'y')} AS m
    FROM pk p JOIN ca USING (run, frame), (VALUES (0.5::DOUBLE), (1.0), (1.5), (2.0), (2.5)) q(r), range(15) z(i) WHERE i < floor(r * 6 + 0.5)) p GROUP BY p.run, p.frame, p.x, p.y, p.v, r),
  grw AS (SELECT run, frame, x, y, w, coalesce(min(r) FILTER (abs(rim) <= 0.2 * abs(w)), 3) AS r FROM rim GROUP BY run, frame, x, y, w),
  cor AS (SELECT g.run, g.frame, g.x, g.y, g.w, g.r, coalesce(sum(rim * 2 * pi() * q.r * 0.5) FILTER (q.r < g.r), 0) AS rough FROM grw g JOIN rim q ON q.run = g.run AND q.frame = g.frame AND q.x = g.x AND q.y = g.y GROUP BY g.run, g.frame, g.x, g.y, g.w, g.r)"""


@query(
    "A35_core_growth",
    KF + "x:i y:i w:6 r:3 rough:6",
    sql(
        "uv",
        """SELECT * FROM cor c WHERE NOT EXISTS (SELECT 1 FROM cor o WHERE o.run = c.run AND o.frame = c.frame AND hypot(o.x - c.x, o.y - c.y) < o.r + c.r + 1 AND o.w * c.w > 0
        AND (abs(o.rough) > abs(c.rough) OR (abs(o.rough) = abs(c.rough) AND (o.x, o.y) < (c.x, c.y))))""",
        CORES,
    ),
)
def a35(spark, sf):
    d = fields.curl(velocity(spark, sf), GRID)
    d = fields.strict_peaks(d, GRID, "curl")
    zipped = F.arrays_zip(F.col("peak"), F.col("curl").alias("w"))
    long = d.select(*K, "curl", F.posexplode(zipped).alias("cell", "_z")).filter((F.col("_z.peak") != 0) & (F.abs("_z.w") > 0.2))
    x, y = GRID.xy(F.col("cell"))
    cores = long.select(*K, "curl", x.alias("x"), y.alias("y"), F.col("_z.w").alias("w"))
    return ops.suppress_cores(ops.grow_cores(cores, GRID, "curl", 0.5, 0.5, 3.0, 0.2, 6), 0.5)

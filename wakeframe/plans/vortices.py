"""Vortex detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeframe.functions import geometry as geo
from wakeframe.functions.grid import explode_cells
from wakeframe.operators import fields, vortices as ops
from wakeframe.plans.fields import SMOOTH
from wakeframe.plans.registry import query
from wakeframe.plans.views import GRID, OCTAGON, SENSORS, contours, frames, sql, velocity

K = ["run", "frame"]

# Mask -> components -> region rows, as recursive SQL over a table named by {src}.
COMP = """m AS (SELECT run, frame, x, y, v FROM {src} WHERE v > {t}),
  reach AS (SELECT run, frame, x, y, y * 8 + x AS root FROM m UNION
    SELECT b.run, b.frame, b.x, b.y, r.root FROM reach r JOIN m b ON b.run = r.run AND b.frame = r.frame
    AND abs(b.x - r.x) + abs(b.y - r.y) = 1),
  lab AS (SELECT run, frame, x, y, min(root) AS region FROM reach GROUP BY run, frame, x, y),
  labv AS (SELECT lab.*, m.v FROM lab JOIN m USING (run, frame, x, y)),
  bnd AS (SELECT a.* FROM lab a LEFT JOIN lab b ON a.run = b.run AND a.frame = b.frame AND a.region = b.region
    AND abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY ALL HAVING count(b.x) < 4),
  reg AS (SELECT run, frame, region, count(*) AS area, arg_max(x, (v, -y, -x)) AS core_x, arg_max(y, (v, -y, -x)) AS core_y,
    max(v) AS core_q, sqrt(count(*) / pi()) AS radius FROM labv GROUP BY run, frame, region)"""
RAW = COMP.format(src="cells", t=0.05)
SMO = SMOOTH + ", " + COMP.format(src="smooth", t=0.02)


def masked(spark, sf):
    return fields.threshold_mask(frames(spark, sf), "v", 0.05)


def raw_regions(spark, sf):
    return ops.regions(masked(spark, sf), GRID, "v")


@query(
    "G20_connected_components",
    "run:i frame:i x:i y:i region:i",
    sql("cells", "SELECT c.run, c.frame, c.x, c.y, coalesce(region, -1) AS region FROM cells c LEFT JOIN lab USING (run, frame, x, y)", RAW),
)
def g20(spark, sf):
    return explode_cells(ops.label_components(masked(spark, sf), GRID), K, GRID, region="region")


@query("G21_region_boundary", "run:i frame:i region:i x:i y:i", sql("cells", "SELECT * FROM bnd", RAW))
def g21(spark, sf):
    return raw_regions(spark, sf).select(*K, "region", F.inline("boundary"))


SEGS = """segs AS (SELECT a.run, a.frame, a.region, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM bnd a JOIN bnd b
  ON a.run = b.run AND a.frame = b.frame AND a.region = b.region AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1
  AND (a.x < b.x OR (a.x = b.x AND a.y < b.y)))"""


@query("G22_boundary_segments", "run:i frame:i region:i x0:i y0:i x1:i y1:i", sql("cells", "SELECT * FROM segs", RAW, SEGS))
def g22(spark, sf):
    return raw_regions(spark, sf).select(*K, "region", F.inline(ops.boundary_segments(F.col("boundary"))))


REG = "run:i frame:i region:i area:i core_x:i core_y:i "


@query("A01_region_statistics", REG + "core_q:6 radius:6", sql("cells", "SELECT * FROM reg", RAW))
def a01(spark, sf):
    return raw_regions(spark, sf)


@query("P15_min_area", REG + "core_q:6", sql("cells", "SELECT * FROM reg WHERE area >= 3", RAW))
def p15(spark, sf):
    return raw_regions(spark, sf).filter(F.col("area") >= 3)


def short_contours(spark, sf):
    """25 contour frames per run, so the later half of a run uses its last contour."""
    cx, cy, r = 3.3 + 4 * F.col("u")[1], 3.4 + 4 * F.col("u")[2], 1.7 + 2 * F.col("w")[3]
    ring = F.array(*[F.struct((cx + r * c).alias("x"), (cy + r * s).alias("y")) for c, s in OCTAGON])
    return velocity(spark, sf).select(*K, ring.alias("poly"))


SHORT = """sring AS (SELECT (a.vec_id // 50)::INT AS run, ((a.vec_id // 2) % 25)::INT AS frame,
  3.3 + 4 * a.embedding[2]::DOUBLE + (1.7 + 2 * b.embedding[4]::DOUBLE) * c AS px, 3.4 + 4 * a.embedding[3]::DOUBLE + (1.7 + 2 * b.embedding[4]::DOUBLE) * s AS py
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0, oct),
  lastf AS (SELECT run, max(frame) AS last FROM sring GROUP BY run)"""
NEAR = """SELECT r.*, (SELECT min(hypot(px - core_x, py - core_y)) FROM sring s WHERE s.run = r.run AND s.frame = least(r.frame, l.last)) AS body_distance
  FROM reg r JOIN lastf l ON l.run = r.run"""


@query("J01_nearest_body_vertex", REG + "body_distance:6", sql("cells oct", NEAR, RAW, SHORT))
def j01(spark, sf):
    return ops.body_distance(raw_regions(spark, sf), short_contours(spark, sf))


BEST = """best AS (SELECT r.*, s.sensor_id, s.sx, s.sy, hypot(core_x - sx, core_y - sy) AS sensor_distance FROM reg r, sensors s
  QUALIFY row_number() OVER (PARTITION BY run, frame, region ORDER BY hypot(core_x - sx, core_y - sy), sensor_id) = 1)"""


@query(
    "J03_closest_sensor",
    REG + "sensor_id:i sensor_distance:6",
    sql("cells sensors", "SELECT * FROM best WHERE sensor_distance <= 4", RAW, BEST),
)
def j03(spark, sf):
    return ops.closest_sensor(raw_regions(spark, sf), SENSORS, 4.0)


EDGE = """edg AS (SELECT t.*, b.x AS edge_x, b.y AS edge_y FROM best t JOIN bnd b USING (run, frame, region)
  QUALIFY row_number() OVER (PARTITION BY run, frame, region ORDER BY pow(b.x - sx, 2) + pow(b.y - sy, 2), b.y, b.x) = 1)"""


@query("J04_closest_edge_point", REG + "sensor_id:i edge_x:i edge_y:i", sql("cells sensors", "SELECT * FROM edg", RAW, BEST, EDGE))
def j04(spark, sf):
    return ops.closest_edge(ops.closest_sensor(raw_regions(spark, sf), SENSORS))


def wall_cte(name, y, tol):
    return f"""wall_{name} AS (SELECT run, frame, region, arg_min(x, (x, y)) AS x1, arg_min(y, (x, y)) AS y1,
      CASE WHEN count(*) > 1 THEN arg_max(x, (x, -y)) END AS x2, CASE WHEN count(*) > 1 THEN arg_max(y, (x, -y)) END AS y2
      FROM bnd WHERE abs(y - {y}) <= {tol} GROUP BY run, frame, region)"""


@query(
    "J05_wall_intersections",
    REG + "wall_top_x1:3 wall_top_y1:3 wall_top_x2:3 wall_top_y2:3",
    sql(
        "cells",
        "SELECT r.*, x1 AS wall_top_x1, y1 AS wall_top_y1, x2 AS wall_top_x2, y2 AS wall_top_y2 FROM reg r LEFT JOIN wall_top USING (run, frame, region)",
        RAW,
        wall_cte("top", 5.5, 0.6),
    ),
)
def j05(spark, sf):
    return ops.wall_intersections(raw_regions(spark, sf), 5.5, 0.6, "top")


def cross_sql(ax, ay, bx, by, cx, cy, dx, dy):
    def o(px, py, qx, qy, rx, ry):
        return f"(({qx} - {px}) * ({ry} - {py}) - ({qy} - {py}) * ({rx} - {px}))"

    def on(px, py, qx, qy, rx, ry):
        return f"({rx} BETWEEN least({px}, {qx}) - 1e-9 AND greatest({px}, {qx}) + 1e-9 AND {ry} BETWEEN least({py}, {qy}) - 1e-9 AND greatest({py}, {qy}) + 1e-9)"

    o1, o2 = o(ax, ay, bx, by, cx, cy), o(ax, ay, bx, by, dx, dy)
    o3, o4 = o(cx, cy, dx, dy, ax, ay), o(cx, cy, dx, dy, bx, by)
    return (
        f"(({o1} * {o2} < 0 AND {o3} * {o4} < 0) OR (abs({o1}) <= 1e-9 AND {on(ax, ay, bx, by, cx, cy)}) OR (abs({o2}) <= 1e-9 AND {on(ax, ay, bx, by, dx, dy)})"
        f" OR (abs({o3}) <= 1e-9 AND {on(cx, cy, dx, dy, ax, ay)}) OR (abs({o4}) <= 1e-9 AND {on(cx, cy, dx, dy, bx, by)}))"
    )


def pseg_sql(px, py, ax, ay, bx, by):
    t = f"greatest(0, least(1, (({bx} - {ax}) * ({px} - {ax}) + ({by} - {ay}) * ({py} - {ay})) / nullif(pow({bx} - {ax}, 2) + pow({by} - {ay}, 2), 0)))"
    return f"hypot({px} - ({ax} + {t} * ({bx} - {ax})), {py} - ({ay} + {t} * ({by} - {ay})))"


def close_sql(a, b, c, d, eps):
    ds = [pseg_sql(*p, *q, *r) for p, q, r in ((a, c, d), (b, c, d), (c, a, b), (d, a, b))]
    return f"({cross_sql(*a, *b, *c, *d)} OR least({', '.join(ds)}) <= {eps})"


def occl_cte(src):
    hit = close_sql(("s.sx", "s.sy"), ("d.core_x", "d.core_y"), ("g.x0", "g.y0"), ("g.x1", "g.y1"), 0.3)
    far = "hypot({0}.core_x - s.sx, {0}.core_y - s.sy)"
    return f"""hid AS (SELECT DISTINCT d.run, d.frame, d.region, s.sensor_id FROM {src} d CROSS JOIN sensors s JOIN {src} o
      ON o.run = d.run AND o.frame = d.frame AND ({far.format('o')} < {far.format('d')} OR ({far.format('o')} = {far.format('d')} AND o.region < d.region))
      JOIN segs g ON g.run = o.run AND g.frame = o.frame AND g.region = o.region WHERE {hit}),
      vis AS (SELECT d.run, d.frame, d.region, count(h.sensor_id) < 3 AS visible FROM {src} d LEFT JOIN hid h USING (run, frame, region) GROUP BY ALL)"""


@query(
    "J06_occlusion",
    REG + "visible:b",
    sql("cells sensors", "SELECT * FROM reg JOIN vis USING (run, frame, region)", RAW, SEGS, occl_cte("reg")),
)
def j06(spark, sf):
    return ops.occlusion(raw_regions(spark, sf), SENSORS, 0.3)


A02 = (
    REG
    + "core_q:6 radius:6 body_distance:6 sensor_id:i sensor_distance:6 edge_x:i edge_y:i "
    + " ".join(f"wall_{w}_{c}:3" for w in ("top", "bottom") for c in ("x1", "y1", "x2", "y2"))
    + " visible:b"
)


def detections(spark, sf):
    return ops.detect(
        frames(spark, sf), GRID, "v", 0.02, min_area=2, sigma=1.0, contours=short_contours(spark, sf), body_distance_min=0.5,
        sensors=SENSORS, sensor_max_distance=6.0, wall_top=6.0, wall_bottom=1.0, wall_tol=0.5, occlusion_eps=0.3,
    )


DET = f"""near AS ({NEAR}), kept AS (SELECT * FROM near WHERE area >= 2 AND body_distance >= 0.5),
  best AS (SELECT r.*, s.sensor_id, s.sx, s.sy, hypot(core_x - sx, core_y - sy) AS sensor_distance FROM kept r, sensors s
  QUALIFY row_number() OVER (PARTITION BY run, frame, region ORDER BY hypot(core_x - sx, core_y - sy), sensor_id) = 1),
  close_ AS (SELECT * FROM best WHERE sensor_distance <= 6), {EDGE.replace('FROM best', 'FROM close_')},
  {wall_cte('top', 6, 0.5)}, {wall_cte('bottom', 1, 0.5)}, {SEGS}, {occl_cte('close_')},
  det AS (SELECT e.*, visible, t.x1 AS wall_top_x1, t.y1 AS wall_top_y1, t.x2 AS wall_top_x2, t.y2 AS wall_top_y2, b.x1 AS wall_bottom_x1,
  b.y1 AS wall_bottom_y1, b.x2 AS wall_bottom_x2, b.y2 AS wall_bottom_y2 FROM edg e JOIN vis v USING (run, frame, region)
  LEFT JOIN wall_top t USING (run, frame, region) LEFT JOIN wall_bottom b USING (run, frame, region))"""


@query("A02_vortex_detector", A02, sql("cells oct sensors", "SELECT * FROM det", SMO, SHORT, DET))
def a02(spark, sf):
    return detections(spark, sf)


PEAKS = """pk AS (SELECT a.run, a.frame, a.x, a.y, a.v AS value, CASE WHEN a.v = max(b.v) AND a.v > 0.02 THEN 1
  WHEN a.v = min(b.v) AND a.v < -0.02 THEN -1 ELSE 0 END AS peak FROM smooth a JOIN smooth b
  ON a.run = b.run AND a.frame = b.frame AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY a.run, a.frame, a.x, a.y, a.v),
  pd AS (SELECT p.run, p.frame, p.x, p.y, p.value, p.peak, min(hypot(r.x - p.x, r.y - p.y)) AS distance FROM pk p JOIN ring r
  ON r.run = p.run AND r.frame = p.frame WHERE peak <> 0 GROUP BY ALL)"""


@query(
    "A03_peak_detector",
    "run:i frame:i x:i y:i value:6 distance:6",
    sql("cells ring", "SELECT * FROM pd WHERE distance >= 1", SMOOTH, PEAKS),
)
def a03(spark, sf):
    return ops.detect_peaks(contours(spark, sf), GRID, "v", 0.02, 5, 1.0, poly="poly", distance_min=1.0)


@query(
    "J02_distance_keep",
    "run:i frame:i x:i y:i value:6 distance:6",
    sql("cells ring", "SELECT * FROM pd WHERE distance >= 1.5 AND peak = -1", SMOOTH, PEAKS),
)
def j02(spark, sf):
    return ops.detect_peaks(contours(spark, sf), GRID, "v", 0.02, 5, 1.0, minima_only=True, poly="poly", distance_min=1.5)


# --- scalar geometry over eight coordinates per vector ---------------------------------

NAMES = ["xa", "ya", "xb", "yb", "xc", "yc", "xd", "yd"]
QUAD = "quad AS (SELECT vec_id, " + ", ".join(f"round(embedding[{i + 1}]::DOUBLE * 20) AS {n}" for i, n in enumerate(NAMES)) + " FROM embeddings)"


def quads(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return e.select("vec_id", *[F.round(F.col("embedding")[i].cast("double") * 20).alias(n) for i, n in enumerate(NAMES)])


def cols(names):
    return [F.col(n) for n in names]


@query(
    "F09_vertex_angle",
    "vec_id:i angle:6",
    sql(
        "",
        """SELECT vec_id, degrees(acos(greatest(-1, least(1, ((xa - xb) * (xc - xb) + (ya - yb) * (yc - yb)) /
        nullif(hypot(xa - xb, ya - yb) * hypot(xc - xb, yc - yb), 0))))) AS angle FROM quad WHERE hypot(xa - xb, ya - yb) * hypot(xc - xb, yc - yb) <> 0
        UNION ALL SELECT vec_id, NULL FROM quad WHERE hypot(xa - xb, ya - yb) * hypot(xc - xb, yc - yb) = 0""",
        QUAD,
    ),
)
def f09(spark, sf):
    return quads(spark, sf).select("vec_id", geo.angle_degrees(*cols(NAMES[:6])).alias("angle"))


@query("F10_distance", "vec_id:i d:6", sql("", "SELECT vec_id, hypot(xa - xb, ya - yb) AS d FROM quad", QUAD))
def f10(spark, sf):
    return quads(spark, sf).select("vec_id", geo.distance(*cols(NAMES[:4])).alias("d"))


@query("F11_orientation", "vec_id:i o:6", sql("", "SELECT vec_id, (xb - xa) * (yc - ya) - (yb - ya) * (xc - xa) AS o FROM quad", QUAD))
def f11(spark, sf):
    return quads(spark, sf).select("vec_id", geo.orient(*cols(NAMES[:6])).alias("o"))


@query(
    "F12_on_segment",
    "vec_id:i hit:b",
    sql("", "SELECT vec_id, xc BETWEEN least(xa, xb) AND greatest(xa, xb) AND yc BETWEEN least(ya, yb) AND greatest(ya, yb) AS hit FROM quad", QUAD),
)
def f12(spark, sf):
    return quads(spark, sf).select("vec_id", geo.on_segment(*cols(NAMES[:6])).alias("hit"))


@query("F13_segments_cross", "vec_id:i hit:b", sql("", f"SELECT vec_id, {cross_sql(*NAMES)} AS hit FROM quad", QUAD))
def f13(spark, sf):
    return quads(spark, sf).select("vec_id", geo.segments_cross(*cols(NAMES)).alias("hit"))


@query(
    "F14_point_segment_distance",
    "vec_id:i d:6",
    sql("", f"SELECT vec_id, CASE WHEN xc = xa AND yc = ya THEN 0 WHEN xa = xb AND ya = yb THEN hypot(xc - xa, yc - ya) ELSE {pseg_sql('xc', 'yc', 'xa', 'ya', 'xb', 'yb')} END AS d FROM quad", QUAD),
)
def f14(spark, sf):
    return quads(spark, sf).select("vec_id", geo.point_segment_distance(*cols(["xc", "yc", "xa", "ya", "xb", "yb"])).alias("d"))


@query(
    "F15_cross_or_close",
    "vec_id:i hit:b",
    sql("", f"SELECT vec_id, {close_sql(('xa', 'ya'), ('xb', 'yb'), ('xc', 'yc'), ('xd', 'yd'), 1.0)} AS hit FROM quad", QUAD),
)
def f15(spark, sf):
    return quads(spark, sf).select("vec_id", geo.segments_cross_or_close(*cols(NAMES), 1.0).alias("hit"))


@query(
    "F23_square_crop",
    "vec_id:i x0:i y0:i x1:i y1:i",
    sql(
        "",
        """SELECT vec_id, x0, y0, x0 + s AS x1, y0 + s AS y1 FROM (SELECT vec_id, s, greatest(0, least(floor(mx - s / 2), 640 - s)) AS x0,
        greatest(0, least(floor(my - s / 2), 480 - s)) AS y0 FROM (SELECT vec_id, 320 + xa * 8 AS mx, 240 + ya * 8 AS my, 100 + 10 * abs(xb) AS s FROM quad))""",
        QUAD,
    ),
)
def f23(spark, sf):
    d = quads(spark, sf)
    w = geo.square_window(320 + F.col("xa") * 8, 240 + F.col("ya") * 8, (100 + 10 * F.abs("xb")).cast("int"), 640, 480)
    return d.select("vec_id", w.alias("w")).select("vec_id", "w.*")


# --- circulation -----------------------------------------------------------------------


def bil(a, px, py):
    return f"""list_transform([{{'px': least(greatest(0.5, {px}), 6.5), 'py': least(greatest(0.5, {py}), 6.5)}}], lambda q:
      (q.px - least(floor(q.px), 6)) * ((q.py - least(floor(q.py), 6)) * {a}[((least(floor(q.px), 6) + 1) * 8 + least(floor(q.py), 6) + 2)::INT]
      + (1 - q.py + least(floor(q.py), 6)) * {a}[((least(floor(q.px), 6) + 1) * 8 + least(floor(q.py), 6) + 1)::INT])
      + (1 - q.px + least(floor(q.px), 6)) * ((q.py - least(floor(q.py), 6)) * {a}[(least(floor(q.px), 6) * 8 + least(floor(q.py), 6) + 2)::INT]
      + (1 - q.py + least(floor(q.py), 6)) * {a}[(least(floor(q.px), 6) * 8 + least(floor(q.py), 6) + 1)::INT]))[1]"""


RINGS = f"""uva AS (SELECT (a.vec_id // 50)::INT AS run, ((a.vec_id // 2) % 25)::INT AS frame, a.embedding::DOUBLE[] AS u, b.embedding::DOUBLE[] AS w
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0),
  cen AS (SELECT *, 3.5 + 4 * u[2] AS cx, 3.5 + 4 * w[2] AS cy FROM uva),
  smpl AS (SELECT run, frame, r, i, 2 * pi() / floor(r * 6 + 0.5) AS step, {bil('u', 'cx + r * cos(i * 2 * pi() / floor(r * 6 + 0.5))', 'cy + r * sin(i * 2 * pi() / floor(r * 6 + 0.5))')} AS fu,
  {bil('w', 'cx + r * cos(i * 2 * pi() / floor(r * 6 + 0.5))', 'cy + r * sin(i * 2 * pi() / floor(r * 6 + 0.5))')} AS fw, {bil('u', 'cx', 'cy')} AS mid
  FROM cen, (VALUES (1.0::DOUBLE), (1.5), (2.0)) rr(r), range(12) ii(i) WHERE i < floor(r * 6 + 0.5))"""


@query(
    "A34_circulation",
    "run:i frame:i velocity_line:6 scalar_line:6 area:6",
    sql(
        "",
        """SELECT run, frame, sum(CASE WHEN r = 2 THEN fu * r * (cos(i * step) - cos((i - 1) * step)) + fw * r * (sin(i * step) - sin((i - 1) * step)) END) AS velocity_line,
        sum(CASE WHEN r = 2 AND fu * mid > 0 THEN fu * r * step ELSE 0 END) AS scalar_line,
        any_value(mid) * pi() * 0.25 / 4 + sum(CASE WHEN fu * mid > 0 THEN fu * (pow(CASE WHEN r = 2 THEN 2 ELSE r + 0.25 END, 2) - pow(r - 0.25, 2)) * step / 2 ELSE 0 END) AS area
        FROM smpl GROUP BY run, frame""",
        RINGS,
    ),
)
def a34(spark, sf):
    d = velocity(spark, sf).withColumns({"cx": 3.5 + 4 * F.col("u")[1], "cy": 3.5 + 4 * F.col("w")[1]})
    return d.select(
        *K,
        ops.circulation_integral(GRID, "u", "w", "cx", "cy", 2.0, 6).alias("velocity_line"),
        ops.line_integrals(GRID, "u", "cx", "cy", [2.0], 6)[0].alias("scalar_line"),
        ops.area_integral(GRID, "u", "cx", "cy", [1.0, 1.5, 2.0], 0.5, 6).alias("area"),
    )

"""Grid, probe and field-statistics queries over ``frames`` and ``velocity``."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeframe.functions.grid import explode_cells
from wakeframe.operators import fields as ops
from wakeframe.plans.registry import query
from wakeframe.plans.views import GRID, SENSORS, contours, frames, sql, velocity

K = ["run", "frame"]
SPEC = "run:i frame:i x:i y:i "


def cells_of(df, **cols):
    return explode_cells(df, K, GRID, **cols)


@query(
    "P01_cell_xy",
    "run:i frame:i cell:i x:i y:i back:i v:8",
    sql("cells", "SELECT run, frame, cell, x, y, x * 8 + y AS back, v FROM cells"),
)
def p01(spark, sf):
    d = cells_of(frames(spark, sf), v="v")
    return d.withColumn("back", F.col("x") * 8 + F.col("y"))


GRAD = """SELECT *, CASE WHEN x = 0 THEN lead(v) OVER wx - v WHEN x = 7 THEN v - lag(v) OVER wx
  ELSE (lead(v) OVER wx - lag(v) OVER wx) / 2 END AS gx,
  CASE WHEN y = 0 THEN lead(v) OVER wy - v WHEN y = 7 THEN v - lag(v) OVER wy
  ELSE (lead(v) OVER wy - lag(v) OVER wy) / 2 END AS gy FROM cells
  WINDOW wx AS (PARTITION BY run, frame, y ORDER BY x), wy AS (PARTITION BY run, frame, x ORDER BY y)"""


@query("G01_gradient", SPEC + "gx:6 gy:6", sql("cells", GRAD))
def g01(spark, sf):
    return cells_of(ops.gradient(frames(spark, sf), GRID), gx="gx", gy="gy")


def slope(c, axis):
    w, i = ("wx", "x") if axis == "x" else ("wy", "y")
    return (
        f"(CASE WHEN {i} = 0 THEN lead({c}) OVER {w} - {c} WHEN {i} = 7 THEN {c} - lag({c}) OVER {w} "
        f"ELSE (lead({c}) OVER {w} - lag({c}) OVER {w}) / 2 END)"
    )


UVW = "WINDOW wx AS (PARTITION BY run, frame, y ORDER BY x), wy AS (PARTITION BY run, frame, x ORDER BY y)"
QMAP = f"""qmap AS (SELECT run, frame, x, y, 0.5 * (2 * pow(0.5 * (wx_ - uy_), 2)
  - (ux_ * ux_ + wy_ * wy_ + 2 * pow(0.5 * (uy_ + wx_), 2))) AS q FROM (SELECT run, frame, x, y,
  {slope('u', 'x')} AS ux_, {slope('u', 'y')} AS uy_, {slope('w', 'x')} AS wx_, {slope('w', 'y')} AS wy_
  FROM uv {UVW}))"""


@query("G02_q_criterion", SPEC + "q:6", sql("uv", "SELECT * FROM qmap", QMAP))
def g02(spark, sf):
    return cells_of(ops.q_criterion(velocity(spark, sf), GRID), q="q")


@query(
    "G03_q_by_run",
    "run:i frames:i mean_q:6 max_q:6 rotating:i",
    sql(
        "uv",
        "SELECT run, count(DISTINCT frame) AS frames, avg(q) AS mean_q, max(q) AS max_q, count(*) FILTER (q > 0) AS rotating FROM qmap GROUP BY run",
        QMAP,
    ),
)
def g03(spark, sf):
    d = ops.q_criterion(velocity(spark, sf), GRID).select(
        "run",
        F.aggregate("q", F.lit(0.0), lambda s, v: s + v).alias("s"),
        F.size("q").alias("n"),
        F.array_max("q").alias("hi"),
        F.size(F.filter("q", lambda v: v > 0)).alias("pos"),
    )
    return d.groupBy("run").agg(
        F.count("n").alias("frames"),
        (F.sum("s") / F.sum("n")).alias("mean_q"),
        F.max("hi").alias("max_q"),
        F.sum("pos").alias("rotating"),
    )


def inner(expr):
    return f"CASE WHEN x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 THEN {expr} ELSE 0 END"


def nb(c, dx=0, dy=0):
    fn = {1: "lead", -1: "lag"}
    return f"{fn[dx]}({c}) OVER wx" if dx else f"{fn[dy]}({c}) OVER wy"


@query(
    "G04_q_determinant",
    SPEC + "q:6",
    sql(
        "uv",
        f"""SELECT run, frame, x, y, {inner('(a * d - b * c) / 4')} AS q FROM (SELECT run, frame, x, y,
        {nb('u', 1)} - {nb('u', -1)} AS a, {nb('u', 0, 1)} - {nb('u', 0, -1)} AS c,
        {nb('w', 1)} - {nb('w', -1)} AS b, {nb('w', 0, 1)} - {nb('w', 0, -1)} AS d FROM uv {UVW})""",
    ),
)
def g04(spark, sf):
    return cells_of(ops.q_determinant(velocity(spark, sf), GRID), q="q")


@query(
    "G05_curl",
    SPEC + "curl:6",
    sql("uv", f"SELECT run, frame, x, y, {inner(nb('u', 0, -1) + ' - u + w - ' + nb('w', -1))} AS curl FROM uv {UVW}"),
)
def g05(spark, sf):
    return cells_of(ops.curl(velocity(spark, sf), GRID), curl="curl")


@query(
    "G06_divergence",
    SPEC + "div:6",
    sql("uv", f"SELECT run, frame, x, y, {inner(nb('u', 1) + ' - u + ' + nb('w', 0, 1) + ' - w')} AS div FROM uv {UVW}"),
)
def g06(spark, sf):
    return cells_of(ops.divergence(velocity(spark, sf), GRID), div="div")


@query(
    "G07_kinetic_energy",
    SPEC + "ke:6",
    sql(
        "uv",
        f"""SELECT run, frame, x, y, {inner('(pow(a + u - 0.2, 2) + pow(b + w, 2)) * 0.125')} AS ke FROM
        (SELECT *, {nb('u', 1)} AS a, {nb('w', 0, 1)} AS b FROM uv {UVW})""",
    ),
)
def g07(spark, sf):
    return cells_of(ops.kinetic_energy(velocity(spark, sf), GRID, u0=0.1), ke="ke")


@query(
    "G08_stream_function",
    SPEC + "psi:6",
    sql(
        "uv",
        """SELECT a.run, a.frame, a.x, a.y, 0.5 * (up + down - base) AS psi FROM s a JOIN
        (SELECT run, frame, down AS base FROM s WHERE x = 0 AND y = 0) b ON a.run = b.run AND a.frame = b.frame""",
        """s AS (SELECT run, frame, x, y, sum(t) OVER (PARTITION BY run, frame, x ORDER BY y) AS up,
        -coalesce(sum(t) OVER (PARTITION BY run, frame, x ORDER BY y ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS down
        FROM (SELECT *, coalesce(0.5 * (u + lag(u) OVER (PARTITION BY run, frame, x ORDER BY y)), 0) AS t FROM uv))""",
    ),
)
def g08(spark, sf):
    return cells_of(ops.stream_function(velocity(spark, sf), GRID), psi="psi")


@query(
    "G09_laplacian",
    SPEC + "lap:6",
    sql(
        "cells",
        f"SELECT run, frame, x, y, {inner(' + '.join([nb('v', 1), nb('v', -1), nb('v', 0, 1), nb('v', 0, -1)]) + ' - 4 * v')} AS lap FROM cells {UVW}",
    ),
)
def g09(spark, sf):
    return cells_of(ops.laplacian(frames(spark, sf), GRID), lap="lap")


@query(
    "G10_backward_gradient",
    SPEC + "gx:6 gy:6 cx:6 cy:6",
    sql(
        "cells",
        f"""SELECT run, frame, x, y, {inner('v - ' + nb('v', -1))} AS gx, {inner('v - ' + nb('v', 0, -1))} AS gy,
        {inner(nb('v', 0, 1) + ' - v')} AS cx, {inner('v - ' + nb('v', 1))} AS cy FROM cells {UVW}""",
    ),
)
def g10(spark, sf):
    return cells_of(ops.backward_gradient(frames(spark, sf), GRID), gx="gx", gy="gy", cx="cx", cy="cy")


@query(
    "G11_normal_gradient",
    SPEC + "ng:6",
    sql(
        "uv",
        f"""SELECT run, frame, x, y, {inner('0.5 * (u * a + w * b)')} AS ng FROM (SELECT *,
        {nb('u', 1)} - {nb('u', -1)} AS a, {nb('u', 0, 1)} - {nb('u', 0, -1)} AS b FROM uv {UVW})""",
    ),
)
def g11(spark, sf):
    return cells_of(ops.normal_gradient(velocity(spark, sf), GRID, "u", "u", "w"), ng="ng")


@query(
    "G12_field_algebra",
    SPEC + "plus:6 minus:6 times:6 inv:3",
    sql("uv", "SELECT run, frame, x, y, u + w AS plus, u - w AS minus, u * w AS times, 1 / nullif(u, 0) AS inv FROM uv"),
)
def g12(spark, sf):
    d = velocity(spark, sf)
    return cells_of(
        ops.algebra(d.select("run", "frame", F.col("u").alias("v")), d.select("run", "frame", F.col("w").alias("v"))),
        plus="plus",
        minus="minus",
        times="times",
        inv="inv",
    )


@query(
    "G13_field_reductions",
    "run:i frame:i total:6 inner_p:6 l_inf:6",
    sql(
        "uv",
        f"SELECT run, frame, sum({inner('u')}) AS total, sum({inner('u * w')}) AS inner_p, max(abs(u)) AS l_inf FROM uv GROUP BY run, frame",
    ),
)
def g13(spark, sf):
    return ops.reductions(velocity(spark, sf), GRID, "u", "w")


POINT = "SELECT run, frame, v, 3.5 + 20 * v[4] AS px, 3.5 + 20 * v[5] AS py FROM fr"


def points(spark, sf):
    return frames(spark, sf).withColumns({"px": 3.5 + 20 * F.col("v")[3], "py": 3.5 + 20 * F.col("v")[4]})


def lin(a, px, py):
    return (
        f"(SELECT s * (t * {a}[(i + 1) * 8 + j + 2] + (1 - t) * {a}[(i + 1) * 8 + j + 1]) + (1 - s) * (t * {a}[i * 8 + j + 2] + (1 - t) * {a}[i * 8 + j + 1]) "
        f"FROM (SELECT i, j, cx - i AS s, cy - j AS t FROM (SELECT cx, cy, least(floor(cx), 6)::INT AS i, least(floor(cy), 6)::INT AS j "
        f"FROM (SELECT least(greatest(0.5, {px}), 6.5) AS cx, least(greatest(0.5, {py}), 6.5) AS cy))))"
    )


@query("G14_bilinear_sample", "run:i frame:i s:6", sql("fr", f"SELECT run, frame, {lin('v', 'px', 'py')} AS s FROM ({POINT})"))
def g14(spark, sf):
    return points(spark, sf).select("run", "frame", GRID.bilinear(F.col("v"), F.col("px"), F.col("py")).alias("s"))


def quad1(d, e, f, g):
    return f"greatest(least({f} * (1 - {d} * {d}) + ({g} * ({d} * {d} + {d}) + {e} * ({d} * {d} - {d})) * 0.5, greatest({e}, {f}, {g})), least({e}, {f}, {g}))"


def _row(r):
    return quad1("dx", *[f"v[(i + {k}) * 8 + j + {r} + 1]" for k in (-1, 0, 1)])


@query(
    "G15_quadratic_sample",
    "run:i frame:i s:6",
    sql(
        "fr",
        f"""SELECT run, frame, CASE WHEN i > 6 OR i < 1 OR j > 6 OR j < 1 THEN lin ELSE {quad1('dy', 'e', 'f', 'g')} END AS s
        FROM (SELECT *, {_row(-1)} AS e, {_row(0)} AS f, {_row(1)} AS g FROM
        (SELECT *, px - i AS dx, py - j AS dy FROM (SELECT *, floor(px + 0.5)::INT AS i, floor(py + 0.5)::INT AS j,
        {lin('v', 'px', 'py')} AS lin FROM ({POINT}))))""",
    ),
)
def g15(spark, sf):
    return points(spark, sf).select("run", "frame", GRID.quadratic(F.col("v"), F.col("px"), F.col("py")).alias("s"))


@query(
    "G16_floor_sample",
    "run:i frame:i s:6",
    sql("fr", f"SELECT run, frame, v[least(trunc(abs(px)), 6)::INT * 8 + least(trunc(abs(py)), 6)::INT + 1] AS s FROM ({POINT})"),
)
def g16(spark, sf):
    d = points(spark, sf)
    return d.select("run", "frame", GRID.floor_sample(F.col("v"), F.abs("px"), F.abs("py")).alias("s"))


_W = ", ".join(f"({k - 4}, {w!r}::DOUBLE)" for k, w in enumerate(ops.gaussian_weights(1.0)))
SMOOTH = f"""wts AS (SELECT * FROM (VALUES {_W}) w(k, wt)),
  gx1 AS (SELECT a.run, a.frame, a.x, a.y, sum(wt * b.v) AS v FROM cells a, wts JOIN cells b ON true
    WHERE b.run = a.run AND b.frame = a.frame AND b.y = a.y AND b.x =
    CASE WHEN (a.x + k + 16) % 16 < 8 THEN (a.x + k + 16) % 16 ELSE 15 - (a.x + k + 16) % 16 END GROUP BY ALL),
  smooth AS (SELECT a.run, a.frame, a.x, a.y, a.x * 8 + a.y AS cell, sum(wt * b.v) AS v FROM gx1 a, wts JOIN gx1 b ON true
    WHERE b.run = a.run AND b.frame = a.frame AND b.x = a.x AND b.y =
    CASE WHEN (a.y + k + 16) % 16 < 8 THEN (a.y + k + 16) % 16 ELSE 15 - (a.y + k + 16) % 16 END GROUP BY ALL)"""


@query("G17_gaussian_smoothing", SPEC + "v:6", sql("cells", "SELECT * FROM smooth", SMOOTH))
def g17(spark, sf):
    return cells_of(ops.gaussian_smooth(frames(spark, sf), GRID), v="smooth")


@query(
    "G18_local_peaks",
    SPEC + "peak:i",
    sql(
        "cells",
        """SELECT a.run, a.frame, a.x, a.y, CASE WHEN a.v = max(b.v) AND a.v > 0.2 THEN 1
        WHEN a.v = min(b.v) AND a.v < -0.2 THEN -1 ELSE 0 END AS peak FROM cells a JOIN cells b
        ON a.run = b.run AND a.frame = b.frame AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY a.run, a.frame, a.x, a.y, a.v""",
    ),
)
def g18(spark, sf):
    return cells_of(ops.local_peaks(frames(spark, sf), GRID, "v", 5, 0.2), peak="peak")


def peak_sql(fourth):
    return f"""SELECT run, frame, x, y, {inner('CASE WHEN greatest(a, b, c, d) < v THEN 1 WHEN least(a, b, c, d) > v THEN -1 ELSE 0 END')} AS peak
      FROM (SELECT *, {nb('v', 1)} AS a, {nb('v', -1)} AS b, {nb('v', 0, 1)} AS c, {fourth} AS d FROM z {UVW})"""


@query(
    "G19_strict_peaks",
    SPEC + "peak:i quirk:i",
    sql(
        "cells",
        f"""SELECT p.run, p.frame, p.x, p.y, p.peak, q.peak AS quirk FROM ({peak_sql(nb('v', 0, -1))}) p
        JOIN ({peak_sql('lead(dn) OVER wx')}) q USING (run, frame, x, y)""",
        "z AS (SELECT *, lag(v) OVER (PARTITION BY run, frame, x ORDER BY y) AS dn FROM cells)",
    ),
)
def g19(spark, sf):
    d = ops.strict_peaks(frames(spark, sf), GRID, "v").withColumnRenamed("peak", "p")
    return cells_of(ops.strict_peaks(d, GRID, "v", reference_quirk=True), peak="p", quirk="peak")


@query(
    "G23_steady_change",
    "run:i frame:i change:6",
    sql(
        "uv",
        """SELECT a.run, a.frame, max(greatest(hypot(a.u - b.u, a.w - b.w), abs(a.u * a.w - b.u * b.w))) AS change
        FROM uv a JOIN uv b ON a.run = b.run AND a.frame = b.frame + 1 AND a.cell = b.cell GROUP BY a.run, a.frame""",
    ),
)
def g23(spark, sf):
    d = velocity(spark, sf).withColumn("p", F.zip_with("u", "w", lambda a, b: a * b))
    return ops.steady_change(d, "u", "w", "p")


SHIFTED = """al AS (SELECT run, frame, cell, cell // 8 AS x, cell % 8 AS y, a, b FROM
  (SELECT a.run, a.frame, unnest(range(64))::INT AS cell, unnest(a.v) AS a, unnest(b.v) AS b FROM fr a JOIN fr b ON a.run = b.run AND b.frame = a.frame + 3))"""


def shifted(spark, sf):
    f = frames(spark, sf)
    return ops.aligned(f, f, "v", 3)


@query("J19_frame_offset_join", SPEC + "a:6 b:6", sql("fr", "SELECT * FROM al", SHIFTED))
def j19(spark, sf):
    return cells_of(shifted(spark, sf), a="a", b="b")


@query(
    "G24_overlap_code",
    SPEC + "code:i",
    sql("fr", "SELECT *, (a > 0.05)::INT + 2 * (b > 0.05)::INT AS code FROM al", SHIFTED),
)
def g24(spark, sf):
    return cells_of(ops.overlap_code(shifted(spark, sf), 0.05), code="code")


@query(
    "A09_mask_overlap",
    "run:i frame:i iou:6 precision:6 recall:6 ref_fraction:6 other_fraction:6",
    sql(
        "fr",
        """SELECT run, frame, both_ / nullif(r + o - both_, 0) AS iou, both_ / nullif(o, 0) AS "precision", both_ / nullif(r, 0) AS recall,
        r / 64 AS ref_fraction, o / 64 AS other_fraction FROM (SELECT run, frame, sum((a > 0.05 AND b > 0.05)::INT) AS both_,
        sum((a > 0.05)::INT) AS r, sum((b > 0.05)::INT) AS o FROM al GROUP BY run, frame)""",
        SHIFTED,
    ),
)
def a09(spark, sf):
    return ops.overlap_metrics(ops.overlap_code(shifted(spark, sf), 0.05))


@query(
    "P02_point_probe",
    "run:i frame:i sensor_id:i p:6",
    sql(
        "cells sensors",
        "SELECT f.run, f.frame, s.sensor_id, c.v AS p FROM fr f CROSS JOIN (SELECT * FROM sensors UNION ALL VALUES (3, 9.0, 1.0)) s LEFT JOIN cells c ON c.run = f.run AND c.frame = f.frame AND c.x = s.sx AND c.y = s.sy",
    ),
)
def p02(spark, sf):
    return ops.probe(frames(spark, sf), GRID, "v", SENSORS + [(3, 9.0, 1.0)])


@query(
    "P03_probe_offsets",
    "run:i frame:i sensor_id:i shift:i p:6",
    sql(
        "cells sensors",
        """SELECT f.run, f.frame, s.sensor_id, k AS shift, c.v AS p FROM fr f CROSS JOIN sensors s CROSS JOIN range(-10, 11) r(k)
        LEFT JOIN cells c ON c.run = f.run AND c.frame = f.frame AND c.x = s.sx + k AND c.y = s.sy""",
    ),
)
def p03(spark, sf):
    return ops.probe(frames(spark, sf), GRID, "v", SENSORS, list(range(-10, 11)))


@query(
    "P04_transect",
    "run:i frame:i y:i p:6",
    sql("cells", "SELECT run, frame, y, v AS p FROM cells WHERE x = 5 AND y IN (0, 1, 2, 3, 4, 6, 7)"),
)
def p04(spark, sf):
    return ops.transect(frames(spark, sf), GRID, "v", 5, [0, 1, 2, 3, 4, 6, 7])


@query(
    "P05_wall_row",
    "run:i frame:i x:i p:6",
    sql("cells", "SELECT c.run, c.frame, c.x, c.v - f.v[1 * 8 + 4 + 1] AS p FROM cells c JOIN fr f USING (run, frame) WHERE y = 2"),
)
def p05(spark, sf):
    return ops.wall_row(frames(spark, sf), GRID, "v", 2, (1, 4))


@query(
    "P06_crop",
    "run:i frame:i pos:i v:6",
    sql(
        "cells",
        "SELECT run, frame, row_number() OVER (PARTITION BY run, frame ORDER BY x, y) - 1 AS pos, v FROM cells WHERE x BETWEEN 2 AND 6 AND y BETWEEN 4 AND 7",
    ),
)
def p06(spark, sf):
    d = ops.crop(frames(spark, sf), GRID, "v", 5, 6, 2, 7)
    return d.select("run", "frame", F.posexplode("v").alias("pos", "v"))


@query(
    "P07_frame_range",
    "run:i frame:i total:6",
    sql("fr", "SELECT run, frame, list_sum(v) AS total FROM fr WHERE frame BETWEEN 5 AND 60"),
)
def p07(spark, sf):
    d = ops.frame_range(frames(spark, sf), 5, 60)
    return d.withColumn("total", F.aggregate("v", F.lit(0.0), lambda s, v: s + v))


@query(
    "P08_drop_prefix",
    "run:i frame:i total:6",
    sql("fr", "SELECT run, frame - 4 AS frame, list_sum(v) AS total FROM fr WHERE frame >= 4"),
)
def p08(spark, sf):
    d = ops.frame_range(frames(spark, sf), 4, 10**9, rebase=True)
    return d.withColumn("total", F.aggregate("v", F.lit(0.0), lambda s, v: s + v))


@query("P09_threshold_mask", SPEC + "mask:b", sql("cells", "SELECT *, v > 0.05 AS mask FROM cells"))
def p09(spark, sf):
    return cells_of(ops.threshold_mask(frames(spark, sf), "v", 0.05), mask="mask")


SIDE = "((e.x2 - e.x1) * (c.y - e.y1) - (e.y2 - e.y1) * (c.x - e.x1))"
WIND = f"sum(CASE WHEN e.y1 <= c.y AND e.y2 > c.y AND {SIDE} > 0 THEN 1 WHEN e.y1 > c.y AND e.y2 <= c.y AND {SIDE} < 0 THEN -1 ELSE 0 END)"
PSEG = f"""hypot(c.x - (e.x1 + tt * (e.x2 - e.x1)), c.y - (e.y1 + tt * (e.y2 - e.y1)))"""


@query(
    "P10_inside_body_mask",
    SPEC + "v:6",
    sql(
        "cells edge",
        f"SELECT c.run, c.frame, c.x, c.y, CASE WHEN {WIND} <> 0 THEN 0 ELSE c.v END AS v FROM cells c JOIN edge e ON c.run = e.run AND c.frame = e.frame GROUP BY c.run, c.frame, c.x, c.y, c.v",
    ),
)
def p10(spark, sf):
    return cells_of(ops.body_mask(contours(spark, sf), GRID, "v", "poly"), v="v")


@query(
    "J24_signed_distance",
    SPEC + "convex:6 euclid:6 edge_sum:6",
    sql(
        "cells edge",
        f"""SELECT run, frame, x, y, max(off) AS convex, CASE WHEN sum(wn) = 0 THEN min(eu) ELSE -min(eu) END AS euclid,
        CASE WHEN sum(wn) = 0 THEN min(l1) ELSE -min(l1) END AS edge_sum FROM (SELECT c.run, c.frame, c.x, c.y,
        {SIDE} / len AS off, {WIND[4:-1]} AS wn,
        hypot(c.x - (e.x1 + tt * (e.x2 - e.x1)), c.y - (e.y1 + tt * (e.y2 - e.y1))) AS eu,
        abs({SIDE} / len) + greatest(0, -st) + greatest(0, st - len) AS l1
        FROM cells c JOIN edge e ON c.run = e.run AND c.frame = e.frame,
        LATERAL (SELECT ((c.x - e.x1) * (e.x2 - e.x1) + (c.y - e.y1) * (e.y2 - e.y1)) / len AS st) l1_,
        LATERAL (SELECT greatest(0, least(1, st / len)) AS tt) l2_) GROUP BY run, frame, x, y""",
    ),
)
def j24(spark, sf):
    d = contours(spark, sf)
    d = ops.body_distance(d, GRID, "poly", convex=True).withColumnRenamed("dist", "convex")
    d = ops.body_distance(d, GRID, "poly").withColumnRenamed("dist", "euclid")
    d = ops.body_distance(d, GRID, "poly", along_edge_sum=True)
    return cells_of(d, convex="convex", euclid="euclid", edge_sum="dist")


@query("P13_clip", SPEC + "v:6", sql("cells", "SELECT run, frame, x, y, least(greatest(v, -0.1), 0.15) AS v FROM cells"))
def p13(spark, sf):
    d = frames(spark, sf)
    return cells_of(
        d.withColumn("v", F.transform("v", lambda v: F.least(F.greatest(v, F.lit(-0.1)), F.lit(0.15)))), v="v"
    )


@query(
    "P16_sensor_name",
    "sensor:s n:i",
    sql(
        "",
        """SELECT CASE WHEN sx = 198 AND sy = 80 THEN 'S1' WHEN sx = 146 AND sy = 80 THEN 'S2' WHEN sx = 200 AND sy = 39 THEN 'S4'
        ELSE 'S' || l_linenumber END AS sensor, count(*) AS n FROM
        (SELECT 146 + 52 * (l_linenumber % 2) AS sx, CASE WHEN l_discount > 0.05 THEN 80 ELSE 39 END AS sy, l_linenumber FROM lineitem) GROUP BY 1""",
    ),
)
def p16(spark, sf):
    l = spark.read.parquet(f"{sf}/lineitem.parquet")
    sx = 146.2 + 52 * (F.col("l_linenumber") % 2)
    sy = F.when(F.col("l_discount") > 0.05, 80.0).otherwise(39.0)
    return l.groupBy(ops.sensor_name(sx, sy, F.col("l_linenumber")).alias("sensor")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "P21_physical_probe",
    "run:i frame:i pa:6",
    sql("cells", "SELECT run, frame, v * (0.5 * 1000 * 0.0915 * 0.0915) AS pa FROM cells WHERE x = 8 - 3 AND y = 8 - 6"),
)
def p21(spark, sf):
    return ops.physical_probe(frames(spark, sf), GRID, "v", 3, 6, True, 1000.0, 0.0915)


@query(
    "N08_reference_pressure",
    SPEC + "v:6",
    sql(
        "cells",
        "SELECT c.run, c.frame, c.x, c.y, c.v - CASE WHEN frame <= 20 THEN (f.v[1 * 8 + 2] + f.v[1 * 8 + 7]) / 2 ELSE (f.v[6 * 8 + 2] + f.v[6 * 8 + 7]) / 2 END AS v FROM cells c JOIN fr f USING (run, frame)",
    ),
)
def n08(spark, sf):
    return cells_of(ops.reference_offset(frames(spark, sf), GRID, "v", 20), v="v")


@query(
    "N09_minmax_ignoring_zero",
    SPEC + "v:6",
    sql(
        "cells",
        """SELECT run, frame, x, y, (z - min(z) FILTER (z <> 0) OVER w) / (max(z) FILTER (z <> 0) OVER w - min(z) FILTER (z <> 0) OVER w) AS v
        FROM (SELECT *, CASE WHEN abs(v) < 0.05 THEN 0 ELSE v END AS z FROM cells) WINDOW w AS (PARTITION BY run, frame)""",
    ),
)
def n09(spark, sf):
    d = frames(spark, sf).withColumn("v", F.transform("v", lambda v: F.when(F.abs(v) < 0.05, F.lit(0.0)).otherwise(v)))
    return cells_of(ops.minmax_ignoring_zero(d, "v"), v="v")


@query(
    "N06_grey_levels",
    SPEC + "v:5 diff:5",
    sql(
        "cells",
        """SELECT run, frame, x, y, 255 * (a - (SELECT min(v) FROM cells WHERE frame > 0)) / (SELECT max(v) - min(v) FROM cells WHERE frame > 0) AS v,
        255 * (abs(a - b) - (SELECT min(abs(a - b)) FROM al WHERE frame > 0)) / (SELECT max(abs(a - b)) - min(abs(a - b)) FROM al WHERE frame > 0) AS diff FROM al""",
        SHIFTED,
    ),
)
def n06(spark, sf):
    f = frames(spark, sf)
    pair = shifted(spark, sf).select("run", "frame", F.zip_with("a", "b", lambda a, b: F.abs(a - b)).alias("diff"))
    grey = ops.grey_levels(f, "v").select("run", "frame", "v")
    return cells_of(ops.grey_levels(pair, "diff").join(grey, K), v="v", diff="diff")


@query("A04_temporal_mean", "run:i cell:i mean:6", sql("cells", "SELECT run, cell, avg(v) AS mean FROM cells WHERE frame >= 4 GROUP BY 1, 2"))
def a04(spark, sf):
    return ops.temporal_mean(frames(spark, sf), from_frame=4)


@query(
    "A05_fluctuation_rms",
    "run:i cell:i root_sum:6 rms:6",
    sql(
        "cells",
        "SELECT run, cell, sqrt(sum(d * d)) AS root_sum, sqrt(avg(d * d)) AS rms FROM (SELECT *, v - avg(v) OVER (PARTITION BY run, cell) AS d FROM cells) GROUP BY 1, 2",
    ),
)
def a05(spark, sf):
    return ops.fluctuation_rms(frames(spark, sf))


@query(
    "A06_field_metrics",
    "run:i lo:6 hi:6 mean:6 l1:6 l2:6 linf:6 var:6 mean_pct:3 l1_pct:3 l2_pct:3 linf_pct:3 var_pct:3",
    sql(
        "cells",
        """SELECT a.*, 100 * a.mean / b.mean AS mean_pct, 100 * a.l1 / b.l1 AS l1_pct, 100 * a.l2 / b.l2 AS l2_pct,
        100 * a.linf / b.linf AS linf_pct, 100 * a."var" / b."var" AS var_pct FROM m a, m b WHERE b.run = 0""",
        """m AS (SELECT run, min(v) AS lo, max(v) AS hi, avg(v) AS mean, sum(abs(v)) AS l1, sqrt(sum(v * v)) AS l2,
        greatest(max(v), -min(v)) AS linf, var_pop(v) AS "var" FROM cells GROUP BY run)""",
    ),
)
def a06(spark, sf):
    return ops.field_metrics(frames(spark, sf), 0)


@query(
    "A07_mse_psnr",
    "run:i mse:6 psnr:6",
    sql("cells", "SELECT run, mse, 10 * log10(255 * 255 / mse) AS psnr FROM (SELECT run, sum(pow(a - b, 2)) / 64 AS mse FROM al GROUP BY run)", SHIFTED),
)
def a07(spark, sf):
    return ops.mse_psnr(shifted(spark, sf))


@query(
    "A08_global_ssim",
    "run:i ssim:6",
    sql(
        "cells",
        """SELECT run, (2 * ma * mb + 6.5025) / (ma * ma + mb * mb + 6.5025) * (2 * sa * sb + 58.5225) / (sa * sa + sb * sb + 58.5225)
        * (cv + 29.26125) / (sa * sb + 29.26125) AS ssim FROM (SELECT run, avg(a * 255) AS ma, avg(b * 255) AS mb, stddev_pop(a * 255) AS sa,
        stddev_pop(b * 255) AS sb, covar_pop(a * 255, b * 255) AS cv FROM al GROUP BY run)""",
        SHIFTED,
    ),
)
def a08(spark, sf):
    d = shifted(spark, sf)
    grey = lambda v: v * 255
    return ops.global_ssim(d.withColumns({"a": F.transform("a", grey), "b": F.transform("b", grey)}))


GREY = "gr AS (SELECT *, floor(least(greatest(v + 0.5, 0), 1) * 255) AS g FROM cells), bg AS (SELECT run, cell, floor(median(g)) AS bg FROM gr GROUP BY run, cell)"


@query("A27_median_background", "run:i cell:i bg:i", sql("cells", "SELECT * FROM bg", GREY))
def a27(spark, sf):
    return ops.median_background(frames(spark, sf))


@query(
    "A28_foreground_mask",
    "run:i frame:i x:i y:i fg:b",
    sql("cells", "SELECT gr.*, abs(g - bg) > 30 AS fg FROM gr JOIN bg USING (run, cell)", GREY),
)
def a28(spark, sf):
    f = frames(spark, sf)
    return cells_of(ops.foreground(f, ops.median_background(f), "v", 30), fg="fg")


@query(
    "A36_mean_profile",
    "x:i mean:6 quirk:6",
    sql("cells", "SELECT x, avg(v) AS mean, sum(v) / 8 AS quirk FROM cells WHERE y = 2 GROUP BY x"),
)
def a36(spark, sf):
    d = ops.transect(frames(spark, sf), GRID, "v", 0, [0])
    rows = ops.wall_row(frames(spark, sf).withColumn("v", F.col("v")), GRID, "v", 2, (0, 0)).join(
        d.select("run", "frame", F.col("p").alias("base")), K
    )
    rows = rows.withColumn("p", F.col("p") + F.col("base"))
    quirk = ops.mean_profile(rows, "x", "p", divide_by_points=True).withColumnRenamed("mean", "quirk")
    return ops.mean_profile(rows, "x", "p").join(quirk, "x")

"""Scaling, resampling, window and event-window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeframe.functions import arrays
from wakeframe.operators import series as ops
from wakeframe.operators.ordering import index_rows
from wakeframe.plans.registry import query
from wakeframe.plans.tracks import j10
from wakeframe.plans.views import contours, frames, segments, signal, sql, table, velocity

SP = "snapshot:i pos:i p:6"


def long(df, col="p"):
    return df.select("snapshot", F.posexplode(col).alias("pos", "p"))


@query("N01_max_abs_normalise", SP, sql("ser", "SELECT snapshot, pos, p / coalesce(nullif(max(abs(p)) OVER (PARTITION BY snapshot), 0), 1) AS p FROM ser"))
def n01(spark, sf):
    return long(segments(spark, sf).withColumn("p", arrays.normalise(F.col("p"))))


@query("N02_zero_mean", SP, sql("ser", "SELECT snapshot, pos, p - avg(p) OVER (PARTITION BY snapshot) AS p FROM ser"))
def n02(spark, sf):
    return long(segments(spark, sf).withColumn("p", arrays.zero_mean(F.col("p"))))


@query("N03_snapshot_scales", "snapshot:i length:i scale:6", sql("ser", "SELECT snapshot, any_value(length) AS length, coalesce(nullif(max(abs(p)), 0), 1) AS scale FROM ser GROUP BY 1"))
def n03(spark, sf):
    return segments(spark, sf).withColumn("scale", arrays.scale(F.col("p")))


SIG = "channel:s n:i "
EXT = "(SELECT min(p) FROM sig)", "(SELECT max(p) - min(p) FROM sig)"


@query("N04_minmax_unit", SIG + "p:6", sql("sig", f"SELECT channel, n, (p - {EXT[0]}) / {EXT[1]} AS p FROM sig"))
def n04(spark, sf):
    return ops.global_min_max(signal(spark, sf), "p", 0.0, 1.0)


@query("N05_minmax_range", SIG + "p:6 q:6", sql("sig", f"SELECT channel, n, 2 * (p - {EXT[0]}) / {EXT[1]} - 1 AS p, 3 + 4 * (p - {EXT[0]}) / {EXT[1]} AS q FROM sig"))
def n05(spark, sf):
    return ops.global_min_max(ops.global_min_max(signal(spark, sf), "p", 3.0, 7.0, "q"), "p", -1.0, 1.0)


NUM = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "N07_standardise",
    "l_orderkey:i l_partkey:i l_linenumber:i " + " ".join(f"{c}:6" for c in NUM),
    sql(
        "",
        "SELECT l_orderkey, l_partkey, l_linenumber, "
        + ", ".join(f"(coalesce({c}, (SELECT avg({c}) FROM base WHERE l_returnflag = 'A')) - (SELECT avg({c}) FROM base WHERE l_returnflag = 'A')) / (SELECT stddev_pop({c}) FROM base WHERE l_returnflag = 'A') AS {c}" for c in NUM)
        + " FROM base",
        "base AS (SELECT * REPLACE (nullif(l_discount, 0) AS l_discount) FROM lineitem)",
    ),
)
def n07(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"))
    return ops.standardise(d, NUM, ops.standardise_stats(d.filter("l_returnflag = 'A'"), NUM))


@query("N10_cp_to_pascal", SIG + "half:6 whole:6", sql("sig", "SELECT channel, n, 0.5 * 1000 * 0.0915 * 0.0915 * p AS half, 1025 * 0.3 * 0.3 * p AS whole FROM sig"))
def n10(spark, sf):
    p = F.col("p")
    return signal(spark, sf).withColumns({"half": ops.pressure_from_cp(p, F.lit(0.0915)), "whole": ops.pressure_from_cp(p, F.lit(0.3), 1025.0, False)})


@query("N11_pixel_speed", SIG + "speed:6", sql("sig", "SELECT channel, n, p * 0.5145 / 0.4 * 4 AS speed FROM sig"))
def n11(spark, sf):
    return signal(spark, sf).withColumn("speed", ops.speed_from_pixels(F.col("p")))


@query("N12_solver_seconds", SIG + "seconds:6", sql("sig", "SELECT channel, n, p * (1 / 128) * (1 / 128) * (6.4 / (1000 + n)) / 1e-6 AS seconds FROM sig"))
def n12(spark, sf):
    return signal(spark, sf).withColumn("seconds", ops.solver_seconds(F.col("p"), 1000 + F.col("n")))


@query("N13_adc_to_pascal", SIG + "pa:6", sql("sig", "SELECT channel, n, (p * 60 + 32768) * 1000 / 65536 - 500 AS pa FROM sig"))
def n13(spark, sf):
    return signal(spark, sf).withColumn("pa", ops.adc_to_pascal(F.col("p") * 60))


_M = "[" + ", ".join("[" + ", ".join(f"{v!r}::DOUBLE" for v in r) + "]" for r in ops.TRANSFER) + "]"


@query(
    "N14_force_transfer",
    "vec_id:i k:i force:6 pressure:4",
    sql(
        "",
        f"""SELECT vec_id, k, list_sum([m[k + 1][j] * embedding[j]::DOUBLE for j in [1, 2, 3, 4, 5, 6]]) * CASE WHEN k < 3 THEN 4.44822162 ELSE 1 END AS force,
        CASE WHEN k < 5 THEN embedding[18 + k]::DOUBLE * 6894.76 / 5 END AS pressure FROM embeddings, range(6) r(k), (SELECT {_M} AS m)""",
    ),
)
def n14(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    d = ops.force_and_pressure(e, "v")
    return d.select("vec_id", F.posexplode(F.arrays_zip("force", "pressure")).alias("k", "z")).select("vec_id", "k", "z.*")


@query("N15_contour_rescale", "run:i frame:i vertex:i x:2 y:2", sql("ring", "SELECT run, frame, vertex, round(x * 256 / 640, 2) AS x, round(y * 128 / 480, 2) AS y FROM ring"))
def n15(spark, sf):
    d = contours(spark, sf).select("run", "frame", F.posexplode("poly").alias("vertex", "p"))
    return d.withColumns({"x": F.bround(F.col("p.x") * 256 / 640, 2), "y": F.bround(F.col("p.y") * 128 / 480, 2)})


@query("N16_normalised_gap", "l_orderkey:i l_partkey:i l_linenumber:i gap:6", sql("", "SELECT *, (l_quantity - 16 / 2) / 16 AS gap FROM lineitem"))
def n16(spark, sf):
    return table(spark, sf, "lineitem").withColumn("gap", (F.col("l_quantity") - 8) / 16)


@query(
    "N17_polygon_renormalise",
    "run:i frame:i vertex:i x:6 y:6",
    sql("ring", "SELECT run, frame, vertex, (x / 8 * 320 + 10 * frame) / 1280 AS x, (y / 8 * 240 + 5 * run) / 720 AS y FROM ring"),
)
def n17(spark, sf):
    place = F.transform(
        "poly",
        lambda p: F.struct(((p["x"] / 8 * 320 + 10 * F.col("frame")) / 1280).alias("x"), ((p["y"] / 8 * 240 + 5 * F.col("run")) / 720).alias("y")),
    )
    return contours(spark, sf).select("run", "frame", F.posexplode(place).alias("vertex", "p")).select("run", "frame", "vertex", "p.*")


@query("P14_minimum_length", "snapshot:i length:i", sql("seg", "SELECT * FROM seg WHERE length >= 10"))
def p14(spark, sf):
    return segments(spark, sf).filter(F.col("length") >= 10)


@query(
    "P18_ring_subset",
    "run:i frame:i k:i v:6",
    sql(
        "fr",
        """SELECT run, frame, k, v[((round_even(k * 63 / 16, 0)::INT - list_position(v, list_min(v)) + 1) % 64 + 64) % 64 + 1] AS v FROM fr, range(16) r(k)""",
    ),
)
def p18(spark, sf):
    return ops.ring_subset(frames(spark, sf), "v", 16).select("run", "frame", F.inline("subset"))


@query("P19_drop_warm_up", SIG + "p:6", sql("sig", "SELECT * FROM sig WHERE n >= 4"))
def p19(spark, sf):
    return signal(spark, sf).filter("n >= 4")


@query("P20_trim_by_trigger", SIG + "t:6 p:6", sql("sig", "SELECT channel, n, t - min(t) OVER (PARTITION BY channel) AS t, p FROM sig WHERE p >= 20"))
def p20(spark, sf):
    return ops.trim_by_trigger(signal(spark, sf), ["channel"], F.col("p") >= 20, "t")


GAPS = "gap AS (SELECT vec_id, i, CASE WHEN abs(v) <= 0.15 THEN v END AS v FROM smp)"
FILL = """fil AS (SELECT vec_id, i, coalesce(v, CASE WHEN pi IS NULL THEN nv WHEN ni IS NULL THEN pv ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END, 0) AS p FROM
  (SELECT vec_id, i, v, last_value(v IGNORE NULLS) OVER b AS pv, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS pi,
  first_value(v IGNORE NULLS) OVER a AS nv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ni FROM gap
  WINDOW b AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY vec_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)))"""


@query("Q10_fill_gaps", "vec_id:i i:i p:6", sql("smp", "SELECT * FROM fil", GAPS, FILL))
def q10(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    holes = e.withColumn("v", F.transform("v", lambda v: F.when(F.abs(v) <= 0.15, v)))
    return holes.select("vec_id", F.posexplode(arrays.fill_gaps(F.col("v"))).alias("i", "p"))


def resample_sql(length):
    return f"""rs AS (SELECT g.snapshot, g.model, k AS pos, CASE WHEN g.length <= 1 THEN a.p ELSE a.p + (b.p - a.p) * (k * (g.length - 1) / ({length} - 1) - a.pos) END AS p
      FROM seg g CROSS JOIN range({length}) r(k) JOIN ser a ON a.snapshot = g.snapshot AND a.pos = greatest(0, least(floor(k * (g.length - 1) / ({length} - 1)), g.length - 2))
      LEFT JOIN ser b ON b.snapshot = g.snapshot AND b.pos = a.pos + 1)"""


@query("Q11_resample_linear", SP, sql("ser", "SELECT * FROM rs", resample_sql(40)))
def q11(spark, sf):
    return long(segments(spark, sf).withColumn("p", arrays.resample_linear(F.col("p"), F.lit(40))))


# Natural spline: elimination forwards, substitution backwards, one knot a step.
SPLINE = [
    "knots AS (SELECT snapshot, any_value(length) AS n, list(p ORDER BY pos) AS p FROM ser GROUP BY snapshot)",
    """down AS (SELECT snapshot, n, p, 0::BIGINT AS i, []::DOUBLE[] AS c, []::DOUBLE[] AS d FROM knots WHERE n >= 4 UNION ALL
      SELECT snapshot, n, p, i + 1, list_append(c, 1 / (4 - coalesce(c[-1], 0))),
      list_append(d, (6 * (p[i + 3] - 2 * p[i + 2] + p[i + 1]) * (n - 1) * (n - 1) - coalesce(d[-1], 0)) / (4 - coalesce(c[-1], 0))) FROM down WHERE i < n - 2)""",
    """up AS (SELECT snapshot, n, p, c, d, i, [0.0::DOUBLE] AS m FROM down WHERE i = n - 2 UNION ALL
      SELECT snapshot, n, p, c, d, i - 1, list_prepend(d[i] - c[i] * m[1], m) FROM up WHERE i > 0)""",
    """spl AS (SELECT snapshot, k AS pos, (1 - t) * p[lo + 1] + t * p[lo + 2] + ((pow(1 - t, 3) - (1 - t)) * m[lo + 1] + (pow(t, 3) - t) * m[lo + 2]) / (6.0::DOUBLE * (n - 1) * (n - 1)) AS p FROM
      (SELECT *, x - lo AS t FROM (SELECT *, least(floor(x), n - 2)::BIGINT AS lo FROM (SELECT snapshot, n, p, list_prepend(0.0::DOUBLE, m) AS m, k, k * (n - 1) / 39.0::DOUBLE AS x
      FROM up, range(40) r(k) WHERE i = 0))))""",
]


@query(
    "Q12_resample_cubic",
    SP,
    sql("ser", "SELECT * FROM spl UNION ALL SELECT snapshot, pos, p FROM rs WHERE snapshot IN (SELECT snapshot FROM seg WHERE length < 4)", resample_sql(40), *SPLINE),
)
def q12(spark, sf):
    return long(segments(spark, sf).withColumn("p", ops.resample_cubic(F.col("p"), 40)))


SCALED = """sc AS (SELECT snapshot, model, pos, z / coalesce(nullif(max(abs(z)) OVER (PARTITION BY snapshot), 0), 1) AS p
  FROM (SELECT *, p - avg(p) OVER (PARTITION BY snapshot) AS z FROM rs))"""
LONGEST = resample_sql("(SELECT max(length) FROM seg)").replace("range((SELECT max(length) FROM seg))", "(SELECT unnest(range((SELECT max(length) FROM seg))) AS k)")


@query("Q13_resample_group", SP, sql("ser", "SELECT snapshot, pos, CASE WHEN (SELECT length FROM seg WHERE seg.snapshot = sc.snapshot) > 1 THEN p ELSE 0 END AS p FROM sc", LONGEST, SCALED))
def q13(spark, sf):
    return long(ops.resample_group(segments(spark, sf), "p"))


@query("Q14_mean_by_class", "model:s pos:i mean:6", sql("ser", "SELECT model, pos, avg(p) AS mean FROM rs GROUP BY 1, 2", resample_sql(40)))
def q14(spark, sf):
    d = segments(spark, sf).withColumn("p", arrays.resample_linear(F.col("p"), F.lit(40)))
    return ops.mean_by_class(d, "model", "p")


@query(
    "Q15_upsample_clock",
    SIG + "p:6",
    sql(
        "sig",
        "SELECT channel, n * 5 + k AS n, p + coalesce((nx - p) * k / 5, 0) AS p FROM (SELECT *, lead(p) OVER (PARTITION BY channel ORDER BY n) AS nx FROM sig), range(5) r(k) WHERE nx IS NOT NULL OR k = 0",
    ),
)
def q15(spark, sf):
    return ops.upsample(signal(spark, sf).select("channel", "n", "p"), ["channel"], "n", "p", 5, size=512)


def run_tables(spark, sf):
    return frames(spark, sf).select("run", F.col("frame").alias("row"), F.col("v")[0].alias("value"), F.col("v")[5].alias("x"), F.col("v")[6].alias("y"))


def times(spark, sf):
    return table(spark, sf, "events").select("event_id", (F.col("user_id") % 10).cast("int").alias("run"), F.col("value").alias("t"))


@query(
    "Q16_periodic_lookup",
    "event_id:i run:i t:6 value:6",
    sql(
        "fr",
        """SELECT event_id, q.run, t, CASE WHEN i = j THEN a.v[1] ELSE a.v[1] + (t - floor(t / 25) * 25 - i * 0.5) * (b.v[1] - a.v[1]) / 0.5 END AS value FROM
        (SELECT event_id, (user_id % 10)::INT AS run, value AS t, (floor(value / 0.5) % 50)::INT AS i, (ceil(value / 0.5) % 50)::INT AS j FROM events) q
        JOIN fr a ON a.run = q.run AND a.frame = i JOIN fr b ON b.run = q.run AND b.frame = j""",
    ),
)
def q16(spark, sf):
    tables = run_tables(spark, sf).select("run", "row", "value")
    return ops.periodic_lookup(times(spark, sf), tables, "run", "t", 0.5, 50)


@query(
    "W24_position_at_time",
    "event_id:i run:i x:6 y:6",
    sql(
        "fr",
        """SELECT event_id, q.run, v[6] * 256 / 2000 AS x, v[7] * 128 / 1200 AS y FROM (SELECT event_id, (user_id % 10)::INT AS run,
        greatest(0, least(trunc(value / 0.686778 - 1), 49))::INT AS i FROM events) q JOIN fr a ON a.run = q.run AND a.frame = i""",
    ),
)
def w24(spark, sf):
    return ops.position_at(times(spark, sf), run_tables(spark, sf), "run", "t", 0.686778, 256 / 2000, 128 / 1200)


@query(
    "W04_speed_acceleration",
    "run:i frame:i pos:i speed:6 accel:6",
    sql(
        "uv",
        """SELECT run, frame, cell AS pos, speed, coalesce(lead(speed) OVER w, speed) - CASE WHEN cell < 63 THEN speed ELSE lag(speed) OVER w END AS accel FROM
        (SELECT *, coalesce(d, lag(d) OVER (PARTITION BY run, frame ORDER BY cell)) AS speed FROM (SELECT run, frame, cell,
        hypot(lead(u) OVER c - u, lead(w) OVER c - w) AS d FROM uv WINDOW c AS (PARTITION BY run, frame ORDER BY cell))) WINDOW w AS (PARTITION BY run, frame ORDER BY cell)""",
    ),
)
def w04(spark, sf):
    d = velocity(spark, sf).select("run", "frame", F.posexplode(ops.motion(F.col("u"), F.col("w"))).alias("pos", "m"))
    return d.select("run", "frame", "pos", "m.*")


SPINE = ["com_x", "com_y", "nose_x", "nose_y", "tail_x1", "tail_y1", "tail_x3", "tail_y3"]
_TAIL = "atan2((nose_x - com_x) * (tail_y3 - tail_y1) - (nose_y - com_y) * (tail_x3 - tail_x1), (nose_x - com_x) * (tail_x3 - tail_x1) + (nose_y - com_y) * (tail_y3 - tail_y1))"


@query(
    "W05_heading_and_tail",
    "vec_id:i heading:6 tail:6",
    sql(
        "",
        f"SELECT vec_id, h / (2 * pi()) + CASE WHEN h < 0 THEN 1 ELSE 0 END AS heading, tl / (2 * pi()) + CASE WHEN tl < 0 THEN 1 ELSE 0 END AS tail FROM (SELECT vec_id, atan2(nose_y - com_y, nose_x - com_x) AS h, {_TAIL} AS tl FROM sp)",
        "sp AS (SELECT vec_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS {c}" for i, c in enumerate(SPINE)) + " FROM embeddings)",
    ),
)
def w05(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(SPINE)])
    return ops.heading_and_tail(e, unit=True)


@query(
    "W07_cumulative_mean",
    SIG + "mean:6",
    sql("sig", "SELECT channel, n, avg(p) OVER (PARTITION BY channel ORDER BY n) AS mean FROM sig UNION ALL SELECT channel, max(n) + 1, avg(p) FROM sig GROUP BY 1"),
)
def w07(spark, sf):
    return ops.cumulative_mean(signal(spark, sf), ["channel"], "n", F.floor(F.col("n") / 512), "p")


@query(
    "W08_cumulative_energy",
    "run:i frame:i rank:i cumulative:6 needed:i",
    sql(
        "cells",
        """SELECT *, least(50, min(CASE WHEN cumulative >= 0.95 THEN rank END) OVER (PARTITION BY run)) AS needed FROM (SELECT run, frame,
        row_number() OVER w AS rank, sum(e) OVER w / sum(e) OVER (PARTITION BY run) AS cumulative FROM (SELECT run, frame, sum(v * v * (frame + 1)) AS e FROM cells GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY run ORDER BY e DESC))""",
    ),
)
def w08(spark, sf):
    e = F.aggregate("v", F.lit(0.0), lambda s, v: s + v * v * (F.col("frame") + 1))
    return ops.energy_cumulative(frames(spark, sf).select("run", "frame", e.alias("e")), ["run"], "e", 0.95)


@query(
    "W09_trailing_baseline",
    SIG + "baseline:6 corrected:6",
    sql("sig", "SELECT *, (p - baseline) / 4 AS corrected FROM (SELECT *, avg(p) OVER (PARTITION BY channel ORDER BY n ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS baseline FROM sig)"),
)
def w09(spark, sf):
    return ops.trailing_baseline(signal(spark, sf), ["channel"], "n", "p", size=512)


@query("W10_every_nth", SIG + "p:6", sql("sig", "SELECT * FROM sig WHERE n % 25 = 24"))
def w10(spark, sf):
    return ops.every_nth(signal(spark, sf), "n", 25)


@query(
    "W11_u_turns",
    SIG + "p:6",
    sql("sig", "SELECT * FROM (SELECT *, p - lag(p) OVER w AS d1, lag(p) OVER w - lag(p, 2) OVER w AS d0 FROM sig WINDOW w AS (PARTITION BY channel ORDER BY n)) WHERE d1 * d0 < 0"),
)
def w11(spark, sf):
    return ops.turns(signal(spark, sf), ["channel"], "n", "p", size=512)


@query(
    "W14_comparison_window",
    "passage:i sample:i before:4 after:4 sim_start:i sim_end:i first_sample:i last_sample:i",
    sql(
        "",
        """SELECT *, CASE WHEN rb < 600 THEN sf ELSE trunc((t - s + 600 * -1) / 0.01) END AS sim_start, CASE WHEN ra < 600 THEN ef ELSE trunc((t - s + 600) / 0.01) END AS sim_end,
        trunc(t * 5) - trunc(before * 5) AS first_sample, trunc(t * 5) + trunc(after * 5) AS last_sample FROM (SELECT *, least(rb, 600) AS before, least(ra, 600) AS after FROM
        (SELECT *, t - (s + sf * 0.01) AS rb, (s + ef * 0.01) - t AS ra FROM (SELECT p.event_id AS passage, w.event_id AS sample,
        (epoch_us(p.ts) - 1704067200000000) / 1e6 AS t, (epoch_us(w.ts) - 1704067200000000) / 1e6 AS s, 0 AS sf, floor(60000 * w.value) AS ef, 600 * w.value AS dur
        FROM events p JOIN events w ON p.user_id = w.user_id AND p.event_type = 'purchase' AND w.event_type = 'signup') WHERE t BETWEEN s AND s + dur))""",
    ),
)
def w14(spark, sf):
    d = j10(spark, sf).withColumns({"start_frame": F.lit(0), "end_frame": F.floor((F.col("end_s") - F.col("start_s")) * 100 + 1e-6)})
    return ops.comparison_window(d, half=600.0, fs=5, dt=0.01)


@query(
    "W15_segment_samples",
    "snapshot:i first_sample:i stop_sample:i",
    sql(
        "seg",
        """SELECT snapshot, lo AS first_sample, least(trunc((vec_id * 0.7::DOUBLE + 0.25::DOUBLE) * 500), lo0 + 5 * (greatest(end_frame - 3, -1) + 1)) AS stop_sample FROM
        (SELECT *, lo0 + 5 * greatest(0, start_frame - 3) AS lo FROM (SELECT *, trunc(vec_id * 0.7::DOUBLE * 500) + 5 * (vec_id % 10) AS lo0 FROM seg))
        WHERE end_frame - 3 >= greatest(0, start_frame - 3) AND lo < least(trunc((vec_id * 0.7::DOUBLE + 0.25::DOUBLE) * 500), lo0 + 5 * (end_frame - 2))""",
    ),
)
def w15(spark, sf):
    d = segments(spark, sf).withColumns(
        {"start_s": F.col("vec_id") * 0.7, "end_s": F.col("vec_id") * 0.7 + 0.25, "skip_frame": F.col("vec_id") % 10}
    )
    return ops.segment_bounds(d, 500.0, 100.0, 3)


@query(
    "W16_tail_spikes",
    "snapshot:i length:i spiky:b",
    sql(
        "ser",
        """SELECT snapshot, length, CASE WHEN length < 2 THEN false ELSE coalesce(max(abs(p)) FILTER (pos >= length - tail) > 1.2 * greatest(max(abs(p)) FILTER (pos < length - tail), 1e-9), false) END AS spiky
        FROM (SELECT *, least(greatest(round_even(length * 0.15, 0), 5), length - 1) AS tail FROM ser) GROUP BY snapshot, length""",
    ),
)
def w16(spark, sf):
    return ops.split_tail_spikes(segments(spark, sf), "p", ratio=1.2)


LASTF = "lastf AS (SELECT run, max(frame) AS last FROM fr GROUP BY run)"


@query(
    "W22_period_start",
    "run:i start:i difference:6 equal_start:i",
    sql(
        "cells",
        """SELECT d.run, least(arg_min(frame, (diff, frame)), any_value(last) - 9) AS start, min(diff) AS difference, max(frame) FILTER (same) AS equal_start FROM
        (SELECT c.run, c.frame, l.last, sum(pow(c.v - z.v, 2)) AS diff, bool_and(cell > 1 OR round(c.v * 4) = round(z.v * 4)) AS same FROM cells c JOIN lastf l USING (run)
        JOIN cells z ON z.run = c.run AND z.frame = l.last AND z.cell = c.cell WHERE c.frame < l.last GROUP BY ALL) d GROUP BY d.run""".replace("z.cell = c.cell WHERE", "z.cell = c.cell WHERE").replace("cell > 1", "c.cell > 1"),
        LASTF,
    ),
)
def w22(spark, sf):
    f = frames(spark, sf)
    near = ops.period_start(f, "v", min_back=10)
    coarse = f.withColumn("v", F.transform(F.slice("v", 1, 2), lambda v: F.round(v * 4)))
    same = ops.period_start(coarse, "v", exact=True).withColumnRenamed("start", "equal_start")
    return near.join(same, "run", "left")


@query(
    "W23_correlation_with_last",
    "run:i frame:i correlation:5",
    sql(
        "cells",
        """SELECT a.run, a.frame, sum(a.z * b.z) AS correlation FROM z a JOIN lastf l USING (run) JOIN z b ON b.run = a.run AND b.frame = l.last AND b.cell = a.cell GROUP BY 1, 2""",
        LASTF,
        "z AS (SELECT run, frame, cell, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-10) AS z FROM cells WINDOW w AS (PARTITION BY run, frame))",
    ),
)
def w23(spark, sf):
    return ops.correlation_with_last(frames(spark, sf), "v")


@query(
    "J22_locate_subsequence",
    "run:i start:i stop:i",
    sql(
        "fr",
        """SELECT run, min(frame) AS start, min(frame) + any_value(len) - 1 AS stop FROM (SELECT f.run, f.frame, (SELECT count(*) FROM fr x WHERE x.run = f.run AND x.label = h.label) AS len
        FROM fr f JOIN (SELECT run, label, arg_min(v, frame) AS v FROM fr GROUP BY run, label) h ON f.run = h.run AND h.label = 3
        WHERE list_sum(list_transform(range(1, 65), lambda i: abs(f.v[i] - h.v[i]))) < 1e-6) GROUP BY run""",
    ),
)
def j22(spark, sf):
    f = frames(spark, sf)
    return ops.locate(f, f.filter("label = 3").withColumn("piece", F.lit(0)), "piece", "v")


@query(
    "J11_positional_join",
    "event_id:i user_id:i snapshot:i window_event:i",
    sql(
        "",
        """SELECT p.event_id, p.user_id, p.k AS snapshot, w.event_id AS window_event FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) % 12 + 1 AS k FROM events WHERE event_type = 'purchase') p
        JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'signup') w ON w.user_id = p.user_id AND w.rn = p.k""",
    ),
)
def j11(spark, sf):
    e = table(spark, sf, "events")
    w = index_rows(e.filter("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("window_event")), ["user_id"], ["ts", "window_event"], F.date_trunc("day", F.col("ts")))
    p = e.filter("event_type = 'purchase'").select("event_id", "user_id", (F.get_json_object("props", "$.k").cast("int") % 12 + 1).alias("snapshot"))
    return p.join(w.select("user_id", "window_event", (F.col("n") + 1).alias("snapshot")), ["user_id", "snapshot"])


@query(
    "F16_slow_clock_seconds",
    "event_id:i seconds:3",
    sql("", "SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 4 AS seconds FROM events"),
)
def f16(spark, sf):
    return table(spark, sf, "events").select("event_id", ops.seconds(F.date_format("ts", "HH:mm:ss")).alias("seconds"))

"""Track, activity-window and matching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeframe.operators import fields, linking, tracks as ops, vortices
from wakeframe.plans.registry import query
from wakeframe.plans.views import GRID, SENSORS, contours, frames, micros, sql, table, tracks
from wakeframe.plans.fields import SMOOTH
from wakeframe.plans.vortices import BEST, PEAKS, RAW, raw_regions

TK = ["run", "track_id"]
ORDER = ["frame", "event_id"]


def day():
    return F.floor(F.col("frame") / 1440)


ACTIVE = "actv AS (SELECT DISTINCT run, sensor_id, frame FROM best WHERE sensor_distance <= 1.5)"
ISL = """isl AS (SELECT run, sensor_id, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS length FROM
  (SELECT *, frame - row_number() OVER (PARTITION BY run, sensor_id ORDER BY frame) AS g FROM actv) GROUP BY run, sensor_id, g)"""


def active(spark, sf):
    near = vortices.closest_sensor(raw_regions(spark, sf), SENSORS, 1.5).withColumn("visible", F.lit(True))
    return ops.active_frames(near, ["run", "sensor_id"], require_visible=True)


@query("W01_active_frames", "run:i sensor_id:i frame:i", sql("cells sensors", "SELECT * FROM actv", RAW, BEST, ACTIVE))
def w01(spark, sf):
    return active(spark, sf)


@query(
    "W02_active_segments",
    "run:i sensor_id:i start_frame:i end_frame:i length:i",
    sql("cells sensors", "SELECT * FROM isl", RAW, BEST, ACTIVE, ISL),
)
def w02(spark, sf):
    return ops.islands(active(spark, sf), ["run", "sensor_id"])


@query(
    "W03_snapshot_extraction",
    "run:i sensor_id:i start_frame:i end_frame:i length:i pos:i p:6",
    sql(
        "cells sensors",
        """SELECT i.*, c.frame - start_frame AS pos, c.v AS p FROM isl i JOIN sensors s USING (sensor_id)
        JOIN cells c ON c.run = i.run AND c.x = s.sx AND c.y = s.sy AND c.frame BETWEEN start_frame AND end_frame""",
        RAW,
        BEST,
        ACTIVE,
        ISL,
    ),
)
def w03(spark, sf):
    probe = fields.probe(frames(spark, sf), GRID, "v", SENSORS)
    return ops.cut_series(probe, w02(spark, sf), ["run", "sensor_id"])


def linking_sql(dets: str, key: str, limit: float, gap: int, winner: str) -> list[str]:
    """Frame-by-frame linking as a recursive CTE whose rows carry the live tracks as a list.

    A track offers its nearest detection; of the offers for one detection the least
    by ``winner`` (fields of the offer) takes it.
    """
    track = "STRUCT(id BIGINT, f BIGINT, x DOUBLE, y DOUBLE)[]"
    row = "STRUCT(r BIGINT, x DOUBLE, y DOUBLE, id BIGINT, dist DOUBLE)[]"
    return [
        f"byf AS (SELECT run, frame, list({{'r': {key}::BIGINT, 'x': x::DOUBLE, 'y': y::DOUBLE}} ORDER BY {key}) AS d FROM {dets} GROUP BY run, frame)",
        "allf AS (SELECT fr.run, fr.frame, coalesce(d, []) AS d FROM fr LEFT JOIN byf USING (run, frame))",
        f"""lnk AS (SELECT DISTINCT run, -1 AS frame, []::{track} AS live, 0::BIGINT AS fresh, []::{row} AS done FROM fr
        UNION ALL SELECT run, frame, list_concat(list_filter(alive, lambda t: NOT list_contains(list_transform(done, lambda o: o.id), t.id)),
          list_transform(done, lambda o: {{'id': o.id, 'f': frame::BIGINT, 'x': o.x, 'y': o.y}})) AS live, fresh + len(list_filter(done, lambda o: o.dist IS NULL)) AS fresh, done FROM
        (SELECT run, frame, alive, fresh, list_transform(won, lambda p, i: {{'r': p.r, 'x': p.x, 'y': p.y, 'id': CASE WHEN p.w IS NULL
          THEN fresh + len(list_filter(won, lambda q, j: j < i AND q.w IS NULL)) ELSE p.w.id END, 'dist': p.w.dist}}) AS done FROM
        (SELECT run, frame, alive, fresh, list_transform(d, lambda p, i: {{'r': p.r, 'x': p.x, 'y': p.y, 'w': list_sort(list_transform(
          list_filter(offers, lambda o: o.k = i), lambda o: {winner}))[1]}}) AS won FROM
        (SELECT run, frame, alive, fresh, d, list_filter(list_transform(alive, lambda t: list_sort(list_transform(d, lambda p, i:
          {{'dist': sqrt(pow(p.x - t.x, 2) + pow(p.y - t.y, 2)), 'k': i, 'id': t.id}}))[1]), lambda o: o.dist < {limit}) AS offers FROM
        (SELECT s.run, n.frame, list_filter(s.live, lambda t: n.frame - t.f <= {gap}) AS alive, s.fresh, n.d FROM lnk s JOIN allf n ON n.run = s.run AND n.frame = s.frame + 1)))))""",
        "linked AS (SELECT run, frame, o.r, o.x, o.y, o.id, o.dist FROM (SELECT run, frame, unnest(done) AS o FROM lnk))",
    ]


NEAREST_FIRST = "{'dist': o.dist, 'id': o.id}"
OLDEST_FIRST = "{'id': o.id, 'dist': o.dist}"
LINK = [RAW, "dts AS (SELECT run, frame, region, core_x AS x, core_y AS y FROM reg WHERE area >= 2)", *linking_sql("dts", "region", 2.0, 3, NEAREST_FIRST)]
LINKED = "SELECT run, frame, r AS region, x AS core_x, y AS core_y, id AS track_id, dist AS track_distance FROM linked"


@query("J07_assign_tracks", "run:i frame:i region:i core_x:6 core_y:6 track_id:i track_distance:6", sql("cells", LINKED, *LINK))
def j07(spark, sf):
    return linking.assign_tracks(raw_regions(spark, sf).filter("area >= 2"), 2.0, 3)


@query(
    "J08_assign_tracks_in_order",
    "run:i frame:i x:i y:i value:6 track_id:i",
    sql(
        "cells ring",
        "SELECT run, frame, l.x, l.y, value, id AS track_id FROM linked l JOIN dts USING (run, frame, r)",
        SMOOTH,
        PEAKS,
        "dts AS (SELECT run, frame, x, y, value, row_number() OVER (PARTITION BY run, frame ORDER BY (value < 0)::INT, x, y) AS r FROM pd WHERE distance >= 1)",
        *linking_sql("dts", "r", 2.0, 1000000, OLDEST_FIRST),
    ),
)
def j08(spark, sf):
    peaks = vortices.detect_peaks(contours(spark, sf), GRID, "v", 0.02, 5, 1.0, poly="poly", distance_min=1.0)
    return ops.assign_tracks_in_order(peaks, 2.0)


@query(
    "J09_tracks_near_sensors",
    "run:i track_id:i frame:i event_id:i core_x:6 core_y:6",
    sql(
        "trk sensors",
        "SELECT c.* FROM clean c SEMI JOIN chosen h ON c.run = h.run AND c.track_id = h.track_id",
        """clean AS (SELECT * FROM trk SEMI JOIN (SELECT run, track_id FROM (SELECT run, track_id, arg_min(core_y, (frame, event_id)) AS y0
        FROM trk GROUP BY run, track_id) WHERE y0 NOT BETWEEN 4 AND 6 AND y0 NOT BETWEEN 1 AND 3) b USING (run, track_id)),
        chosen AS (SELECT DISTINCT run, track_id FROM (SELECT c.run, c.track_id, row_number() OVER (PARTITION BY c.run, c.frame, s.sensor_id
        ORDER BY hypot(core_x - sx, core_y - sy), track_id) AS rn FROM clean c, sensors s WHERE abs(core_x - sx) <= 2) WHERE rn = 1)""",
    ),
)
def j09(spark, sf):
    return ops.near_sensors(tracks(spark, sf), ["run"], ORDER, SENSORS, 2.0, 1.0)


WIN = """hrs AS (SELECT DISTINCT run, sensor_id, frame // 60 AS h FROM trk WHERE sensor_id >= 0 AND visible),
  win AS (SELECT run, sensor_id, min(h) * 60 AS start_frame, max(h) * 60 + 59 AS end_frame FROM
  (SELECT *, h - row_number() OVER (PARTITION BY run, sensor_id ORDER BY h) AS g FROM hrs) GROUP BY run, sensor_id, g)"""
MATCH = """hit AS (SELECT t.*, w.sensor_id AS win_sensor, start_frame, end_frame, end_frame - start_frame + 1 AS snapshot_length FROM trk t
  JOIN win w ON t.run = w.run AND t.frame BETWEEN start_frame AND end_frame WHERE t.visible AND (t.sensor_id < 0 OR t.sensor_id = w.sensor_id))"""


def windows(t):
    hours = ops.active_frames(
        t.filter("sensor_id >= 0").withColumn("frame", F.floor(F.col("frame") / 60)), ["run", "sensor_id"], require_visible=True
    )
    w = ops.islands(hours, ["run", "sensor_id"])
    return w.select("run", "sensor_id", (F.col("start_frame") * 60).alias("start_frame"), (F.col("end_frame") * 60 + 59).alias("end_frame"))


def matched(spark, sf):
    t = tracks(spark, sf)
    hit = ops.rows_in_windows(t, windows(t), ["run"], 360)
    return hit.withColumn("snapshot_length", F.col("end_frame") - F.col("start_frame") + 1)


HIT = "run:i track_id:i frame:i event_id:i win_sensor:i start_frame:i end_frame:i"


@query("J14_rows_in_windows", HIT, sql("trk", "SELECT * FROM hit", WIN, MATCH))
def j14(spark, sf):
    return matched(spark, sf)


WK = ["run", "track_id", "win_sensor", "start_frame", "end_frame"]


@query(
    "A13_track_persistence",
    "run:i track_id:i win_sensor:i start_frame:i end_frame:i duration:i ratio:6",
    sql(
        "trk",
        """SELECT run, track_id, win_sensor, start_frame, end_frame, count(DISTINCT frame) AS duration, count(DISTINCT frame) / any_value(snapshot_length) AS ratio
        FROM hit GROUP BY ALL HAVING count(DISTINCT frame) / any_value(snapshot_length) >= 0.002""",
        WIN,
        MATCH,
    ),
)
def a13(spark, sf):
    return ops.persistence(matched(spark, sf), WK, F.col("snapshot_length"), 0.002)


@query(
    "A14_first_match",
    HIT.replace("win_sensor:i ", "") + " core_x:6",
    sql(
        "trk",
        "SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY run, track_id, start_frame, end_frame ORDER BY frame, event_id, win_sensor) = 1",
        WIN,
        MATCH,
    ),
)
def a14(spark, sf):
    return ops.first_by_key(matched(spark, sf), ["run", "track_id", "start_frame", "end_frame"], ["frame", "event_id", "win_sensor"])


FEAT_SQL = """SELECT {k}, count(DISTINCT frame) AS duration_frames, count(DISTINCT frame) / {length} AS duration_ratio,
  hypot(arg_max(core_x, (frame, event_id)) - arg_min(core_x, (frame, event_id)), arg_max(core_y, (frame, event_id)) - arg_min(core_y, (frame, event_id))) AS displacement,
  coalesce(sum(step), 0) AS path_length, coalesce(avg(step / greatest(gap, 1)), 0) AS mean_speed, coalesce(max(step / greatest(gap, 1)), 0) AS max_speed,
  avg(core_q) AS mean_core_q, max(core_q) AS max_core_q, avg(abs(core_q)) AS mean_abs_core_q, avg(radius) AS mean_radius, max(radius) AS max_radius,
  avg(area) AS mean_area, max(area) AS max_area, avg(body_distance) AS mean_body_distance, avg(sensor_distance) AS mean_sensor_distance,
  avg(core_x) AS mean_core_x, avg(core_y) AS mean_core_y FROM (SELECT *, hypot(core_x - lag(core_x) OVER w, core_y - lag(core_y) OVER w) AS step,
  frame - lag(frame) OVER w AS gap FROM {src} WINDOW w AS (PARTITION BY {k} ORDER BY frame, event_id)) GROUP BY {k}"""
FEAT_SPEC = " ".join(f"{f}:6" for f in ops.FEATURES)


@query("A10_track_features", "run:i track_id:i " + FEAT_SPEC, sql("trk", FEAT_SQL.format(k="run, track_id", length="10080", src="trk")))
def a10(spark, sf):
    return ops.track_features(tracks(spark, sf), TK, ORDER, day(), F.lit(10080))


@query(
    "A11_feature_meta",
    "run:i track_id:i win_sensor:i start_frame:i end_frame:i snapshot_length:i track_duration:i duration_ratio:6",
    sql(
        "trk",
        """SELECT run, track_id, win_sensor, start_frame, end_frame, len AS snapshot_length, dur AS track_duration, dur / len AS duration_ratio FROM
        (SELECT run, track_id, win_sensor, start_frame, end_frame, end_frame - start_frame + 1 AS len, CASE WHEN any_value(track_id) % 2 = 0 THEN 5 ELSE count(DISTINCT frame) END AS dur
        FROM hit GROUP BY run, track_id, win_sensor, start_frame, end_frame)""",
        WIN,
        MATCH,
    ),
)
def a11(spark, sf):
    d = matched(spark, sf).withColumns(
        {
            "snapshot_length": F.when(F.col("win_sensor") == 1, 0).otherwise(F.col("snapshot_length")),
            "track_duration": F.when(F.col("track_id") % 2 == 0, 5).otherwise(0),
            "duration_ratio": F.lit(0.0),
        }
    )
    keyed = d.withColumns({"start": F.col("start_frame"), "stop": F.col("end_frame")})
    m = ops.feature_meta(keyed, ["run", "track_id", "win_sensor", "start", "stop"])
    return m.withColumnsRenamed({"start": "start_frame", "stop": "end_frame"})


@query(
    "A12_track_features_v1",
    "run:i track_id:i duration:i displacement:6 avg_speed:6 max_speed:6 mean_vorticity:6 std_vorticity:6 min_distance:6 max_vorticity:6",
    sql(
        "trk",
        """SELECT *, displacement / duration AS avg_speed FROM (SELECT run, track_id, max(frame) - min(frame) + 1 AS duration,
        hypot(arg_max(core_x, (frame, event_id)) - arg_min(core_x, (frame, event_id)), arg_max(core_y, (frame, event_id)) - arg_min(core_y, (frame, event_id))) AS displacement,
        coalesce(max(step), 0) AS max_speed, avg(abs(core_q)) AS mean_vorticity, stddev_pop(core_q) AS std_vorticity,
        min(hypot(core_x - 6, core_y - 5)) AS min_distance, max(abs(core_q)) AS max_vorticity FROM (SELECT *,
        hypot(core_x - lag(core_x) OVER w, core_y - lag(core_y) OVER w) AS step FROM trk WINDOW w AS (PARTITION BY run, track_id ORDER BY frame, event_id))
        GROUP BY run, track_id)""",
    ),
)
def a12(spark, sf):
    return ops.track_features_v1(tracks(spark, sf), TK, ORDER, day(), 6.0, 5.0)


@query(
    "A43_theoretical_pressure",
    "run:i track_id:i event_id:i pressure:6",
    sql("trk", "SELECT *, -(pi() * 2.25) * core_q / nullif(pow(core_x - 6, 2) + pow(core_y - 5.25, 2), 0) AS pressure FROM trk"),
)
def a43(spark, sf):
    return ops.theoretical_pressure(tracks(spark, sf), 6.0, 5.25)


@query(
    "J23_reanchor_contour",
    "run:i frame:i total:6 vertex:i x:6",
    sql(
        "ring",
        "SELECT f.run, f.frame, list_sum(f.v) AS total, vertex, r.x FROM fr f JOIN ring r ON r.run = f.run AND r.frame = f.frame + 7",
    ),
)
def j23(spark, sf):
    c = contours(spark, sf)
    later = c.select("run", (F.col("frame") - 7).alias("frame"), "poly")
    j = c.select("run", "frame", "v").join(later, ["run", "frame"])
    total = F.aggregate("v", F.lit(0.0), lambda s, v: s + v)
    return j.select("run", "frame", total.alias("total"), F.posexplode("poly").alias("vertex", "pt")).withColumn("x", F.col("pt.x"))


@query(
    "O02_track_order",
    "run:i track_id:i frame:i event_id:i core_q:6",
    sql("trk", "SELECT * FROM trk ORDER BY run, track_id, frame, event_id"),
)
def o02(spark, sf):
    return tracks(spark, sf).orderBy("run", "track_id", "frame", "event_id")


@query(
    "P11_validity_and_deny_list",
    "l_orderkey:i l_linenumber:i l_partkey:i l_quantity:2",
    sql(
        "",
        """SELECT * FROM lineitem l WHERE l_linestatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem d
        WHERE d.l_returnflag = 'R' AND d.l_orderkey = l.l_orderkey AND d.l_linenumber = l.l_linenumber)""",
    ),
)
def p11(spark, sf):
    l = table(spark, sf, "lineitem")
    deny = l.filter("l_returnflag = 'R'").select("l_orderkey", "l_linenumber")
    return l.filter("l_linestatus = 'O'").join(deny, ["l_orderkey", "l_linenumber"], "left_anti")


LABEL_SQL = "lbl AS (SELECT user_id AS track_id, event_id, CASE event_type WHEN 'view' THEN ' Match' WHEN 'click' THEN 'semi match ' WHEN 'purchase' THEN 'no match' ELSE 'Not relevant ' END AS label, hour(ts) AS h, dayofmonth(ts) AS d FROM events)"


@query(
    "P12_label_predicates",
    "track_id:i d:i event_id:i label:s",
    sql(
        "",
        """SELECT * FROM lbl WHERE lower(trim(label)) IN ('match', 'semi match') AND (track_id, d) IN
        (SELECT (track_id, d) FROM lbl GROUP BY track_id, d HAVING NOT bool_and(lower(trim(label)) = 'not relevant'))""",
        LABEL_SQL,
    ),
)
def p12(spark, sf):
    e = table(spark, sf, "events")
    label = (
        F.when(F.col("event_type") == "view", " Match")
        .when(F.col("event_type") == "click", "semi match ")
        .when(F.col("event_type") == "purchase", "no match")
        .otherwise("Not relevant ")
    )
    d = e.select(F.col("user_id").alias("track_id"), F.dayofmonth("ts").alias("d"), "event_id", label.alias("label"))
    return ops.relevant(d, ["track_id", "d"], "label", ["match", "semi match"])


@query(
    "J10_event_in_interval",
    "experiment:i passage:i sample:i t:6 start_s:6 end_s:6",
    sql(
        "",
        """SELECT p.user_id AS experiment, p.event_id AS passage, w.event_id AS sample, (epoch_us(p.ts) - 1704067200000000) / 1e6 AS t,
        (epoch_us(w.ts) - 1704067200000000) / 1e6 AS start_s, (epoch_us(w.ts) - 1704067200000000) / 1e6 + 600 * w.value AS end_s
        FROM events p JOIN events w ON p.user_id = w.user_id AND p.event_type = 'purchase' AND w.event_type = 'signup'
        AND (epoch_us(p.ts) - 1704067200000000) / 1e6 BETWEEN (epoch_us(w.ts) - 1704067200000000) / 1e6 AND (epoch_us(w.ts) - 1704067200000000) / 1e6 + 600 * w.value""",
    ),
)
def j10(spark, sf):
    e = table(spark, sf, "events").withColumn("t", micros("ts") / 1e6)
    passages = e.filter("event_type = 'purchase'").select(F.col("user_id").alias("experiment"), F.col("event_id").alias("passage"), "t")
    w = e.filter("event_type = 'signup'").select(
        F.col("user_id").alias("experiment"), F.col("event_id").alias("sample"), F.col("t").alias("start_s"), (F.col("t") + 600 * F.col("value")).alias("end_s")
    )
    return ops.interval_join(passages, w, ["experiment"], "t", "start_s", "end_s", 86400.0)

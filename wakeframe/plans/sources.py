"""Source, sink, set and text queries: tables go out in a format and come back through its reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeframe.functions import text
from wakeframe.operators import modal
from wakeframe.operators.series import seconds
from wakeframe.plans.registry import query
from wakeframe.plans.similarity import SWEEP, sweep
from wakeframe.plans.views import cells, contours, frames, segments, sql, table, tracks, velocity
from wakeframe.session import scratch
from wakeframe.sources import scans, sinks


def run_of():
    return F.regexp_extract("file", r"run=(\d+)", 1).cast("int")


def back(spark, df, name, keys=("run",), order=("line",)):
    """Write (keys, order, value) as one text file per key and scan it."""
    path = scratch(spark, name)
    sinks.write_lines(df, path, list(keys), list(order))
    return scans.read_lines(spark, path)


def map_file(spark, sf, holes=False):
    d = cells(spark, sf).select("run", "frame", "cell", "v")
    if holes:
        d = d.withColumn("v", F.when(F.abs("v") < 0.3, F.col("v")))
    path = scratch(spark, "map")
    sinks.write_map(d, path)
    return scans.read_lines(spark, path)


@query("S01_wide_map_scan", "run:i cell:i frame:i v:8", sql("cells", "SELECT * FROM cells"))
def s01(spark, sf):
    return scans.wide_map(map_file(spark, sf)).withColumn("run", run_of())


@query("S02_shape_check", "run:i cells:i total:6", sql("cells", "SELECT run, count(*) AS cells, sum(v) AS total FROM cells WHERE run % 2 = 0 GROUP BY run"))
def s02(spark, sf):
    """Runs with an odd number get one cell more, which makes their grid invalid."""
    d = sinks.map_lines(cells(spark, sf).select("run", "frame", "cell", "v")).withColumnRenamed("cell", "line")
    extra = d.filter("run % 2 = 1 AND line = 63").withColumn("line", F.col("line") + 1)
    m = scans.wide_map(back(spark, d.unionByName(extra), "shape")).withColumn("run", run_of())
    return scans.valid_shape(m, 64, "skip").groupBy("run").agg(F.count(F.lit(1)).alias("cells"), F.sum("v").alias("total"))


@query(
    "S03_fill_missing",
    "run:i filled:i total:6",
    sql("cells", "SELECT run, count_if(abs(v) >= 0.3) AS filled, sum(CASE WHEN abs(v) < 0.3 THEN v ELSE 0 END) AS total FROM cells GROUP BY run"),
)
def s03(spark, sf):
    m = scans.fill_cells(scans.wide_map(map_file(spark, sf, holes=True))).withColumn("run", run_of())
    return m.groupBy("run").agg(F.count_if("filled").alias("filled"), F.sum("v").alias("total"))


@query("S04_contour_pair", "run:i frame:i vertex:i x:0 y:0", sql("ring", "SELECT run, frame, vertex, round_even(x, 0) AS x, round_even(y, 0) AS y FROM ring"))
def s04(spark, sf):
    d = contours(spark, sf).select("run", "frame", F.posexplode("poly").alias("cell", "p"))
    side = lambda axis: back(spark, sinks.map_lines(d.select("run", "frame", "cell", F.col("p")[axis].alias("v"))).withColumnRenamed("cell", "line"), axis)
    return scans.contour_pair(side("x"), side("y"), run_of(), rounded=True)


@query("S05_spine_scan", "run:i row:i com_x:6 last:6", sql("", "SELECT (a.vec_id // 50)::INT AS run, a.vec_id % 50 AS row, a.embedding[1] AS com_x, a.embedding[64] AS last FROM embeddings a WHERE a.vec_id % 50 >= 2 AND abs(embedding[2]) < 0.2"))
def s05(spark, sf):
    vals = F.transform("v", lambda v: v.cast("string"))
    wide = F.concat(vals, F.slice(vals, 57, 8))
    bad = F.abs(F.col("v")[1]) >= 0.2
    line = F.concat_ws(",", F.when(bad, F.concat(F.array(F.lit("lost")), wide)).otherwise(wide))
    d = frames(spark, sf).select("run", F.col("frame").alias("line"), line.alias("value"))
    rows = scans.spine_rows(back(spark, d, "spine"), skip=2)
    return rows.select(run_of().alias("run"), "row", F.get("vals", F.lit(0)).alias("com_x"), F.get("vals", F.lit(63)).alias("last"))


def sensor_lines(spark, sf):
    nums = lambda arr: F.array_join(F.transform(arr, lambda v: v.cast("string")), " ")
    f = frames(spark, sf)
    coords = F.concat(F.lit("% xcoord = ["), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: (i + F.col("run")).cast("string")), " "), F.lit("];"))
    head = f.select("run").distinct().select(
        "run", F.inline(F.array(*[F.struct(F.lit(i).alias("line"), t.alias("value")) for i, t in enumerate([F.lit("% pressure log"), coords, F.lit("% 50 steps"), F.lit("%")])]))
    )
    body = f.select(
        "run",
        F.inline(
            F.array(
                F.struct((4 + 2 * F.col("frame")).alias("line"), F.concat((F.col("frame") * 0.5).cast("string"), F.lit(" "), nums(F.slice("v", 1, 32)), F.lit(" ;")).alias("value")),
                F.struct((5 + 2 * F.col("frame")).alias("line"), F.concat(nums(F.slice("v", 33, 32)), F.lit(" ;")).alias("value")),
            )
        ),
    )
    return back(spark, head.unionByName(body), "log")


@query(
    "S06_sensor_log",
    "run:i step:i t:3 k:i ring:6 wall:6",
    sql("fr", "SELECT run, frame AS step, frame * 0.5 AS t, k, v[k + 1] AS ring, v[k + 33] AS wall FROM fr, range(32) r(k)"),
)
def s06(spark, sf):
    d = scans.sensor_log(sensor_lines(spark, sf))
    return d.select(run_of().alias("run"), "step", "t", F.posexplode(F.arrays_zip("cylinder", "wall")).alias("k", "z")).select("run", "step", "t", "k", F.col("z.cylinder").alias("ring"), "z.wall")


@query("S07_two_column_log", "run:i t:3 p:6", sql("fr", "SELECT run, frame * 0.01 AS t, v[1] AS p FROM fr WHERE v[2] > -0.1"))
def s07(spark, sf):
    row = F.when(F.col("v")[1] > -0.1, F.concat_ws(" ", (F.col("frame") * 0.01).cast("string"), F.col("v")[0].cast("string"))).otherwise("sensor lost")
    d = frames(spark, sf).select("run", F.col("frame").alias("line"), row.alias("value"))
    return scans.two_columns(back(spark, d, "two")).withColumn("run", run_of())


@query("S08_ring_coordinates", "run:i k:i x:3", sql("fr", "SELECT run, k, k + run AS x FROM (SELECT DISTINCT run FROM fr), range(32) r(k)"))
def s08(spark, sf):
    return scans.ring_coordinates(sensor_lines(spark, sf)).select(run_of().alias("run"), F.posexplode("coords").alias("k", "x"))


@query("S09_timed_table", "run:i row:i t:4 col:i value:6", sql("fr", "SELECT run, frame AS row, frame * 0.25 AS t, k AS col, v[k + 1] AS value FROM fr, range(64) r(k)"))
def s09(spark, sf):
    f = frames(spark, sf)
    head = f.select("run").distinct().select("run", F.lit(0).alias("line"), F.lit("50\t64\t0.25").alias("value"))
    row = F.array_join(F.transform("v", lambda v: v.cast("string")), "\t")
    d = head.unionByName(f.select("run", (F.col("frame") + 1).alias("line"), row.alias("value")))
    return scans.timed_table(back(spark, d, "timed")).withColumn("run", run_of())


@query("S10_named_channel", "channel:s day:i n:i total:4", sql("", "SELECT event_type AS channel, dayofmonth(ts) AS day, count(*) AS n, sum(value) AS total FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2"))
def s10(spark, sf):
    path = scratch(spark, "channels")
    e = table(spark, sf, "events").select(F.dayofmonth("ts").alias("experiment"), F.col("event_type").alias("channel"), "event_id", "value")
    e.write.mode("overwrite").partitionBy("experiment", "channel").parquet(path)
    d = scans.channels(spark, path, ["click", "view"])
    return d.groupBy("channel", F.col("experiment").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


WALL = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "S11_wall_pressure",
    "t:i channel:s n:i p:2",
    sql("", " UNION ALL ".join(f"SELECT l_orderkey AS t, '{c}' AS channel, count(*) AS n, sum({c}) AS p FROM lineitem GROUP BY 1" for c in WALL)),
)
def s11(spark, sf):
    d = scans.wall_pressure(table(spark, sf, "lineitem").select(*WALL, "l_orderkey"))
    return d.groupBy("t", "channel").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("p"))


@query("S12_first_columns", "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:2 l_extendedprice:2 l_discount:2 l_tax:2", sql("", "SELECT * FROM lineitem"))
def s12(spark, sf):
    return scans.first_columns(table(spark, sf, "lineitem"), 8)


def raw_tracks(spark, sf):
    """Tracks as text with faults: words for ids, empty frames, missing numbers."""
    t = tracks(spark, sf)
    return t.select(
        "event_id",
        F.when(F.col("area") < 5, F.lit("lost")).otherwise(F.col("frame").cast("double").cast("string")).alias("frame"),
        F.when(F.col("area") > 95, F.lit("none")).otherwise(F.col("track_id").cast("string")).alias("track_id"),
        F.when(F.col("core_x") > 20, F.lit("nan")).otherwise(F.col("core_x").cast("string")).alias("core_x"),
        F.col("core_y").cast("string").alias("core_y"),
        F.when(F.col("sensor_id") < 0, F.lit("nan")).otherwise(F.col("sensor_id").cast("string")).alias("sensor_id"),
        F.when(F.col("visible"), F.lit("1")).when(F.col("core_y") > 40, F.lit("maybe")).otherwise(F.lit("0")).alias("visible"),
    )


def csv_back(spark, df, name):
    path = scratch(spark, name)
    df.write.mode("overwrite").option("header", True).csv(path)
    return scans.strings(spark, path)


TRACK_SQL = "CASE WHEN area > 95 THEN -1 ELSE track_id END AS track_id, CASE WHEN core_x <= 20 THEN core_x END AS core_x, core_y"


@query(
    "S13_lenient_tracks",
    "frame:i track_id:i core_x:6 core_y:6 sensor_id:i visible:b",
    sql("trk", f"SELECT frame, {TRACK_SQL}, sensor_id, visible OR core_y > 40 AS visible FROM trk WHERE area >= 5"),
)
def s13(spark, sf):
    return scans.track_rows(csv_back(spark, raw_tracks(spark, sf), "tracks"))


@query(
    "S14_typed_tracks",
    "event_id:i frame:i track_id:i core_x:6 core_y:6 sensor_id:i visible:i",
    sql("trk", f"SELECT event_id, CASE WHEN area < 5 THEN -1 ELSE frame END AS frame, {TRACK_SQL}, sensor_id, CASE WHEN visible THEN 1 WHEN core_y > 40 THEN -1 ELSE 0 END AS visible FROM trk"),
)
def s14(spark, sf):
    return scans.typed_tracks(csv_back(spark, raw_tracks(spark, sf), "typed"))


@query(
    "S15_coerced_meta",
    "event_id:i frame:i track_id:i core_y:6",
    sql("trk", "SELECT event_id, frame, track_id, core_y FROM trk WHERE area >= 5 AND area <= 95"),
)
def s15(spark, sf):
    raw = csv_back(spark, raw_tracks(spark, sf), "meta").select("event_id", "frame", "track_id", "core_y")
    return scans.coerced(raw, ["frame", "track_id"], ["core_y"])


@query(
    "S16_series_lengths",
    "snapshot:i length:i",
    sql("ser", "SELECT snapshot, CASE WHEN length > 5 THEN length ELSE coalesce(max(pos) FILTER (p < 0.1) + 1, 0) END AS length FROM ser GROUP BY snapshot, length"),
)
def s16(spark, sf):
    d = segments(spark, sf)
    long = d.select("snapshot", F.posexplode("p").alias("pos", "p")).withColumn("p", F.when(F.col("p") < 0.1, F.col("p")))
    meta = d.select("snapshot", F.when(F.col("length") > 5, F.col("length")).otherwise(0).alias("length"))
    return scans.lengths(long, meta, "snapshot")


@query(
    "S17_timestamp_table",
    "event_id:i start_s:3 end_s:3 start_frame:i validity:b",
    sql("", "SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 4 AS start_s, (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 4 + 1.25 AS end_s, user_id AS start_frame, event_type <> 'error' AS validity FROM events"),
)
def s17(spark, sf):
    e = table(spark, sf, "events").select(
        "event_id", F.date_format("ts", "HH:mm:ss").alias("start_time"), F.col("user_id").alias("start_frame"), (F.col("event_type") != "error").alias("validity")
    )
    raw = csv_back(spark, e, "times")
    return raw.select(
        "event_id", seconds(F.col("start_time")).alias("start_s"), (seconds(F.col("start_time")) + 1.25).alias("end_s"), "start_frame", F.col("validity").cast("boolean").alias("validity")
    )


@query(
    "S18_automation_list",
    "experiment:s sub:s skip:i",
    sql("", "SELECT user_id::VARCHAR AS experiment, event_id::VARCHAR AS sub, CASE WHEN event_type = 'error' THEN 0 ELSE greatest(0, floor(value) - 20) END AS skip FROM events WHERE event_type <> 'signup'"),
)
def s18(spark, sf):
    skip = F.when(F.col("event_type") == "error", F.lit("unknown")).otherwise((F.floor("value") - 20).cast("string"))
    row = F.when(F.col("event_type") == "signup", F.col("user_id").cast("string")).otherwise(F.concat_ws(", ", F.col("user_id").cast("string"), F.col("event_id").cast("string"), skip))
    e = table(spark, sf, "events").select(F.dayofmonth("ts").alias("run"), (F.col("event_id") + 1).alias("line"), row.alias("value"))
    head = e.select("run").distinct().select("run", F.lit(0).cast("bigint").alias("line"), F.lit("experiment,sub,skip").alias("value"))
    return scans.automation_list(back(spark, head.unionByName(e), "auto"))


def label_file(spark, sf):
    d = sinks.label_lines(contours(spark, sf).select("run", F.col("frame").alias("line"), "poly"))
    return back(spark, d, "labels")


@query("S19_polygon_labels", "run:i line:i class:i vertex:i x:6 y:6", sql("ring", "SELECT run, frame AS line, 0 AS class, vertex, x, y FROM ring"))
def s19(spark, sf):
    d = scans.polygon_labels(label_file(spark, sf))
    return d.select(run_of().alias("run"), "line", "class", F.posexplode("pts").alias("vertex", "p")).select("run", "line", "class", "vertex", "p.*")


@query("S20_simulator_points", "run:i frame:i k:i v:6", sql("fr", "SELECT run, frame + 1 AS frame, k, CASE WHEN k = 0 THEN 0 ELSE v[k + 1] / 8 END AS v FROM fr, range(64) r(k)"))
def s20(spark, sf):
    f = frames(spark, sf)
    head = f.select("run").distinct().select("run", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("line"), F.lit("% header").alias("value"))
    row = F.array_join(F.transform("v", lambda v: v.cast("string")), " ")
    d = head.unionByName(f.select("run", (F.col("frame") + 4).alias("line"), row.alias("value")))
    out = scans.simulator_points(back(spark, d, "points"), 8)
    return out.select(run_of().alias("run"), "frame", F.posexplode("vals").alias("k", "v"))


@query("S21_annotation_json", "image:s shape:i label:s vertex:i x:6 y:6", sql("ring", "SELECT 'run' || run || '-' || frame || '.png' AS image, 0 AS shape, 'fish' AS label, vertex, x, y FROM ring"))
def s21(spark, sf):
    path = scratch(spark, "json")
    pts = F.transform("poly", lambda p: F.array(p["x"], p["y"]))
    shape = F.struct(F.lit("fish").alias("label"), pts.alias("points"), F.lit(None).cast("string").alias("group_id"), F.lit("polygon").alias("shape_type"))
    image = F.concat(F.lit("run"), F.col("run").cast("string"), F.lit("-"), F.col("frame").cast("string"), F.lit(".png"))
    contours(spark, sf).select(F.array(shape).alias("shapes"), image.alias("imagePath")).write.mode("overwrite").json(path)
    raw = spark.read.schema(scans.ANNOTATION).json(path)
    return scans.annotations(raw).withColumnRenamed("imagePath", "image")


def sweep_paths(spark, sf):
    d = sweep(spark, sf)
    return d.select(F.concat(F.lit("/data/Re"), (F.col("re") * 1000).cast("string"), F.lit("_h"), F.col("h").cast("double").cast("string"), F.lit("/FullMap.csv")).alias("file"), "p")


@query("S22_sweep_discovery", "re:i h:2 n:i total:3", sql("", "SELECT re * 1000 AS re, h, count(*) AS n, sum(p) AS total FROM swp WHERE re = 3 GROUP BY 1, 2", SWEEP))
def s22(spark, sf):
    return scans.sweep_files(sweep_paths(spark, sf), re=3000.0).groupBy("re", "h").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("total"))


@query(
    "S23_sweep_combinations",
    "re:i h:2 n:i",
    sql("", "SELECT re * 1000 AS re, h, count(*) AS n FROM swp WHERE (re, h) IN (SELECT (r_regionkey + 1, n_nationkey + 1) FROM region JOIN nation ON n_regionkey = r_regionkey) GROUP BY 1, 2", SWEEP),
)
def s23(spark, sf):
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    pairs = r.join(n, r.r_regionkey == n.n_regionkey).select(((F.col("r_regionkey") + 1) * 1000).cast("double").alias("re"), (F.col("n_nationkey") + 1).cast("double").alias("h"))
    return scans.sweep_combinations(sweep_paths(spark, sf), pairs).groupBy("re", "h").agg(F.count(F.lit(1)).alias("n"))


@query(
    "S24_paired_runs",
    "experiment:i snapshot:i",
    sql("", "SELECT DISTINCT a.user_id AS experiment, dayofmonth(a.ts) AS snapshot FROM events a JOIN events b ON a.user_id = b.user_id AND dayofmonth(a.ts) = dayofmonth(b.ts) AND a.event_type = 'view' AND b.event_type = 'click'"),
)
def s24(spark, sf):
    name = F.when(F.col("event_type") == "view", "ux_map.csv").when(F.col("event_type") == "click", "uy_map.csv").otherwise("notes.txt")
    files = table(spark, sf, "events").select(F.concat_ws("/", F.lit("/data"), F.col("user_id").cast("string"), F.dayofmonth("ts").cast("string"), name).alias("file"))
    return scans.paired_runs(files, "ux_map.csv", "uy_map.csv")


@query("S28_schema_drift", "run:i line:i a:6 b:6 extra:6", sql("fr", "SELECT run, frame + 1 AS line, v[1] AS a, v[2] AS b, CASE WHEN frame >= 30 THEN v[3] END AS extra FROM fr"))
def s28(spark, sf):
    f = frames(spark, sf)
    s = lambda i: F.col("v")[i].cast("string")
    row = F.when(F.col("frame") >= 30, F.concat_ws(",", s(0), s(1), s(2))).otherwise(F.concat_ws(",", s(0), s(1)))
    head = f.select("run").distinct().select("run", F.lit(0).alias("line"), F.lit("a,b").alias("value"))
    lines = back(spark, head.unionByName(f.select("run", (F.col("frame") + 1).alias("line"), row.alias("value"))), "drift")
    out = scans.drifting_table(lines, ["a", "b"], ["extra"])
    return out.select(run_of().alias("run"), "line", *[F.col(c).cast("double").alias(c) for c in ("a", "b", "extra")])


@query("S29_stacked_blocks", "run:i frame:i x:i y:i u:6 v:6 p:6", sql("uv", "SELECT run, frame, x, y, u, w AS v, u * w AS p FROM uv"))
def s29(spark, sf):
    f = velocity(spark, sf).withColumn("p", F.zip_with("u", "w", lambda a, b: a * b))
    head = f.select("run").distinct().select("run", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("line"), F.lit("% header").alias("value"))
    rows = []
    for b, col in enumerate(("u", "w", "p")):
        for y in range(8):
            nums = [F.get(col, F.lit(x * 8 + y)).cast("string") for x in range(8)]
            rows.append(F.struct((5 + F.col("frame") * 24 + 8 * b + y).alias("line"), F.concat(F.concat_ws(" ", *nums), F.lit(" ;")).alias("value")))
    d = head.unionByName(f.select("run", F.inline(F.array(*rows))))
    return scans.stacked_blocks(back(spark, d, "blocks"), 8).withColumn("run", run_of()).withColumnRenamed("snapshot", "frame")


# --- sinks ------------------------------------------------------------------------------


@query(
    "K01_wide_map_lines",
    "run:i cell:i frames:i first:8 last:8",
    sql("cells", "SELECT run, cell, count(*) AS frames, arg_min(v, frame) AS first, arg_max(v, frame) AS last FROM cells GROUP BY run, cell"),
)
def k01(spark, sf):
    d = sinks.map_lines(cells(spark, sf).select("run", "frame", "cell", "v"))
    parts = F.split("value", ",")
    return d.select("run", "cell", F.size(parts).alias("frames"), parts[0].alias("first"), F.element_at(parts, -1).alias("last"))


@query(
    "K02_padded_matrix",
    "run:i line:i frame:i present:b p:6",
    sql(
        "fr grid",
        "SELECT run, cell AS line, frame, cell < 20 + frame AS present, CASE WHEN cell < 20 + frame THEN v[cell + 1] END AS p FROM fr, grid WHERE cell < 64",
    ),
)
def k02(spark, sf):
    """Snapshot ``frame`` of a run has 20 + frame samples; one padded matrix per run."""
    d = frames(spark, sf).select("run", "frame", F.posexplode(F.slice("v", F.lit(1), F.least(F.lit(64), 20 + F.col("frame")))).alias("pos", "p"))
    lines = sinks.padded_matrix(d, ["run"], "frame", 64)
    m = lines.select("run", F.col("pos").alias("line"), F.posexplode(scans.doubles(F.col("value"))).alias("frame", "p"))
    return m.withColumn("present", F.col("p").isNotNull())


@query("K03_track_csv", "track_id:i frame:i time:4 event_id:i core_x:6 visible:i", sql("trk", "SELECT track_id, frame, frame * 0.02 AS time, event_id, core_x, visible::INT AS visible FROM trk"))
def k03(spark, sf):
    path = scratch(spark, "out")
    sinks.write_tracks(tracks(spark, sf).select("track_id", "frame", "event_id", "core_x", "visible"), path, 0.02)
    return scans.strings(spark, path)


@query("K04_split_output", "sensor_id:i track_id:i frame:i event_id:i", sql("trk", "SELECT sensor_id, track_id, frame, event_id FROM trk"))
def k04(spark, sf):
    path = scratch(spark, "split")
    sinks.write_split(tracks(spark, sf).select("track_id", "frame", "event_id", "sensor_id"), path, "sensor_id")
    return scans.strings(spark, path)


@query("K05_append_rows", "run:i n:i total:6", sql("fr", "SELECT run, 50 AS n, sum(list_sum(v)) AS total FROM fr GROUP BY run UNION ALL SELECT run, 50, 2 * sum(list_sum(v)) FROM fr GROUP BY run"))
def k05(spark, sf):
    path = scratch(spark, "append")
    total = F.aggregate("v", F.lit(0.0), lambda s, v: s + v)
    d = frames(spark, sf).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("total"))
    sinks.append_rows(d, path)
    sinks.append_rows(d.withColumn("total", 2 * F.col("total")), path)
    return spark.read.parquet(path)


@query("K06_append_new", "run:i frame:i batch:i", sql("fr", "SELECT run, frame, CASE WHEN label < 5 THEN 1 ELSE 2 END AS batch FROM fr"))
def k06(spark, sf):
    path = scratch(spark, "incremental")
    d = frames(spark, sf).select("run", "frame", "label")
    sinks.append_new(spark, d.filter("label < 5").withColumn("batch", F.lit(1)), path, ["run", "frame"])
    sinks.append_new(spark, d.withColumn("batch", F.lit(2)), path, ["run", "frame"])
    return spark.read.parquet(path)


@query("K07_write_once", "run:i frame:i version:i", sql("fr", "SELECT run, frame, 1 AS version FROM fr UNION ALL SELECT run, frame, 3 FROM fr"))
def k07(spark, sf):
    kept, forced = scratch(spark, "kept"), scratch(spark, "forced")
    d = frames(spark, sf).select("run", "frame")
    for version in (1, 2):
        sinks.write_once(d.withColumn("version", F.lit(version)), kept)
    for version in (1, 3):
        sinks.write_once(d.withColumn("version", F.lit(version)), forced, force=True)
    return spark.read.parquet(kept).unionByName(spark.read.parquet(forced))


@query(
    "K08_decimal_comma",
    "l_orderkey:i l_linenumber:i l_partkey:i price:s",
    sql("", "SELECT l_orderkey, l_linenumber, l_partkey, replace(printf('%.2f', l_extendedprice), '.', ',') AS price FROM lineitem"),
)
def k08(spark, sf):
    d = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"))
    return sinks.decimal_comma(d, 2)


@query(
    "K09_union_columns",
    "event_id:i run:i core_x:6 ratio:6",
    sql("trk", "SELECT event_id, run, core_x, NULL::DOUBLE AS ratio FROM trk WHERE visible UNION ALL SELECT event_id, run, NULL, radius FROM trk WHERE NOT visible"),
)
def k09(spark, sf):
    t = tracks(spark, sf)
    return sinks.union_columns(t.filter("visible").select("event_id", "run", "core_x"), t.filter(~F.col("visible")).select("event_id", "run", F.col("radius").alias("ratio")))


@query("K10_label_lines", "run:i line:i fields:i cls:s", sql("fr", "SELECT run, frame AS line, 17 AS fields, '0' AS cls FROM fr"))
def k10(spark, sf):
    d = label_file(spark, sf)
    parts = F.split("value", " ")
    return d.select(run_of().alias("run"), "line", F.size(parts).alias("fields"), parts[0].alias("cls"))


@query("K11_basis_tables", "model:s k:i size:i squares:4", sql("smp", "SELECT CASE WHEN label % 2 = 0 THEN 'fish' ELSE 'cylinder' END AS model, 64 AS k, 64 AS size, 64 AS squares FROM smp GROUP BY 1"))
def k11(spark, sf):
    path = scratch(spark, "basis")
    m = modal.pressure_modes(frames_models(spark, sf), ["model"], "v", 1.0).select("model", "mode", "value", "vector", "k")
    sinks.write_basis(m.select("model", "mode", "vector"), m.select("model", "mode", "value", "k"), path)
    modes, spec = spark.read.parquet(path + "/modes"), spark.read.parquet(path + "/spectrum")
    sq = F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)
    return modes.join(spec, ["model", "mode"]).groupBy("model").agg(F.max("k").alias("k"), F.count(F.lit(1)).alias("size"), F.sum(sq).alias("squares"))


def frames_models(spark, sf):
    return frames(spark, sf).select(F.when(F.col("label") % 2 == 0, "fish").otherwise("cylinder").alias("model"), "v")


# --- sets and text ------------------------------------------------------------------------


@query("E01_union_rows", "snapshot:i model:s length:i", sql("seg", "SELECT snapshot, model, length FROM seg"))
def e01(spark, sf):
    d = segments(spark, sf).select("snapshot", "model", "length")
    return d.filter("model = 'fish'").unionByName(d.filter("model <> 'fish'"))


@query("E02_difference", "o_orderkey:i", sql("", "SELECT o_orderkey FROM orders EXCEPT ALL SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'A')"))
def e02(spark, sf):
    done = table(spark, sf, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    return table(spark, sf, "orders").select("o_orderkey").exceptAll(done)


@query("E03_work_list_flags", "run:i frame:i flag:b", sql("fr", "SELECT run, frame, flag FROM fr, (VALUES (true), (false)) f(flag)"))
def e03(spark, sf):
    return frames(spark, sf).select("run", "frame", F.explode(F.array(F.lit(True), F.lit(False))).alias("flag"))


@query(
    "E04_common_frames",
    "frame:i n:i",
    sql("fr", "SELECT a.frame, count(*) AS n FROM fr a JOIN fr b ON a.frame = b.frame AND a.label = 1 AND b.label = 2 GROUP BY a.frame"),
)
def e04(spark, sf):
    f = frames(spark, sf).groupBy("frame").agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 2).alias("b"))
    return f.filter("a > 0 AND b > 0").select("frame", (F.col("a") * F.col("b")).alias("n"))


@query("E05_distinct_tracks", "run:i track_id:i", sql("trk", "SELECT DISTINCT run, track_id FROM trk WHERE core_q > 1"))
def e05(spark, sf):
    return tracks(spark, sf).filter("core_q > 1").select("run", "track_id").distinct()


RANGES = "SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY v) - 1 AS k, v FROM (SELECT DISTINCT event_id, unnest(list_concat([user_id], range(least(m, k), greatest(m, k) + 1))) AS v FROM (SELECT event_id, user_id, minute(ts) AS m, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"


def range_specs(spark, sf):
    spec = F.concat(F.col("user_id").cast("string"), F.lit(", "), F.minute("ts").cast("string"), F.lit("-"), F.get_json_object("props", "$.k"))
    return table(spark, sf, "events").select("event_id", spec.alias("spec"))


@query("F01_range_list", "event_id:i k:i v:i", sql("", RANGES))
def f01(spark, sf):
    return range_specs(spark, sf).select("event_id", F.posexplode(text.range_list(F.col("spec"))).alias("k", "v"))


@query("F01_range_table", "event_id:i k:i v:i", sql("", RANGES))
def f01_table(spark, sf):
    """The same through a table function, once for each row of a table."""
    spark.udtf.register("range_values", text.RangeValues)
    return spark.sql("SELECT event_id, r.k, r.v FROM {specs} s, LATERAL range_values(s.spec) r", specs=range_specs(spark, sf))


@query("F02_sensor_list", "event_id:i k:i x:4 y:4", sql("", "SELECT event_id, k, CASE k WHEN 0 THEN value ELSE user_id END AS x, CASE k WHEN 0 THEN user_id ELSE value END AS y FROM events, range(2) r(k)"))
def f02(spark, sf):
    spec = F.concat(F.col("value").cast("string"), F.lit(","), F.col("user_id").cast("string"), F.lit("; "), F.col("user_id").cast("string"), F.lit(", "), F.col("value").cast("string"), F.lit(";"))
    return table(spark, sf, "events").select("event_id", F.posexplode(text.sensor_list(spec)).alias("k", "p")).select("event_id", "k", "p.*")


@query("F05_lenient_numbers", "event_id:i whole:i real:4", sql("", "SELECT event_id, CASE WHEN event_type = 'error' THEN -1 ELSE trunc(value) END AS whole, CASE WHEN event_type = 'error' THEN 0.5 ELSE value END AS real FROM events"))
def f05(spark, sf):
    raw = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", text.parse_int(raw).alias("whole"), text.parse_float(raw, 0.5).alias("real"))


@query("F08_path_parts", "page_id:i leaf:s parent:s", sql("", "SELECT page_id, string_split(url, '/')[-1] AS leaf, CASE WHEN len(string_split(url, '/')) >= 5 THEN string_split(url, '/')[-5] ELSE 'unknown' END AS parent FROM pages"))
def f08(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", text.path_part(u, 1).alias("leaf"), text.path_part(u, 5).alias("parent"))


@query("F21_json_points", "event_id:i vertex:i x:4 y:4", sql("", "SELECT event_id, k AS vertex, value + k AS x, user_id AS y FROM events, range(3) r(k)"))
def f21(spark, sf):
    v, u = F.col("value").cast("string"), F.col("user_id").cast("string")
    pts = [F.concat(F.lit("["), (F.col("value") + k).cast("string"), F.lit(","), u, F.lit("]")) for k in range(3)]
    doc = F.concat(F.lit('{"shapes": [{"label": "fish", "points": ['), F.concat_ws(",", *pts), F.lit("]}]}"))
    d = table(spark, sf, "events").select("event_id", F.posexplode(text.json_points(doc)[0]["points"]).alias("vertex", "p"))
    return d.select("event_id", "vertex", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


@query("F22_lookup", "n_nationkey:i root:s", sql("", "SELECT n_nationkey, CASE r_name WHEN 'ASIA' THEN 'rig' WHEN 'EUROPE' THEN 'tank' ELSE 'full' END AS root FROM nation JOIN region ON r_regionkey = n_regionkey"))
def f22(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", text.lookup(F.col("r_name"), {"ASIA": "rig", "EUROPE": "tank"}, "full").alias("root"))


@query("F24_sequence_names", "event_id:i name:s", sql("", "SELECT event_id, 'frame-' || CASE WHEN event_id < 10000 THEN lpad(event_id::VARCHAR, 4, '0') ELSE event_id::VARCHAR END || '.txt' AS name FROM events"))
def f24(spark, sf):
    return table(spark, sf, "events").select("event_id", text.sequence_name("frame-", F.col("event_id"), ".txt").alias("name"))

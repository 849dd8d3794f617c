"""Streaming queries: a table is replayed as a stream, its sink is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from wakeframe.operators.learn import candidate_grid, grid_index
from wakeframe.plans.learn import GRID_SIZE, fitted, sweep_bounds
from wakeframe.plans.registry import query
from wakeframe.plans.similarity import sweep
from wakeframe.plans.tracks import LINK, LINKED
from wakeframe.plans.views import frames, micros, sql, table
from wakeframe.plans.vortices import raw_regions
from wakeframe.session import scratch, written
from wakeframe.sources import sinks
from wakeframe.streaming import live

def finish(df, name):
    spark = df.sparkSession
    with live.state_in_rocksdb(spark):
        return live.run_to_table(df, scratch(spark, name), scratch(spark, name + "-state"))

def replay(spark, df, name, files_per_trigger=None):
    """Write ``df`` to files and stream them back."""
    path = scratch(spark, name)
    df.write.mode("overwrite").parquet(path)
    reader = spark.readStream.schema(df.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)

def feed(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("channel"), F.col("event_id").alias("id"), (micros("ts") / 1e6).alias("t"), F.col("value").alias("p"))

def array_lines(spark, sf):
    """One CSV line per frame: time, 64 channels; frames with a low first value are cut short."""
    nums = F.transform("v", lambda v: v.cast("string"))
    short = F.slice(nums, 1, 40)
    row = F.concat_ws(",", (F.col("run") * 50 + F.col("frame")).cast("string"), F.when(F.col("v")[0] < -0.1, short).otherwise(nums))
    return frames(spark, sf).select("run", F.col("frame").alias("line"), row.alias("value"))

TAIL = "SELECT run * 50 + frame AS timestamp, cell AS k, v[cell + 1] AS p FROM fr, grid WHERE v[1] >= -0.1"

# Files of a recording that are aimed at, and runs in a file at most.
RECORDED_FILES, FILE_RUNS = 256, 64

def recorded(spark, sf):
    """The lines in text files of whole runs: a file holds the more of them the longer the recording is, up to a bound."""
    path, lines = scratch(spark, "live"), array_lines(spark, sf)
    last = lines.agg(F.max("run")).first()[0] or 0
    runs = min(FILE_RUNS, last // RECORDED_FILES + 1)
    sinks.write_lines(lines.withColumn("part", F.floor(F.col("run") / runs)), path, ["part"], ["run", "line"])
    return path

@query("T01_tail_csv", "timestamp:i k:i p:6", sql("fr grid", TAIL))
def t01(spark, sf):
    return finish(live.tail_csv(spark, recorded(spark, sf), 64), "t01").select("timestamp", F.posexplode("pressures").alias("k", "p"))

@query("T02_replay_chunks", "timestamp:i k:i p:6", sql("fr grid", TAIL))
def t02(spark, sf):
    return finish(live.replay_csv(spark, recorded(spark, sf) + "/part=*", 64, 4), "t02").select("timestamp", F.posexplode("pressures").alias("k", "p"))

BASE = """bse AS (SELECT channel, n, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY channel)) / 1e6 AS elapsed, p,
  avg(p) OVER (PARTITION BY channel ORDER BY n ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS baseline FROM
  (SELECT event_type AS channel, ts, value AS p, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n FROM events))"""

def emitted(spark, sf, name, every):
    """The feed in four batches, in order of time; the state carries over."""
    path, folder = scratch(spark, name + "-in"), scratch(spark, name)
    quarter = 31 * 86400 / 4
    for k in range(4):
        low, high = F.lit(k * quarter) if k else F.lit(float("-inf")), F.lit((k + 1) * quarter) if k < 3 else F.lit(float("inf"))
        feed(spark, sf).filter((F.col("t") >= low) & (F.col("t") < high)).write.mode("append").parquet(f"{path}/part={k}")
    for k in range(4):
        stream = spark.readStream.schema(feed(spark, sf).schema).parquet(f"{path}/part=[0-{k}]")
        live.emit_every(stream, every, folder, folder + "-state").awaitTermination()
    return live.emitted(spark, folder)

@query("T03_count_emission", "channel:s n:i elapsed:3 p:4", sql("", "SELECT * FROM bse WHERE n % 50 = 49", BASE))
def t03(spark, sf):
    return emitted(spark, sf, "t03", 50)

@query("T04_trailing_baseline", "channel:s n:i baseline:5 corrected:5", sql("", "SELECT *, (p - baseline) / 4 AS corrected FROM bse", BASE))
def t04(spark, sf):
    return emitted(spark, sf, "t04", 1)

@query("T05_serial_records", "t:i k:i p:6", sql("fr", "SELECT run * 50 + frame AS t, k, v[k + 1] AS p FROM fr, range(64) r(k) WHERE v[1] >= -0.1"))
def t05(spark, sf):
    nums = F.transform("v", lambda v: v.cast("string"))
    bad = F.concat_ws(" ", F.slice(nums, 1, 5), F.lit("x"))
    good = F.concat_ws(" ", nums, (F.col("run") * 50 + F.col("frame")).cast("string"))
    d = frames(spark, sf).select(F.when(F.col("v")[0] < -0.1, bad).otherwise(good).alias("value"))
    out = finish(live.serial_records(replay(spark, d, "t05-in"), fields=65), "t05")
    return out.select("t", F.posexplode("sensors").alias("k", "p"))

@query(
    "T06_bounded_capture",
    "channel:s id:i t:3 p:4",
    sql("", "SELECT channel, id, t, p FROM (SELECT event_type AS channel, event_id AS id, (epoch_us(ts) - 1704067200000000) / 1e6 AS t, value AS p FROM events) QUALIFY t < min(t) OVER (PARTITION BY channel) + 50000"),
)
def t06(spark, sf):
    return finish(live.bounded_capture(replay(spark, feed(spark, sf), "t06-in"), live.capture_duration(1.0)), "t06")

@query(
    "T07_force_feed",
    "vec_id:i f0:6 f3:6 p17:4",
    sql(
        "",
        """SELECT vec_id, (-0.00325 * e[1] + 0.00015 * e[2] + 0.09822 * e[3] - 1.82505 * e[4] - 0.09847 * e[5] + 1.94002 * e[6]) * 4.44822162 AS f0,
        -0.07841 * e[1] + 1.03241 * e[2] - 3.81689 * e[3] - 0.40255 * e[4] + 3.85454 * e[5] - 0.69811 * e[6] AS f3, e[18] * 6894.76 / 5 AS p17
        FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""",
    ),
)
def t07(spark, sf):
    d = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    out = finish(live.force_feed(replay(spark, d, "t07-in"), "v"), "t07")
    return out.select("vec_id", F.col("force")[0].alias("f0"), F.col("force")[3].alias("f3"), F.col("pressure")[0].alias("p17"))

def stamped(spark, sf, kind):
    e = table(spark, sf, "events").filter(F.col("event_type") == kind)
    return e.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")

@query(
    "T08_paired_feeds",
    "user_id:i event_id:i other_event_id:i value:3 other_value:3",
    sql(
        "",
        """SELECT a.user_id, a.event_id, b.event_id AS other_event_id, a.value, b.value AS other_value FROM events a JOIN events b ON a.user_id = b.user_id
        AND a.event_type = 'view' AND b.event_type = 'click' AND time_bucket(INTERVAL '1 day', a.ts) = time_bucket(INTERVAL '1 day', b.ts)""",
    ),
)
def t08(spark, sf):
    a, b = replay(spark, stamped(spark, sf, "view"), "t08-a"), replay(spark, stamped(spark, sf, "click"), "t08-b")
    return finish(live.paired_feeds(a, b, "user_id", "ts", "1 day", "2 hours"), "t08")

def loop(spark, sf, threshold):
    """All runs arrive in four parts, each run spread over several of them; the folder of what the loop wrote."""
    runs = sweep(spark, sf).select("re", "h", "sensor", "p", "t")
    folder, path, size = scratch(spark, "t09"), scratch(spark, "t09-in"), GRID_SIZE
    # The part is told by the measured values alone, so each part is written, without a sort, from its own quarter.
    part = F.pmod(F.xxhash64("re", "sensor", "p", "t"), F.lit(4))
    for k in range(4):
        runs.filter(part == k).write.parquet(f"{path}/part={k}")
    limits = written(sweep_bounds(spark.read.schema(runs.schema).parquet(path)), "bounds")
    index = lambda done: grid_index(done, limits, *size)
    candidates, state = written(candidate_grid(limits, *size), "grid"), scratch(spark, "t09-state")
    for k in range(4):
        stream = spark.readStream.schema(runs.schema).parquet(f"{path}/part=[0-{k}]")
        live.closed_loop(stream, candidates, index, folder, fitted, threshold, state).awaitTermination()
    return folder

@query("T09_closed_loop", "batch:i idx:i a:4 b:4 mean_f_re:3 mean_f_h:3 std:4 runs:i")
def t09(spark, sf):
    folder = loop(spark, sf, 1e-9)
    done = live.latest_metrics(spark, folder).agg(F.count(F.lit(1)).alias("runs"))
    return spark.read.parquet(folder + "/next").join(F.broadcast(done))

@query("T09_stopped_loop", "batches:i last:i", sql("", "SELECT 1 AS batches, 0 AS last FROM (SELECT count(*) FROM lineitem)"))
def t09_stopped(spark, sf):
    """With a threshold that no deviation reaches the loop is over after its first batch."""
    folder = loop(spark, sf, 1.5)
    return spark.read.parquet(folder + "/next").agg(F.count_distinct("batch").alias("batches"), F.max("batch").alias("last"))

@query(
    "T09_coverage",
    "batches:i runs:i bad:i",
    sql("", "SELECT 4 AS batches, count(*) AS runs, 0 AS bad FROM (SELECT DISTINCT l_linenumber, p_size FROM lineitem JOIN part ON l_partkey = p_partkey)"),
)
def t09_coverage(spark, sf):
    """One choice for each batch, metrics for every run, deviations within bounds."""
    d = t09(spark, sf)
    return d.agg(F.count_distinct("batch").alias("batches"), F.max("runs").alias("runs"), F.count_if(~F.col("std").between(0, 1)).alias("bad"))

@query("T10_stateful_tracking", "run:i frame:i region:i core_x:4 core_y:4 track_id:i", sql("cells", LINKED, *LINK))
def t10(spark, sf):
    d = raw_regions(spark, sf).filter("area >= 2").select("run", "frame", "region", "core_x", "core_y")
    return finish(live.track_stream(replay(spark, d.withColumn("ts", live.frame_time(F.col("frame"))), "t10-in"), 2.0, 3), "t10")

def event_feed(spark, sf, name):
    e = table(spark, sf, "events")
    d = e.select(F.col("event_type").alias("channel"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("p"))
    return replay(spark, d, name)

def closed(length, slide):
    return f"""SELECT channel, epoch(s) AS start_s, avg(p) AS mean, count(*) AS n FROM (SELECT event_type AS channel, value AS p,
      unnest(list_transform(range({length // slide}), lambda k: time_bucket(INTERVAL '{slide} hours', ts, TIMESTAMP '2024-01-01') - to_hours(k * {slide}))) AS s FROM events)
      WHERE s + INTERVAL '{length} hours' <= (SELECT max(ts) FROM events) - INTERVAL '2 hours' GROUP BY 1, 2"""

@query("T11_tumbling_means", "channel:s start_s:i mean:5 n:i", sql("", closed(12, 12)))
def t11(spark, sf):
    d = live.window_means(event_feed(spark, sf, "t11-in"), "channel", "ts", "p", "12 hours", None, "2 hours")
    return finish(d, "t11").withColumn("start_s", F.unix_timestamp("start"))

@query("T11_sliding_means", "channel:s start_s:i mean:5 n:i", sql("", closed(12, 4)))
def t11s(spark, sf):
    d = live.window_means(event_feed(spark, sf, "t11s-in"), "channel", "ts", "p", "12 hours", "4 hours", "2 hours")
    return finish(d, "t11s").withColumn("start_s", F.unix_timestamp("start"))

"""Structured Streaming forms of the live paths.

Feeds arrive as files (or any source with the same columns). Count-based operators
keep a few numbers per feed in state; a feed is one instrument with a fixed rate,
and different feeds run in parallel.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wakeframe.functions.text import lenient_double
from wakeframe.operators.learn import next_parameters
from wakeframe.operators.ordering import index_rows, windowed
from wakeframe.operators.processes import Process
from wakeframe.operators.series import force_and_pressure
from wakeframe.operators.similarity import peak_to_peak, time_of_minimum
from wakeframe.operators.tracks import Linker
from wakeframe.session import qualified, written
from wakeframe.sources.growing import GrowingLines

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_in_rocksdb(spark: SparkSession):
    """The arbitrary-state operators need this provider; the session's own is put back after."""
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def run_to_table(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is available into a parquet table and return the table."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


# --- feeds ----------------------------------------------------------------------------------


def tail_rows(lines: DataFrame, channels: int = 96, sep: str = ",") -> DataFrame:
    """(timestamp, pressures) of complete rows: a time and every channel must be numbers."""
    parts = F.transform(F.split("value", sep), lambda s: lenient_double(s))
    d = lines.withColumn("_p", parts).filter((F.size("_p") >= channels + 1) & F.forall(F.slice("_p", 1, channels + 1), lambda v: v.isNotNull()))
    return d.select(F.get("_p", F.lit(0)).alias("timestamp"), F.slice("_p", 2, channels).alias("pressures"))


def tail_csv(spark: SparkSession, path: str, channels: int = 96) -> DataFrame:
    """Stream of complete CSV rows of the files under ``path``, also of rows that are appended later."""
    spark.dataSource.register(GrowingLines)
    return tail_rows(spark.readStream.format("growing_lines").option("path", qualified(spark, path)).load(), channels)


def replay_csv(spark: SparkSession, path: str, channels: int, files_per_trigger: int) -> DataFrame:
    """A recording as a stream, some files at a time."""
    return tail_rows(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path), channels)


def serial_records(lines: DataFrame, fields: int = 9) -> DataFrame:
    """Exactly ``fields`` numbers a line: the sensors, then the time; other lines are dropped."""
    parts = F.transform(F.split(F.trim("value"), r"\s+"), lambda s: lenient_double(s))
    d = lines.withColumn("_p", parts).filter((F.size("_p") == fields) & F.forall("_p", lambda v: v.isNotNull()))
    return d.select(F.slice("_p", 1, fields - 1).alias("sensors"), F.element_at("_p", fields).alias("t"))


def force_feed(df: DataFrame, col: str) -> DataFrame:
    """Calibrated force and pressure beside the reading's own time."""
    return force_and_pressure(df, col).drop(col)


# --- count-based state ------------------------------------------------------------------------


def emit_every(df: DataFrame, every: int, folder: str, checkpoint: str, rows: int = 20, divisor: float = 4.0, block: Column | None = None):
    """Feed (channel, id, t, p) -> one row out of ``every`` with its trailing-mean baseline, as a running query.

    Rows of one micro-batch are put in time order; batches must arrive in order. A batch is numbered and
    averaged block by block (``block`` grows with t; by default an hour), so no channel is one task's. A channel's
    state (rows seen, first time, last values) is one row of the batch's state table; batch k reads that of
    batch k - 1 and replaces its own files when it is repeated. Results are under ``folder``/rows.
    """
    spark = df.sparkSession
    hour = F.floor(F.col("t") / 3600) if block is None else block
    state_of = lambda k: f"{folder}/state/batch={k}"

    def step(batch: DataFrame, batch_id: int) -> None:
        now = written(index_rows(batch.select("channel", "id", "t", "p"), ["channel"], ["t", "id"], hour, "_k"), "feed")
        kind = "channel string, seen bigint, t0 double, last array<double>"
        old = spark.read.schema(kind).parquet(state_of(batch_id - 1)) if batch_id else spark.createDataFrame([], kind)
        starts = now.groupBy("channel").agg(F.min("t").alias("_first"), F.count(F.lit(1)).alias("_new")).join(old, "channel", "full")
        starts = written(starts.select("channel", F.coalesce("seen", F.lit(0)).alias("seen"), F.coalesce("t0", "_first").alias("t0"), F.coalesce("_new", F.lit(0)).alias("_new"), F.coalesce("last", F.array().cast("array<double>")).alias("last")), "starts")
        fresh = now.join(starts.select("channel", "seen", "t0"), "channel").select("channel", (F.col("seen") + F.col("_k")).alias("n"), "t", "t0", "p")
        held = starts.select("channel", "seen", "t0", F.size("last").alias("_size"), F.posexplode("last").alias("_i", "p"))
        held = held.select("channel", (F.col("seen") - F.col("_size") + F.col("_i")).alias("n"), F.lit(None).cast("double").alias("t"), "t0", "p")
        both = windowed(fresh.unionByName(held), ["channel"], "n", rows - 1, 0, lambda w: {"baseline": F.avg("p").over(w.rowsBetween(1 - rows, 0))})
        out = both.filter(F.col("t").isNotNull() & (F.col("n") % every == every - 1)).select(
            "channel", "n", (F.col("t") - F.col("t0")).alias("elapsed"), "p", "baseline", ((F.col("p") - F.col("baseline")) / divisor).alias("corrected")
        )
        out.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")
        # The last values of a channel: at most rows - 1 of them.
        late = fresh.unionByName(held).join(starts.select("channel", (F.col("seen") + F.col("_new")).alias("_total")), "channel").filter(F.col("n") > F.col("_total") - rows)
        last = late.groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("n", "p"))).alias("_l"))
        kept = starts.join(last, "channel", "left").select(
            "channel", (F.col("seen") + F.col("_new")).alias("seen"), "t0", F.transform("_l", lambda r: r["p"]).alias("last")
        )
        kept.write.mode("overwrite").parquet(state_of(batch_id))

    return df.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def emitted(spark: SparkSession, folder: str) -> DataFrame:
    """What :func:`emit_every` has put out."""
    kind = "channel string, n bigint, elapsed double, p double, baseline double, corrected double, batch bigint"
    return spark.read.schema(kind).parquet(f"{folder}/rows").drop("batch")


class _Capture(StatefulProcessor):
    def __init__(self, duration: float):
        self.duration = duration

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.start = handle.getValueState("start", "t0 double")

    def handleInputRows(self, key, rows, timerValues):
        """Only rows that may still lie in the capture are held while the first time is looked for."""
        if self.start.exists():
            end = self.start.get()[0] + self.duration
            for pdf in rows:
                yield pdf.loc[pdf["t"] < end, ["channel", "id", "t", "p"]]
            return
        first, held = math.inf, []
        for pdf in rows:
            low = float(pdf["t"].min())
            if low < first:
                first = low
                held = [h[h["t"] < first + self.duration] for h in held]
            held.append(pdf.loc[pdf["t"] < first + self.duration, ["channel", "id", "t", "p"]])
        self.start.update((first,))
        yield from (h for h in held if len(h))

    def close(self) -> None:
        pass


def bounded_capture(df: DataFrame, duration: float) -> DataFrame:
    """Rows of each feed within ``duration`` of its first one."""
    return df.groupBy("channel").transformWithStateInPandas(
        statefulProcessor=_Capture(duration), outputStructType="channel string, id bigint, t double, p double", outputMode="Append", timeMode="None"
    )


def capture_duration(re: float) -> float:
    return 0.05 * 1e6 / re


class _Tracker(StatefulProcessor):
    """Detections wait in state, a frame an entry, until the watermark has passed them; then frames are linked in order."""

    def __init__(self, max_distance: float, max_gap: int, period: int):
        self.max_distance, self.max_gap, self.period = max_distance, max_gap, period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms bigint", "frame int, regions array<int>, xs array<double>, ys array<double>")
        self.live = handle.getValueState("live", "ids array<bigint>, frames array<bigint>, xs array<double>, ys array<double>, ms bigint")
        self.told = handle.getValueState("told", "fresh bigint, done bigint")

    def handleInputRows(self, key, rows, timerValues):
        done, last = (self.told.get()[1] if self.told.exists() else -1), -1
        for pdf in rows:
            pdf = pdf[pdf["ms"] > done]
            for ms, part in pdf.groupby("ms"):
                new = [part["region"].tolist(), part["core_x"].tolist(), part["core_y"].tolist()]
                if self.waiting.containsKey((int(ms),)):
                    _, *old = self.waiting.getValue((int(ms),))
                    new = [list(a) + b for a, b in zip(old, new)]
                self.waiting.updateValue((int(ms),), (int(part["frame"].iloc[0]), *new))
                last = max(last, int(ms))
        if last >= 0:
            self.handle.registerTimer(last)
        yield from self._due(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._due(key, timerValues.getCurrentWatermarkInMs())

    def _due(self, key, now: int):
        """Link the frames that no more detections can come for; forget tracks that have been silent for too long."""
        times = sorted(k[0] for k in self.waiting.keys() if k[0] <= now)
        silence = (self.max_gap + 1) * self.period
        if times:
            fresh = self.told.get()[0] if self.told.exists() else 0
            state = (*self.live.get()[:4], fresh) if self.live.exists() else ([], [], [], [], fresh)
            linker = Linker(self.max_distance, self.max_gap, state)
            for ms in times:
                frame, regions, xs, ys = self.waiting.getValue((ms,))
                order = np.argsort(regions, kind="stable")
                xy = np.column_stack([xs, ys]).astype(float)[order]
                ids, _ = linker.step(int(frame), xy)
                self.waiting.removeKey((ms,))
                yield pd.DataFrame({"run": key[0], "frame": int(frame), "region": np.asarray(regions)[order], "core_x": xy[:, 0], "core_y": xy[:, 1], "track_id": ids})
            *heads, fresh = linker.state()
            self.live.update((*heads, times[-1]))
            self.told.update((fresh, times[-1]))
            self.handle.registerTimer(times[-1] + silence)
        if self.live.exists() and self.live.get()[4] + silence <= now:
            self.live.clear()

    def close(self) -> None:
        pass


def track_stream(df: DataFrame, max_distance: float, max_gap: int, ts: str = "ts", period: int = 1000, delay: str = "0 seconds") -> DataFrame:
    """Track ids for a stream of detections (run, frame, region, core_x, core_y) whose frames are ``period`` milliseconds apart.

    ``ts`` is a frame's time. A frame is linked when the watermark (the latest time less ``delay``) has reached it, so its
    detections may come in several batches and out of order; those that come later are dropped. A task holds one frame
    and the live tracks of a run. A run that has been silent for more than ``max_gap`` frames keeps nothing but its number
    of tracks.
    """
    rows = df.withWatermark(ts, delay).select("run", "frame", "region", "core_x", "core_y", ts, F.unix_millis(ts).alias("ms"))
    return rows.groupBy("run").transformWithStateInPandas(
        statefulProcessor=_Tracker(max_distance, max_gap, period),
        outputStructType="run int, frame int, region int, core_x double, core_y double, track_id bigint",
        outputMode="Append",
        timeMode="EventTime",
    )


def frame_time(frame: Column, period: int = 1000) -> Column:
    """The time of a frame of a recording that starts at the first one."""
    return F.timestamp_millis((frame + 1) * period)


# --- event time -------------------------------------------------------------------------------


def paired_feeds(a: DataFrame, b: DataFrame, key: str, ts: str, bucket: str, delay: str) -> DataFrame:
    """Rows of two feeds that fall in one time bucket of one key; late rows beyond ``delay`` are dropped.

    The times of a pair are less than a bucket apart, which is said as a condition too: rows leave the
    state when the watermark of the other feed has passed that range.
    """
    left = a.withWatermark(ts, delay).withColumn("bucket", F.window(ts, bucket)["start"])
    other = [F.col(c).alias("other_" + c) for c in b.columns if c not in (key, ts)]
    right = b.withWatermark(ts, delay).select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), *other, F.window(ts, bucket)["start"].alias("_bucket"))
    reach = F.expr(f"INTERVAL {bucket}")
    near = (F.col(ts) > F.col("_ts") - reach) & (F.col(ts) < F.col("_ts") + reach)
    return left.join(right, (F.col(key) == F.col("_key")) & (F.col("bucket") == F.col("_bucket")) & near).drop("_key", "_ts", "_bucket")


def window_means(df: DataFrame, key: str, ts: str, value: str, length: str, slide: str | None, delay: str) -> DataFrame:
    """Mean and count per key and event-time window, emitted once the watermark has passed its end."""
    win = F.window(ts, length, slide) if slide else F.window(ts, length)
    g = df.withWatermark(ts, delay).groupBy(F.col(key), win.alias("w")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean", "n")


# --- closed loop --------------------------------------------------------------------------------


def _extremes(batch: DataFrame) -> DataFrame:
    """The rows of a batch that the metrics of a run can need: first minimum and maximum of each sensor, and its first gap.

    The smallest and largest values come first, then the times of the rows that have them: both are plain hash
    aggregates, while the minimum of (value, time) pairs would sort a task's rows.
    """
    keys = ["re", "h", "sensor"]
    first = lambda rows: F.when(F.count_if(rows & F.col("t").isNull()) == 0, F.min(F.when(rows, F.col("t"))))
    gap, low, high = F.col("p").isNull(), F.col("p") == F.col("_low"), F.col("p") == F.col("_high")
    ends = batch.groupBy(*keys).agg(F.min("p").alias("_low"), F.max("p").alias("_high"), F.count_if(gap).alias("_gaps"), first(gap).alias("_t"))
    ends = written(ends, "ends")
    own = ends.select(*[F.col(k).alias("_" + k) for k in keys], "_low", "_high")
    at = batch.join(own, [F.col(k).eqNullSafe(F.col("_" + k)) for k in keys]).filter(low | high)
    edges = at.groupBy(*keys, "_low", "_high").agg(first(low).alias("_first"), F.max(F.when(high, F.col("t"))).alias("_last"))
    pairs = F.array_distinct(F.array(F.struct(F.col("_low").alias("p"), F.col("_first").alias("t")), F.struct(F.col("_high").alias("p"), F.col("_last").alias("t"))))
    gaps = ends.filter("_gaps > 0").select(*keys, F.lit(None).cast(dict(batch.dtypes)["p"]).alias("p"), F.col("_t").alias("t"))
    return edges.select(*keys, F.inline(pairs)).unionByName(gaps)


def closed_loop(
    feed: DataFrame, candidates: DataFrame, index: Callable[[DataFrame], DataFrame], folder: str, fit: Callable[[DataFrame], Process], threshold: float, checkpoint: str
):
    """For every batch of new rows: metrics of the runs, refit, next parameters.

    Of a batch only each sensor's first minimum and maximum are kept, and the metrics of the runs (re, h) that it
    touches are made anew from those, so a run may arrive in parts and no batch reads earlier rows. ``fit`` makes a
    process of (a, b, f_re, f_h), ``index`` maps finished experiments (a, b) to the candidates they stand for. Once no
    candidate's deviation reaches ``threshold`` the loop is over: later batches change nothing, also after a restart.
    Each batch writes to its own folders: a repeated one replaces its first try.
    """
    spark = feed.sparkSession
    chosen = candidates.select("idx", "a", "b").schema.simpleString()[len("struct<") : -1].replace(":", " ")

    def step(batch: DataFrame, batch_id: int) -> None:
        earlier = spark.read.schema(f"{chosen}, highest double, batch bigint").parquet(f"{folder}/next") if batch_id else None
        if earlier is not None and not earlier.filter((F.col("batch") < batch_id) & (F.col("highest") < threshold)).isEmpty():
            return
        _extremes(batch).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch_id}")
        so_far = spark.read.schema("re {re}, h {h}, sensor {sensor}, p {p}, t {t}, batch bigint".format(**dict(batch.dtypes))).parquet(f"{folder}/rows")
        so_far = so_far.filter(F.col("batch") <= batch_id)
        touched = so_far.filter(F.col("batch") == batch_id).select("re", "h").distinct()
        whole = written(so_far.drop("batch").join(touched, ["re", "h"], "left_semi"), "touched")
        metrics = time_of_minimum(whole, ["re", "h"], "sensor", "t", "p").join(peak_to_peak(whole, ["re", "h"], "sensor", "p"), ["re", "h"])
        metrics.write.mode("overwrite").parquet(f"{folder}/metrics/batch={batch_id}")
        done = written(latest_metrics(spark, folder, batch_id).withColumnsRenamed({"re": "a", "h": "b"}), "done")
        scored = written(fit(done).predict(candidates), "scored")
        highest = scored.agg(F.max("std").alias("highest"))
        best = next_parameters(scored, index(done.select("a", "b").distinct()), "std").join(F.broadcast(highest))
        best.write.mode("overwrite").parquet(f"{folder}/next/batch={batch_id}")

    return feed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_metrics(spark: SparkSession, folder: str, upto: int | None = None) -> DataFrame:
    """The metrics of each run as of the last batch that touched it."""
    rows = spark.read.parquet(f"{folder}/metrics")
    rows = rows if upto is None else rows.filter(F.col("batch") <= upto)
    last = rows.groupBy("re", "h").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["re", "h", "batch"])

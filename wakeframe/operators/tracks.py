"""Vortex tracks: linking detections, activity windows, features, matching to windows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from wakeframe.operators.ordering import previous_row
from wakeframe.operators.vortices import sensor_array

# --- activity windows -------------------------------------------------------------------


def active_frames(df: DataFrame, keys: Sequence[str], require_visible: bool = False) -> DataFrame:
    """Distinct (keys, frame) that hold at least one (visible) detection."""
    d = df.filter("visible") if require_visible else df
    return d.select(*keys, "frame").distinct()


def islands(active: DataFrame, keys: Sequence[str], frame: str = "frame") -> DataFrame:
    """Runs of consecutive frames as (start_frame, end_frame, length), both ends included.

    One row per distinct frame of a run enters the window, so its size is bounded
    by the length of a recording whatever the number of detections.
    """
    w = W.partitionBy(*keys).orderBy(frame)
    tagged = active.withColumn("_island", F.col(frame) - F.row_number().over(w))
    return (
        tagged.groupBy(*keys, "_island")
        .agg(F.min(frame).alias("start_frame"), F.max(frame).alias("end_frame"), F.count(F.lit(1)).alias("length"))
        .drop("_island")
    )


def cut_series(probe: DataFrame, windows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples of a probe inside each window, numbered from the window's start."""
    j = probe.join(windows, list(keys)).filter(F.col("frame").between(F.col("start_frame"), F.col("end_frame")))
    return j.withColumn("pos", F.col("frame") - F.col("start_frame"))


def interval_join(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], t: str, start: str, end: str, bucket: float
) -> DataFrame:
    """Every (point, interval) with start <= t <= end, both inclusive.

    The interval side is copied to the buckets it covers and the join runs on
    (keys, bucket), so neither a wide key nor a long recording meets in one task;
    adaptive execution broadcasts the intervals when they turn out small.
    """
    first, last = F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket)
    spread = intervals.filter(F.col(end) >= F.col(start)).withColumn("_b", F.explode(F.sequence(first, last)))
    tagged = points.withColumn("_b", F.floor(F.col(t) / bucket))
    return tagged.join(spread, [*keys, "_b"]).filter(F.col(t).between(F.col(start), F.col(end))).drop("_b")


# --- linking detections -----------------------------------------------------------------


class Linker:
    """Live tracks of one run, fed frame by frame."""

    def __init__(self, max_distance: float, max_gap: int, state=None):
        self.max_distance, self.max_gap = max_distance, max_gap
        ids, frames, xs, ys, self.fresh = state or ([], [], [], [], 0)
        self.ids, self.frames = np.asarray(ids, np.int64), np.asarray(frames, np.int64)
        self.xy = np.column_stack([xs, ys]).astype(float).reshape(-1, 2)
        # Tracks with ids below ``unsure`` may be in another order; ``tied`` tells whether that made a difference.
        self.unsure, self.tied = 0, False

    def state(self):
        return (self.ids.tolist(), self.frames.tolist(), self.xy[:, 0].tolist(), self.xy[:, 1].tolist(), int(self.fresh))

    def step(self, frame: int, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Track ids and link distances (NaN for a new track) of one frame's detections.

        A frame may come in parts: a track that took a detection of it already offers for no other.
        """
        alive = frame - self.frames <= self.max_gap
        self.ids, self.frames, self.xy = self.ids[alive], self.frames[alive], self.xy[alive]
        ids, dist = np.full(len(xy), -1, np.int64), np.full(len(xy), np.nan)
        free = np.flatnonzero(self.frames < frame)
        if len(free) and len(xy):
            d = np.hypot(*(self.xy[free][:, None, :] - xy[None, :, :]).transpose(2, 0, 1))
            near = d.argmin(axis=1)
            best = d[np.arange(len(near)), near]
            old = np.flatnonzero((self.ids[free] < self.unsure) & (best < self.max_distance))
            if len(old) > 1 and not self.tied:
                offers = np.stack([near[old], best[old]])
                offers = offers[:, np.lexsort(offers)]
                self.tied = bool((offers[:, 1:] == offers[:, :-1]).all(axis=0).any())
            for k in np.lexsort((self.ids[free], best)):
                if best[k] < self.max_distance and ids[near[k]] < 0:
                    ids[near[k]], dist[near[k]] = self.ids[free[k]], best[k]
        new = ids < 0
        ids[new] = self.fresh + np.arange(new.sum())
        self.fresh += int(new.sum())
        rest = ~np.isin(self.ids, ids)
        self.ids = np.append(self.ids[rest], ids)
        self.frames = np.append(self.frames[rest], np.full(len(xy), frame))
        self.xy = np.vstack([self.xy[rest], xy])
        return ids, dist


def _link_in_order(pdf: pd.DataFrame, max_distance: float) -> pd.DataFrame:
    pdf = pdf.sort_values(["frame", "rank"], kind="stable").reset_index(drop=True)
    ids = np.empty(len(pdf), np.int64)
    xy = pdf[["x", "y"]].to_numpy(float)
    heads = np.empty((0, 2))
    for _, rows in pdf.groupby("frame", sort=True).indices.items():
        own = np.full(len(rows), -1)
        if len(heads):
            d = np.hypot(*(heads[:, None, :] - xy[rows][None, :, :]).transpose(2, 0, 1))
            near = d.argmin(axis=1)
            for k in range(len(heads)):
                if d[k, near[k]] < max_distance and own[near[k]] < 0:
                    own[near[k]] = k
        new = np.flatnonzero(own < 0)
        own[new] = len(heads) + np.arange(len(new))
        heads = np.vstack([heads, np.zeros((len(new), 2))])
        heads[own] = xy[rows]
        ids[rows] = own
    return pdf.assign(track_id=ids)[["run", "frame", "rank", "x", "y", "value", "track_id"]]


def assign_tracks_in_order(df: DataFrame, max_distance: float) -> DataFrame:
    """Linking where tracks pick in creation order and never expire.

    Input (run, frame, x, y, value): maxima before minima, each in cell order. The
    group is one run, that is one recording.
    """
    order = W.partitionBy("run", "frame").orderBy((F.col("value") < 0).cast("int"), "x", "y")
    ranked = df.select("run", "frame", "x", "y", "value").withColumn("rank", F.row_number().over(order))
    return ranked.groupBy("run").applyInPandas(
        lambda pdf: _link_in_order(pdf, max_distance),
        "run int, frame int, rank int, x int, y int, value double, track_id bigint",
    )


# --- selecting tracks -------------------------------------------------------------------


def near_sensors(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sensors, x_limit: float, birth_limit: float
) -> DataFrame:
    """Rows of tracks that, at some frame, are a sensor's closest within ``x_limit`` columns.

    Tracks born within ``birth_limit`` rows of any sensor are dropped first.
    """
    track = [*keys, "track_id"]
    born = df.groupBy(*track).agg(F.min_by("core_y", F.struct(*order)).alias("_y0"))
    clash = F.exists(sensor_array(sensors), lambda s: F.abs(F.col("_y0") - s["y"]) <= birth_limit)
    clean = df.join(born.filter(~clash).select(*track), track, "left_semi")
    pairs = clean.select(*keys, "frame", "track_id", "core_x", "core_y", F.explode(sensor_array(sensors)).alias("s"))
    pairs = pairs.filter(F.abs(F.col("core_x") - F.col("s.x")) <= x_limit)
    d = F.hypot(F.col("core_x") - F.col("s.x"), F.col("core_y") - F.col("s.y"))
    best = pairs.groupBy(*keys, "frame", "s.id").agg(F.min(F.struct(d.alias("d"), F.col("track_id").alias("track_id"))).alias("b"))
    chosen = best.select(*keys, F.col("b.track_id").alias("track_id")).distinct()
    return clean.join(chosen, track, "left_semi")


def rows_in_windows(df: DataFrame, windows: DataFrame, keys: Sequence[str], bucket: float) -> DataFrame:
    """Visible rows inside a window whose sensor is the window's, or unassigned (-1)."""
    w = windows.withColumnRenamed("sensor_id", "win_sensor")
    ok = df.filter(F.col("visible") & (F.col("track_id") >= 0))
    j = interval_join(ok, w, keys, "frame", "start_frame", "end_frame", bucket)
    return j.filter((F.col("sensor_id") < 0) | (F.col("sensor_id") == F.col("win_sensor")))


def persistence(df: DataFrame, keys: Sequence[str], window_length: Column, minimum: float) -> DataFrame:
    """Distinct frames of a track over the window length; keeps ratios of at least ``minimum``."""
    frames = df.select(*keys, "frame", window_length.alias("snapshot_length")).distinct()
    agg = frames.groupBy(*keys, "snapshot_length").agg(F.count(F.lit(1)).alias("duration"))
    return agg.withColumn("ratio", F.col("duration") / F.col("snapshot_length")).filter(F.col("ratio") >= minimum)


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key by ``order``, as a partial aggregate rather than a sorted window."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


# --- features ---------------------------------------------------------------------------

# Feature names and their order (fixed names: models are trained on them).
FEATURES = [
    "duration_frames", "duration_ratio", "displacement", "path_length", "mean_speed", "max_speed",
    "mean_core_q", "max_core_q", "mean_abs_core_q", "mean_radius", "max_radius", "mean_area", "max_area",
    "mean_body_distance", "mean_sensor_distance", "mean_core_x", "mean_core_y",
]


def safe(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def track_features(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, snapshot_length: Column
) -> DataFrame:
    """The 17 features of each track.

    ``order`` begins with the frame. Steps come from the previous row (block by block, so a very
    long track is not one task); everything else is one hash aggregate: the displacement is the sum
    of the steps, and a frame counts where it differs from the one before. A frame gap of 0 counts as 1.
    """
    d = previous_row(df, keys, order, block, ["frame", "core_x", "core_y"])
    dx, dy = F.col("core_x") - F.col("prev_core_x"), F.col("core_y") - F.col("prev_core_y")
    step = F.hypot(dx, dy)
    gap = F.col("frame") - F.col("prev_frame")
    d = d.withColumns({"_dx": dx, "_dy": dy, "_step": step, "_speed": step / F.when(gap <= 0, 1).otherwise(gap)})
    agg = d.groupBy(*keys).agg(
        F.count_if(~F.col("frame").eqNullSafe(F.col("prev_frame"))).alias("_frames"),
        F.max(snapshot_length).alias("_length"),
        F.hypot(safe(F.sum("_dx")), safe(F.sum("_dy"))).alias("displacement"),
        safe(F.sum("_step")).alias("path_length"),
        safe(F.avg("_speed")).alias("mean_speed"),
        safe(F.max("_speed")).alias("max_speed"),
        safe(F.avg("core_q")).alias("mean_core_q"),
        safe(F.max("core_q")).alias("max_core_q"),
        safe(F.avg(F.abs("core_q"))).alias("mean_abs_core_q"),
        safe(F.avg("radius")).alias("mean_radius"),
        safe(F.max("radius")).alias("max_radius"),
        safe(F.avg("area")).alias("mean_area"),
        safe(F.max("area")).alias("max_area"),
        safe(F.avg("body_distance")).alias("mean_body_distance"),
        safe(F.avg("sensor_distance")).alias("mean_sensor_distance"),
        safe(F.avg("core_x")).alias("mean_core_x"),
        safe(F.avg("core_y")).alias("mean_core_y"),
    )
    return agg.withColumns(
        {
            "duration_frames": F.col("_frames").cast("double"),
            "duration_ratio": F.col("_frames") / F.col("_length"),
        }
    ).select(*keys, *FEATURES)


def feature_meta(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Snapshot length, duration and ratio of a group, each falling back when the row has none.

    Length falls back to the window's frames, duration to the distinct valid frames,
    ratio to duration over length.
    """
    g = df.groupBy(*keys).agg(
        F.max("snapshot_length").alias("_len"),
        F.max("track_duration").alias("_dur"),
        F.max("duration_ratio").alias("_ratio"),
        F.min("start_frame").alias("_s"),
        F.min("end_frame").alias("_e"),
        F.count_distinct(F.when(F.col("frame") >= 0, F.col("frame"))).alias("_frames"),
    )
    length = F.when(F.col("_len") > 0, F.col("_len")).when(F.col("_e") >= F.col("_s"), F.col("_e") - F.col("_s") + 1).otherwise(0)
    g = g.withColumns({"snapshot_length": length, "track_duration": F.when(F.col("_dur") > 0, F.col("_dur")).otherwise(F.col("_frames"))})
    ratio = F.when(F.col("_ratio") > 0, F.col("_ratio")).when(
        F.col("snapshot_length") > 0, F.col("track_duration") / F.col("snapshot_length")
    ).otherwise(F.lit(0.0))
    return g.select(*keys, "snapshot_length", "track_duration", ratio.alias("duration_ratio"))


def track_features_v1(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, sx: float, sy: float) -> DataFrame:
    """Duration, displacement, speeds and strength of a track, and its closest pass by a sensor."""
    d = previous_row(df, keys, order, block, ["core_x", "core_y"])
    dx, dy = F.col("core_x") - F.col("prev_core_x"), F.col("core_y") - F.col("prev_core_y")
    g = d.groupBy(*keys).agg(
        (F.max("frame") - F.min("frame") + 1).alias("duration"),
        F.hypot(safe(F.sum(dx)), safe(F.sum(dy))).alias("displacement"),
        safe(F.max(F.hypot(dx, dy))).alias("max_speed"),
        F.avg(F.abs("core_q")).alias("mean_vorticity"),
        F.stddev_pop("core_q").alias("std_vorticity"),
        F.min(F.hypot(F.col("core_x") - sx, F.col("core_y") - sy)).alias("min_distance"),
        F.max(F.abs("core_q")).alias("max_vorticity"),
    )
    return g.withColumn("avg_speed", F.when(F.col("duration") > 0, F.col("displacement") / F.col("duration")).otherwise(0.0))


def theoretical_pressure(df: DataFrame, sx: float, sy: float, core: float = 1.5) -> DataFrame:
    """Pressure of an ideal vortex at a sensor: -(pi core^2) strength / distance^2."""
    d2 = (F.col("core_x") - sx) * (F.col("core_x") - sx) + (F.col("core_y") - sy) * (F.col("core_y") - sy)
    return df.withColumn("pressure", -(F.pi() * core * core) * F.col("core_q") / F.nullif(d2, F.lit(0.0)))


def relevant(df: DataFrame, keys: Sequence[str], label: str, keep: Sequence[str]) -> DataFrame:
    """Rows with a wanted label, from groups that are not wholly "not relevant"."""
    clean = F.lower(F.trim(F.col(label)))
    live = df.groupBy(*keys).agg(F.bool_and(clean == "not relevant").alias("_none")).filter(~F.col("_none"))
    return df.filter(clean.isin(*keep) & (clean != "not relevant")).join(live.select(*keys), list(keys), "left_semi")

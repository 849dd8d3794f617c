"""Tracks of recordings of any length: slices of frames are linked in parallel and repaired at their borders.

What a slice needs from the past is its live tracks: where each has its last detection. A slice first guesses
them by linking some frames before its border; then it compares them with what the slice before leaves behind,
and where they differ it is linked again from there, until all borders agree. A slice that follows a right one
is right after one repair, so the result is that of a single pass. Links name a track by its place among the
slice's incoming tracks or by its number among those born in the slice; numbers over the whole recording come from
counting births, and reach later slices by pointer doubling over the borders.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from wakeframe.operators.tracks import Linker
from wakeframe.session import scratch, written

SLICE_FRAMES = 2048
# Frames before its border that a slice guesses its live tracks from, in units of the longest gap.
WARM_GAPS = 4

_SLICE = """run int, slice bigint, first int, in_frame array<int>, in_region array<int>, in_x array<double>, in_y array<double>,
    out_frame array<int>, out_region array<int>, out_x array<double>, out_y array<double>, out_label array<bigint>, births bigint, tied boolean,
    frames array<int>, regions array<int>, xs array<double>, ys array<double>, labels array<bigint>, distances array<double>"""
_HEAD = ["frame", "region", "x", "y"]
_HEADS = "array<struct<out_frame:int,out_region:int,out_x:double,out_y:double>>"


def _steps(linker: Linker, frame: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of detections sorted by frame."""
    ids, dist = np.empty(len(frame), np.int64), np.empty(len(frame))
    edge = np.concatenate([[0], np.flatnonzero(np.diff(frame)) + 1, [len(frame)]]) if len(frame) else [0]
    for a, z in zip(edge[:-1], edge[1:]):
        ids[a:z], dist[a:z] = linker.step(int(frame[a]), xy[a:z])
    return ids, dist


def _link_slice(det: pd.DataFrame, given: pd.DataFrame, max_distance: float, max_gap: int) -> pd.DataFrame:
    """One slice, from ``given`` live tracks or, without, from those that its warm-up rows leave."""
    names = [c.strip().split()[0] for c in _SLICE.split(",")]
    det = det.sort_values(["frame", "region"], kind="stable")
    early, own = det[det["ahead"]], det[~det["ahead"]]
    if own.empty:
        return pd.DataFrame(columns=names)
    frame, region, xy = own["frame"].to_numpy(), own["region"].to_numpy(), own[["core_x", "core_y"]].to_numpy(float)
    if len(given):
        heads = [np.asarray(given[f"in_{c}"].iloc[0]) for c in _HEAD]
    else:
        warm = Linker(max_distance, max_gap)
        ids, _ = _steps(warm, early["frame"].to_numpy(), early[["core_x", "core_y"]].to_numpy(float))
        last = np.unique(ids[::-1], return_index=True)[1] if len(ids) else np.empty(0, np.int64)
        rows = early.iloc[len(ids) - 1 - last]
        rows = rows[frame[0] - rows["frame"].to_numpy() <= max_gap]
        heads = [rows[c].to_numpy() for c in ("frame", "region", "core_x", "core_y")]
    n = len(heads[0])
    linker = Linker(max_distance, max_gap, (np.arange(n), heads[0], heads[2], heads[3], n))
    linker.unsure = n
    ids, dist = _steps(linker, frame, xy)
    live = np.sort(linker.ids[frame[-1] - linker.frames <= max_gap])
    place = np.full(linker.fresh, -1)
    place[ids] = np.arange(len(ids))
    now = place[live]
    left = [
        np.where(now >= 0, mine[now], np.append(theirs, 0)[np.where(now >= 0, n, live)])
        for mine, theirs in zip((frame, region, xy[:, 0], xy[:, 1]), heads)
    ]
    row = [own["run"].iloc[0], own["slice"].iloc[0], frame[0], *heads, *left, live, linker.fresh - n, linker.tied, frame, region, xy[:, 0], xy[:, 1], ids, dist]
    return pd.DataFrame({name: [value] for name, value in zip(names, row)})


def _latest(rounds: DataFrame) -> DataFrame:
    """Each slice as it was linked last."""
    last = rounds.groupBy("run", "slice").agg(F.max("round").alias("round"))
    return rounds.join(last, ["run", "slice", "round"])


def _wrong_borders(state: DataFrame, chain: DataFrame, max_gap: int) -> DataFrame:
    """Slices whose incoming tracks are not what the slice before leaves, with the right ones."""
    left = state.select("run", F.col("slice").alias("before"), F.arrays_zip(*[f"out_{c}" for c in _HEAD]).alias("left"))
    here = state.select("run", "slice", "first", F.arrays_zip(*[f"in_{c}" for c in _HEAD]).alias("came")).join(chain, ["run", "slice"])
    both = here.join(left, ["run", "before"], "left")
    # Tracks that are too old when the slice begins are out.
    due = F.filter(F.coalesce("left", F.array().cast(_HEADS)), lambda h: F.col("first") - h["out_frame"] <= max_gap)
    both = both.withColumn("due", due)
    names = lambda col, side: F.array_sort(F.transform(col, lambda h: F.struct(h[f"{side}_frame"].alias("frame"), h[f"{side}_region"].alias("region"))))
    wrong = both.filter(names("due", "out") != names("came", "in"))
    return wrong.select("run", "slice", *[F.col(f"due.out_{c}").alias(f"in_{c}") for c in _HEAD])


def _incoming_ids(state: DataFrame, chain: DataFrame) -> DataFrame:
    """(run, slice, offset, ids): numbers of each slice's incoming tracks, and of tracks born before it."""
    earlier = W.partitionBy("run").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    births = state.select("run", "slice", "births", F.size("in_frame").alias("came"))
    births = written(births.withColumn("offset", F.coalesce(F.sum("births").over(earlier), F.lit(0))), "births")
    came = state.select("run", "slice", F.posexplode(F.arrays_zip("in_frame", "in_region")).alias("i", "h")).join(chain, ["run", "slice"])
    left = state.select("run", F.col("slice").alias("before"), F.explode(F.arrays_zip("out_frame", "out_region", "out_label")).alias("o"))
    one = came.select("run", "slice", "before", F.col("i").cast("bigint").alias("i"), F.col("h.in_frame").alias("frame"), F.col("h.in_region").alias("region")).join(
        left.select("run", "before", F.col("o.out_frame").alias("frame"), F.col("o.out_region").alias("region"), F.col("o.out_label").alias("label")),
        ["run", "before", "frame", "region"],
    )
    one = one.join(births.select("run", F.col("slice").alias("before"), "came", "offset"), ["run", "before"])
    born = F.col("label") >= F.col("came")
    points = one.select(
        "run", "slice", "i", F.when(born, F.col("offset") + F.col("label") - F.col("came")).alias("id"), F.when(~born, F.col("before")).alias("to_slice"), F.when(~born, F.col("label")).alias("to")
    )
    points = written(points, "pointers")
    while not points.filter("id IS NULL").isEmpty():
        at = points.select("run", F.col("slice").alias("to_slice"), F.col("i").alias("to"), F.col("id").alias("id2"), F.col("to_slice").alias("slice2"), F.col("to").alias("to2"))
        points = points.join(at, ["run", "to_slice", "to"], "left").select("run", "slice", "i", F.coalesce("id", "id2").alias("id"), F.col("slice2").alias("to_slice"), F.col("to2").alias("to"))
        points = written(points, "pointers")
    ids = points.groupBy("run", "slice").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "id"))), lambda p: p["id"]).alias("ids"))
    return births.select("run", "slice", "offset").join(ids, ["run", "slice"], "left")


def _wrong_orders(state: DataFrame, ids: DataFrame) -> DataFrame:
    """Slices where two incoming tracks were equally close to a detection and did not come in the order of their numbers."""
    tied = state.filter("tied").join(ids, ["run", "slice"]).filter(F.col("ids") != F.array_sort("ids"))
    heads = F.array_sort(F.arrays_zip(F.col("ids").alias("id"), *[F.col(f"in_{c}") for c in _HEAD]))
    return tied.withColumn("heads", heads).select("run", "slice", *[F.col(f"heads.in_{c}").alias(f"in_{c}") for c in _HEAD])


def assign_tracks(df: DataFrame, max_distance: float, max_gap: int, slice_frames: int = SLICE_FRAMES) -> DataFrame:
    """Give every detection (run, frame, region, core_x, core_y) a track id.

    Each live track offers its nearest detection closer than ``max_distance``; offers are taken shortest first (the older
    track first where they are equal), one to one; the rest start new tracks, numbered as they come. A track lives on for
    ``max_gap`` frames without a detection. A task holds ``slice_frames`` frames of one recording.
    """
    spark = df.sparkSession
    part = F.floor(F.col("frame") / slice_frames)
    det = df.select("run", "frame", "region", "core_x", "core_y").withColumn("slice", part)
    det = written(det, "detections")
    chain = det.select("run", "slice").distinct().withColumn("before", F.lag("slice").over(W.partitionBy("run").orderBy("slice")))
    chain = written(chain, "chain")
    folder = scratch(spark, "links")
    by = ["run", "slice"]

    def link(rows: DataFrame, given: DataFrame, number: int) -> None:
        made = rows.groupBy(*by).cogroup(given.groupBy(*by)).applyInPandas(lambda d, g: _link_slice(d, g, max_distance, max_gap), _SLICE)
        made.write.parquet(f"{folder}/round={number}")

    warm = WARM_GAPS * (max_gap + 1)
    edges = F.sequence(F.col("slice"), F.floor((F.col("frame") + warm) / slice_frames))
    ahead = det.withColumn("to", F.explode(edges)).withColumn("ahead", F.col("to") > F.col("slice")).drop("slice").withColumnRenamed("to", "slice")
    nothing = spark.createDataFrame([], "run int, slice bigint, in_frame array<int>, in_region array<int>, in_x array<double>, in_y array<double>")
    link(ahead, nothing, 0)
    number, ids = 0, None
    while True:
        rounds = spark.read.schema(_SLICE + ", round int").parquet(folder)
        state = _latest(rounds)
        again = written(_wrong_borders(state, chain, max_gap), "again")
        if again.isEmpty():
            ids = written(_incoming_ids(state, chain), "ids")
            again = written(_wrong_orders(state, ids), "again")
            if again.isEmpty():
                break
        number += 1
        link(det.withColumn("ahead", F.lit(False)).join(again.select(*by), by, "left_semi"), again, number)
    rows = state.join(ids, by).select("run", "offset", "ids", F.size("in_frame").alias("came"), F.inline(F.arrays_zip("frames", "regions", "xs", "ys", "labels", "distances")))
    born = F.col("labels") - F.col("came")
    track = F.when(born >= 0, F.col("offset") + born).otherwise(F.get("ids", F.col("labels").cast("int")))
    return rows.select(
        "run", F.col("frames").alias("frame"), F.col("regions").alias("region"), F.col("xs").alias("core_x"), F.col("ys").alias("core_y"),
        track.alias("track_id"), F.nanvl("distances", F.lit(None).cast("double")).alias("track_distance"),
    )

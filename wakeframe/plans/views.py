"""Virtual tables over the analytic tables, in Spark and as SQL with the same rule.

* ``frames``: an embedding is one 8 x 8 frame; 50 consecutive vectors are one run.
* ``velocity``: vector 2k holds u, vector 2k+1 holds v of frame k; 25 frames a run.
* ``signal``: the events of one type are a sensor channel, ordered by time.
* ``tracks``: a user's events are a vortex track, a week is a run, a minute a frame.
* ``contours``: an octagon whose centre and radius come from the frame's own values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeframe.functions.grid import Grid, let
from wakeframe.operators.ordering import index_rows
from wakeframe.session import spread

GRID = Grid(8, 8)
RUN = 50

# Unit octagon, counter-clockwise with y up (fixed values).
OCTAGON = [
    (1.0, 0.0),
    (0.7071067811865476, 0.7071067811865476),
    (0.0, 1.0),
    (-0.7071067811865476, 0.7071067811865476),
    (-1.0, 0.0),
    (-0.7071067811865476, -0.7071067811865476),
    (0.0, -1.0),
    (0.7071067811865476, -0.7071067811865476),
]
# Sensor positions on the 8 x 8 grid (fixed values).
SENSORS = [(0, 4.0, 5.0), (1, 6.0, 5.0), (2, 6.0, 2.0)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def idiv(c, k: int):
    return F.floor(F.col(c) / k).cast("int")


def micros(ts: str):
    """Microseconds since the first day of the events, whatever the session's time zone."""
    origin = F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    return F.unix_micros(F.col(ts).cast("timestamp")) - origin


def frames(spark, sf_dir) -> DataFrame:
    """(run, frame, label, v ARRAY<DOUBLE>)."""
    return spread(table(spark, sf_dir, "embeddings")).select(
        idiv("vec_id", RUN).alias("run"),
        (F.col("vec_id") % RUN).cast("int").alias("frame"),
        "label",
        F.col("embedding").cast("array<double>").alias("v"),
    )


def velocity(spark, sf_dir) -> DataFrame:
    """(run, frame, u ARRAY<DOUBLE>, w ARRAY<DOUBLE>)."""
    e = spread(table(spark, sf_dir, "embeddings")).select(
        idiv("vec_id", 2).alias("k"), (F.col("vec_id") % 2).alias("part"), F.col("embedding").cast("array<double>").alias("a")
    )
    return (
        e.groupBy("k")
        .agg(F.max(F.when(F.col("part") == 0, F.col("a"))).alias("u"), F.max(F.when(F.col("part") == 1, F.col("a"))).alias("w"))
        .select(idiv("k", 25).alias("run"), (F.col("k") % 25).cast("int").alias("frame"), "u", "w")
    )


def cells(spark, sf_dir) -> DataFrame:
    f = frames(spark, sf_dir).select("run", "frame", F.posexplode("v").alias("cell", "v"))
    x, y = GRID.xy(F.col("cell"))
    return f.select("run", "frame", "cell", x.alias("x"), y.alias("y"), "v")


def contours(spark, sf_dir) -> DataFrame:
    """(run, frame, v, poly ARRAY<STRUCT<x, y>>): one octagon per frame."""
    cx, cy, r = 3.3 + 4 * F.col("v")[1], 3.4 + 4 * F.col("v")[2], 1.7 + 2 * F.col("v")[3]
    ring = F.array(*[F.struct((cx + r * c).alias("x"), (cy + r * s).alias("y")) for c, s in OCTAGON])
    return frames(spark, sf_dir).select("run", "frame", "label", "v", ring.alias("poly"))


def signal(spark, sf_dir) -> DataFrame:
    """(channel, n BIGINT, t, p): dense sample numbers, hour blocks, no channel-wide sort."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("channel"), "ts", "event_id", F.col("value").alias("p"))
    hour = F.date_trunc("hour", F.col("ts"))
    return index_rows(e, ["channel"], ["ts", "event_id"], hour).select(
        "channel", "n", (F.col("n") / 100.0).alias("t"), "p"
    )


def tracks(spark, sf_dir) -> DataFrame:
    """One row per detection of a track; ``event_id`` breaks ties inside a frame."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    minute = F.floor(micros("ts") / 60000000)
    area = (k + 1).alias("area")
    return e.select(
        F.floor(minute / 10080).cast("int").alias("run"),
        F.col("user_id").alias("track_id"),
        (minute % 10080).cast("int").alias("frame"),
        "event_id",
        (F.col("value") / 8).alias("core_x"),
        (k / 2).alias("core_y"),
        (F.col("value") / 50 - 1).alias("core_q"),
        F.sqrt((k + 1) / F.pi()).alias("radius"),
        area,
        (F.col("value") / 10).alias("body_distance"),
        (F.col("event_type") != "error").alias("visible"),
        F.when(F.col("event_type") == "view", 0)
        .when(F.col("event_type") == "click", 1)
        .when(F.col("event_type") == "purchase", 2)
        .otherwise(-1)
        .alias("sensor_id"),
        F.hypot(F.col("value") / 8 - 4, k / 2 - 5).alias("sensor_distance"),
    )


def segments(spark, sf_dir) -> DataFrame:
    """Ragged pressure snapshots: runs of active samples (value above -0.2) in a vector.

    (snapshot, vec_id, model, start_frame, end_frame, length, p ARRAY<DOUBLE>). A vector
    is one row of 64 samples, so the runs are cut inside the row without a shuffle.
    """
    e = spread(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("v")
    )
    size = 64
    cut = F.filter(
        F.sequence(F.lit(0), F.lit(size)),
        lambda i: (i == 0) | (i == size) | ((F.get("v", i) > -0.2) != (F.get("v", i - 1) > -0.2)),
    )
    pieces = let(
        cut,
        lambda c: F.transform(
            F.sequence(F.lit(0), F.size(c) - 2), lambda k: F.struct(F.get(c, k).alias("a"), F.get(c, k + 1).alias("b"))
        ),
    )
    return (
        e.select("*", F.inline(pieces))
        .filter(F.get("v", F.col("a")) > -0.2)
        .select(
            (F.col("vec_id") * 64 + F.col("a")).alias("snapshot"),
            "vec_id",
            F.when(F.col("label") % 2 == 0, "fish").otherwise("cylinder").alias("model"),
            F.col("a").alias("start_frame"),
            (F.col("b") - 1).alias("end_frame"),
            (F.col("b") - F.col("a")).alias("length"),
            F.slice("v", F.col("a") + 1, F.col("b") - F.col("a")).alias("p"),
        )
    )


# --- the same views as SQL -----------------------------------------------------------

_OCT = ", ".join(f"({i}, {c}::DOUBLE, {s}::DOUBLE)" for i, (c, s) in enumerate(OCTAGON))
_SENS = ", ".join(f"({i}, {x}::DOUBLE, {y}::DOUBLE)" for i, x, y in SENSORS)

VIEWS = {
    "fr": "fr AS (SELECT (vec_id // 50)::INT AS run, (vec_id % 50)::INT AS frame, label, embedding::DOUBLE[] AS v FROM embeddings)",
    "grid": "grid AS (SELECT c::INT AS cell, (c // 8)::INT AS x, (c % 8)::INT AS y FROM range(64) r(c))",
    "cells": "cells AS (SELECT run, frame, label, cell, x, y, v[cell + 1] AS v FROM fr, grid)",
    "uv": """uv AS (SELECT (a.vec_id // 50)::INT AS run, ((a.vec_id // 2) % 25)::INT AS frame, cell, x, y,
        a.embedding[cell + 1]::DOUBLE AS u, b.embedding[cell + 1]::DOUBLE AS w
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 2 = 0, grid)""",
    "oct": f"oct AS (SELECT * FROM (VALUES {_OCT}) o(vertex, c, s))",
    "sensors": f"sensors AS (SELECT * FROM (VALUES {_SENS}) s(sensor_id, sx, sy))",
    "ring": """ring AS (SELECT run, frame, label, vertex, 3.3 + 4 * v[2] + (1.7 + 2 * v[4]) * c AS x,
        3.4 + 4 * v[3] + (1.7 + 2 * v[4]) * s AS y FROM fr, oct)""",
    "edge": """edge AS (SELECT a.run, a.frame, a.vertex, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2,
        hypot(b.x - a.x, b.y - a.y) AS len FROM ring a JOIN ring b
        ON a.run = b.run AND a.frame = b.frame AND b.vertex = (a.vertex + 1) % 8)""",
    "sig": """sig AS (SELECT event_type AS channel, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n,
        (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) / 100.0 AS t, value AS p FROM events)""",
    "trk": """trk AS (SELECT (m // 10080)::INT AS run, user_id AS track_id, (m % 10080)::INT AS frame, event_id,
        value / 8 AS core_x, k / 2 AS core_y, value / 50 - 1 AS core_q, sqrt((k + 1) / pi()) AS radius, k + 1 AS area,
        value / 10 AS body_distance, event_type <> 'error' AS visible,
        CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE -1 END AS sensor_id,
        hypot(value / 8 - 4, k / 2 - 5) AS sensor_distance
        FROM (SELECT *, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 60000000 AS m,
              CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events))""",
    "smp": "smp AS (SELECT vec_id, label, cell AS i, embedding[cell + 1]::DOUBLE AS v FROM embeddings, grid)",
    "act": "act AS (SELECT *, i - row_number() OVER (PARTITION BY vec_id ORDER BY i) AS isl FROM smp WHERE v > -0.2)",
    "seg": """seg AS (SELECT vec_id * 64 + min(i) AS snapshot, vec_id, isl,
        CASE WHEN any_value(label) % 2 = 0 THEN 'fish' ELSE 'cylinder' END AS model,
        min(i) AS start_frame, max(i) AS end_frame, count(*) AS length FROM act GROUP BY vec_id, isl)""",
    "ser": """ser AS (SELECT snapshot, seg.vec_id, model, start_frame, end_frame, length, i - start_frame AS pos, v AS p
        FROM act JOIN seg ON act.vec_id = seg.vec_id AND act.isl = seg.isl)""",
}
_NEEDS = {
    "cells": ["fr", "grid"],
    "uv": ["grid"],
    "ring": ["fr", "oct"],
    "edge": ["ring"],
    "smp": ["grid"],
    "act": ["smp"],
    "seg": ["act"],
    "ser": ["act", "seg"],
}


def sql(views: str, body: str, *ctes: str) -> str:
    """``WITH`` the named views (and what they need), then extra CTEs, then ``body``."""
    done: list[str] = []

    def add(v: str) -> None:
        for need in _NEEDS.get(v, []):
            add(need)
        if v not in done:
            done.append(v)

    for v in views.split():
        add(v)
    tables = [VIEWS[v] for v in done] + list(ctes)
    return f"WITH RECURSIVE {', '.join(tables)} {body}" if tables else body

"""Readers for the experiment's text formats, all by distributed text scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from wakeframe.functions.text import lenient_double, lenient_int
from wakeframe.session import written


def read_lines(spark: SparkSession, path: str | list[str], recursive: bool = True) -> DataFrame:
    """(file, line, value) with exact 0-based line numbers, without sorting any file.

    Rows of one file split sit together in scan order, so a line's number is its distance from the
    split's first row plus the rows of the file's earlier splits. The scan is written once and both
    the rows and the one row per split are read from there: splits that another scan cuts elsewhere
    cannot lose a line.
    """
    raw = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )
    lines = written(raw, "lines")
    splits = lines.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = splits.select("file", "_block", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return lines.join(starts, ["file", "_block"]).select("file", (F.col("_id") + F.col("_shift")).alias("line"), "value")


def doubles(value: Column, sep: str = ",") -> Column:
    """Separated numbers; a cell that is no number is NULL."""
    return F.transform(F.split(value, sep), lambda s: lenient_double(s))


# --- maps and contours ------------------------------------------------------------------------


def wide_map(lines: DataFrame) -> DataFrame:
    """Headerless map: row = cell, column = frame -> (file, cell, frame, v)."""
    return lines.select("file", F.col("line").alias("cell"), F.posexplode(doubles(F.col("value"))).alias("frame", "v"))


def valid_shape(cells: DataFrame, expected: int, on_error: str = "raise") -> DataFrame:
    """Keep files with ``expected`` cells per frame; others raise, or are skipped."""
    sizes = cells.groupBy("file").agg(F.max("cell").alias("_top"))
    ok = F.col("_top") == expected - 1
    if on_error == "skip":
        return cells.join(sizes.filter(ok).select("file"), "file", "left_semi")
    message = F.concat(F.lit("grid does not fit "), F.col("file"))
    checked = sizes.select("file", F.when(ok, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")).alias("_ok"))
    return cells.join(checked, "file").filter("_ok").drop("_ok")


def fill_cells(cells: DataFrame) -> DataFrame:
    """Missing cells become 0, flagged in ``filled``."""
    bad = F.col("v").isNull() | F.isnan("v")
    return cells.withColumns({"filled": bad, "v": F.when(bad, F.lit(0.0)).otherwise(F.col("v"))})


def contour_pair(xs: DataFrame, ys: DataFrame, key: Column, skip_header: bool = False, rounded: bool = False) -> DataFrame:
    """(run, frame, vertex, x, y) from two map files per run; raises when a side lacks a point."""

    def side(lines, name):
        m = wide_map(lines.filter("line > 0").withColumn("line", F.col("line") - 1) if skip_header else lines)
        v = F.bround("v") if rounded else F.col("v")
        return m.select(key.alias("run"), "frame", F.col("cell").alias("vertex"), F.struct(v.alias("v")).alias(name))

    j = side(xs, "sx").join(side(ys, "sy"), ["run", "frame", "vertex"], "full")
    ok = F.col("sx").isNotNull() & F.col("sy").isNotNull()
    both = F.when(ok, F.col("sx.v")).otherwise(F.raise_error(F.lit("contour files differ in shape")).cast("double"))
    return j.select("run", "frame", "vertex", both.alias("x"), F.col("sy.v").alias("y"))


def stacked_blocks(lines: DataFrame, rows: int, header: int = 5) -> DataFrame:
    """Blocks of u, v and p rows after a header -> (file, snapshot, x, y, u, v, p)."""
    k = F.col("line") - header
    body = lines.filter(k >= 0).select(
        "file",
        F.floor(k / (3 * rows)).alias("snapshot"),
        F.floor((k % (3 * rows)) / rows).alias("block"),
        (k % rows).alias("y"),
        F.posexplode(doubles(F.regexp_replace(F.trim("value"), r"\s*;\s*$", ""), r"\s+")).alias("x", "value"),
    )
    pick = lambda b, name: F.max(F.when(F.col("block") == b, F.col("value"))).alias(name)
    return body.groupBy("file", "snapshot", "x", "y").agg(pick(0, "u"), pick(1, "v"), pick(2, "p"))


# --- logs ---------------------------------------------------------------------------------------


def spine_rows(lines: DataFrame, skip: int = 0, least: int = 71) -> DataFrame:
    """(file, frame, vals): numeric rows of at least ``least`` columns; other rows are dropped."""
    vals = doubles(F.col("value"))
    kept = lines.filter(F.col("line") >= skip).withColumn("vals", vals)
    kept = kept.filter((F.size("vals") >= least) & F.forall("vals", lambda v: v.isNotNull()))
    return kept.select("file", F.col("line").alias("row"), "vals")


def sensor_log(lines: DataFrame, header: int = 4) -> DataFrame:
    """(file, step, t, cylinder, wall): even lines carry time and ring, odd lines the wall."""
    k = F.col("line") - header
    vals = doubles(F.regexp_replace(F.trim("value"), r"\s*;\s*$", ""), r"\s+")
    body = lines.filter(k >= 0).select("file", F.floor(k / 2).alias("step"), (k % 2).alias("odd"), vals.alias("vals"))
    even = F.max(F.when(F.col("odd") == 0, F.col("vals")))
    out = body.groupBy("file", "step").agg(even.alias("_even"), F.max(F.when(F.col("odd") == 1, F.col("vals"))).alias("wall"))
    return out.select("file", "step", F.get("_even", F.lit(0)).alias("t"), F.slice("_even", 2, F.size("_even") - 1).alias("cylinder"), "wall")


def ring_coordinates(lines: DataFrame) -> DataFrame:
    """(file, coords) from a ``% xcoord = [...]`` comment line."""
    inside = F.regexp_extract("value", r"^%\s*xcoord\s*=\s*\[([^\]]*)\]", 1)
    return lines.filter(F.col("value").startswith("%")).filter(inside != "").select("file", doubles(F.trim(inside), r"\s+").alias("coords"))


def two_columns(lines: DataFrame) -> DataFrame:
    """(file, line, t, p) of space-separated logs; lines that do not parse are skipped."""
    v = doubles(F.trim("value"), r"\s+")
    return lines.select("file", "line", F.get(v, F.lit(0)).alias("t"), F.get(v, F.lit(1)).alias("p")).filter("t IS NOT NULL AND p IS NOT NULL")


def timed_table(lines: DataFrame) -> DataFrame:
    """Tab-separated table under a ``rows cols dt`` line -> (file, row, t, col, value)."""
    v = doubles(F.col("value"), "\t")
    head = lines.filter("line = 0").select("file", F.get(v, F.lit(0)).alias("_rows"), F.get(v, F.lit(1)).alias("_cols"), F.get(v, F.lit(2)).alias("_dt"))
    body = lines.filter("line > 0").withColumn("row", F.col("line") - 1).join(written(head), "file").filter("row < _rows")
    long = body.select("file", "row", (F.col("row") * F.col("_dt")).alias("t"), "_cols", F.posexplode(v).alias("col", "value"))
    return long.filter("col < _cols").drop("_cols")


# --- tables ---------------------------------------------------------------------------------------


def channels(spark: SparkSession, path: str, wanted: Sequence[str] | None = None) -> DataFrame:
    """Long sensor table partitioned by experiment and channel; raises on an unknown channel."""
    df = spark.read.parquet(path)
    if wanted is None:
        return df
    found = {r["channel"] for r in df.select("channel").distinct().filter(F.col("channel").isin(*wanted)).collect()}
    if missing := sorted(set(wanted) - found):
        raise ValueError(f"no such channel: {', '.join(missing)}")
    return df.filter(F.col("channel").isin(*wanted))


def wall_pressure(df: DataFrame, time_column: str | None = None) -> DataFrame:
    """Every column but the time (by default the last) is a channel -> (t, channel, p)."""
    time_column = time_column or df.columns[-1]
    names = [c for c in df.columns if c != time_column]
    return df.unpivot([time_column], names, "channel", "p").withColumnRenamed(time_column, "t")


def first_columns(df: DataFrame, count: int = 8) -> DataFrame:
    return df.select(*df.columns[:count])


def strings(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Header CSV with every column as text, so that each field can be parsed leniently."""
    return spark.read.option("header", True).option("sep", sep).csv(path)


def track_rows(raw: DataFrame) -> DataFrame:
    """Lenient tracks: a bad frame drops the row, bad ids become -1, bad flags true, bad numbers NULL."""
    visible = lenient_double(F.col("visible"))
    return raw.select(
        lenient_int(F.col("frame")).alias("frame"),
        F.coalesce(lenient_int(F.col("track_id")), F.lit(-1)).alias("track_id"),
        lenient_double(F.col("core_x")).alias("core_x"),
        lenient_double(F.col("core_y")).alias("core_y"),
        F.coalesce(lenient_int(F.col("sensor_id")), F.lit(-1)).alias("sensor_id"),
        F.coalesce(visible.cast("int") != 0, F.lit(True)).alias("visible"),
    ).filter("frame IS NOT NULL")


# Columns of the track format that hold whole numbers (fixed values).
WHOLE_COLUMNS = ("frame", "track_id", "sensor_id", "visible")


def typed_tracks(raw: DataFrame) -> DataFrame:
    """All columns kept: the id columns as integers (bad: -1), the others as doubles (bad: NULL)."""
    one = lambda c: F.coalesce(lenient_int(F.col(c)), F.lit(-1)) if c in WHOLE_COLUMNS else lenient_double(F.col(c))
    return raw.select(*[one(c).alias(c) for c in raw.columns])


def coerced(raw: DataFrame, whole: Sequence[str], real: Sequence[str], drop_bad: bool = True) -> DataFrame:
    """Integers written as numbers ("12.0") and reals; rows with a bad integer go, or get -1."""
    cols = {c: lenient_int(F.col(c)) for c in whole} | {c: lenient_double(F.col(c)) for c in real}
    out = raw.withColumns(cols)
    if drop_bad:
        return out.filter(" AND ".join(f"{c} IS NOT NULL" for c in whole))
    return out.fillna({c: -1 for c in whole})


def lengths(series: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Length per series: the metadata's when usable, else last present row + 1."""
    seen = series.groupBy(key).agg(
        F.coalesce(F.max(F.when(F.col("p").isNotNull() & ~F.isnan("p"), F.col("pos"))) + 1, F.lit(0)).alias("_seen"), (F.max("pos") + 1).alias("_rows")
    )
    j = seen.join(meta.select(key, "length"), key, "left")
    good = F.col("length").between(1, F.col("_rows"))
    return j.select(key, F.when(good, F.col("length")).otherwise(F.col("_seen")).alias("length"))


def automation_list(lines: DataFrame) -> DataFrame:
    """(file, experiment, sub, skip): header and short rows dropped, a bad skip is 0, never negative."""
    parts = F.split("value", ",")
    body = lines.filter("line > 0").filter(F.size(parts) >= 2)
    skip = F.greatest(F.coalesce(lenient_int(F.get(parts, F.lit(2))), F.lit(0)), F.lit(0))
    return body.select("file", F.trim(F.get(parts, F.lit(0))).alias("experiment"), F.trim(F.get(parts, F.lit(1))).alias("sub"), skip.alias("skip"))


def drifting_table(lines: DataFrame, columns: Sequence[str], added: Sequence[str]) -> DataFrame:
    """Header CSV whose later rows carry ``added`` fields that the header lacks."""
    parts = F.split("value", ",")
    body = lines.filter("line > 0").withColumn("_p", parts)
    pick = lambda names: [F.get("_p", F.lit(i)).alias(c) for i, c in enumerate(names)]
    old = body.filter(F.size("_p") == len(columns)).select("file", "line", *pick(columns))
    new = body.filter(F.size("_p") == len(columns) + len(added)).select("file", "line", *pick([*columns, *added]))
    return old.unionByName(new, allowMissingColumns=True)


# --- labels ---------------------------------------------------------------------------------------


def polygon_labels(lines: DataFrame) -> DataFrame:
    """``class x y x y ...`` -> (file, class, pts)."""
    v = doubles(F.trim("value"), r"\s+")
    pts = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(v) - 1) / 2).cast("int") - 1),
        lambda i: F.struct(F.get(v, 2 * i + 1).alias("x"), F.get(v, 2 * i + 2).alias("y")),
    )
    return lines.filter(F.size(v) >= 3).select("file", "line", F.get(v, F.lit(0)).cast("int").alias("class"), pts.alias("pts"))


def simulator_points(lines: DataFrame, n: int, header: int = 4) -> DataFrame:
    """Point log -> label rows: values over ``n``, the first one replaced by class 0."""
    v = F.transform(doubles(F.trim("value"), r"\s+"), lambda x: x / n)
    body = lines.filter(F.col("line") >= header)
    return body.select("file", (F.col("line") - header + 1).alias("frame"), F.concat(F.array(F.lit(0.0)), F.slice(v, 2, F.size(v))).alias("vals"))


ANNOTATION = (
    "shapes ARRAY<STRUCT<label STRING, points ARRAY<ARRAY<DOUBLE>>, group_id STRING, shape_type STRING>>, "
    "imagePath STRING, imageHeight INT, imageWidth INT"
)


def annotations(raw: DataFrame) -> DataFrame:
    """Annotation JSON -> (imagePath, shape, label, vertex, x, y)."""
    shapes = raw.select("imagePath", F.posexplode("shapes").alias("shape", "_s"))
    pts = shapes.select("imagePath", "shape", F.col("_s.label").alias("label"), F.posexplode("_s.points").alias("vertex", "_p"))
    return pts.select("imagePath", "shape", "label", "vertex", F.get("_p", F.lit(0)).alias("x"), F.get("_p", F.lit(1)).alias("y"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return annotations(spark.read.schema(ANNOTATION).option("multiLine", True).option("recursiveFileLookup", True).json(path))


# --- discovery ------------------------------------------------------------------------------------


def sweep_files(files: DataFrame, re: float | None = None, h: float | None = None) -> DataFrame:
    """Files of ``Re<..>_h<..>`` folders with their parameters, filtered by either or both."""
    number = lambda tag: lenient_double(F.regexp_extract("file", tag + r"(\d+(?:\.\d+)?)", 1))
    d = files.withColumns({"re": number(r"/Re"), "h": number(r"/Re[0-9.]+_h")}).filter("re IS NOT NULL AND h IS NOT NULL")
    if re is not None:
        d = d.filter(F.col("re") == re)
    return d if h is None else d.filter(F.col("h") == h)


def sweep_combinations(files: DataFrame, pairs: DataFrame) -> DataFrame:
    return sweep_files(files).join(pairs, ["re", "h"], "left_semi")


def paired_runs(files: DataFrame, first: str, second: str) -> DataFrame:
    """(experiment, snapshot) of ``<root>/<experiment>/<snapshot>/<name>`` holding both files."""
    part = lambda k: F.element_at(F.split("file", "/"), -k)
    d = files.select(part(3).alias("experiment"), part(2).alias("snapshot"), part(1).alias("name")).distinct()
    side = lambda name: d.filter(F.col("name") == name).select("experiment", "snapshot")
    return side(first).join(side(second), ["experiment", "snapshot"])

"""Writers for the experiment's formats; each leaves the writing to Spark's tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def map_lines(cells: DataFrame, keys: Sequence[str] = ("run",)) -> DataFrame:
    """(keys, cell, value): one comma-joined line per cell with its frames in order."""
    row = F.array_sort(F.collect_list(F.struct("frame", "v")))
    text = F.array_join(F.transform(row, lambda s: s["v"].cast("string")), ",", "nan")
    return cells.groupBy(*keys, "cell").agg(text.alias("value"))


def write_lines(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str]) -> None:
    """One folder of text per key, lines in order; a key's lines go to one task and file."""
    out = df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    out.select(*keys, "value").write.mode("overwrite").partitionBy(*keys).text(path)


def write_map(cells: DataFrame, path: str, keys: Sequence[str] = ("run",)) -> None:
    write_lines(map_lines(cells, keys), path, keys, ["cell"])


def padded_matrix(series: DataFrame, blocks: Sequence[str], key: str, max_len: int | None = None) -> DataFrame:
    """(blocks, pos, value): ragged series as columns, missing samples as nan, columns in key order.

    A line holds one entry per series of its block; ``blocks`` (a run, or a slice of
    the series numbers) keep lines and groups bounded, one matrix file per block.
    """
    if max_len is None:
        max_len = series.agg((F.max("pos") + 1).alias("n")).first()["n"] or 0
    blocks = list(blocks)
    ids = series.select(*blocks, key).distinct()
    spine = ids.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(max_len - 1))))
    full = spine.join(series.select(*blocks, key, "pos", "p"), [*blocks, key, "pos"], "left")
    row = F.array_sort(F.collect_list(F.struct(F.col(key), F.col("p"))))
    return full.groupBy(*blocks, "pos").agg(F.array_join(F.transform(row, lambda s: s["p"].cast("string")), ",", "nan").alias("value"))


def write_tracks(df: DataFrame, path: str, dt: float | None = None) -> None:
    """Header CSV sorted by (track_id, frame); time is frame * dt, or the frame."""
    time = F.col("frame") * dt if dt is not None else F.col("frame")
    cols = [c for c in df.columns if c not in ("track_id", "frame", "time", "visible")]
    out = df.select("track_id", "frame", time.alias("time"), *cols, F.col("visible").cast("int").alias("visible"))
    out.orderBy("track_id", "frame").write.mode("overwrite").option("header", True).csv(path)


def write_split(df: DataFrame, path: str, by: str) -> None:
    """One folder of header CSV per value of ``by``."""
    df.write.mode("overwrite").option("header", True).partitionBy(by).csv(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Append to a growing table; the schema travels with every file."""
    df.write.mode("append").parquet(path)


def append_new(spark: SparkSession, df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append only the rows whose keys the table does not hold yet."""
    try:
        known = spark.read.parquet(path).select(*keys)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        known = None
    new = df if known is None else df.join(known, list(keys), "left_anti")
    new.write.mode("append").parquet(path)


def write_once(df: DataFrame, path: str, force: bool = False) -> None:
    """Leave an existing table alone unless forced."""
    df.write.mode("overwrite" if force else "ignore").parquet(path)


def decimal_comma(df: DataFrame, digits: int = 6) -> DataFrame:
    """Numbers as text with a decimal comma."""
    text = lambda c: F.regexp_replace(F.format_string(f"%.{digits}f", F.col(c).cast("double")), r"\.", ",")
    return df.select(*[text(n).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes])


def write_decimal_comma(df: DataFrame, path: str) -> None:
    decimal_comma(df).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def union_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both with the union of their columns."""
    return a.unionByName(b, allowMissingColumns=True)


def label_lines(df: DataFrame, poly: str = "poly") -> DataFrame:
    """``value``: class 0 and the points, space separated."""
    flat = F.flatten(F.transform(poly, lambda p: F.array(p["x"].cast("string"), p["y"].cast("string"))))
    return df.withColumn("value", F.concat_ws(" ", F.lit("0"), flat))


def write_basis(modes: DataFrame, spectrum: DataFrame, path: str) -> None:
    """Mode basis and its provenance as two tables side by side."""
    modes.write.mode("overwrite").parquet(path + "/modes")
    spectrum.write.mode("overwrite").parquet(path + "/spectrum")

"""Boilerplate lines by the number of sites that carry them.

A HyperLogLog sketch of the sites is kept for each line hash and merged by aggregation, so a line costs a
few bytes a task, however often it occurs. Only lines whose estimate lies near the threshold are counted
exactly. A line found on enough sites stays in the document with the smallest id and goes from all others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wakeframe.llm.stored import stored

MIN_SITES = 10
LG_K = 12
# Standard errors of the sketch around the threshold within which lines are counted exactly.
ERRORS = 6


def _key(line: Column) -> Column:
    """Lines are compared without the blanks around them."""
    return F.btrim(line, F.lit(" \t\r"))


def _lines(docs: DataFrame) -> DataFrame:
    pieces = F.posexplode(F.split("text", "\n", -1)).alias("at", "line")
    rows = docs.select("id", "site", F.xxhash64("text").alias("version"), pieces).withColumn("key", _key(F.col("line")))
    hashes = F.struct(F.xxhash64("key").alias("a"), F.xxhash64(F.lit(1), "key").alias("b")).alias("hash")
    return rows.filter(F.col("key") != "").select("id", "site", "version", "at", hashes)


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(hash, first): lines on at least ``min_sites`` different sites, and the smallest id that has each.

    ``lines`` has (id, site, hash). The band that is counted exactly is at least one site wide on either
    side and spans ERRORS standard errors, so the set is that of an exact count.
    """
    slack = max(1.0, math.ceil(min_sites * ERRORS * 1.04 / math.sqrt(1 << LG_K)))
    sketches = lines.groupBy("hash").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.min("id").alias("first"))
    spread = sketches.select("hash", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    wide = stored(spread.filter(F.col("sites") >= min_sites - slack), "line-sites")
    near = wide.filter(F.col("sites") <= min_sites + slack)
    exact = lines.join(near.select("hash"), "hash", "left_semi").groupBy("hash").agg(F.count_distinct("site").alias("n"))
    enough = exact.filter(F.col("n") >= min_sites).select("hash")
    return wide.filter(F.col("sites") > min_sites + slack).select("hash", "first").unionByName(near.join(enough, "hash", "left_semi").select("hash", "first"))


def drop_boilerplate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES
) -> DataFrame:
    """``docs`` with the text cleaned, and ``n_lines`` and ``n_removed`` BIGINT.

    Lines end with a line feed; blanks around a line do not count, and empty lines are never removed. A null
    site is a site of its own; a null text stays null and has no lines. A text whose every line goes becomes
    empty. A line that all of whose rows lack an id stays in them. Rows that repeat an id are cleaned one by
    one, and the line stays in all rows with the smallest id. Other columns pass through; columns named
    n_lines or n_removed are replaced. An empty table gives no rows.
    """
    source = docs.drop("n_lines", "n_removed")
    site = F.coalesce(F.concat(F.lit("s"), F.col(site_col).cast("string")), F.lit(""))
    lines = _lines(source.select(F.col(id_col).alias("id"), site.alias("site"), F.col(text_col).alias("text")))
    common = boilerplate(lines, min_sites)
    gone = lines.join(common, "hash").filter(~F.col("id").eqNullSafe(F.col("first")))
    marks = gone.groupBy("id", "version").agg(F.collect_set("at").alias("marks"))
    rows = source.select(F.struct("*").alias("row"), F.xxhash64(text_col).alias("version"))
    on = rows["row"][id_col].eqNullSafe(marks["id"]) & (rows["version"] == marks["version"])
    out = rows.join(marks, on, "left").select("row", F.split(F.col("row")[text_col], "\n", -1).alias("lines"), "marks")
    n = F.coalesce(F.size("lines"), F.lit(0))
    removed = F.coalesce(F.size("marks"), F.lit(0))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "marks")
    cleaned = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    text = F.when(F.col("marks").isNull(), F.col("row")[text_col]).otherwise(cleaned)
    kept = [(text if c == text_col else F.col("row")[c]).alias(c) for c in source.columns]
    return out.select(*kept, F.when(n < 0, 0).otherwise(n).cast("bigint").alias("n_lines"), F.when(removed < 0, 0).otherwise(removed).cast("bigint").alias("n_removed"))

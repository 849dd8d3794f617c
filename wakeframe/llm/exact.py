"""Exact duplicates by content sort, with DataFrame functions only.

Texts are ranged over the partitions by sampled splitters (first characters, then a hash that equal texts
share), sorted there with spilling, and neighbours compared in full. A text that more than a small share of
all rows repeats is cut into several runs, whose results (one row each) are merged afterwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from wakeframe.llm.stored import stored

PREFIX = 64
# A text is hot if its rows exceed 1 / (SHARE * shuffle partitions) of all, and this number.
SHARE = 4
HOT_ROWS = 1000


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] = lambda t: t
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row for each row of ``docs``.

    Texts are equal when their normalised bytes are; null counts as empty. Of equal texts the row with the
    smallest (or largest) id stays; a row without an id stays only where no other has one. Rows that repeat
    an id and a text are told apart: one of them stays. Other columns are not read. An empty table gives no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep}")
    spark = docs.sparkSession
    text = F.coalesce(normalise(F.col(text_col)), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("hash", F.xxhash64("text"))

    # At most SHARE * partitions texts can be hot, whatever the data: a bound for the broadcast.
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = max(HOT_ROWS, -(-docs.count() // (SHARE * partitions)))
    counts = rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    hot = counts.select("hash", F.ceil(F.col("n") / limit).cast("int").alias("runs"))
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id"), "runs"), F.lit(0)).cast("int")
    tagged = rows.join(F.broadcast(hot), "hash", "left").withColumns(
        {"salt": salt, "hot": F.col("runs").isNotNull(), "prefix": F.substring("text", 1, PREFIX)}
    )

    # The windows need their keys together, which the ranges already give: no second exchange, one external sort.
    ranged = tagged.drop("runs").repartitionByRange("prefix", "hash", "salt")
    order = F.col("doc_id").asc_nulls_last() if keep == "smallest" else F.col("doc_id").desc_nulls_last()
    run = W.partitionBy("prefix", "hash", "salt", "text").orderBy(order)
    whole = run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    best = F.min if keep == "smallest" else F.max
    runs = ranged.select(
        "doc_id",
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        "hot",
        "salt",
        best("doc_id").over(whole).alias("run_keep"),
        F.count(F.lit(1)).over(whole).alias("run_size"),
        F.row_number().over(run).alias("at"),
    )
    base = stored(runs, "exact-runs")
    heads = base.filter(F.col("hot") & (F.col("at") == 1)).groupBy("text_sha256")
    merged = heads.agg(best("run_keep").alias("all_keep"), F.sum("run_size").alias("all_size"), F.min("salt").alias("first_salt"))
    out = base.join(F.broadcast(merged), "text_sha256", "left")  # no more rows than hot texts
    keep_id = F.when(F.col("all_size").isNotNull(), F.col("all_keep")).otherwise(F.col("run_keep"))
    # Without any id in a hot group, the first row of its first run stays.
    mine = F.col("doc_id").eqNullSafe(keep_id) & (F.col("doc_id").isNotNull() | F.col("salt").eqNullSafe(F.coalesce("first_salt", "salt")))
    return out.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("all_size", "run_size").alias("group_size"),
        ((F.col("at") == 1) & mine).alias("kept"),
        "text_sha256",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows whose text another row keeps: for ids that are unique and not null."""
    stay = exact_groups(docs, id_col, **options).filter("kept").select(F.col("doc_id").alias("_stays"))
    return docs.join(stay, docs[id_col] == stay["_stays"], "left_semi")

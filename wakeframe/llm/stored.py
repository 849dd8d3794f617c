"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from wakeframe.session import scratch

# Bytes of rows that a Python worker gets at a time.
BATCH_BYTES = 4 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, with the session's bound on the bytes of an Arrow batch lowered to BATCH_BYTES (a longer row goes alone).

    Spark reads that setting when the query runs.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark: SparkSession = df.sparkSession
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return df


def in_batches(df: DataFrame, run, schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` on batches of bounded bytes, whatever the rows' sizes."""
    return in_small_batches(df).mapInArrow(run, schema)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet beside the checkpoints and read again.

    What a lost executor held is not computed anew: the rows, and ids that depend on the partitioning,
    are those of the committed files. Readers prune columns and know the size.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Session-level helpers: intermediate tables and checkpoints in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# The temporary folder of each application that has no shared one.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder of a single machine.

    On a cluster executors do not see each other's disks, so there the setting must be there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="wakeframe-")
    return _OWN[app]


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the cluster's shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_folder(spark)}/wakeframe-{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with its file system's scheme: what Spark takes it for, for readers outside of Spark."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()


def written(df: DataFrame, name: str = "side") -> DataFrame:
    """``df`` computed once into the shared folder and read from there.

    Its size is then known, so Catalyst broadcasts a small one and shuffles a large one, and rows
    that depend on the partitioning stay as they were written.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on an input too small to be split; a large scan keeps its own splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

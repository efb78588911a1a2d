"""Shared-storage helpers: where operators cut lineage so that lost executors cost little.

Everything goes to the folder the session names in ``spark.checkpoint.dir``, which all
executors and the driver share. Only where it is unset, on a local master, a folder of our
own is chosen; on a cluster that would be a folder of one machine, and is refused.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="refrain-checkpoint-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


#: Spark deletes a query's shuffle files at its end; else they stay until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back without lineage.

    Nothing reads its shuffles again, so they go when it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/refrain-{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._refrain_path = path
    return stored


def is_stored(df: DataFrame) -> bool:
    """Whether ``df`` is a table as ``materialize`` returned it."""
    return hasattr(df, "_refrain_path")


def spread(table: DataFrame) -> DataFrame:
    """A table as read; where its scan has fewer tasks than there are cores, its rows are dealt to twice as many.

    For scans in front of costly functions: a file of one row group is one task, whatever its
    size. So few tasks are a small table, and a large one is left where it is.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(2 * cores) if table.rdd.getNumPartitions() < cores else table


def discard(*stored: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once nothing that is still to run reads it."""
    for df in stored:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._refrain_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

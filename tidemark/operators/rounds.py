"""Lineage of iterative operators, cut in the shared folder."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def cut(rows: DataFrame) -> DataFrame:
    """The rows, written and read again through ``checkpoint()``: what follows depends on files and not on how they came about.

    The folder is the one that ``spark.checkpoint.dir`` names. Where that is unset, which is allowed on a local master only, it is a temporary one.
    """
    spark = rows.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="tidemark-rounds-")
        sc.setCheckpointDir(folder)
    return rows.checkpoint()


def cut_by(rows: DataFrame, key: str) -> DataFrame:
    """:func:`cut`, keeping that rows are dealt out by ``key``, so that joins on it move the other side only. Adaptive execution would forget it, so it pauses for this one write."""
    spark = rows.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortWithinPartitions(key))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def sweep(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files and checkpoints that nothing refers to any more; references from Python go some time after its objects."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)

"""What the training-data operators share: durable cut points, code shipping and skew-proof group lookup."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shipping import ship as ship_code

#: A group is hot when it holds at least this share of all rows, so there can be at most 1 / HOT_SHARE hot groups.
HOT_SHARE = 0.001

#: Bytes of a batch between the JVM and Python, so that rows with long texts come in small batches.
BATCH_BYTES = 4 << 20

_held: dict[str, Any] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where that is unset, a local master gets a temporary folder; a cluster gets an error, as no folder of one machine
    can be read by the others.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and cut its lineage; it survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def without_estimates(df: DataFrame) -> DataFrame:
    """A checkpoint without the size that its plan was estimated at.

    Spark carries the estimate along and multiplies those of both sides of a join. After dozens of joins, as when an
    operator calls itself, it is a number of millions of digits, and planning takes minutes. Where this Spark can't do without, it stays.
    """
    spark = df.sparkSession
    try:
        return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)
    except Py4JError:
        return df


def durable_by(df: DataFrame, key: str, number: int | None = None) -> DataFrame:
    """:func:`durable`, keeping that rows are dealt out and sorted by ``key``, so that joins on it move the other side only.

    Adaptive execution would forget how rows are dealt out, so it pauses for this one write.
    """
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        shared_dir(spark)
        return df.repartition(number or parts(spark), key).sortWithinPartitions(key).checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_state(name: str, make: Callable[[], Any] = dict) -> Any:
    """What a Python worker keeps from task to task, for one operator at a time: another operator's state goes first."""
    if name not in _held:
        _held.clear()
        _give_back()
        _held[name] = make()
    return _held[name]


def _give_back() -> None:
    """Return memory that earlier tasks of this worker have freed to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch function that begins without what other operators left in the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state(f.__module__)
        _give_back()
        return f(batches)

    return run


def ship(spark: SparkSession) -> None:
    """Give executors this package's code once per application, and bound the bytes of a batch unless that is set."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    ship_code(spark)


def in_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` for ``f`` run tidily, with the package's code on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(tidy(f), schema)


def sweep(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files and checkpoints that nothing refers to any more.

    References from Python go some time after its objects, so Java's garbage is collected again after a while.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def look_up(members: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of ``members`` with ``groups``, which has one row per ``key`` (string, binary or long), without a hot task.

    Groups of at least ``HOT_SHARE`` of all ``total`` members are at most ``1 / HOT_SHARE`` rows, so they are
    broadcast; their members then carry a stand-in for the key and spread over the shuffle of the rest. Should a
    stand-in equal a key, the broadcast values still win.
    """
    values = [c for c in groups.columns if c != key]
    hot_at = max(1000, int(total * HOT_SHARE))
    hot = groups.filter(F.col(size) >= hot_at).select(F.col(key), *(F.col(c).alias(f"__hot_{c}") for c in values))
    cold = groups.filter(F.col(size) < hot_at).select(F.col(key).alias("__cold"), *(F.col(c).alias(f"__cold_{c}") for c in values))
    out = members.join(F.broadcast(hot), key, "left")
    other = F.xxhash64(F.monotonically_increasing_id())
    kind = dict(members.dtypes)[key]
    spread = F.when(F.col(f"__hot_{size}").isNull(), F.col(key)).otherwise(other if kind == "bigint" else other.cast("string").cast(kind))
    out = out.withColumn("__route", spread)
    out = out.join(cold, out["__route"] == cold["__cold"], "left")
    return out.select(*members.columns, *(F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in values))


def row_key(id_col: Column, text_hash: Column) -> Column:
    """What tells a row of one id and text from others, whether ids repeat or are null."""
    return F.concat(F.coalesce(F.concat(F.lit("="), id_col.cast("string")), F.lit("")), F.lit(":"), text_hash)


def rows_with_keys(docs: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for each :func:`row_key` in ``kept`` (column key). Rows that repeat a key are folded map-side first."""
    keyed = docs.withColumn("__key", key).dropDuplicates(["__key"])
    return keyed.join(kept.select(F.col("key").alias("__key")), "__key", "left_semi").drop("__key")

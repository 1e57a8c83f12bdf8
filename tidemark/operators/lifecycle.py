"""Life cycle of indexes: retention by level, pruning, rebuilding and compaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Retention

#: Levels in order; month and year are never pruned.
ORDER = ("segment", "grip", "day", "week", "month", "year")
PROTECTED = ("month", "year")


def retention_days(level: Column, config: Retention = Retention()) -> Column:
    out = F.lit(None).cast("int")
    for name in ("segment", "grip", "day", "week"):
        out = F.when(level == name, getattr(config, name)).otherwise(out)
    return out


def expired(docs: DataFrame, as_of: Column, config: Retention = Retention(), ts: str = "ts", level: str = "level") -> DataFrame:
    """Documents older than their level keeps; a document without a time, or of a protected level, stays."""
    cutoff = as_of - F.make_interval(days=retention_days(F.col(level), config))
    return docs.filter(F.coalesce(F.col(ts) < cutoff, F.lit(False)))


def kept(docs: DataFrame, as_of: Column, config: Retention = Retention(), ts: str = "ts", level: str = "level") -> DataFrame:
    cutoff = as_of - F.make_interval(days=retention_days(F.col(level), config))
    return docs.filter(~F.coalesce(F.col(ts) < cutoff, F.lit(False)))


def prune_counts(docs: DataFrame, as_of: Column, config: Retention = Retention(), level: str = "level") -> DataFrame:
    """What a prune would remove, by level."""
    return expired(docs, as_of, config, level=level).groupBy(level).agg(F.count(F.lit(1)).alias("n"))


def at_or_above(docs: DataFrame, least: str, level: str = "level") -> DataFrame:
    """Documents of a level and those above it, as a rebuild keeps them."""
    return docs.filter(F.col(level).isin(*ORDER[ORDER.index(least) :]))


def compact(spark: SparkSession, source: str, target: str, files: int) -> None:
    """Rewrite a table into a number of files."""
    spark.read.parquet(source).repartition(files).write.mode("overwrite").option("compression", "zstd").parquet(target)

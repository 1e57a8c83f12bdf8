"""Vector expressions over arrays, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products; for vectors of length 1 this is the cosine."""
    return F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(as_doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def normalise(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    size = norm(a)
    return F.when(size > 0, F.transform(as_doubles(a), lambda x: x / size)).otherwise(as_doubles(a))


def literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def centroids(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, embedding, n: the mean of each key's vectors at length 1. Components are summed map-side, by place."""
    parts = rows.select(key, F.posexplode(as_doubles(F.col(vector))).alias("place", "x"))
    means = parts.groupBy(key, "place").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    folded = means.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("xs"), F.max("n").alias("n"))
    return folded.select(key, normalise(F.transform("xs", lambda p: p["x"])).alias("embedding"), "n")

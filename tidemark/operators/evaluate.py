"""Evaluation: percentiles, accuracy, recall, compression and scores by question type."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_statistics(rows: DataFrame, value: str, ranks: Callable[[int], Sequence[int]], buckets: int = 4096) -> list[Any]:
    """The values at ranks (from 0, given the number of values) in ascending order; nulls and NaN take no part.

    Each round counts the values of the narrowest range known for each rank by buckets of equal width, with the least
    and the greatest of each bucket, and goes on inside the bucket that the rank lies in, until that holds one value.
    Nothing is sorted, and the driver gets at most ``buckets`` rows a rank and round. Ends have buckets of their
    own, so each round narrows a range however values are spread.
    """
    values = rows.select(F.col(value).alias("value")).filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    total, lo, hi = values.agg(F.count(F.lit(1)), F.min("value"), F.max("value")).first()
    wanted = list(ranks(total)) if total else []
    ranges = {r: (lo, hi, 0) for r in wanted}  # least, greatest, and how many values lie before
    while open_ := {x for x in ranges.values() if x[0] != x[1]}:
        ends = sorted(open_)
        at = F.lit(None).cast("int")
        inside = F.lit(None).cast("int")
        for k, (lo, hi, _) in enumerate(ends):
            v, a, b = (c.cast("double") / 2 for c in (F.col("value"), F.lit(lo), F.lit(hi)))
            share = (v - a) / (b - a) * (buckets - 2)
            middle = F.when(F.isnan(share), 1).otherwise(1 + F.least(F.floor(share), F.lit(buckets - 3))).cast("int")
            here = F.col("value").between(F.lit(lo), F.lit(hi))
            at = F.when(here, k).otherwise(at)
            inside = F.when(here, F.when(F.col("value") == F.lit(lo), 0).when(F.col("value") == F.lit(hi), buckets - 1).otherwise(middle)).otherwise(inside)
        counts = values.select("value", at.alias("at"), inside.alias("bucket")).filter("at IS NOT NULL").groupBy("at", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        found: dict[int, list] = {}
        for r in sorted(counts.collect()):  # buckets x ranks at most
            found.setdefault(r["at"], []).append(r)
        for rank, (lo, hi, before) in list(ranges.items()):
            if lo == hi:
                continue
            for r in found[ends.index((lo, hi, before))]:
                if rank < before + r["n"]:
                    ranges[rank] = (r["lo"], r["hi"], before)
                    break
                before += r["n"]
    return [ranges[r][0] for r in wanted]


def percentile_nearest(rows: DataFrame, value: str, p: float, buckets: int = 4096) -> DataFrame:
    """The value at rank round(p / 100 x (n - 1)), half up, of those that aren't null; null if there is none."""
    found = order_statistics(rows, value, lambda n: [math.floor(p / 100.0 * (n - 1) + 0.5)], buckets)
    return rows.sparkSession.createDataFrame([(found[0] if found else None,)], f"value {dict(rows.dtypes)[value]}")


def percentiles_linear(rows: DataFrame, value: str, buckets: int = 4096) -> DataFrame:
    """p50, p90 and p99 by linear interpolation between the two values next to the rank; null if there is none."""
    places: list[float] = []

    def ranks(n: int) -> list[int]:
        places.extend(p / 100 * (n - 1) for p in (50, 90, 99))
        return [r for x in places for r in (math.floor(x), math.ceil(x))]

    found = [float(x) for x in order_statistics(rows, value, ranks, buckets)]
    between = [(found[2 * k] + (found[2 * k + 1] - found[2 * k]) * (x - math.floor(x)) if x % 1 else found[2 * k]) for k, x in enumerate(places)] or [None] * 3
    return rows.sparkSession.createDataFrame([tuple(between)], "p50 double, p90 double, p99 double")


def accuracy(rows: DataFrame, hit: Column) -> DataFrame:
    return rows.agg(F.coalesce(F.avg(hit.cast("double")), F.lit(0.0)).alias("accuracy"))


def recall_at_k(results: DataFrame, relevant: DataFrame, k: int, query: str = "query_id", doc: str = "doc_id") -> DataFrame:
    """The share of relevant pairs that are among the first k results; 0 without relevant pairs."""
    found = results.filter(F.col("rank") <= k).select(query, doc).distinct().withColumn("__hit", F.lit(1))
    joined = relevant.select(query, doc).distinct().join(found, [query, doc], "left")
    return joined.agg(F.coalesce(F.avg(F.coalesce("__hit", F.lit(0)).cast("double")), F.lit(0.0)).alias("recall"))


def compression(rows: DataFrame, before: Column, after: Column) -> DataFrame:
    """1 - after / before, 0 without input."""
    sums = rows.agg(F.sum(before).alias("b"), F.sum(after).alias("a"))
    return sums.select(F.when(F.col("b") > 0, 1 - F.col("a") / F.col("b")).otherwise(F.lit(0.0)).alias("compression"))


def by_type(rows: DataFrame, kind: str, hit: Column) -> DataFrame:
    """Accuracy of each type and, as type "all", of everything, in one pass."""
    out = rows.rollup(kind).agg(F.sum(hit.cast("int")).alias("correct"), F.count(F.lit(1)).alias("total"), F.grouping(kind).alias("__all"))
    return out.select(F.when(F.col("__all") == 1, "all").otherwise(F.col(kind)).alias(kind), "correct", "total", (F.col("correct") / F.col("total")).alias("score"))


def regression(now: dict[str, float], base: dict[str, float]) -> dict[str, str]:
    """ok, warning or severe for each step's milliseconds: severe from +50 ms or 30 %, warning from +25 ms or 15 %."""
    out = {}
    for step, ms in now.items():
        if step not in base:
            continue
        more, share = ms - base[step], ms / base[step] - 1 if base[step] else 0.0
        out[step] = "severe" if more >= 50 or share >= 0.30 else "warning" if more >= 25 or share >= 0.15 else "ok"
    return out


def regressions(now: DataFrame, base: DataFrame, step: str = "step") -> DataFrame:
    """step, ms_verdict and throughput_verdict of the steps that both tables have (step, ms, throughput; each a number or null).

    Milliseconds are judged as by :func:`regression`; a throughput by its loss, severe from 30 % and a warning from 15 %.
    """
    both = now.select(step, F.col("ms").alias("__ms"), F.col("throughput").alias("__rate")).join(base.select(step, F.col("ms").alias("__ms0"), F.col("throughput").alias("__rate0")), step)
    more, share = F.col("__ms") - F.col("__ms0"), F.coalesce(F.try_divide(F.col("__ms"), F.col("__ms0")) - 1, F.lit(0.0))
    slower = F.when(more.isNull(), None).when((more >= 50) | (share >= 0.30), "severe").when((more >= 25) | (share >= 0.15), "warning").otherwise("ok")
    loss = 1 - F.try_divide(F.col("__rate"), F.col("__rate0"))
    less = F.when(loss.isNull(), None).when(loss >= 0.30, "severe").when(loss >= 0.15, "warning").otherwise("ok")
    return both.select(step, slower.alias("ms_verdict"), less.alias("throughput_verdict"))

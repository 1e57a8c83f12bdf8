"""The novelty gate: which events are new enough to index."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Dedup
from ..shipping import map_batches
from .similarity import most_similar_earlier


def skip_reason(text: Column, embedding: Column, enabled: bool = True, index_ready: bool = True, config: Dedup = Dedup()) -> Column:
    """Why an event isn't compared, in order; null if it is. Events that aren't compared pass."""
    if not enabled:
        return F.lit("disabled")
    short = F.octet_length(F.coalesce(text, F.lit(""))) < config.min_text_bytes
    out = F.when(short, "short_text").when(embedding.isNull(), "no_embedding")
    return out if index_ready else out.otherwise(F.lit("index_not_ready"))


def ring_buffer(rows: DataFrame, key: str, order: str, vector: str, config: Dedup = Dedup()) -> DataFrame:
    """key, order, decision and similarity: each row against the last accepted rows of its key.

    Only accepted rows enter the buffer, so each decision changes later ones; rows are sorted and folded in a stream,
    and a task holds one buffer.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, deque(maxlen=config.buffer)
        for b in batches:
            decisions, scores = [], []
            for k, v in zip(b["k"].tolist(), b["v"].tolist(), strict=True):
                if k != now:
                    now = k
                    held.clear()
                v = np.asarray(v, dtype=np.float64)
                score = float((np.stack(held) @ v).max()) if held else None
                duplicate = score is not None and score > config.threshold
                if not duplicate:
                    held.append(v)
                decisions.append("duplicate" if duplicate else "new")
                scores.append(score)
            yield pd.DataFrame({"k": b["k"], "o": b["o"], "decision": decisions, "similarity": scores})

    kinds = dict(rows.dtypes)
    given = rows.select(F.col(key).alias("k"), F.col(order).alias("o"), F.col(vector).alias("v"))
    out = map_batches(given.repartition("k").sortWithinPartitions("k", "o"), fold, f"k {kinds[key]}, o {kinds[order]}, decision string, similarity double")
    return out.select(F.col("k").alias(key), F.col("o").alias(order), "decision", "similarity")


def nearest_earlier(rows: DataFrame, key: str, order: str, vector: str) -> DataFrame:
    """key, order and similarity to the most similar earlier row of the key."""
    return most_similar_earlier(rows, key, order, vector)


def decision_counts(decisions: DataFrame) -> DataFrame:
    """Counters of the gate: rows by decision and their total."""
    return decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))

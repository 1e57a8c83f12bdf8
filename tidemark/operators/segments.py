"""Segments of an event stream: by gap, by gap and token budget, and the overlap carried into the next segment."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Segmentation
from ..functions import timekeys
from ..functions.scoring import token_estimate
from ..functions.text import cut_bytes
from ..shipping import map_batches
from .toc import mock_summary


def event_tokens(events: DataFrame, config: Segmentation = Segmentation(), text: str = "text") -> DataFrame:
    """Events with tokens; long tool results count by their first bytes only."""
    long_tool = (F.col("event_type") == "tool_result") & (F.octet_length(text) > config.tool_text_bytes)
    return events.withColumn("tokens", token_estimate(F.when(long_tool, cut_bytes(F.col(text), config.tool_text_bytes)).otherwise(F.col(text))))


def by_gap(events: DataFrame, key: str, config: Segmentation = Segmentation(), ts: str = "ts", order: str = "event_id") -> DataFrame:
    """Events with segment_no from 0: a gap above the limit begins a segment; an equal one doesn't."""
    w = Window.partitionBy(key).orderBy(ts, order)
    gap = F.unix_millis(ts) - F.unix_millis(F.lag(ts).over(w))
    return events.withColumn("__new", F.coalesce((gap > config.gap_ms).cast("int"), F.lit(0))).withColumn("segment_no", F.sum("__new").over(w)).drop("__new")


def by_gap_and_tokens(events: DataFrame, key: str, config: Segmentation = Segmentation(), ts: str = "ts", order: str = "event_id") -> DataFrame:
    """key, order and segment_no: a gap above the limit, or a token sum that would exceed the budget, begins a segment.

    The sum starts anew with each segment, so it depends on its own past and no window can express it. Rows are sorted
    by key inside partitions and folded in a stream: a key's events are never gathered, whatever their number.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last, used, number = None, 0, 0, 0
        for rows in batches:
            out = []
            for k, ms, tokens in zip(rows["k"].tolist(), rows["ms"].tolist(), rows["tokens"].tolist(), strict=True):
                if k != now:
                    now, number, used = k, 0, tokens
                elif ms - last > config.gap_ms or used + tokens > config.max_tokens:
                    number, used = number + 1, tokens
                else:
                    used += tokens
                last = ms
                out.append(number)
            yield pd.DataFrame({"k": rows["k"], "o": rows["o"], "segment_no": out})

    kinds = dict(events.dtypes)
    rows = events.select(F.col(key).alias("k"), F.col(order).alias("o"), F.unix_millis(ts).alias("ms"), "tokens")
    folded = map_batches(rows.repartition("k").sortWithinPartitions("k", "ms", "o"), fold, f"k {kinds[key]}, o {kinds[order]}, segment_no int")
    return folded.select(F.col("k").alias(key), F.col("o").alias(order), "segment_no")


def summarise_segments(events: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """start, end, events and tokens of each segment."""
    return events.groupBy(key, "segment_no").agg(F.min(ts).alias("start_ts"), F.max(ts).alias("end_ts"), F.count(F.lit(1)).alias("n_events"), F.sum("tokens").alias("tokens"))


def segment_nodes(events: DataFrame, key: str, ts: str = "ts", order: str = "event_id", text: str = "text") -> DataFrame:
    """A node for each segment of ``events`` (with segment_no): a fixed id, bounds, parent, and the summary of its events."""
    rows = events.withColumn("__seg", F.concat_ws("-", F.col(key).cast("string"), F.col("segment_no").cast("string")))
    bounds = rows.groupBy("__seg").agg(F.min(ts).alias("start_time"), F.max(ts).alias("end_time"))
    nodes = mock_summary(rows.withColumn("__order", F.struct(ts, order)), "__seg", text, "__order").join(bounds, "__seg")
    s = F.col("start_time")
    return nodes.select(
        timekeys.node_id("segment", s, F.col("__seg")).alias("node_id"),
        F.lit("segment").alias("level"),
        timekeys.parent_id("segment", s).alias("parent_id"),
        "title",
        "start_time",
        "end_time",
        F.array("bullet_first", "bullet_last", "bullet_total").alias("bullets"),
        "keywords",
    )


def overlap(events: DataFrame, key: str, config: Segmentation = Segmentation(), ts: str = "ts", order: str = "event_id") -> DataFrame:
    """The events of each segment that the next one gets as context: from its end back, inside the time and token limits."""
    back = Window.partitionBy(key, "segment_no").orderBy(F.desc(ts), F.desc(order))
    whole = Window.partitionBy(key, "segment_no")
    rows = events.withColumn("__used", F.sum("tokens").over(back.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__age", F.unix_millis(F.max(ts).over(whole)) - F.unix_millis(ts))
    return rows.filter((F.col("__used") <= config.overlap_tokens) & (F.col("__age") <= config.overlap_ms)).drop("__used", "__age")

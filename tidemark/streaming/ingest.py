"""Streaming: validated ingestion, windows, segment sessions, near-duplicate gate and index sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Segmentation
from ..shipping import ship
from ..sources.tables import is_structural


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def valid(events: DataFrame) -> DataFrame:
    """Events with an id, a time and a type."""
    return events.filter("event_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL")


def once(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event id once within the watermark; events later than that are dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def gated(events: DataFrame, min_bytes: int = 50) -> DataFrame:
    """Events with gate: structural and short ones pass without comparison."""
    reason = F.when(is_structural(F.col("event_type")), "structural").when(F.octet_length("text") < min_bytes, "short_text").otherwise("compare")
    return events.withColumn("gate", reason)


def tumbling(events: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Events of each agent and window; weeks begin on Monday."""
    monday = F.window("ts", width, width, "4 days") if width == "7 days" else F.window("ts", width)
    return events.withWatermark("ts", delay).groupBy(monday.alias("w"), "agent").agg(F.count(F.lit(1)).alias("n_events"))


def sliding(events: DataFrame, width: str, slide: str, delay: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("value"))


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Session windows of each key: the gap rule of segments."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n_events"))


def segment_stream(events: DataFrame, key: str, config: Segmentation = Segmentation()) -> DataFrame:
    """Segments by gap and token budget in a stream: state is the open segment's number, end and tokens.

    Rows of a batch are folded in time order; a row that comes late joins the open segment, as a negative gap never splits.
    """

    def fold(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, last, used = state.get if state.exists else (0, None, 0)
        rows = pd.concat(list(batches)).sort_values(["ms", "event_id"])
        out = []
        for ms, tokens in zip(rows["ms"].tolist(), rows["tokens"].tolist(), strict=True):
            if last is not None and (ms - last > config.gap_ms or used + tokens > config.max_tokens):
                number, used = number + 1, 0
            last, used = ms, used + tokens
            out.append(number)
        state.update((number, last, used))
        yield pd.DataFrame({"key": rows["key"], "event_id": rows["event_id"], "segment_no": out})

    rows = events.select(F.col(key).alias("key"), "event_id", F.unix_millis("ts").alias("ms"), "tokens")
    kinds = dict(rows.dtypes)
    ship(events.sparkSession)
    return rows.groupBy("key").applyInPandasWithState(fold, f"key {kinds['key']}, event_id {kinds['event_id']}, segment_no int", "number int, last long, used long", "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> int:
    """Run what is available through a batch sink and return the number of batches that had rows."""
    seen = [0]

    def each(batch: DataFrame, number: int) -> None:
        sink(batch, number)
        seen[0] += 1

    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return seen[0]


def idempotent_sink(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch into a folder of its own, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write

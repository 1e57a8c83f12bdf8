"""The novelty gate as a stream: which events are stored, which are indexed, and why."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..config import Dedup
from ..operators.dedup import skip_reason
from ..shipping import ship
from ..sources.tables import is_structural

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside keep their state where lists, values and timers of a key can be held."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class _Gate(StatefulProcessor):
    """State of a key: the ids seen, each until the watermark has passed it by ``idle_ms``, and the last accepted vectors.

    Both are lists that a trigger reads and writes once a key. A timer clears a key that has been idle.
    """

    def __init__(self, config: Dedup, idle_ms: int) -> None:
        self.config, self.idle_ms = config, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "v array<double>")
        self.seen = handle.getListState("seen", "event_id string, ms bigint")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        given = pd.concat(list(rows)).sort_values(["ms", "event_id"], ignore_index=True)  # what one trigger brings for a key
        seen = {name: ms for name, ms in self.seen.get()} if self.seen.exists() else {}
        held = deque((np.asarray(v[0], dtype=np.float64) for v in self.held.get()) if self.held.exists() else (), maxlen=self.config.buffer)
        out: list[tuple] = []
        accepted = False
        for event, ms, gate, v in zip(given["event_id"].tolist(), given["ms"].tolist(), given["gate"].tolist(), given["v"], strict=True):
            name = str(event)
            if name in seen:
                out.append((event, False, gate, None, False))
                continue
            seen[name] = ms
            score, duplicate = None, False
            if gate == "compare":
                x = np.asarray(v, dtype=np.float64)
                score = max((float(h @ x) for h in held), default=None)
                duplicate = score is not None and score > self.config.threshold
                if not duplicate:
                    held.append(x)
                    accepted = True
            out.append((event, True, gate, score, duplicate))
        last = max(seen.values())
        oldest = timerValues.getCurrentWatermarkInMs() - self.idle_ms
        self.seen.put([(name, ms) for name, ms in seen.items() if ms >= oldest or ms == last])
        if accepted:
            self.held.put([(x.tolist(),) for x in held])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last + self.idle_ms)
        done = pd.DataFrame(out, columns=["event_id", "created", "gate", "similarity", "deduplicated"])
        done.insert(0, "key", [key[0]] * len(done))
        done["similarity"] = done["similarity"].astype("float64")
        yield done

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        for state in (self.held, self.seen):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


def ingest(events: DataFrame, key: str, config: Dedup = Dedup(), delay: str = "1 hour", idle_ms: int = 7 * 86_400_000, embedding: str = "embedding") -> DataFrame:
    """key, event_id, created, gate, similarity and deduplicated for each valid event of a stream (event_id, ts, event_type, text, embedding).

    Structural events, short ones and those without a vector pass uncompared, for the first reason that holds. The others are compared with the key's
    last ``config.buffer`` accepted vectors; one that is too similar is stored but not to be indexed, and doesn't enter the buffer.
    An id that comes again isn't created, unless the watermark has passed its event by ``idle_ms``. Events without id, time, type or key are invalid and left out. The events that a trigger
    brings for a key are taken by time and id, and are held by one task: ``maxFilesPerTrigger`` or the like bounds them. A key
    with no event for ``idle_ms`` loses its state when the watermark says so. Start the query inside :func:`keyed_state`.
    """
    reason = F.coalesce(F.when(is_structural(F.col("event_type")), "structural").otherwise(skip_reason(F.col("text"), F.col(embedding), config=config)), F.lit("compare"))
    valid = events.filter("event_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL").filter(F.col(key).isNotNull())
    rows = valid.withWatermark("ts", delay).select(F.col(key).alias("key"), "event_id", "ts", F.unix_millis("ts").alias("ms"), reason.alias("gate"), F.col(embedding).cast("array<double>").alias("v"))
    kinds = dict(rows.dtypes)
    ship(events.sparkSession)
    schema = f"key {kinds['key']}, event_id {kinds['event_id']}, created boolean, gate string, similarity double, deduplicated boolean"
    return rows.groupBy("key").transformWithStateInPandas(_Gate(config, idle_ms), schema, "Append", "EventTime")


def to_index(decided: DataFrame) -> DataFrame:
    """The events that go to the outbox: created and not duplicates."""
    return decided.filter("created AND NOT deduplicated").select("key", "event_id")

from __future__ import annotations

import datetime as dt
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import Dedup, Segmentation
from tidemark.operators import segments
from tidemark.sources import tables
from tidemark.streaming import gate, ingest


@pytest.fixture(scope="module")
def landed(spark, sf, tmp_path_factory):
    """Events in four files by time, with some rows twice."""
    path = str(tmp_path_factory.mktemp("stream"))
    rows = tables.events(spark, sf).withColumn("session_id", F.col("user_id"))
    for k in range(4):
        rows.filter((F.col("event_id") % 1000) * 4 < 1000 * (k + 1)).filter((F.col("event_id") % 1000) * 4 >= 1000 * k).coalesce(1).write.mode("append").parquet(path)
    rows.limit(5).coalesce(1).write.mode("append").parquet(path)
    return path, rows


def test_each_event_once(spark, landed, tmp_path):
    path, rows = landed
    stream = ingest.once(ingest.valid(ingest.read_stream(spark, path, rows.schema.simpleString()[7:-1].replace(":", " "), files_per_batch=99)), "365 days")
    out = str(tmp_path / "out")
    assert ingest.run_to_end(stream, ingest.idempotent_sink(out), str(tmp_path / "cp")) >= 1
    stored = spark.read.parquet(out)
    assert stored.count() == stored.select("event_id").distinct().count() == rows.count()


def test_tumbling_windows_match_the_batch(spark, landed, tmp_path):
    path, rows = landed
    stream = spark.readStream.schema(rows.schema).parquet(path)
    counted = ingest.tumbling(stream)
    seen = []
    ingest.run_to_end(counted, lambda b, n: seen.append({(r.w.start, r.agent): r.n_events for r in b.collect()}), str(tmp_path / "cp"), "complete")
    batch = {(r.d, r.agent): r.n for r in spark.read.parquet(path).groupBy(F.date_trunc("day", "ts").alias("d"), "agent").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert seen[-1] == batch


def test_segments_of_a_stream_match_the_batch(spark, landed, tmp_path):
    _, rows = landed
    config = Segmentation(gap_ms=86_400_000, max_tokens=20)
    given = segments.event_tokens(rows, config)
    path = str(tmp_path / "in")
    given.coalesce(1).write.parquet(path)
    stream = ingest.segment_stream(spark.readStream.schema(given.schema).parquet(path), "user_id", config)
    out = str(tmp_path / "out")
    ingest.run_to_end(stream, ingest.idempotent_sink(out), str(tmp_path / "cp"))
    found = {(r.key, r.event_id, r.segment_no) for r in spark.read.parquet(out).collect()}
    batch = {(r.user_id, r.event_id, r.segment_no) for r in segments.by_gap_and_tokens(given, "user_id", config).collect()}
    assert found == batch


def test_gate_passes_structural_and_short_events(spark):
    rows = spark.createDataFrame([("session_start", "x" * 99), ("user_message", "short"), ("user_message", "x" * 99)], "event_type string, text string")
    assert [r.gate for r in ingest.gated(rows).collect()] == ["structural", "short_text", "compare"]


def _decided(spark, folder, config, checkpoint, out, **more):
    schema = "k int, event_id bigint, ts timestamp, event_type string, text string, embedding array<double>"
    with gate.keyed_state(spark):
        stream = ingest.read_stream(spark, folder, schema)
        ingest.run_to_end(gate.ingest(stream, "k", config, **more), ingest.idempotent_sink(out), checkpoint)
    return {(r.key, r.event_id, r.created): (r.gate, None if r.similarity is None else round(r.similarity, 6), r.deduplicated) for r in spark.read.parquet(out).collect()}


def test_gate_in_a_stream_equals_the_fold(spark, tmp_path):
    """Three triggers, some ids again in a later one, a buffer that forgets, and every reason to pass."""
    rng = np.random.default_rng(3)
    config = Dedup(threshold=0.8, min_text_bytes=5, buffer=3)
    rows, wanted, held = [], {}, {}
    for n in range(120):
        v = rng.normal(size=3)
        v = None if n % 17 == 0 else (v / np.linalg.norm(v)).tolist()
        kind = "session_start" if n % 11 == 0 else "user_message"
        rows.append((n % 4, n, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n), kind, "abc" if n % 7 == 0 else "abcdef", v))
    for k, n, _, kind, text, v in rows:
        reason = "structural" if kind == "session_start" else "short_text" if len(text) < 5 else "no_embedding" if v is None else "compare"
        score, duplicate = None, False
        if reason == "compare":
            buffer = held.setdefault(k, deque(maxlen=3))
            score = max((float(np.dot(h, v)) for h in buffer), default=None)
            duplicate = score is not None and score > 0.8
            if not duplicate:
                buffer.append(v)
        wanted[k, n, True] = (reason, None if score is None else round(score, 6), duplicate)
    folder = str(tmp_path / "in")
    schema = "k int, event_id bigint, ts timestamp, event_type string, text string, embedding array<double>"
    for k in range(3):
        part = rows[40 * k : 40 * (k + 1)] + (rows[35:40] if k == 1 else []) + [(None, 999, rows[0][2], "x", "abcdef", None)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    found = _decided(spark, folder, config, str(tmp_path / "cp"), str(tmp_path / "out"))
    again = {k for k in found if not k[2]}
    assert {k: v for k, v in found.items() if k[2]} == wanted
    assert {n for _, n, _ in again} == set(range(35, 40))


def test_idle_keys_lose_their_state(spark, tmp_path):
    schema = "k int, event_id bigint, ts timestamp, event_type string, text string, embedding array<double>"
    day = dt.datetime(2024, 1, 1)
    folder = str(tmp_path / "in")
    for n, (k, days) in enumerate([(1, 0), (2, 30), (2, 31), (1, 32)]):
        spark.createDataFrame([(k, n, day + dt.timedelta(days=days), "user_message", "x" * 60, [1.0, 0.0])], schema).coalesce(1).write.mode("append").parquet(folder)
    found = _decided(spark, folder, Dedup(), str(tmp_path / "cp"), str(tmp_path / "out"))
    assert {n: v[2] for (_, n, _), v in found.items()} == {0: False, 1: False, 2: True, 3: False}

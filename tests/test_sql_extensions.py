from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import table_functions
from tidemark.sources import trace
from tidemark.streaming import ingest


def test_variants_by_a_lateral_join(spark):
    table_functions.register(spark)
    spark.createDataFrame([(1, "What is It"), (2, "plain"), (3, None), (4, "")], "id int, q string").createOrReplaceTempView("asked")
    rows = spark.sql("SELECT id, place, variant FROM asked, LATERAL query_variants(q)").collect()
    assert {tuple(r) for r in rows} == {(1, 0, "What is It"), (1, 1, "what is it"), (1, 2, "is it"), (2, 0, "plain")}


def test_field_matches_fit_any_table(spark):
    table_functions.register(spark)
    spark.createDataFrame([(1, "Red house", ["a red, red rose", None], 0.5), (2, None, None, 0.1), (3, "blue", ["green"], 0.2)], "id int, title string, bullets array<string>, w double").createOrReplaceTempView("nodes")
    out = spark.sql("SELECT * FROM field_matches(TABLE(nodes), 'red Rose')")
    assert out.columns == ["id", "w", "field", "value", "score"]
    assert {tuple(r) for r in out.collect()} == {(1, 0.5, "title", "Red house", 0.5), (1, 0.5, "bullets", "a red, red rose", 1.0)}
    assert spark.sql("SELECT * FROM field_matches(TABLE(nodes), '')").count() == 0


EVENTS = [("e1", "s", "2024-01-01T00:00:00Z", "user_message", "u", "héllo\nthere", {"a": "1"}, "x"), ("e2", "s", "2024-01-02T00:00:00.5Z", "tool_result", None, None, None, None), ("e3", "t", "2024-01-03T00:00:00Z", "user_message", "u", "y" * 500, None, "x")]


@pytest.fixture
def written(spark, tmp_path):
    trace.register(spark)
    rows = spark.createDataFrame(EVENTS, "event_id string, session_id string, ts string, event_type string, role string, text string, metadata map<string,string>, agent string").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "traces")
    rows.repartition(2).write.format("trace").mode("append").save(folder)
    return rows, folder


def _set(df):
    return {tuple(tuple(sorted(v.items())) if isinstance(v, dict) else v for v in r) for r in df.collect()}


@pytest.mark.parametrize("split", [1, 7, 64, 10_000_000])
def test_traces_read_as_written_however_they_are_split(spark, written, split):
    rows, folder = written
    found = spark.read.format("trace").option("split", split).load(folder)
    assert found.count() == 3
    assert _set(found) == _set(rows.select(found.columns))


def test_pushed_filters_give_what_filters_give(spark, written):
    rows, folder = written
    for test in ("event_type = 'user_message'", "ts >= TIMESTAMP '2024-01-02 00:00:00'", "agent IS NOT NULL AND session_id IN ('t', 'q')", "text LIKE 'y%'", "metadata IS NULL", "role IS NULL"):
        found = spark.read.format("trace").load(folder).filter(test)
        assert {r.event_id for r in found.collect()} == {r.event_id for r in rows.filter(test).collect()}, test


def test_lines_that_are_no_events_are_passed_over(spark, tmp_path):
    trace.register(spark)
    (tmp_path / "a.jsonl").write_bytes(b'\n{"event_id": "1", "ts": "2024-01-01T00:00:00"}\nnot json\n[1]\n{"event_id": null, "ts": "2024-01-01T00:00:00"}\n{"event_id": "2"}\n{"event_id": 3, "ts": "2024-01-01T01:00:00+01:00", "extra": 1}')
    (tmp_path / "_b.jsonl").write_bytes(b'{"event_id": "4", "ts": "2024-01-01T00:00:00"}')
    (tmp_path / "empty.jsonl").write_bytes(b"")
    rows = spark.read.format("trace").load(str(tmp_path)).collect()
    assert {r.event_id for r in rows} == {"1", "3"}
    assert {r.ts for r in rows} == {dt.datetime(2024, 1, 1)}
    assert spark.read.format("trace").load(str(tmp_path / "none")).count() == 0


def test_a_stream_takes_each_file_once_and_goes_on_after_a_stop(spark, written, tmp_path):
    rows, folder = written
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        ingest.run_to_end(spark.readStream.format("trace").load(folder), ingest.idempotent_sink(out), checkpoint)
        return sorted(r.event_id for r in spark.read.parquet(out).select("event_id").collect())

    assert run() == ["e1", "e2", "e3"]
    rows.limit(1).withColumn("event_id", F.lit("e4")).write.format("trace").mode("append").save(folder)
    assert run() == ["e1", "e2", "e3", "e4"]


def test_overwriting_and_failing_writes(spark, written, tmp_path):
    rows, folder = written
    bad = rows.withColumn("text", F.when(F.col("event_id") == "e3", F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no"):
        bad.write.format("trace").mode("append").save(folder)
    assert spark.read.format("trace").load(folder).count() == 3
    rows.limit(1).write.format("trace").mode("overwrite").save(folder)
    assert spark.read.format("trace").load(folder).count() == 1

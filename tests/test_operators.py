from __future__ import annotations

import math

import json

import pytest
import numpy as np
from pyspark.sql import functions as F

from tidemark.api import Engine
from tidemark.config import Dedup, Segmentation, StopConditions
from tidemark.operators import dedup, evaluate, lifecycle, ranking, search, segments, store, toc, topics
from tidemark.plans import router
from tidemark.sources import tables


def test_versions_and_upserts(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, version int, v string")
    assert {(r.k, r.v) for r in store.latest_versions(rows, "k").collect()} == {("a", "y"), ("b", "z")}
    new = spark.createDataFrame([("a",), ("c",)], "k string")
    assert {(r.k, r.version) for r in store.next_versions(new, rows, "k").collect()} == {("a", 3), ("c", 1)}


def test_page_knows_whether_more_follows(spark):
    rows = spark.range(5)
    assert [r.has_more for r in store.page(rows, ["id"], 0, 5).collect()] == [False] * 5
    assert [r.has_more for r in store.page(rows, ["id"], 2, 2).collect()] == [True] * 2
    assert store.next_token(2, 2, True) == "4"


@pytest.mark.parametrize("size", [1, 3, 50])
def test_pages_by_key_give_each_row_once(spark, size):
    rows = [(None, 1), (None, 2), (0.1, 7), (0.1, 3), (0.1, 5), (1e300, 4), (float("nan"), 6)]
    table = spark.createDataFrame(rows, "x double, id int").withColumn("ts", F.when(F.col("id") != 2, F.timestamp_micros(F.lit(1_700_000_000_000_001))))
    seen, token, more = [], None, True
    while more:
        got = store.page_after(table, ["ts", "x", "id"], token, size).collect()
        seen += [r.id for r in got]
        token, more = got[-1].token, got[-1].has_more
    assert seen == [2, 1, 3, 5, 7, 4, 6]
    assert store.page_after(table, ["ts", "x", "id"], token, size).count() == 0
    with pytest.raises(ValueError, match="3 values"):
        store.page_after(table, ["id"], token)


def test_a_token_reaches_the_scan(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet")
    plan = store.page_after(rows, ["ts", "event_id"], '["2024-01-05 00:00:00", "5"]')._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts" in plan


def test_gap_that_equals_the_limit_does_not_split(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1_800_000), (3, 3_600_001)], "event_id int, ms long").select(F.lit("k").alias("k"), "event_id", F.timestamp_millis("ms").alias("ts"), F.lit(1).cast("long").alias("tokens"))
    assert [r.segment_no for r in segments.by_gap(rows, "k").orderBy("event_id").collect()] == [0, 0, 1]
    assert [r.segment_no for r in segments.by_gap_and_tokens(rows, "k").orderBy("event_id").collect()] == [0, 0, 1]


def test_token_budget_starts_anew(spark):
    rows = spark.range(6).select(F.lit("k").alias("k"), F.col("id").alias("event_id"), F.timestamp_millis("id").alias("ts"), F.lit(4).cast("long").alias("tokens"))
    found = segments.by_gap_and_tokens(rows, "k", Segmentation(max_tokens=10)).orderBy("event_id").collect()
    assert [r.segment_no for r in found] == [0, 0, 1, 1, 2, 2]


def test_empty_tables_give_empty_results(spark):
    none = spark.createDataFrame([], "event_id long, ts timestamp, tokens long, k string, text string")
    assert segments.by_gap(none, "k").count() == 0
    assert segments.by_gap_and_tokens(none, "k").count() == 0
    assert search.bm25(none, "x", "event_id").count() == 0
    assert toc.grips(none.select("k", F.col("text").alias("bullet")), none, "k").count() == 0


def test_bm25_blank_query_and_nulls(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, None), (3, "")], "doc_id int, text string")
    assert search.bm25(docs, "  ").count() == 0
    assert [r.doc_id for r in search.bm25(docs, "ALPHA").collect()] == [1]


def test_rrf_does_not_depend_on_list_order(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.5)], "doc_id int, score double")
    b = spark.createDataFrame([(2, 7.0), (3, 1.0)], "doc_id int, score double")
    one = {r.doc_id: r.score for r in search.rrf({"x": a, "y": b}, "doc_id").collect()}
    two = {r.doc_id: r.score for r in search.rrf({"y": a, "x": b}, "doc_id").collect()}
    assert one == pytest.approx(two)
    assert one[2] == pytest.approx(1 / 62 + 1 / 61)


def test_nearest_of_a_stored_vector_is_itself(spark, sf):
    rows = tables.read(spark, sf, "embeddings")
    v = list(rows.filter("vec_id = 5").first().embedding)
    assert search.knn(rows, v, 1).first().vec_id == 5


def test_supersession_takes_the_newest_later_match(spark):
    rows = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [1.0, 0.0]), (3, 3, [0.9, 0.1]), (4, 4, [0.0, 1.0])], "doc_id int, s int, embedding array<double>").withColumn("ts", F.timestamp_seconds("s")).withColumn("k", F.lit(0))
    assert {(r.doc_id, r.newer) for r in ranking.superseded(rows, "k").collect()} == {(1, 3), (2, 3)}


def test_ring_buffer_forgets_the_oldest(spark):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(([1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [1.0, 0.0]))], "o int, v array<double>").withColumn("k", F.lit(0))
    small = dedup.ring_buffer(rows, "k", "o", "v", Dedup(buffer=1)).orderBy("o").collect()
    assert [r.decision for r in small] == ["new", "new", "new", "duplicate"]
    wide = dedup.ring_buffer(rows, "k", "o", "v").orderBy("o").collect()
    assert [r.decision for r in wide] == ["new", "new", "duplicate", "duplicate"]


def test_greedy_merge_keeps_the_more_important(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 0.2), (2, [1.0, 0.0], 0.9), (3, [0.0, 1.0], 0.1)], "topic_id int, embedding array<double>, importance_score double")
    assert {(r.topic_id, r.keeper) for r in topics.merge_similar(rows).collect()} == {(1, 2), (2, 2), (3, 3)}


def test_density_clusters_leave_noise(spark):
    points = [[1.0, 0.0], [1.0, 0.01], [1.0, 0.02], [0.0, 1.0], [0.01, 1.0], [0.02, 1.0], [-5.0, -5.0]]
    rows = spark.createDataFrame([(k + 1, v, "a") for k, v in enumerate(points)] + [(8, points[0], "b"), (9, None, "a")], "id int, v array<double>, b string")
    found = {(r.id, r.cluster) for r in topics.cluster_by_density(rows, "id", "v", "b").collect()}
    assert found == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 4), (7, -1), (8, -1)}


def test_density_clusters_part_by_part_equal_those_of_whole_blocks(spark, monkeypatch):
    """Blocks, one of them without a name, over many parts: ids that repeat and equal points too."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(260, 3)) + rng.choice([-6, 0, 6], (260, 3))
    x[5] = x[6]
    rows = [(k if k != 40 else 41, v.tolist(), (None, "a", "b")[min(k % 5, 2)]) for k, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "id int, v array<double>, b string")
    wanted = sorted(tuple(r) for r in topics.cluster_by_density(frame, "id", "v", "b").collect())
    monkeypatch.setattr(topics, "PART", 12)
    assert sorted(tuple(r) for r in topics.cluster_by_density(frame, "id", "v", "b").collect()) == wanted
    assert len({c for _, c in wanted}) > 8


def test_retention_spares_protected_levels_and_missing_times(spark):
    as_of = F.lit("2024-02-01").cast("timestamp")
    rows = spark.createDataFrame([(1, "segment", "2020-01-01"), (2, "year", "2000-01-01"), (3, "day", None)], "id int, level string, t string").withColumn("ts", F.col("t").cast("timestamp"))
    assert [r.id for r in lifecycle.expired(rows, as_of).collect()] == [1]
    assert sorted(r.id for r in lifecycle.kept(rows, as_of).collect()) == [2, 3]


def test_grips_follow_the_greedy_rule(spark):
    bullets = spark.createDataFrame([("s", "alpha beta gamma delta")], "k string, bullet string")
    lines = ["alpha beta something longer", "alpha beta gamma plus more", "nothing of that kind here", "alpha beta gamma again here"]
    rows = spark.createDataFrame([("s", k, t) for k, t in enumerate(lines)], "k string, event_id int, text string").withColumn("ts", F.timestamp_seconds("event_id"))
    found = toc.grips(bullets, rows, "k").first()
    assert (found["first"], found["last"], found.score) == ("0", "3", 0.75)


@pytest.mark.parametrize(("query", "intent"), [("show me an overview of topics", "explore"), ("where is the exact config", "locate"), ("why did it break", "answer"), ("zzz", "answer")])
def test_intents(spark, query, intent):
    assert router.classify_text(query)[0] == intent
    assert router.classify(spark.createDataFrame([(query,)], "query string")).first().intent == intent


def test_tiers_and_chains():
    assert router.tier(True, True, True) == "full"
    assert router.tier(False, False, True) == "keyword"
    assert router.chain("locate", "full") == ["bm25", "hybrid", "vector"]
    assert router.chain("answer", "keyword") == ["bm25", "agentic"]
    assert router.chain("time_boxed", "semantic") == ["vector", "agentic"]
    assert router.classify_text("how", timeout_ms=5)[0] == "time_boxed"


def test_sequential_execution_falls_back(spark):
    weak = spark.createDataFrame([(1, 0.1)], "doc_id int, score double")
    strong = spark.createDataFrame([(2, 0.9)], "doc_id int, score double")
    empty = weak.filter("false")
    layers = {"bm25": lambda q: weak, "hybrid": lambda q: empty, "vector": lambda q: strong}
    done = router.execute("q", layers, ["bm25", "hybrid", "vector"], "sequential")
    rows, tried, used = done.rows, list(done.tried), list(done.used)
    assert ([r.doc_id for r in rows.collect()], tried, used) == ([2], ["bm25", "hybrid", "vector"], ["vector"])
    done = router.execute("q", {"bm25": lambda q: weak}, ["bm25"], "sequential", StopConditions())
    rows, tried, used = done.rows, list(done.tried), list(done.used)
    assert ([r.doc_id for r in rows.collect()], used) == ([1], ["bm25"])


def test_empty_query_is_an_error(spark):
    with pytest.raises(ValueError, match="empty"):
        router.route("  ", {}, None)


def test_skill_check():
    assert router.check_skill({"name": "x", "triggers": ["y"]}) == [("error", "description"), ("warning", "retrieval"), ("warning", "fallback")]


def test_hooks_fail_open(spark):
    lines = [json.dumps({"hook_event_name": "PostToolUse", "session_id": "s", "tool_name": "Read", "tool_input": "{}", "agent": "X"}), "{broken", json.dumps({"hook_event_name": "Odd", "session_id": "s", "message": "hi"})]
    found = tables.hook_events(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r.event_type, r.role, r.text, r.agent) for r in found] == [("tool_result", "tool", "{}", "x"), ("user_message", "user", "hi", None)]


def test_missing_store_is_skipped(spark, tmp_path):
    assert tables.read_only(spark, str(tmp_path / "none")) is None


def test_sources(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"role": "user", "content": "hi"}\n')
    assert tables.jsonl_sessions(spark, str(tmp_path / "s.jsonl")).first().session == "s"
    (tmp_path / "f.toml").write_text('[[test]]\nid = "a"\nquery = "q"\nexpected_contains = ["x"]\n')
    assert tables.toml_fixtures(spark, [str(tmp_path / "f.toml")]).first().id == "a"
    (tmp_path / "bad.toml").write_text('[[test]]\nid = ""\nquery = "q"\n')
    with pytest.raises(ValueError, match="needs an id"):
        tables.toml_fixtures(spark, [str(tmp_path / "bad.toml")])
    (tmp_path / "c.json").write_text('{"conversation_id": "c", "turns": [{"role": "user", "content": "x"}], "questions": []}')
    assert tables.locomo(spark, str(tmp_path / "c.json")).first().conversation_id == "c"


def test_envelope_and_report(spark):
    found = json.loads(tables.envelope(spark.range(2), "q").first().envelope)
    assert (found["status"], found["meta"]["count"]) == ("ok", 2)
    assert "| recall | 0.5 | 0.9 |" in tables.report({"recall": 0.5}, {"other": {"recall": 0.9}})


def test_percentile_and_regression(spark):
    rows = spark.range(11).select(F.col("id").cast("double").alias("v"))
    assert evaluate.percentile_nearest(rows, "v", 90).first().value == 9.0
    assert evaluate.percentile_nearest(rows.filter("false"), "v", 90).first().value is None
    assert evaluate.regression({"a": 160, "b": 126, "c": 100.0}, {"a": 100, "b": 100, "c": 100}) == {"a": "severe", "b": "warning", "c": "ok"}


def test_throughput_is_judged_by_its_loss(spark):
    shape = "step string, ms double, throughput double"
    base = spark.createDataFrame([("a", 100.0, 100.0), ("b", 100.0, 100.0), ("c", 10.0, 100.0), ("d", None, None), ("old", 1.0, 1.0)], shape)
    now = spark.createDataFrame([("a", 110.0, 90.0), ("b", 126.0, 85.0), ("c", 13.5, 70.0), ("d", 5.0, 5.0), ("new", 1.0, 1.0)], shape)
    assert sorted(map(tuple, evaluate.regressions(now, base).collect())) == [("a", "ok", "ok"), ("b", "warning", "warning"), ("c", "severe", "severe"), ("d", None, None)]


def test_stop_presets():
    held = [StopConditions(), StopConditions.time_boxed(800), StopConditions.exploration(), StopConditions().with_beam(9)]
    assert [(s.max_depth, s.max_nodes, s.max_calls, s.max_tokens, s.timeout_ms, s.beam_width) for s in held] == [(5, 100, 20, 4000, 5000, 1), (3, 50, 10, 4000, 800, 1), (7, 200, 30, 8000, 10000, 3), (5, 100, 20, 4000, 5000, 5)]


def test_chains_and_tiers_of_columns(spark):
    from itertools import product

    ready = spark.createDataFrame(list(product([True, False], repeat=3)), "t boolean, v boolean, b boolean")
    for r in ready.withColumn("tier", router.tier_column(F.col("t"), F.col("v"), F.col("b"))).collect():
        assert r.tier == router.tier(r.t, r.v, r.b)
    pairs = spark.createDataFrame(list(product([*router.CHAINS, "time_boxed"], router.TIER_LAYERS)), "intent string, tier string")
    for r in pairs.withColumn("chain", router.chain_column(F.col("intent"), F.col("tier"))).collect():
        assert r.chain == router.chain(r.intent, r.tier)


def test_job_status(spark):
    engine = Engine(spark, {}, F.lit(0))
    for name in ("a", "b"):
        engine.jobs.add(name, lambda: None)
        engine.pause_job(name)
    engine.resume_job("a")
    engine.jobs.start("a")
    engine.jobs.start("b")
    assert [tuple(r) for r in engine.scheduler_status().select("name", "run_count", "skipped", "is_paused").collect()] == [("a", 1, 0, False), ("b", 0, 1, True)]


@pytest.mark.parametrize("values", [[1.0], [2.0] * 50, [float(k * k % 37) for k in range(101)], [10.0**k for k in range(-300, 300, 7)] + [float("inf"), float("-inf"), float("nan")], [1e308, -1e308, 0.0, 5e-324, 1.0, 1.0]])
@pytest.mark.parametrize("buckets", [4, 4096])
def test_percentiles_by_refinement_equal_sorting(spark, values, buckets):
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(3)
    order = sorted(v for v in values if v == v)
    n = len(order)
    assert evaluate.order_statistics(rows, "v", range, buckets) == order
    assert evaluate.percentile_nearest(rows, "v", 90, buckets).first().value == order[math.floor(0.9 * (n - 1) + 0.5)]


def test_percentiles_between_values(spark):
    rows = spark.createDataFrame([(v,) for v in (1, 2, 3, 10)], "v int")
    assert evaluate.percentiles_linear(rows, "v").first().asDict() == pytest.approx({"p50": 2.5, "p90": 7.9, "p99": 9.79})
    assert evaluate.percentiles_linear(rows.filter("false"), "v").first().asDict() == {"p50": None, "p90": None, "p99": None}

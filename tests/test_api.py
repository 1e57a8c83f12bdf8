from __future__ import annotations

import json
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.api import Engine
from tidemark.functions.embedding import HashingEmbedder, embed, index_missing
from tidemark.operators import topics
from tidemark.plans import catalogue, catalogue_search
from tidemark.plans.jobs import Jobs
from tidemark.sources import tables


@pytest.fixture(scope="module")
def engine(spark, sf):
    docs = tables.read(spark, sf, "documents").select("doc_id", "text").withColumn("level", F.lit("segment")).withColumn("ts", F.lit("2020-01-01").cast("timestamp"))
    vectors = docs.filter("doc_id < 50").select("doc_id", embed(F.col("text")).alias("embedding"))
    events = tables.events(spark, sf).withColumn("session_id", F.col("user_id"))
    made = {"documents": docs, "vectors": vectors, "events": events, "facts": catalogue.facts(spark, sf)}
    found = Engine(spark, made, catalogue.as_of())
    found.tables["nodes"] = found.rebuild_toc().withColumns({"bullets": F.array("title"), "keywords": F.array(F.lit("the"))})
    return found


def test_every_layer_answers(engine):
    rows, why = engine.route_query("find the exact nation")
    assert rows.count() <= 10 and why.intent == "locate" and why.tier == "hybrid"
    assert "locate" in why.markdown()
    assert engine.hybrid_search("the thereen", 5).count() == 5
    assert engine.orchestrate("What is the nation").count() <= 10
    assert {r.layer for r in engine.retrieval_capabilities().filter("ready").collect()} == {"bm25", "vector", "hybrid", "agentic"}


def test_browsing(engine):
    assert engine.get_toc_root().count() == 1
    month = engine.tables["nodes"].filter("level = 'month'").first().node_id
    weeks = engine.browse_toc(month, size=2).collect()
    assert len(weeks) == 2 and all(r.has_more for r in weeks)
    behind = engine.browse_toc(month, weeks[-1].token, size=2).collect()
    assert behind and min(r.start_time for r in behind) > max(r.start_time for r in weeks)
    assert engine.search_children(month, "the week").count() >= 1
    assert engine.search_node(month, "january").count() >= 1
    assert engine.list_agents().count() == 5
    assert engine.agent_activity("week").count() >= 5
    assert engine.prune().first().n == engine.tables["documents"].count()
    assert engine.prune(dry_run=False).count() == 0
    assert {r.name for r in engine.stats().collect()} == set(engine.tables)


def test_missing_tables_are_named(engine):
    with pytest.raises(LookupError, match="topics"):
        engine.topics_by_query("x")


def test_embedder(spark):
    a = HashingEmbedder(16).embed(["alpha beta", "alpha beta", ""])
    assert (a[0] == a[1]).all() and a[0] @ a[0] == pytest.approx(1.0) and not a[2].any()
    docs = spark.createDataFrame([(1, "x"), (2, " "), (3, "y"), (4, None)], "doc_id int, text string")
    assert [r.doc_id for r in index_missing(docs, docs.filter("doc_id = 3"), "doc_id", "text").collect()] == [1]


def test_cli(spark, sf, tmp_path, capsys):
    tables.events(spark, sf).write.parquet(f"{tmp_path}/events")
    tables.read(spark, sf, "documents").select("doc_id", "text").write.parquet(f"{tmp_path}/documents")
    base = ["--store", str(tmp_path), "--as-of", "2024-02-01"]
    for more in (["teleport", "the"], ["search", "the"], ["timeline", "--range", "3w", "--entity", "click"], ["stats"], ["rebuild"]):
        found = json.loads(cli.main(base + more))
        assert found["status"] == "ok" and found["meta"]["count"] > 0


def test_jobs(spark):
    jobs = Jobs()
    jobs.add("good", lambda: None, "* * * * *")
    jobs.add("bad", lambda: 1 / 0)
    assert jobs.start("good") == "success"
    assert jobs.start("bad").startswith("failed")
    jobs.pause("good")
    assert jobs.start("good") == "skipped"
    found = {r.name: (r.run_count, r.error_count, r.skipped) for r in jobs.status(spark).collect()}
    assert found == {"good": (1, 0, 1), "bad": (1, 1, 0)}


def test_topic_updates(spark):
    rows = spark.createDataFrame([(1, 3, "active", 0), (2, 1, "pruned", 0)], "topic_id int, node_count int, status string, s int").withColumn("last_mentioned_at", F.timestamp_seconds("s"))
    said = spark.createDataFrame([(1, 50), (1, 90)], "topic_id int, s int").select("topic_id", F.timestamp_seconds("s").alias("ts"))
    found = {r.topic_id: r.node_count for r in topics.mention(rows, said).collect()}
    assert found == {1: 5, 2: 1}
    assert topics.resurrect(rows, [2]).filter("status = 'active'").count() == 2


def test_ingest_query_adds_events_whose_shifted_id_is_stored(spark, tmp_path):
    """Ids that reach past the shift, as in a table of millions of events."""
    rows = [(i, datetime(2024, 1, 5), 1, "view", float(i % 97), "{}") for i in (1, 2, 5, 1000001, 1000003, 1000005, 2000001)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    found = catalogue_search.api_ingest(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted((i + 1000000, v) for i, _, _, _, v, _ in rows if i % 2 == 1)


def test_texts_whose_hashed_words_cancel_have_length_1(spark):
    place = lambda w: (zlib.crc32(w.encode()) % 64, zlib.crc32(w.encode()) >> 31)
    names = {place(w): w for w in (f"w{k}" for k in range(2000))}
    plus, minus = next((names[p, 1], names[p, 0]) for p in range(64) if (p, 0) in names and (p, 1) in names)
    texts = [f"{plus} {minus}", f"{minus} {plus} {plus} {minus}", "\t\n", "\u00a0"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(embed(F.col("text"), HashingEmbedder(64)).alias("e")).collect()
    assert [round(sum(x * x for x in r.e), 9) for r in rows] == [1.0] * 4
    assert not HashingEmbedder(64).embed(["", "  "]).any()

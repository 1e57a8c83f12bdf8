"""Queries over stores, sources, sinks, the time hierarchy, episodes and jobs, with the same in SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Dedup, Retention, Staleness
from ..functions import scoring, text, timekeys
from ..operators import agents, dedup, episodes, evaluate, lifecycle, ranking, search, segments, store, toc
from ..operators.indexes import WordIndex
from ..operators.indexing import catch_up, consumed, rebuild
from ..operators.journal import Journal
from ..sources import tables
from ..streaming import gate, ingest
from ..streaming.outbox import follow, followed
from . import jobs, router
from .catalogue import _ASOF_MS, _EV, _FACTS, _SALIENCE, _SEGMENTS, _TOKENS, _TURNS, _VEC, AS_OF, SEARCH, _bm25_sql, _query_vector, as_of, doc_facts, doc_nodes, facts, ms, query, r6, scratch, word_index

# Grips and documents of a store.

_GRIPS = f"""{_EV}, gr AS (SELECT event_id, 'grip:' || epoch_us(ts) // 1000 || ':' || lpad(CAST(event_id AS VARCHAR), 26, '0') AS grip_id, text AS excerpt,
    CASE WHEN event_id % 2 = 0 THEN 'toc:day:' || strftime(ts, '%Y-%m-%d') END AS toc_node_id, ts FROM ev WHERE event_type = 'purchase')"""


def _grips(spark: SparkSession, sf: str) -> DataFrame:
    """Each purchase as a grip; those with even ids belong to their day."""
    e = tables.events(spark, sf).filter("event_type = 'purchase'")
    grip_id = F.concat(F.lit("grip:"), ms("ts").cast("string"), F.lit(":"), F.lpad(F.col("event_id").cast("string"), 26, "0"))
    return e.select("event_id", grip_id.alias("grip_id"), F.col("text").alias("excerpt"), F.when(F.col("event_id") % 2 == 0, timekeys.node_id("day", F.col("ts"))).alias("toc_node_id"), "ts")


@query("grip_node_index", f"WITH {_GRIPS} SELECT DISTINCT toc_node_id, grip_id FROM gr WHERE toc_node_id IS NOT NULL")
def grip_node_index(spark: SparkSession, sf: str) -> DataFrame:
    return store.node_index(_grips(spark, sf))


@query("grips_of_node", f"WITH {_GRIPS} SELECT grip_id, excerpt FROM gr WHERE toc_node_id = 'toc:day:2024-01-05'")
def grips_of_node(spark: SparkSession, sf: str) -> DataFrame:
    node = spark.createDataFrame([("toc:day:2024-01-05",)], "node_id string")
    return store.grips_of_nodes(_grips(spark, sf), node).select("grip_id", "excerpt")


@query("grip_put_delete", f"WITH {_GRIPS} SELECT grip_id, CASE WHEN event_id % 3 = 0 THEN 'changed' ELSE excerpt END AS excerpt FROM gr WHERE event_id % 5 <> 0")
def grip_put_delete(spark: SparkSession, sf: str) -> DataFrame:
    g = _grips(spark, sf)
    put = store.upsert(g, g.filter("event_id % 3 = 0").withColumn("excerpt", F.lit("changed")), "grip_id")
    return store.delete(put, g.filter("event_id % 5 = 0"), "grip_id").select("grip_id", "excerpt")


@query("store_without_index", "SELECT event_id, user_id % 4 <> 0 OR value <= 5 AS indexed FROM events")
def store_without_index(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.events(spark, sf)
    return store.with_index_flag(e, e.filter("user_id % 4 = 0 AND value > 5")).select("event_id", "indexed")


@query("outbox_of_stored", "SELECT event_id AS seq, event_id AS doc_id, 'add' AS action FROM events WHERE user_id % 4 <> 0 OR value <= 5")
def outbox_of_stored(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.events(spark, sf)
    return store.outbox_of(store.with_index_flag(e, e.filter("user_id % 4 = 0 AND value > 5")))


@query("keyed_delete", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey <> 3")
def keyed_delete(spark: SparkSession, sf: str) -> DataFrame:
    c = tables.read(spark, sf, "customer")
    return store.delete(c, c.filter("c_nationkey = 3"), "c_custkey").select("c_custkey", "c_name")


@query("checkpoint_records", "SELECT event_type AS name, max(event_id) AS last_sequence, count(*) AS processed_count FROM events GROUP BY event_type")
def checkpoint_records(spark: SparkSession, sf: str) -> DataFrame:
    """A checkpoint for each kind of event, put twice by a job that went on, and read back."""
    e = tables.read(spark, sf, "events")
    j = Journal(spark, scratch(spark, "journal"))
    for part in (e.filter("event_id % 2 = 0"), e):
        for r in part.groupBy("event_type").agg(F.max("event_id").alias("last"), F.count(F.lit(1)).alias("n")).collect():  # a row a kind
            j.put(r["event_type"], {"last_sequence": r["last"], "processed_count": r["n"]})
    names = [r[0] for r in e.select("event_type").distinct().collect()]
    return spark.createDataFrame([(n, held["last_sequence"], held["processed_count"]) for n in names if (held := j.get(n))], "name string, last_sequence bigint, processed_count bigint")


_METADATA = "md AS (SELECT vec_id, vec_id * 3 AS doc_id, CASE WHEN label % 2 = 0 THEN 'toc_node' ELSE 'grip' END AS doc_type FROM embeddings WHERE vec_id % 7 <> 0)"


def _metadata(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("label") % 2 == 0, "toc_node").otherwise("grip")
    return tables.read(spark, sf, "embeddings").filter("vec_id % 7 <> 0").select("vec_id", (F.col("vec_id") * 3).alias("doc_id"), kind.alias("doc_type"))


@query("vector_metadata_scans", f"WITH {_METADATA} SELECT 'by_type' AS scan, vec_id FROM md WHERE doc_type = 'grip' UNION ALL SELECT 'by_doc', vec_id FROM md WHERE doc_id = 30 UNION ALL SELECT 'count', count(*) FROM md")
def vector_metadata_scans(spark: SparkSession, sf: str) -> DataFrame:
    m = _metadata(spark, sf)
    by_type = store.vectors_of_type(m, "grip").select(F.lit("by_type").alias("scan"), "vec_id")
    by_doc = store.vectors_of_document(m, 30).select(F.lit("by_doc").alias("scan"), "vec_id")
    return by_type.unionByName(by_doc).unionByName(m.agg(F.count(F.lit(1)).alias("vec_id")).select(F.lit("count").alias("scan"), "vec_id"))


@query("vector_with_metadata", f"WITH {_VEC}, {_METADATA}, k AS (SELECT vec_id, list_cosine_similarity(e, qe) AS s FROM v, q ORDER BY s DESC, vec_id LIMIT 40) SELECT vec_id, doc_id, doc_type, round(s, 6) AS score FROM k JOIN md USING (vec_id)")
def vector_with_metadata(spark: SparkSession, sf: str) -> DataFrame:
    found = search.knn(tables.read(spark, sf, "embeddings"), _query_vector(spark, sf), 40)
    return search.with_metadata(found, _metadata(spark, sf)).select("vec_id", "doc_id", "doc_type", r6("score").alias("score"))


@query("embeddings_of_results", f"WITH {_METADATA} SELECT doc_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM md JOIN embeddings USING (vec_id) WHERE doc_id IN (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100)")
def embeddings_of_results(spark: SparkSession, sf: str) -> DataFrame:
    found = search.top(tables.read(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("score")), 100, "doc_id")
    rows = search.embeddings_of(found, _metadata(spark, sf), tables.read(spark, sf, "embeddings"))
    return rows.select("doc_id", r6(F.element_at("embedding", 1).cast("double")).alias("first"))


@query("readonly_federation", "SELECT * FROM (SELECT page_id AS doc_id, CAST(length(html) AS DOUBLE) AS score, 'here' AS project FROM pages) ORDER BY score DESC, doc_id LIMIT 10")
def readonly_federation(spark: SparkSession, sf: str) -> DataFrame:
    """A store that can't be reached is skipped."""
    stores = {"here": tables.read_only(spark, f"{sf}/pages.parquet"), "away": tables.read_only(spark, f"{sf}/no_such_store.parquet")}
    scored = {n: s.select(F.col("page_id").alias("doc_id"), F.char_length("html").cast("double").alias("score")) for n, s in stores.items() if s is not None}
    return search.federated(scored, 10, "doc_id")


# Sources and sinks.

_HOOK_NAMES = ("SessionStart", "UserPromptSubmit", "AssistantResponse", "PostToolUse", "Stop", "SubagentStop", "SessionEnd", "Unheard")
_HOOK_KINDS = {n: tables.HOOKS.get(n, ("user_message", "user")) for n in _HOOK_NAMES}


@query(
    "hook_events",
    "SELECT 's' || user_id AS session_id, epoch_us(ts) // 1000 AS ms, "
    + " ".join(f"{'CASE event_id % 8' if k == 0 else ''} WHEN {k} THEN '{_HOOK_KINDS[n][0]}'" for k, n in enumerate(_HOOK_NAMES))
    + " END AS event_type, "
    + " ".join(f"{'CASE event_id % 8' if k == 0 else ''} WHEN {k} THEN '{_HOOK_KINDS[n][1]}'" for k, n in enumerate(_HOOK_NAMES))
    + " END AS role, CASE WHEN event_id % 8 = 3 THEN props ELSE event_type END AS text, CASE WHEN event_id % 8 = 3 THEN 'tool' END AS tool, 'agent' || user_id % 3 AS agent FROM events",
)
def hook_events(spark: SparkSession, sf: str) -> DataFrame:
    e, k = tables.events(spark, sf), F.col("event_id") % 8
    name = F.element_at(F.array(*map(F.lit, _HOOK_NAMES)), (k + 1).cast("int"))
    fields = F.struct(
        name.alias("hook_event_name"),
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        F.when(k != 3, F.col("event_type")).alias("message"),
        F.when(k == 3, F.lit("tool")).alias("tool_name"),
        F.when(k == 3, F.col("props")).alias("tool_input"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit(" AGENT"), (F.col("user_id") % 3).cast("string")).alias("agent"),
    )
    lines = e.select(F.to_json(fields).alias("value")).unionByName(e.limit(3).select(F.lit("{not json").alias("value")))
    out = tables.hook_events(lines)
    return out.select("session_id", ms("ts").alias("ms"), "event_type", "role", "text", F.try_element_at("metadata", F.lit("tool_name")).alias("tool"), "agent")


@query("manual_entries", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'tool_result' ELSE 'user_message' END AS event_type FROM events")
def manual_entries(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 3 == 0, "tool_result").when(F.col("event_id") % 3 == 1, "user_message").otherwise("no such kind")
    return tables.events(spark, sf).select("event_id", tables.event_type_for(kind).alias("event_type"))


@query("jsonl_events", f"WITH {_EV} SELECT CAST(event_id AS VARCHAR) AS event_id, epoch_us(ts) // 1000 AS ms, event_type, text, agent FROM ev")
def jsonl_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as JSON lines and read back."""
    folder = scratch(spark, "jsonl")
    e = tables.events(spark, sf).select(F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("session_id"), "ts", "event_type", "role", "text", "agent")
    e.write.json(folder)
    return tables.jsonl_events(spark, folder).select("event_id", ms("ts").alias("ms"), "event_type", "text", "agent")


@query("jsonl_sessions", "SELECT role, text AS content FROM conversations")
def jsonl_sessions(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark, "sessions")
    tables.read(spark, sf, "conversations").select("role", F.col("text").alias("content")).write.json(folder)
    return tables.jsonl_sessions(spark, folder).select("role", "content")


@query("locomo_dataset", "SELECT 'c' || conv_id AS conversation_id, count(*) AS n_turns, 1 AS n_questions FROM conversations GROUP BY conv_id")
def locomo_dataset(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark, "locomo")
    asked = F.array(F.struct(F.lit("who").alias("question"), F.lit("user").alias("answer"), F.lit("single").alias("question_type")))
    c = tables.read(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("role", F.col("text").alias("content"))).alias("turns"))
    c.select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("conversation_id"), "turns", asked.alias("questions")).write.json(folder)
    found = spark.read.schema(tables.schemas.LOCOMO).json(folder)
    return found.select("conversation_id", F.size("turns").alias("n_turns"), F.size("questions").alias("n_questions"))


@query("result_envelope", "SELECT 'ok' AS status, 'longest' AS query, 5 AS n, (SELECT max(n_chars) FROM documents) AS best")
def result_envelope(spark: SparkSession, sf: str) -> DataFrame:
    rows = search.top(tables.read(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("score")), 5, "doc_id")
    schema = "status string, query string, results array<struct<doc_id: bigint, score: bigint>>, meta struct<count: int>"
    j = tables.envelope(rows, "longest").select(F.from_json("envelope", schema).alias("j")).select("j.*")
    return j.select("status", "query", F.col("meta.count").alias("n"), F.array_max(F.transform("results", lambda r: r["score"])).alias("best"))


@query("competitor_report", "SELECT role AS metric, round(sum(CAST(contains(lower(text), 'the') AS INT)) / count(*), 6) AS ours, round(sum(CAST(contains(lower(text), 'a') AS INT)) / count(*), 6) AS rival FROM conversations GROUP BY role")
def competitor_report(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON report of scores beside a rival's, written and read back by Spark, and rounded once, at its end."""
    turns = tables.read(spark, sf, "conversations")

    def scores(word: str) -> DataFrame:
        return evaluate.by_type(turns, "role", text.any_expected(F.col("text"), F.array(F.lit(word)))).filter("role <> 'all'")

    beside = scores("the").select("role", F.col("score").alias("ours")).join(scores("a").select("role", F.col("score").alias("rival")), "role")
    told = beside.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("role", F.struct("ours", "rival"))))).alias("report"))  # a row a role
    read = told.select(F.explode(F.from_json("report", "map<string, struct<ours: double, rival: double>>")).alias("metric", "s"))
    return read.select("metric", F.round("s.ours", 6).alias("ours"), F.round("s.rival", 6).alias("rival"))


_LOADS = "SELECT event_type AS step, avg(value) FILTER ({0}) AS ms, count(*) FILTER ({0}) AS throughput FROM events GROUP BY event_type"


@query(
    "regression_gate",
    f"""WITH a AS ({_LOADS.format("event_id % 3 = 0")}), b AS ({_LOADS.format("event_id % 3 <> 0")})
    SELECT step, CASE WHEN a.ms - b.ms >= 50 OR a.ms / b.ms - 1 >= 0.30 THEN 'severe' WHEN a.ms - b.ms >= 25 OR a.ms / b.ms - 1 >= 0.15 THEN 'warning' ELSE 'ok' END AS ms_verdict,
      CASE WHEN 1 - a.throughput / b.throughput >= 0.30 THEN 'severe' WHEN 1 - a.throughput / b.throughput >= 0.15 THEN 'warning' ELSE 'ok' END AS throughput_verdict FROM a JOIN b USING (step)""",
)
def regression_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of events as steps: every third event against the others, by mean value and by number."""

    def loads(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("event_type").alias("step")).agg(F.avg("value").alias("ms"), F.count(F.lit(1)).alias("throughput"))

    e = tables.read(spark, sf, "events")
    return evaluate.regressions(loads(e.filter("event_id % 3 = 0")), loads(e.filter("event_id % 3 <> 0")))


# Wire rows.


@query("node_wire", "WITH d AS (SELECT DISTINCT date_trunc('day', ts) AS s FROM events) SELECT 'toc:day:' || strftime(s, '%Y-%m-%d') AS node_id, strftime(s, '%A, %B %d, %Y') AS title, CASE WHEN day(s) % 2 = 0 THEN 'a b' END AS summary, epoch_us(s) // 1000 AS start_ms FROM d")
def node_wire(spark: SparkSession, sf: str) -> DataFrame:
    days = toc.period_nodes(tables.events(spark, sf), "day")
    bullets = F.when(F.dayofmonth("start_time") % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return toc.node_to_wire(days.withColumn("bullets", bullets)).select("node_id", "title", "summary", "start_ms")


@query("event_from_wire", "SELECT event_id, epoch_us(ts) // 1000 AS ms, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'agent' || user_id END AS agent FROM events")
def event_from_wire(spark: SparkSession, sf: str) -> DataFrame:
    agent = F.when(F.col("user_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("AGENT"), F.col("user_id").cast("string")))
    wire = tables.events(spark, sf).select("event_id", ms("ts").alias("ts_ms"), agent.alias("agent"))
    return tables.wire_to_event(wire).select("event_id", ms("ts").alias("ms"), "agent")


@query("result_projection", "SELECT doc_id, round(n_chars / 7.0, 4) AS score, CASE doc_id % 7 WHEN 1 THEN 'topics' WHEN 2 THEN 'hybrid' WHEN 3 THEN 'vector' WHEN 4 THEN 'bm25' WHEN 5 THEN 'agentic' ELSE 'unknown' END AS layer, source AS preview FROM documents")
def result_projection(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.read(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 7.0).alias("score"), (F.col("doc_id") % 7).alias("layer_code"), F.col("source").alias("text"))
    return router.map_results(rows)


@query("result_metadata", f"WITH {_FACTS} SELECT doc_id, CAST(ms AS VARCHAR) AS timestamp_ms, memory_kind, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END AS n FROM fx")
def result_metadata(spark: SparkSession, sf: str) -> DataFrame:
    rows = doc_facts(spark, sf).withColumn("agent", F.when(F.col("doc_id") % 2 == 0, "a"))
    m = F.col("metadata")
    return search.result_metadata(rows).select("doc_id", m["timestamp_ms"].alias("timestamp_ms"), m["memory_kind"].alias("memory_kind"), F.size(m).alias("n"))


# The hierarchy.


@query("toc_roots", "SELECT 'toc:year:' || CAST(year(o_orderdate) AS VARCHAR) AS node_id, CAST(rank() OVER (ORDER BY year(o_orderdate) DESC) AS INT) AS place FROM (SELECT DISTINCT date_trunc('year', o_orderdate) AS o_orderdate FROM orders)")
def toc_roots(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.read(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit("a").alias("agent"))
    found = toc.roots(toc.period_nodes(e, "year"))
    return found.select("node_id", F.row_number().over(Window.orderBy(F.desc("start_time"))).alias("place"))  # a row a year


_SEGMENT_NODES = f"""{_SEGMENTS}, sn AS (SELECT user_id, segment_no, user_id || '-' || CAST(segment_no AS BIGINT) AS seg, min(ts) AS s, max(ts) AS e, count(*) AS n, arg_min(text, (ts, event_id)) AS a, arg_max(text, (ts, event_id)) AS z FROM seg GROUP BY 1, 2)"""


def _segment_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return segments.segment_nodes(segments.by_gap(tables.events(spark, sf), "user_id"), "user_id")


@query(
    "segment_nodes",
    f"WITH {_EV}, {_SEGMENT_NODES} SELECT 'toc:segment:' || strftime(s, '%Y-%m-%d') || ':' || seg AS node_id, 'toc:day:' || strftime(s, '%Y-%m-%d') AS parent_id, 'Summary of ' || n || ' events' AS title, epoch_us(s) // 1000 AS start_ms, epoch_us(e) // 1000 AS end_ms, 'First message: ' || a || '|Last message: ' || z || '|Total events: ' || n AS bullets FROM sn",
)
def segment_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _segment_nodes(spark, sf).select("node_id", "parent_id", "title", ms("start_time").alias("start_ms"), ms("end_time").alias("end_ms"), F.array_join("bullets", "|").alias("bullets"))


@query("segments_of_day", f"WITH {_EV}, {_SEGMENT_NODES} SELECT 'toc:segment:' || strftime(s, '%Y-%m-%d') || ':' || seg AS node_id, epoch_us(s) // 1000 AS start_ms FROM sn WHERE strftime(s, '%Y-%m-%d') = '2024-01-05'")
def segments_of_day(spark: SparkSession, sf: str) -> DataFrame:
    return _segment_nodes(spark, sf).filter("parent_id = 'toc:day:2024-01-05'").select("node_id", ms("start_time").alias("start_ms"))


@query(
    "rollup_days",
    f"WITH {_EV}, {_SEGMENT_NODES} SELECT 'toc:day:' || d AS node_id, 'Summary of ' || count(*) || ' child summaries' AS title, len(list(n)[1:5]) AS n_bullets FROM (SELECT strftime(s, '%Y-%m-%d') AS d, n FROM sn) WHERE d > '2024-01-03' AND d < '2024-01-20' GROUP BY d",
)
def rollup_days(spark: SparkSession, sf: str) -> DataFrame:
    """Days after the checkpoint (the end of 3 January) that had closed by 01:00 on 20 January."""
    done = F.lit("2024-01-03 23:59:59.999").cast("timestamp")
    found = toc.rollup(_segment_nodes(spark, sf), "day", F.lit("2024-01-20 01:00:00").cast("timestamp"), done)
    return found.select("node_id", "title", F.size("bullets").alias("n_bullets"))


@query(
    "rollup_job",
    f"""WITH {_EV}, {_SEGMENT_NODES}, dy AS (SELECT date_trunc('day', s) AS d, count(*) AS n FROM sn WHERE s < TIMESTAMP '2024-01-20' GROUP BY 1)
    SELECT 'toc:day:' || strftime(d, '%Y-%m-%d') AS node_id, 'Summary of ' || n || ' child summaries' AS title FROM dy
    UNION ALL SELECT 'toc:week:' || isoyear(d) || '-W' || lpad(CAST(week(d) AS VARCHAR), 2, '0'), 'Summary of ' || count(*) || ' child summaries' FROM dy GROUP BY 1""",
)
def rollup_job(spark: SparkSession, sf: str) -> DataFrame:
    """Segments rolled up by the day job on the 10th, again at once, and on the 20th, and their days by the week job on the 28th."""
    folder, below = scratch(spark, "rollup"), _segment_nodes(spark, sf)
    j = Journal(spark, f"{folder}/journal")
    for at in ("2024-01-10 01:00:00", "2024-01-10 01:00:00", "2024-01-20 01:00:00"):
        jobs.roll_up(below, folder, "day", F.lit(at).cast("timestamp"), j)
    days = jobs.rolled_up(spark, folder, "day", j)
    jobs.roll_up(days, folder, "week", F.lit("2024-01-28 02:00:00").cast("timestamp"), j)
    return days.select("node_id", "title").unionByName(jobs.rolled_up(spark, folder, "week", j).select("node_id", "title"))


@query(
    "summary_of_children",
    f"""WITH {_TURNS}, k AS (SELECT conv_id, turn, text, list_sort(list_distinct(string_split(lower(text), ' '))) AS w FROM tu)
    SELECT conv_id, 'Summary of ' || count(*) || ' child summaries' AS title, array_to_string(list(text ORDER BY turn)[1:5], '|') AS bullets, array_to_string(list_sort(list_distinct(flatten(list(w))))[1:7], ',') AS keywords FROM k GROUP BY conv_id""",
)
def summary_of_children(spark: SparkSession, sf: str) -> DataFrame:
    t = tables.turns(spark, sf).select("conv_id", "turn", F.col("turn").alias("node_id"), F.array("text").alias("bullets"), F.split(F.lower("text"), " ").alias("keywords"))
    found = toc.summarise_children(t, "conv_id", "turn")
    return found.select("conv_id", "title", F.array_join("bullets", "|").alias("bullets"), F.array_join("keywords", ",").alias("keywords"))


@query("summary_bullets", f"WITH {_EV} SELECT user_id, 'First message: ' || arg_min(text, event_id) AS bullet_first, 'Last message: ' || arg_max(text, event_id) AS bullet_last, len(list_distinct(list_filter(string_split(string_agg(text, ' '), ' '), lambda x: strlen(x) > 3))) > 0 AS has_keywords FROM ev GROUP BY user_id")
def summary_bullets(spark: SparkSession, sf: str) -> DataFrame:
    found = toc.mock_summary(tables.events(spark, sf), "user_id", "text", "event_id")
    return found.select("user_id", "bullet_first", "bullet_last", (F.size("keywords") > 0).alias("has_keywords"))


@query("rebuild_enumeration", f"WITH {_GRIPS}, n AS (SELECT DISTINCT date_trunc('day', ts) AS s FROM events) SELECT 'toc:day:' || strftime(s, '%Y-%m-%d') AS doc_id, 'toc_node' AS doc_type, strftime(s, '%A, %B %d, %Y') || ' b' AS text FROM n UNION ALL SELECT grip_id, 'grip', excerpt FROM gr")
def rebuild_enumeration(spark: SparkSession, sf: str) -> DataFrame:
    days = toc.period_nodes(tables.events(spark, sf), "day").withColumn("bullets", F.array(F.lit("b")))
    return toc.everything(days, _grips(spark, sf))


_LONG = "list_filter(string_split_regex(lower(bullet), '\\s+'), lambda w: strlen(w) > 3)"


@query(
    "grip_extract",
    f"""WITH RECURSIVE {_TURNS}, b AS (SELECT session_id, regexp_extract(text, '^((?:\\S+\\s+){{0,11}}\\S+)', 1) AS bullet FROM tu WHERE turn = 0),
    bw AS (SELECT session_id, bullet, list_filter(regexp_split_to_array(lower(bullet), '\\s+'), lambda w: strlen(w) > 3) AS w FROM b),
    o AS (SELECT session_id, CAST(event_id AS VARCHAR) AS id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: strlen(w) > 3) AS have,
      row_number() OVER (PARTITION BY session_id ORDER BY ms, CAST(event_id AS VARCHAR)) AS k FROM tu WHERE strlen(text) >= 20),
    s AS (SELECT o.session_id, bullet, id, k, CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda x: list_contains(have, x))) / CAST(len(w) AS DOUBLE) END AS score FROM o JOIN bw USING (session_id)),
    f AS (SELECT session_id, bullet, k, CASE WHEN score > 0.3 THEN id END AS first, CASE WHEN score > 0.3 THEN id END AS last, CASE WHEN score > 0.3 THEN score ELSE 0.0 END AS best FROM s WHERE k = 1
      UNION ALL SELECT s.session_id, s.bullet, s.k,
        CASE WHEN score > 0.3 AND score > best THEN coalesce(first, id) ELSE first END,
        CASE WHEN score > 0.3 AND (score > best OR score >= 0.8 * best) THEN id ELSE last END,
        CASE WHEN score > 0.3 AND score > best THEN score ELSE best END FROM f JOIN s ON s.session_id = f.session_id AND s.bullet = f.bullet AND s.k = f.k + 1)
    SELECT session_id, bullet, first, last, round(best, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY session_id, bullet ORDER BY k DESC) AS n FROM f) WHERE n = 1 AND first IS NOT NULL""",
)
def grip_extract(spark: SparkSession, sf: str) -> DataFrame:
    t = tables.turns(spark, sf)
    bullets = t.filter("turn = 0").select("session_id", F.regexp_extract("text", r"^((?:\S+\s+){0,11}\S+)", 1).alias("bullet"))
    return toc.grips(bullets, t, "session_id").withColumn("score", r6("score"))


# Indexing.


_HIT = f"list_has_any(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), [{', '.join(repr(w) for w in SEARCH.split())}])"


@query(
    "outbox_indexing",
    f"""WITH d AS (SELECT doc_id, {_HIT} AND doc_id % 10 <> 9 AS hit FROM documents)
    SELECT 'bm25' AS name, max(doc_id) AS last_sequence, count(*) AS processed_count, 0 AS left_over, count(*) FILTER (hit) AS n_found FROM d
    UNION ALL SELECT 'other', max(doc_id), count(*) FILTER (doc_id > 99), 0, count(*) FILTER (hit AND doc_id > 99) FROM d""",
)
def outbox_indexing(spark: SparkSession, sf: str) -> DataFrame:
    """Two word indexes, one ahead of the other, caught up over an entry for each document in four batches; a tenth are removals."""
    docs = tables.read(spark, sf, "documents").select("doc_id", "text")
    outbox = docs.select(F.col("doc_id").alias("seq"), "doc_id", F.when(F.col("doc_id") % 10 == 9, "remove").otherwise("add").alias("action"))
    folder = scratch(spark, "outbox")
    j = Journal(spark, f"{folder}/journal")
    j.put("checkpoint-other", {"last_sequence": 99, "processed_count": 0})
    both = {"bm25": WordIndex(spark, f"{folder}/bm25", buckets=2, spread=1), "other": WordIndex(spark, f"{folder}/other", buckets=2, spread=1)}
    catch_up(outbox, docs, both, j, batch=outbox.count() // 4 + 1)
    left = consumed(outbox, list(both), j).count()
    rows = [(n, held["last_sequence"], held["processed_count"], left, x.search(SEARCH).count()) for n, x in both.items() if (held := j.get(f"checkpoint-{n}"))]
    return spark.createDataFrame(rows, "name string, last_sequence bigint, processed_count bigint, left_over int, n_found bigint")


_CHANGED = "ch AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN text || ' nation nation' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 3)"


@query("bm25_index_search", f"WITH {_CHANGED}, {_bm25_sql('ch', 'doc_id', SEARCH)} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY score DESC, doc_id LIMIT 20")
def bm25_index_search(spark: SparkSession, sf: str) -> DataFrame:
    """Postings written, some documents replaced, some removed, two commits and a compaction; the search reads its terms' buckets."""
    docs = tables.read(spark, sf, "documents").select("doc_id", "text")
    folder = scratch(spark, "bm25")
    index = WordIndex(spark, folder, buckets=8)
    index.add(docs)
    index.commit()
    index.add(docs.filter("doc_id % 10 = 0").withColumn("text", F.concat("text", F.lit(" nation nation"))))
    index.remove(docs.filter("doc_id % 10 = 3"))
    index.commit()
    index.compact()
    return search.top(WordIndex(spark, folder, buckets=8).search(SEARCH), 20, "doc_id").withColumn("score", r6("score"))


_SPLIT = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _weighed(words: str, f: str, dl: str = "dl", mean: str = "a") -> str:
    """BM25 in SQL of one word or phrase, whose words have document frequencies df_<word>."""
    idf = " + ".join(f"ln(1 + (n - df_{w} + 0.5) / (df_{w} + 0.5))" for w in words.split())
    return f"({idf}) * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * {dl} / {mean}))"


def _words_sql(words: str, pairs: str = "") -> str:
    """CTEs in SQL: t has doc_id, dl, f_<word> and f_<word>_<word> (side by side); s has n, a and df_<word>."""
    f = [f"len(list_filter(w, lambda x: x = '{x}')) AS f_{x}" for x in words.split()]
    f += [f"len(list_filter(range(1, len(w)), lambda i: w[i] = '{a}' AND w[i + 1] = '{b}')) AS f_{a}_{b}" for a, b in (p.split("_") for p in pairs.split())]
    df = ", ".join(f"count(*) FILTER (f_{x} > 0) AS df_{x}" for x in words.split())
    return f"t AS (SELECT doc_id, len(w) AS dl, {', '.join(f)} FROM (SELECT doc_id, {_SPLIT.format('text')} AS w FROM documents)), s AS (SELECT count(*) AS n, avg(dl) AS a, {df} FROM t)"


def _asked(spark: SparkSession, sf: str, asked: str) -> DataFrame:
    """All documents that fit a query of the word index of whole texts."""
    return word_index(spark, sf).search(asked).withColumn("score", r6("score"))


@query("bm25_punctuated", f"WITH {_bm25_sql('documents', 'doc_id', 'north the thereen nation s idiot and')} SELECT doc_id, round(score, 6) AS score FROM bm")
def bm25_punctuated(spark: SparkSession, sf: str) -> DataFrame:
    """Words of a query are what texts are split into, hyphens, commas and apostrophes or not."""
    return _asked(spark, sf, "North-the, thereen nation's (idiot)/and")


@query("bm25_punctuated_scan", f"WITH {_bm25_sql('documents', 'doc_id', 'north the thereen nation s idiot and')} SELECT doc_id, round(score, 6) AS score FROM bm")
def bm25_punctuated_scan(spark: SparkSession, sf: str) -> DataFrame:
    return search.bm25(tables.read(spark, sf, "documents"), "North-the, thereen nation's (idiot)/and").withColumn("score", r6("score"))


@query("word_phrases", f"WITH {_words_sql('is of the nation', 'of_the is_the')} SELECT doc_id, round({_weighed('of the', 'f_of_the')} + {_weighed('is the', 'f_is_the')} + {_weighed('nation', 'f_nation')}, 6) AS score FROM t, s WHERE f_of_the > 0 OR f_is_the > 0 OR f_nation > 0")
def word_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Phrases, found by positions, beside a single word."""
    return _asked(spark, sf, '"of the" "Is, the" nation')


@query("word_phrase_needed", f"WITH {_words_sql('in the and nation', 'in_the')} SELECT doc_id, round({_weighed('in the', 'f_in_the')} + {_weighed('and', 'f_and')}, 6) AS score FROM t, s WHERE f_in_the > 0 AND f_nation = 0")
def word_phrase_needed(spark: SparkSession, sf: str) -> DataFrame:
    """A phrase that must be there, a word that may, and one that must not."""
    return _asked(spark, sf, '+"in the" and -nation')


@query("word_operators", f"WITH {_words_sql('the of nation in thereen', 'in_the')} SELECT doc_id, round({_weighed('the', 'f_the')} + {_weighed('of', 'f_of')} + {_weighed('nation', 'f_nation')} + {_weighed('thereen', 'f_thereen')}, 6) AS score FROM t, s WHERE (f_the > 0 AND (f_of > 0 OR f_nation > 0) AND f_in_the = 0) OR f_thereen > 0")
def word_operators(spark: SparkSession, sf: str) -> DataFrame:
    """AND before OR, parentheses, and a phrase that is excluded."""
    return _asked(spark, sf, 'the AND (of OR nation) AND NOT "in the" OR thereen')


_FIELDS = f"""f AS (SELECT doc_id, {_SPLIT.format('text')} AS w, {_SPLIT.format('lang')} AS v FROM documents),
  t AS (SELECT doc_id, len(w) AS dl, len(v) AS dv, len(list_filter(w, lambda x: x = 'der')) AS f_der, len(list_filter(v, lambda x: x = 'de')) AS f_de, len(list_filter(w, lambda x: x = 'en')) AS f_en, len(list_filter(v, lambda x: x = 'en')) AS f_env FROM f),
  s AS (SELECT count(*) AS n, avg(dl) AS a, avg(dv) AS av, count(*) FILTER (f_der > 0) AS df_der, count(*) FILTER (f_de > 0) AS df_de, count(*) FILTER (f_en > 0) AS df_en, count(*) FILTER (f_env > 0) AS df_env FROM t)"""


@query("word_fields", f"WITH {_FIELDS} SELECT doc_id, round({_weighed('der', 'f_der')} + {_weighed('de', 'f_de', 'dv', 'av')} + {_weighed('en', 'f_en')} + {_weighed('env', 'f_env', 'dv', 'av')}, 6) AS score FROM t, s WHERE (f_der > 0 AND f_de > 0) OR f_en > 0 OR f_env > 0")
def word_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Two fields with statistics of their own: terms of one field, and a word that either may have."""
    index = WordIndex(spark, scratch(spark, "fields"), buckets=8, fields=["text", "lang"])
    index.add(tables.read(spark, sf, "documents").select("doc_id", "text", "lang"))
    index.commit()
    return index.search("(text:der AND lang:de) en").withColumn("score", r6("score"))


@query("index_growth", f"WITH {_CHANGED}, {_bm25_sql('ch', 'doc_id', SEARCH)} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY score DESC, doc_id LIMIT 50")
def index_growth(spark: SparkSession, sf: str) -> DataFrame:
    """Ten commits that merge by tiers, with documents replaced and removed on the way."""
    docs = tables.read(spark, sf, "documents").select("doc_id", "text")
    index = WordIndex(spark, scratch(spark, "growth"), buckets=4, spread=1, fanout=3)
    for k in range(8):
        index.add(docs.filter(F.col("doc_id") % 8 == k))
        index.commit()
    index.add(docs.filter("doc_id % 10 = 0").withColumn("text", F.concat("text", F.lit(" nation nation"))))
    index.commit()
    index.remove(docs.filter("doc_id % 10 = 3"))
    index.commit()
    return search.top(index.search(SEARCH), 50, "doc_id").withColumn("score", r6("score"))


@query("index_rebuild", f"WITH {_FACTS}, n AS (SELECT level, count(*) AS n FROM fx WHERE level IN ('day', 'week', 'month', 'year') GROUP BY level) SELECT level, CAST(sum(n) OVER (ORDER BY CASE level WHEN 'day' THEN 0 WHEN 'week' THEN 1 WHEN 'month' THEN 2 ELSE 3 END) AS INT) AS done, 0 AS errors FROM n")
def index_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """The word index of days and above made anew, with the progress that was told."""
    told: list[tuple[str, int, int]] = []
    index = WordIndex(spark, scratch(spark, "rebuild"), buckets=4)
    rebuild(doc_facts(spark, sf).select("doc_id", "text", "level"), index, lambda *x: told.append(x), least="day", folder=index.folder)
    return spark.createDataFrame(told, "level string, done int, errors int")


@query("bm25_retention", f"WITH {_FACTS} SELECT level, count(*) AS n FROM fx WHERE ms < {_ASOF_MS} - CAST(CASE level WHEN 'segment' THEN 30 WHEN 'grip' THEN 30 WHEN 'day' THEN 180 WHEN 'week' THEN 1825 END AS BIGINT) * 86400000 GROUP BY level")
def bm25_retention(spark: SparkSession, sf: str) -> DataFrame:
    """What a dry run of the word index's prune reports; it keeps days for 180 days only."""
    return lifecycle.prune_counts(doc_facts(spark, sf), as_of(), Retention.words())


@query("prune_job", f"WITH {_FACTS} SELECT doc_id, level FROM fx WHERE text IS NOT NULL AND NOT coalesce(ms < {_ASOF_MS} - CAST(CASE level WHEN 'segment' THEN 30 WHEN 'grip' THEN 30 WHEN 'day' THEN 180 WHEN 'week' THEN 1825 END AS BIGINT) * 86400000, false)")
def prune_job(spark: SparkSession, sf: str) -> DataFrame:
    """What a word index of all documents still holds after its prune job has run twice, by a reader that opens it anew."""
    facts, folder = doc_facts(spark, sf), scratch(spark, "prune")
    index = WordIndex(spark, folder, buckets=4)
    index.add(facts.select("doc_id", "text"))
    index.commit()
    for _ in range(2):
        jobs.prune(index, facts, as_of(), Retention.words())
    return WordIndex(spark, folder, buckets=4).live().select("doc_id").join(facts.select("doc_id", "level"), "doc_id")


@query("compaction", "SELECT event_id, value FROM events")
def compaction(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark, "compaction")
    tables.read(spark, sf, "events").select("event_id", "value").repartition(16).write.parquet(f"{folder}/before")
    lifecycle.compact(spark, f"{folder}/before", f"{folder}/after", 2)
    return spark.read.parquet(f"{folder}/after")


@query("job_runs", "SELECT * FROM (VALUES ('prune', 2, 0, 0, 'success'), ('broken', 1, 1, 0, 'failed: no'), ('asleep', 0, 0, 1, 'never')) AS t(name, run_count, error_count, skipped, last_result)")
def job_runs(spark: SparkSession, sf: str) -> DataFrame:
    def fails() -> None:
        raise ValueError("no")

    registry = jobs.Jobs()
    registry.add("prune", lambda: lifecycle.prune_counts(doc_facts(spark, sf), as_of()).count(), "0 3 * * *")
    registry.add("broken", fails)
    registry.add("asleep", fails)
    registry.pause("asleep")
    for name in ("prune", "broken", "asleep", "prune"):
        registry.start(name)
    return registry.status(spark).select("name", "run_count", "error_count", "skipped", "last_result")


# Episodes, usage and the novelty gate.


@query(
    "episode_lifecycle",
    """SELECT doc_id AS episode_id, CASE WHEN doc_id % 4 = 0 THEN 'failed' ELSE 'completed' END AS status, round(doc_id % 101 / 100.0, 6) AS outcome_score, round(greatest(0.0, 1 - abs(doc_id % 101 / 100.0 - 0.65)), 6) AS value_score,
       CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS n_actions, CASE WHEN doc_id % 2 = 0 THEN 'pending' END AS first_status FROM documents""",
)
def episode_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Episodes started, with two actions for even ids, and completed or failed."""
    d = tables.read(spark, sf, "documents")
    begun = d.select(*episodes.start(F.col("doc_id"), F.concat(F.lit("Task "), F.col("doc_id").cast("string")), as_of()))
    acts = d.filter("doc_id % 2 = 0").select(F.col("doc_id").alias("episode_id"), F.explode(F.array(F.lit(2), F.lit(1))).alias("nth"))
    acts = acts.select("episode_id", F.timestamp_seconds("nth").alias("ts"), F.lit("tool").alias("action_type"), F.lit("in").alias("input"), F.when(F.col("nth") == 1, "odd").otherwise("success").alias("status"))
    outcomes = d.select(F.col("doc_id").alias("episode_id"), (F.col("doc_id") % 101 / 100.0).alias("outcome"), (F.col("doc_id") % 4 == 0).alias("failed"))
    done = episodes.complete(episodes.with_actions(begun, acts), outcomes)
    n = F.coalesce(F.size("actions"), F.lit(0))
    return done.select("episode_id", "status", r6("outcome_score").alias("outcome_score"), r6("value_score").alias("value_score"), F.greatest(n, F.lit(0)).alias("n_actions"), F.try_element_at("actions", F.lit(1))["status"].alias("first_status"))


@query("episodes_newest_first", "SELECT doc_id AS episode_id, CAST(row_number() OVER (ORDER BY doc_id DESC) AS INT) AS place FROM (SELECT doc_id FROM documents WHERE doc_id % 9 <> 0 ORDER BY doc_id DESC LIMIT 25)")
def episodes_newest_first(spark: SparkSession, sf: str) -> DataFrame:
    d = tables.read(spark, sf, "documents").select(F.col("doc_id").alias("episode_id"))
    kept = store.newest_first(store.delete(d, d.filter("episode_id % 9 = 0"), "episode_id"), "episode_id", 25)
    return kept.withColumn("place", F.row_number().over(Window.orderBy(F.desc("episode_id"))))  # 25 rows


@query("usage_merge", "SELECT user_id AS doc_id, greatest(count(*) FILTER (event_type = 'view'), count(*) FILTER (event_type = 'click')) AS access_count, max(epoch_us(ts) // 1000) AS last_ms FROM events WHERE event_type IN ('view', 'click') GROUP BY user_id")
def usage_merge(spark: SparkSession, sf: str) -> DataFrame:
    log = tables.events(spark, sf).withColumnRenamed("user_id", "doc_id")
    a, b = (agents.usage_from_log(log.filter(F.col("event_type") == k)) for k in ("view", "click"))
    return agents.merge_usage(a, b).select("doc_id", "access_count", ms("last_accessed").alias("last_ms"))


_RING = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
    f AS (SELECT label, vec_id, k, [e] AS held, CAST(NULL AS DOUBLE) AS similarity, 'new' AS decision FROM v WHERE k = 1
      UNION ALL SELECT n.label, n.vec_id, n.k, CASE WHEN s > 0.3 THEN held WHEN len(held) < 16 THEN list_append(held, e) ELSE list_append(held[2:], e) END, s, CASE WHEN s > 0.3 THEN 'duplicate' ELSE 'new' END
        FROM (SELECT v.label, v.vec_id, v.k, v.e, f.held, list_max(list_transform(f.held, lambda h: list_inner_product(h, v.e))) AS s FROM f JOIN v ON v.label = f.label AND v.k = f.k + 1) n)"""


@query("dedup_ring_buffer", f"WITH RECURSIVE {_RING} SELECT label, vec_id, decision, round(similarity, 6) AS similarity FROM f")
def dedup_ring_buffer(spark: SparkSession, sf: str) -> DataFrame:
    rows = dedup.ring_buffer(tables.read(spark, sf, "embeddings"), "label", "vec_id", "embedding", Dedup(threshold=0.3, buffer=16))
    return rows.withColumn("similarity", r6("similarity"))


@query("dedup_metrics", f"WITH RECURSIVE {_RING} SELECT decision, count(*) AS n, (SELECT count(*) FROM embeddings) AS total FROM f GROUP BY decision")
def dedup_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = dedup.ring_buffer(tables.read(spark, sf, "embeddings"), "label", "vec_id", "embedding", Dedup(threshold=0.3, buffer=16))
    return dedup.decision_counts(rows)


@query(
    "composite_index",
    f"WITH {_VEC}, a AS (SELECT vec_id, list_cosine_similarity(e, qe) AS s FROM v, q WHERE vec_id % 2 = 0 ORDER BY s DESC, vec_id LIMIT 10), b AS (SELECT vec_id, 0.5 * list_cosine_similarity(e, qe) AS s FROM v, q WHERE vec_id % 3 = 0 ORDER BY s DESC, vec_id LIMIT 10) SELECT vec_id, round(max(s), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY vec_id ORDER BY max(s) DESC, vec_id LIMIT 10",
)
def composite_index(spark: SparkSession, sf: str) -> DataFrame:
    """What a buffer and a store find for one vector, each at its best."""
    e, q = tables.read(spark, sf, "embeddings"), _query_vector(spark, sf)
    a = search.knn(e, q, 10, where=F.col("vec_id") % 2 == 0)
    b = search.knn(e, q, 10, where=F.col("vec_id") % 3 == 0).withColumn("score", 0.5 * F.col("score"))
    return search.composite([a, b], 10, "vec_id").withColumn("score", r6("score"))


@query(
    "stale_filter",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), m AS (SELECT max(vec_id) AS newest FROM v),
    g AS (SELECT DISTINCT a.vec_id FROM v a JOIN v b ON b.vec_id > a.vec_id AND list_inner_product(a.e, b.e) >= 0.3)
    SELECT v.vec_id AS doc_id, round((1 - 0.3 * (1 - exp(-(newest - v.vec_id) / 14.0))) * CASE WHEN g.vec_id IS NOT NULL THEN 0.85 ELSE 1 END, 6) AS score FROM v LEFT JOIN g USING (vec_id), m""",
)
def stale_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Decay by day, then one penalty for results that a newer similar one replaces."""
    e = tables.read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    rows = e.select("doc_id", F.lit(1.0).alias("score"), F.timestamp_millis(F.col("doc_id") * 86_400_000).alias("ts"), F.lit("observation").alias("memory_kind"))
    found = ranking.stale_filter(rows, e, Staleness(supersession_similarity=0.3))
    return found.select("doc_id", r6("score").alias("score"))


# Streams, run to the end of their input.

_STREAMED = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    folder = scratch(spark, "stream")
    tables.events(spark, sf).select("event_id", "ts", "user_id", "event_type", "value", "agent", "text").write.parquet(folder)
    return ingest.read_stream(spark, folder, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, agent string, text string", files_per_batch=1000)


def _ran(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    folder = scratch(spark, "stream-out")
    ingest.run_to_end(stream, ingest.idempotent_sink(f"{folder}/rows"), f"{folder}/checkpoint", mode)
    return spark.read.parquet(f"{folder}/rows").drop("batch")


_CLOSED = "(SELECT max(ts) - INTERVAL 1 HOUR FROM events)"


@query("stream_tumbling", f"WITH {_EV} SELECT epoch_us(date_trunc('day', ts)) // 1000 AS start_ms, agent, count(*) AS n_events FROM ev WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {_CLOSED} GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Days that the watermark has passed, by agent."""
    return _ran(spark, ingest.tumbling(_stream(spark, sf))).select(ms(F.col("w.start")).alias("start_ms"), "agent", "n_events")


@query(
    "stream_sliding",
    f"""WITH w AS (SELECT event_type, value, time_bucket(INTERVAL 1 HOUR, ts) - to_hours(CAST(k AS INT)) AS s FROM events, (SELECT unnest([0, 1]) AS k))
    SELECT epoch_us(s) // 1000 AS start_ms, event_type, count(*) AS n_events, round(sum(value), 2) AS value FROM w WHERE s + INTERVAL 2 HOUR <= {_CLOSED} GROUP BY 1, 2""",
)
def stream_sliding(spark: SparkSession, sf: str) -> DataFrame:
    found = _ran(spark, ingest.sliding(_stream(spark, sf), "2 hours", "1 hour"))
    return found.select(ms(F.col("w.start")).alias("start_ms"), "event_type", "n_events", F.round("value", 2).alias("value"))


@query(
    "stream_sessions",
    f"""WITH {_EV}, x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM ev), y AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM x)
    SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, count(*) AS n_events FROM y GROUP BY user_id, n HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}""",
)
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return _ran(spark, ingest.sessions(_stream(spark, sf), "user_id")).select("user_id", ms(F.col("w.start")).alias("start_ms"), "n_events")


@query("stream_ingest_once", f"WITH {_EV} SELECT event_id, CASE WHEN event_type = 'error' THEN 'short_text' ELSE 'short_text' END AS gate FROM ev")
def stream_ingest_once(spark: SparkSession, sf: str) -> DataFrame:
    """Valid events, each id once although all arrive twice, with the gate's decision."""
    s = _stream(spark, sf)
    return _ran(spark, ingest.gated(ingest.once(ingest.valid(s.union(s))))).select("event_id", "gate")


_GATED = f"""{_EV}, g AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e,
      CASE WHEN event_type = 'error' THEN 'structural' WHEN strlen(text) < 15 THEN 'short_text' WHEN embedding IS NULL THEN 'no_embedding' ELSE 'compare' END AS gate
      FROM ev LEFT JOIN embeddings ON vec_id = event_id % 100 AND vec_id % 20 <> 7),
    o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS k FROM g WHERE gate = 'compare'),
    f AS (SELECT user_id, event_id, k, [e] AS held, CAST(NULL AS DOUBLE) AS similarity, false AS deduplicated FROM o WHERE k = 1
      UNION ALL SELECT user_id, event_id, k, CASE WHEN s > 0.3 THEN held WHEN len(held) < 16 THEN list_append(held, e) ELSE list_append(held[2:], e) END, s, s > 0.3
        FROM (SELECT o.user_id, o.event_id, o.k, o.e, f.held, list_max(list_transform(f.held, lambda h: list_inner_product(h, o.e))) AS s FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1) n)"""


@query("stream_novelty_gate", f"WITH RECURSIVE {_GATED} SELECT g.event_id, gate, round(similarity, 6) AS similarity, coalesce(deduplicated, false) AS deduplicated, 1 AS created, 2 AS arrivals FROM g LEFT JOIN f ON f.event_id = g.event_id")
def stream_novelty_gate(spark: SparkSession, sf: str) -> DataFrame:
    """All events, each arriving twice, through the gate: buffers of 16 vectors a user, with every reason to pass among them."""
    folder = scratch(spark, "gated")
    e = tables.events(spark, sf).withColumn("event_type", F.when(F.col("event_type") == "error", "session_end").otherwise(F.col("event_type")))
    v = tables.read(spark, sf, "embeddings").filter("vec_id < 100 AND vec_id % 20 <> 7").select(F.col("vec_id").alias("__v"), "embedding")
    e.join(v, F.col("event_id") % 100 == F.col("__v"), "left").select("event_id", "ts", "user_id", "event_type", "text", "embedding").write.parquet(folder)
    s = ingest.read_stream(spark, folder, "event_id bigint, ts timestamp, user_id bigint, event_type string, text string, embedding array<float>", files_per_batch=1000)
    with gate.keyed_state(spark):
        out = _ran(spark, gate.ingest(s.union(s), "user_id", Dedup(threshold=0.3, min_text_bytes=15, buffer=16)))
    decided = out.groupBy("event_id").agg(F.max("gate").alias("gate"), F.max("similarity").alias("similarity"), F.bool_or("deduplicated").alias("deduplicated"), F.count_if("created").cast("int").alias("created"), F.count(F.lit(1)).cast("int").alias("arrivals"))
    return decided.withColumn("similarity", r6("similarity"))


@query("outbox_stream", f"WITH ob AS (SELECT * FROM documents WHERE doc_id % 10 <> 3 OR doc_id % 20 = 3), {_bm25_sql('ob', 'doc_id', SEARCH)} SELECT doc_id, round(score, 6) AS score, (SELECT count(*) + count(*) FILTER (doc_id % 10 = 3) + count(*) FILTER (doc_id % 20 = 3) FROM documents) AS processed_count FROM bm")
def outbox_stream(spark: SparkSession, sf: str) -> DataFrame:
    """All documents added through the outbox, some removed, and some of these added again, by four batches; then a search."""
    docs, folder = tables.read(spark, sf, "documents").select("doc_id", "text"), scratch(spark, "outbox")
    n = F.lit(10_000_000_000)
    steps = [("doc_id % 2 = 0", "add", 0), ("doc_id % 2 = 1", "add", 1), ("doc_id % 10 = 3", "remove", 2), ("doc_id % 20 = 3", "add", 3)]
    for keep, action, k in steps:
        docs.filter(keep).select((F.col("doc_id") + n * k).alias("seq"), "doc_id", F.lit(action).alias("action")).coalesce(1).write.mode("append").parquet(f"{folder}/entries")
    index, journal = WordIndex(spark, f"{folder}/words", buckets=8), Journal(spark, f"{folder}/journal")
    follow(ingest.read_stream(spark, f"{folder}/entries", "seq bigint, doc_id bigint, action string"), docs, {"words": index}, journal, f"{folder}/checkpoint")
    return index.search(SEARCH).select("doc_id", r6("score").alias("score"), F.lit(followed(journal, "words")["processed_count"]).cast("bigint").alias("processed_count"))


@query("stream_segments", f"WITH RECURSIVE {_EV}, o AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms, CAST({_TOKENS} AS BIGINT) AS tokens, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM ev), f AS (SELECT event_id, user_id, ms, k, tokens AS used, 0 AS segment_no FROM o WHERE k = 1 UNION ALL SELECT o.event_id, o.user_id, o.ms, o.k, CASE WHEN o.ms - f.ms > 1800000 OR f.used + o.tokens > 4000 THEN o.tokens ELSE f.used + o.tokens END, CASE WHEN o.ms - f.ms > 1800000 OR f.used + o.tokens > 4000 THEN f.segment_no + 1 ELSE f.segment_no END FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1) SELECT user_id, event_id, CAST(segment_no AS INT) AS segment_no FROM f")
def stream_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments by gap and token budget, kept as state by user."""
    rows = _ran(spark, ingest.segment_stream(segments.event_tokens(_stream(spark, sf)), "user_id"))
    return rows.select(F.col("key").alias("user_id"), "event_id", "segment_no")

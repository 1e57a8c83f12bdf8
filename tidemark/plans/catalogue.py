"""The queries over the given tables, and the same in SQL.

Scores are rounded to six places on both sides, times are epoch milliseconds, and ties are broken by ids.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Dedup, Grips, Ranking, Segmentation
from ..functions import scoring, text, timekeys, vectors
from ..functions.embedding import HashingEmbedder
from ..operators import agents, dedup, episodes, evaluate, lifecycle, ranking, search, segments, store, toc, topics
from ..operators.indexes import WordIndex
from ..sources import tables
from . import router

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

AS_OF = "2024-02-01 00:00:00"
#: Words that the invented texts have, for search queries.
SEARCH = "the thereen nation and idiot"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def r6(c: Column) -> Column:
    return F.round(c, 6)


def ms(c: Column | str) -> Column:
    return F.unix_millis(c)


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def doc_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as stored nodes: level, time, kind, pin and accesses follow from id and label."""
    return _doc_facts(tables.read(spark, sf, "documents"), tables.read(spark, sf, "labels"))


def _doc_facts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    labels = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    level = F.element_at(F.array(*(F.lit(x) for x in lifecycle.ORDER)), (F.col("doc_id") % 6 + 1).cast("int"))
    rows = docs.join(labels, "doc_id", "left")
    return rows.select(
        "doc_id",
        "text",
        "source",
        level.alias("level"),
        F.timestamp_millis(F.lit(1577836800000) + (F.col("doc_id") * 37 % 1500) * 86_400_000).alias("ts"),
        text.memory_kind(F.col("text")).alias("memory_kind"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("is_pinned"),
        (F.col("doc_id") % 7).cast("int").alias("access_count"),
    )


def _kind_sql(column: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join("contains(lower(" + column + "), '" + p.replace("'", "''") + "')" for p in phrases)} THEN '{kind}'" for kind, phrases in text.KIND_PHRASES)
    return f"(CASE {cases} ELSE 'observation' END)"


_EV = """ev AS (SELECT event_id, ts, user_id, event_type, value, props, 'agent_' || (user_id % 5) AS agent,
    CASE event_type WHEN 'error' THEN 'system' WHEN 'view' THEN 'assistant' ELSE 'user' END AS role, event_type || ' ' || props AS text FROM events)"""
_TURNS = """tu AS (SELECT conv_id * 1000 + turn AS event_id, 'conv-' || conv_id AS session_id, conv_id, turn, role, text,
    1706540400000 + conv_id * 3600000 + turn * 100 AS ms FROM conversations)"""
_FACTS = f"""lb AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
  fx AS (SELECT d.doc_id, text, source, ['segment','grip','day','week','month','year'][CAST(d.doc_id % 6 + 1 AS INT)] AS level,
    1577836800000 + (d.doc_id * 37 % 1500) * 86400000 AS ms, {_kind_sql("text")} AS memory_kind, coalesce(quality = 1, false) AS is_pinned,
    CAST(d.doc_id % 7 AS INT) AS access_count FROM documents d LEFT JOIN lb ON lb.doc_id = d.doc_id)"""
_SALIENCE = "(0.35 + 0.45 * least(strlen(text) / 500.0, 1.0) + CASE WHEN memory_kind <> 'observation' THEN 0.2 ELSE 0 END + CASE WHEN is_pinned THEN 0.2 ELSE 0 END)"
_ASOF_MS = "epoch_ms(TIMESTAMP '2024-02-01')"
_SEGMENTS = """gaps AS (SELECT *, CASE WHEN epoch_us(ts) // 1000 - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000 > 1800000 THEN 1 ELSE 0 END AS b FROM ev),
  seg AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS segment_no FROM gaps)"""


def _bm25_sql(table: str, key: str, terms: str, keep: str = "") -> str:
    words = ", ".join(f"'{t}'" for t in dict.fromkeys(terms.lower().split()))
    return f"""tk AS (SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {table}{keep}),
  st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM tk),
  tf AS (SELECT {key}, len(w) AS dl, t, len(list_filter(w, lambda x: x = t)) AS f FROM tk, (SELECT unnest([{words}]) AS t)),
  dfs AS (SELECT t, count(*) FILTER (f > 0) AS df FROM tf GROUP BY t),
  bm AS (SELECT {key}, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / a))), 9) AS score
         FROM tf JOIN dfs USING (t), st GROUP BY {key} HAVING sum(f) > 0)"""


_VEC = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), q AS (SELECT e AS qe FROM v WHERE vec_id = 0)"
_COS = "list_cosine_similarity(e, qe)"


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    """One row by id: the query of the kNN examples."""
    return list(tables.read(spark, sf, "embeddings").filter("vec_id = 0").select("embedding").first()[0])


# Store.


@query("events_in_range", f"WITH {_EV} SELECT event_id, epoch_us(ts) // 1000 AS ms, agent FROM ev WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08'")
def events_in_range(spark: SparkSession, sf: str) -> DataFrame:
    return store.in_range(tables.events(spark, sf), "2024-01-05", "2024-01-08").select("event_id", ms("ts").alias("ms"), "agent")


@query("event_lookup", f"WITH {_EV} SELECT event_id, epoch_us(ts) // 1000 AS ms, event_type, text FROM ev WHERE event_id = 77")
def event_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return store.lookup(tables.events(spark, sf), "event_id", 77).select("event_id", ms("ts").alias("ms"), "event_type", "text")


@query("idempotent_insert", "SELECT event_id, value FROM events WHERE event_id % 3 = 0 AND event_id % 2 <> 0")
def idempotent_insert(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.events(spark, sf)
    incoming = e.filter("event_id % 3 = 0").unionByName(e.filter("event_id % 6 = 3"))
    return store.new_rows(incoming, e.filter("event_id % 2 = 0"), "event_id").select("event_id", "value")


@query("upsert_replaces", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'new' ELSE event_type END AS event_type FROM events")
def upsert_replaces(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.events(spark, sf).select("event_id", "event_type")
    return store.upsert(e, e.filter("event_id % 5 = 0").withColumn("event_type", F.lit("new")), "event_id")


@query("events_page_has_more", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS position, (SELECT count(*) FROM events) > 60 AS has_more FROM (SELECT * FROM events ORDER BY ts, event_id LIMIT 20 OFFSET 40)")
def events_page_has_more(spark: SparkSession, sf: str) -> DataFrame:
    return store.page(tables.events(spark, sf), ["ts", "event_id"], 40, 20).select("event_id", "position", "has_more")


@query("events_pages_by_key", "SELECT page, event_id, has_more FROM (SELECT CAST((row_number() OVER (ORDER BY ts, event_id) - 1) // 400 AS INT) AS page, event_id, (SELECT count(*) FROM events) > 400 * (1 + (row_number() OVER (ORDER BY ts, event_id) - 1) // 400) AS has_more FROM events) WHERE page < 3")
def events_pages_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """The first three pages of all events, each asked for by the token of the row before it."""
    e, token, pages = tables.events(spark, sf), None, []
    for k in range(3):
        pages.append(store.page_after(e, ["ts", "event_id"], token, 400).select(F.lit(k).alias("page"), "event_id", "has_more", "token"))
        last = pages[-1].agg(F.max_by("token", F.struct(F.get_json_object("token", "$[0]").cast("bigint"), "event_id"))).first()[0]  # one row
        token = last if last is not None else token
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).drop("token")


@query("prefix_scan", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_type, 'PROMO') OR p_name LIKE 'a%'")
def prefix_scan(spark: SparkSession, sf: str) -> DataFrame:
    p = tables.read(spark, sf, "part")
    by_type, by_name = store.prefix_scan(p, "p_type", "PROMO"), store.prefix_scan(p, "p_name", "a")
    return by_type.unionByName(by_name).dropDuplicates(["p_partkey"]).select("p_partkey", "p_name")


@query("outbox_window", "SELECT event_id AS seq, event_type FROM events WHERE event_id >= 100 ORDER BY event_id LIMIT 50")
def outbox_window(spark: SparkSession, sf: str) -> DataFrame:
    outbox = tables.events(spark, sf).select(F.col("event_id").alias("seq"), "event_type")
    return store.outbox_after(store.outbox_truncated(outbox, 99), 0, 50)


@query("store_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("events", "documents", "conversations", "embeddings")))
def store_counts(spark: SparkSession, sf: str) -> DataFrame:
    return store.counts({t: tables.read(spark, sf, t) for t in ("events", "documents", "conversations", "embeddings")})


@query("next_vector_id", "SELECT max(vec_id) + 1 AS next_id FROM embeddings")
def next_vector_id(spark: SparkSession, sf: str) -> DataFrame:
    return store.next_id(tables.read(spark, sf, "embeddings"), "vec_id")


@query("toc_latest_version", "SELECT user_id AS node_id, count(*) AS version, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def toc_latest_version(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.events(spark, sf)
    version = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")
    rows = e.select(F.col("user_id").alias("node_id"), version.alias("version"), "event_id")
    return store.latest_versions(rows, "node_id")


@query("toc_next_version", "SELECT user_id AS node_id, CAST(count(*) FILTER (event_id % 2 = 0) + 1 AS BIGINT) AS version FROM events GROUP BY user_id")
def toc_next_version(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.events(spark, sf)
    stored = e.filter("event_id % 2 = 0").select(F.col("user_id").alias("node_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint").alias("version"))
    return store.next_versions(e.select(F.col("user_id").alias("node_id")).distinct(), stored, "node_id").select("node_id", "version")


# Time keys and hierarchy.


@query(
    "toc_node_ids",
    "SELECT event_id, 'toc:year:' || strftime(ts, '%Y') AS year_id, 'toc:month:' || strftime(ts, '%Y-%m') AS month_id, 'toc:week:' || isoyear(ts) || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0') AS week_id, 'toc:day:' || strftime(ts, '%Y-%m-%d') AS day_id FROM events",
)
def toc_node_ids(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("ts")
    return tables.events(spark, sf).select("event_id", *(timekeys.node_id(x, t).alias(f"{x}_id") for x in ("year", "month", "week", "day")))


@query(
    "toc_parent_chain",
    """SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, 'toc:week:' || isoyear(o_orderdate) || '-W' || lpad(CAST(week(o_orderdate) AS VARCHAR), 2, '0') AS day_parent,
       'toc:month:' || strftime(date_trunc('week', o_orderdate) + INTERVAL 3 DAY, '%Y-%m') AS week_parent, 'toc:year:' || strftime(o_orderdate, '%Y') AS month_parent FROM orders""",
)
def toc_parent_chain(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("o_orderdate").cast("timestamp")
    return tables.read(spark, sf, "orders").select("o_orderkey", *(timekeys.parent_id(x, t).alias(f"{x}_parent") for x in ("day", "week", "month")))


_BOUNDS = ", ".join(f"epoch_ms(date_trunc('{u}', o_orderdate)) AS {u}_start, epoch_ms(date_trunc('{u}', o_orderdate) + INTERVAL {n}) - 1 AS {u}_end" for u, n in (("day", "1 DAY"), ("week", "7 DAY"), ("month", "1 MONTH"), ("year", "1 YEAR")))


@query("toc_period_bounds", f"SELECT o_orderkey, {_BOUNDS} FROM orders")
def toc_period_bounds(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("o_orderdate").cast("timestamp")
    cols = [c for u in ("day", "week", "month", "year") for c in (ms(timekeys.period_start(u, t)).alias(f"{u}_start"), ms(timekeys.period_end(u, t)).alias(f"{u}_end"))]
    return tables.read(spark, sf, "orders").select("o_orderkey", *cols)


@query(
    "toc_titles",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year_title, strftime(o_orderdate, '%B %Y') AS month_title, 'Week ' || week(o_orderdate) || ' of ' || isoyear(o_orderdate) AS week_title, strftime(o_orderdate, '%A, %B %d, %Y') AS day_title FROM orders",
)
def toc_titles(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("o_orderdate").cast("timestamp")
    return tables.read(spark, sf, "orders").select("o_orderkey", *(timekeys.title(x, t).alias(f"{x}_title") for x in ("year", "month", "week", "day")))


_LEVELS = """d AS (SELECT date_trunc('day', ts) AS s, agent FROM ev),
  lv AS (SELECT 'toc:day:' || strftime(s, '%Y-%m-%d') AS node_id, 'day' AS level, agent FROM d
   UNION ALL SELECT 'toc:week:' || isoyear(s) || '-W' || lpad(CAST(week(s) AS VARCHAR), 2, '0'), 'week', agent FROM d
   UNION ALL SELECT 'toc:month:' || strftime(date_trunc('week', s) + INTERVAL 3 DAY, '%Y-%m'), 'month', agent FROM d
   UNION ALL SELECT 'toc:year:' || strftime(date_trunc('week', s) + INTERVAL 3 DAY, '%Y'), 'year', agent FROM d)"""


@query("toc_levels_rollup", f"WITH {_EV}, {_LEVELS} SELECT node_id, level, count(*) AS n_events, array_to_string(list_sort(list_distinct(list(agent))), ',') AS agents FROM lv GROUP BY node_id, level")
def toc_levels_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return toc.hierarchy(tables.events(spark, sf)).select("node_id", "level", F.col("n_events").cast("bigint").alias("n_events"), F.array_join("contributing_agents", ",").alias("agents"))


@query(
    "toc_children_browse",
    f"""WITH {_EV} SELECT 'toc:week:' || isoyear(s) || '-W' || lpad(CAST(week(s) AS VARCHAR), 2, '0') AS node_id, string_agg('toc:day:' || strftime(s, '%Y-%m-%d'), ',' ORDER BY s) AS children
    FROM (SELECT DISTINCT date_trunc('day', ts) AS s FROM ev) GROUP BY 1""",
)
def toc_children_browse(spark: SparkSession, sf: str) -> DataFrame:
    nodes = toc.with_children(toc.hierarchy(tables.events(spark, sf)))
    return nodes.filter("level = 'week'").select("node_id", F.array_join("child_node_ids", ",").alias("children"))


@query("toc_level_overlap_scan", f"WITH {_EV} SELECT DISTINCT 'toc:day:' || strftime(ts, '%Y-%m-%d') AS node_id FROM ev WHERE date_trunc('day', ts) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09'")
def toc_level_overlap_scan(spark: SparkSession, sf: str) -> DataFrame:
    days = toc.period_nodes(tables.events(spark, sf), "day")
    return toc.range_summary(days, F.lit("2024-01-05 12:00:00").cast("timestamp"), F.lit("2024-01-09 00:00:00").cast("timestamp")).select("node_id")


@query("toc_closed_periods", f"WITH {_EV}, {_LEVELS} SELECT DISTINCT node_id FROM lv WHERE level = 'day' AND node_id < 'toc:day:2024-01-20'")
def toc_closed_periods(spark: SparkSession, sf: str) -> DataFrame:
    days = toc.period_nodes(tables.events(spark, sf), "day")
    return toc.closed(days, F.lit("2024-01-20 01:00:00").cast("timestamp")).select("node_id")


@query(
    "timeline_entity",
    f"WITH {_EV} SELECT event_id, epoch_us(ts) // 1000 AS ms FROM ev WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-10' AND contains(lower(text), 'purchase') ORDER BY ts, event_id LIMIT 100",
)
def timeline_entity(spark: SparkSession, sf: str) -> DataFrame:
    rows = toc.timeline(tables.events(spark, sf), F.lit("2024-01-03").cast("timestamp"), F.lit("2024-01-10").cast("timestamp"), "Purchase")
    return rows.select("event_id", ms("ts").alias("ms"))


@query(
    "mock_summary",
    f"""WITH {_TURNS} SELECT session_id, 'Summary of ' || count(*) || ' events' AS title, 'Total events: ' || count(*) AS bullet_total FROM tu GROUP BY session_id""",
)
def mock_summary(spark: SparkSession, sf: str) -> DataFrame:
    return toc.mock_summary(tables.turns(spark, sf), "session_id", "text", "turn").select("session_id", "title", "bullet_total")


# Segments.


@query("segments_by_gap", f"WITH {_EV}, {_SEGMENTS} SELECT user_id, CAST(segment_no AS BIGINT) AS segment_no, count(*) AS n_events, min(epoch_us(ts) // 1000) AS start_ms, max(epoch_us(ts) // 1000) AS end_ms FROM seg GROUP BY 1, 2")
def segments_by_gap(spark: SparkSession, sf: str) -> DataFrame:
    rows = segments.by_gap(tables.events(spark, sf), "user_id")
    return rows.groupBy("user_id", "segment_no").agg(F.count(F.lit(1)).alias("n_events"), F.min(ms("ts")).alias("start_ms"), F.max(ms("ts")).alias("end_ms"))


_TOKENS = "greatest(strlen(text) // 4, 1)"


@query(
    "segments_by_gap_and_tokens",
    f"""WITH RECURSIVE {_EV}, o AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS ms, CAST({_TOKENS} AS BIGINT) AS tokens, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS k FROM ev),
    f AS (SELECT event_id, user_id, ms, k, tokens AS used, 0 AS segment_no FROM o WHERE k = 1
      UNION ALL SELECT o.event_id, o.user_id, o.ms, o.k, CASE WHEN o.ms - f.ms > 86400000 OR f.used + o.tokens > 20 THEN o.tokens ELSE f.used + o.tokens END,
        CASE WHEN o.ms - f.ms > 86400000 OR f.used + o.tokens > 20 THEN f.segment_no + 1 ELSE f.segment_no END FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
    SELECT user_id, event_id, CAST(segment_no AS INT) AS segment_no FROM f""",
)
def segments_by_gap_and_tokens(spark: SparkSession, sf: str) -> DataFrame:
    config = Segmentation(gap_ms=86_400_000, max_tokens=20)
    return segments.by_gap_and_tokens(segments.event_tokens(tables.events(spark, sf), config), "user_id", config)


@query(
    "segment_overlap",
    f"""WITH {_EV}, {_SEGMENTS}, b AS (SELECT user_id, segment_no, event_id, sum({_TOKENS}) OVER (PARTITION BY user_id, segment_no ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS used,
      max(epoch_us(ts) // 1000) OVER (PARTITION BY user_id, segment_no) - epoch_us(ts) // 1000 AS age FROM seg)
    SELECT user_id, CAST(segment_no AS BIGINT) AS segment_no, event_id FROM b WHERE used <= 500 AND age <= 300000""",
)
def segment_overlap(spark: SparkSession, sf: str) -> DataFrame:
    rows = segments.by_gap(segments.event_tokens(tables.events(spark, sf)), "user_id")
    return segments.overlap(rows, "user_id").select("user_id", "segment_no", "event_id")


@query(
    "grip_expand_context",
    f"""WITH {_EV}, g AS (SELECT event_id AS grip_id, user_id, ts AS ts_start, ts AS ts_end FROM ev),
    n AS (SELECT g.grip_id, e.event_id, CASE WHEN e.ts < ts_start THEN 'before' WHEN e.ts > ts_end THEN 'after' ELSE 'excerpt' END AS place, abs(epoch_us(e.ts) - epoch_us(ts_start)) AS away
      FROM g JOIN ev e ON e.user_id = g.user_id AND e.ts BETWEEN ts_start - INTERVAL 10 HOUR AND ts_end + INTERVAL 10 HOUR),
    r AS (SELECT *, row_number() OVER (PARTITION BY grip_id, place ORDER BY away, CASE WHEN place = 'before' THEN -event_id ELSE event_id END) AS nth FROM n)
    SELECT grip_id, event_id, place, CAST(nth AS INT) AS nth FROM r WHERE place = 'excerpt' OR nth <= 3""",
)
def grip_expand_context(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.events(spark, sf)
    g = e.select(F.col("event_id").alias("grip_id"), "user_id", F.col("ts").alias("ts_start"), F.col("ts").alias("ts_end"))
    return toc.grip_context(g, e, Grips(window_minutes=600), key="user_id")


# Text search over nodes.

_TERMS = text.query_terms("the nation thereen")
_HITS = " + ".join(f"CAST(contains(lower(text), '{t}') AS INT)" for t in _TERMS)


@query("term_overlap_search", f"SELECT doc_id, round(({_HITS}) / {float(len(_TERMS))}, 6) AS score FROM documents WHERE ({_HITS}) > 0")
def term_overlap_search(spark: SparkSession, sf: str) -> DataFrame:
    d = tables.read(spark, sf, "documents")
    return d.select("doc_id", r6(text.term_overlap(F.col("text"), _TERMS)).alias("score")).filter("score IS NOT NULL")


def doc_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as nodes: the first sentence is the title and gives the keywords, and all sentences are bullets."""
    d = tables.read(spark, sf, "documents")
    sentences = F.split("text", r"\. ")
    rows = d.select(F.col("doc_id").alias("node_id"), F.col("source").alias("parent_id"), sentences.alias("bullets"))
    first = F.element_at("bullets", 1)
    return rows.select("node_id", "parent_id", first.alias("title"), "bullets", F.split(F.lower(first), " ").alias("keywords"))


def _overlap_sql(column: str) -> str:
    hits = " + ".join(f"CAST(contains(lower({column}), '{t}') AS INT)" for t in _TERMS)
    return f"round(({hits}) / {float(len(_TERMS))}, 6)"


NODES = """n AS (SELECT doc_id AS node_id, source AS parent_id, bullets[1] AS title, bullets, string_split(lower(bullets[1]), ' ') AS keywords
    FROM (SELECT doc_id, source, string_split(text, '. ') AS bullets FROM documents))"""
_NODE_MATCHES = f"""{NODES},
  m AS (SELECT node_id, parent_id, 'title' AS field, {_overlap_sql("title")} AS score FROM n
    UNION ALL SELECT node_id, parent_id, 'summary', {_overlap_sql("array_to_string(bullets, ' ')")} FROM n
    UNION ALL SELECT node_id, parent_id, 'bullets', {_overlap_sql("b")} FROM (SELECT node_id, parent_id, unnest(bullets) AS b FROM n)
    UNION ALL SELECT node_id, parent_id, 'keywords', 1.0 FROM (SELECT node_id, parent_id, unnest(keywords) AS k FROM n) WHERE k IN ({", ".join(f"'{t}'" for t in _TERMS)}))"""


@query("node_field_search", f"WITH {_NODE_MATCHES} SELECT node_id, field, CAST(score AS DOUBLE) AS score FROM m WHERE score > 0")
def node_field_search(spark: SparkSession, sf: str) -> DataFrame:
    return toc.node_search(doc_nodes(spark, sf), _TERMS).select("node_id", "field", r6("score").alias("score"))


@query("search_children_relevance", f"WITH {_NODE_MATCHES} SELECT node_id, round(avg(score), 5) AS relevance, count(*) AS n_matches FROM m WHERE score > 0 AND parent_id = 'src0' GROUP BY node_id ORDER BY avg(score) DESC, node_id LIMIT 10")
def search_children_relevance(spark: SparkSession, sf: str) -> DataFrame:
    return toc.children_relevance(doc_nodes(spark, sf), "src0", _TERMS).withColumn("relevance", F.round("relevance", 5))


# Scores.


@query("memory_kind", f"SELECT doc_id, {_kind_sql('text')} AS memory_kind FROM documents")
def memory_kind(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read(spark, sf, "documents").select("doc_id", text.memory_kind(F.col("text")).alias("memory_kind"))


@query("salience_score", f"WITH {_FACTS} SELECT doc_id, round({_SALIENCE}, 6) AS salience FROM fx")
def salience_score(spark: SparkSession, sf: str) -> DataFrame:
    return doc_facts(spark, sf).select("doc_id", r6(scoring.salience(F.col("text"), F.col("memory_kind"), F.col("is_pinned"))).alias("salience"))


@query("usage_penalty", f"WITH {_FACTS} SELECT doc_id, round(1.0 / (1 + 0.15 * access_count), 6) AS penalty FROM fx")
def usage_penalty(spark: SparkSession, sf: str) -> DataFrame:
    return doc_facts(spark, sf).select("doc_id", r6(scoring.usage_penalty(F.col("access_count"))).alias("penalty"))


@query("combined_ranking", f"WITH {_FACTS} SELECT doc_id, round(greatest(s * (0.55 + 0.45 * {_SALIENCE}) / (1 + 0.15 * access_count), 0.5 * s), 6) AS score FROM (SELECT *, (doc_id % 100) / 100.0 AS s FROM fx)")
def combined_ranking(spark: SparkSession, sf: str) -> DataFrame:
    rows = doc_facts(spark, sf).withColumns({"salience_score": scoring.salience(F.col("text"), F.col("memory_kind"), F.col("is_pinned")), "score": F.col("doc_id") % 100 / 100.0})
    return ranking.combine(rows, Ranking(usage=True)).select("doc_id", r6("score").alias("score"))


@query(
    "stale_decay",
    f"""WITH {_FACTS} SELECT doc_id, round(CASE WHEN memory_kind IN ('constraint', 'definition', 'procedure', 'preference') THEN 1.0
    ELSE 1 - 0.3 * (1 - exp(-((max(ms) OVER () - ms) / 86400000.0) / 14.0)) END, 6) AS score FROM fx""",
)
def stale_decay(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.decay(doc_facts(spark, sf).withColumn("score", F.lit(1.0))).select("doc_id", r6("score").alias("score"))


@query(
    "supersession",
    """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    p AS (SELECT a.vec_id, b.vec_id AS newer FROM v a JOIN v b ON a.label = b.label AND b.vec_id > a.vec_id AND list_inner_product(a.e, b.e) >= 0.8)
    SELECT vec_id AS doc_id, max(newer) AS newer FROM p GROUP BY vec_id""",
)
def supersession(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", "embedding", F.timestamp_millis(F.col("vec_id") * 1000).alias("ts"))
    return ranking.superseded(rows, "label")


@query(
    "enrich_results",
    f"""WITH {_FACTS} SELECT doc_id, round(CASE WHEN doc_id % 2 = 0 THEN {_SALIENCE} WHEN doc_id % 3 = 0 THEN {_SALIENCE} ELSE 0.5 END, 6) AS salience_score,
    CASE WHEN doc_id % 2 = 0 OR doc_id % 3 = 0 THEN memory_kind ELSE 'observation' END AS memory_kind, CASE WHEN doc_id % 2 = 0 THEN access_count ELSE 0 END AS access_count FROM fx""",
)
def enrich_results(spark: SparkSession, sf: str) -> DataFrame:
    facts = doc_facts(spark, sf)
    full = facts.select("doc_id", scoring.salience(F.col("text"), F.col("memory_kind"), F.col("is_pinned")).alias("salience_score"), "memory_kind", "access_count")
    out = ranking.enrich(facts.select("doc_id"), full.filter("doc_id % 2 = 0"), full.filter("doc_id % 3 = 0"))
    return out.withColumn("salience_score", r6("salience_score"))


@query("episode_value", "SELECT doc_id, round(greatest(0.0, 1 - abs((doc_id % 101) / 100.0 - 0.65)), 6) AS value FROM documents")
def episode_value(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read(spark, sf, "documents").select("doc_id", r6(scoring.episode_value(F.col("doc_id") % 101 / 100.0)).alias("value"))


@query(
    "topic_importance",
    """SELECT doc_id, round(greatest(ln(1 + doc_id % 50) * greatest(pow(2.0, -d / 30.0), 0.01) * CASE WHEN d < 1 THEN 2.0 WHEN d < 7 THEN 2.0 - (d - 1) / 6.0 ELSE 1.0 END, 0.01), 6) AS importance
    FROM (SELECT doc_id, (doc_id % 1000) / 8.0 AS d FROM documents)""",
)
def topic_importance(spark: SparkSession, sf: str) -> DataFrame:
    return tables.read(spark, sf, "documents").select("doc_id", r6(scoring.importance(F.col("doc_id") % 50, F.col("doc_id") % 1000 / 8.0)).alias("importance"))


# Search.


@query("bm25_search", f"WITH {_bm25_sql('documents', 'doc_id', SEARCH)} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY score DESC, doc_id LIMIT 20")
def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    found = search.top(word_index(spark, sf).search(SEARCH), 20, "doc_id")
    return found.select("doc_id", r6("score").alias("score"))


@query("bm25_doc_type_filter", f"WITH {_bm25_sql('documents', 'doc_id', SEARCH)} SELECT doc_id, lang, round(score, 6) AS score FROM bm JOIN documents USING (doc_id) WHERE lang = 'en' ORDER BY score DESC, doc_id LIMIT 20")
def bm25_doc_type_filter(spark: SparkSession, sf: str) -> DataFrame:
    found = search.bm25(tables.read(spark, sf, "documents"), SEARCH, carry=["lang"]).filter("lang = 'en'")
    return search.top(found, 20, "doc_id").select("doc_id", "lang", r6("score").alias("score"))


@query(
    "bm25_postings",
    """WITH tk AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM documents)
    SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM tk GROUP BY term""",
)
def bm25_postings(spark: SparkSession, sf: str) -> DataFrame:
    terms, _ = search.postings(tables.read(spark, sf, "documents"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@query(
    "tfidf_top_terms",
    f"""WITH sw AS (SELECT [{", ".join(f"'{w}'" for w in text.STOP_WORDS)}] AS s),
    tk AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: strlen(x) > 1 AND NOT list_contains(s, x) AND NOT regexp_full_match(x, '[0-9]+')) AS w FROM conversations, sw),
    x AS (SELECT conv_id, turn, unnest(w) AS term FROM tk), tf AS (SELECT conv_id, term, count(*) AS tf FROM x GROUP BY 1, 2),
    df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT conv_id, turn, term FROM x) GROUP BY term), tot AS (SELECT conv_id, sum(len(w)) AS total FROM tk GROUP BY conv_id), n AS (SELECT count(*) AS n FROM tk),
    sc AS (SELECT conv_id, term, tf / total * (ln((n + 1) / (df + 1)) + 1) AS score FROM tf JOIN df USING (term) JOIN tot USING (conv_id), n)
    SELECT conv_id, term, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY round(score, 9) DESC, term) AS rank FROM sc) WHERE rank <= 3""",
)
def tfidf_top_terms(spark: SparkSession, sf: str) -> DataFrame:
    scores = topics.term_scores(tables.read(spark, sf, "conversations"), "conv_id").withColumn("score", F.round("score", 9))
    return topics.top_terms(scores, "conv_id", 3).select("conv_id", "term", "rank", r6("score").alias("score"))


@query("vector_knn", f"WITH {_VEC} SELECT vec_id, round({_COS}, 6) AS score FROM v, q ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vector_knn(spark: SparkSession, sf: str) -> DataFrame:
    found = search.knn(tables.read(spark, sf, "embeddings"), _query_vector(spark, sf), 10)
    return found.select("vec_id", r6("score").alias("score"))


@query("vector_knn_filtered", f"WITH {_VEC} SELECT vec_id, label, round({_COS}, 6) AS score FROM v, q WHERE label = 3 AND {_COS} >= 0.05 ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vector_knn_filtered(spark: SparkSession, sf: str) -> DataFrame:
    found = search.knn(tables.read(spark, sf, "embeddings"), _query_vector(spark, sf), 10, carry=["label"], where=F.col("label") == 3)
    return found.filter("score >= 0.05").select("vec_id", "label", r6("score").alias("score"))


_TWO_LISTS = f"""{_bm25_sql("documents", "doc_id", SEARCH)}, {_VEC},
  l1 AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM bm QUALIFY r <= 20),
  l2 AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY {_COS} DESC, vec_id) AS r FROM v, q QUALIFY r <= 20)"""


_indexes: dict[tuple[str, str], WordIndex] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all machines share: under ``spark.checkpoint.dir``, or a temporary one where that is unset and the master is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
    return f"{shared or tempfile.gettempdir()}/{name}-{uuid.uuid4().hex}"


def word_index(spark: SparkSession, sf: str) -> WordIndex:
    """The word index of the documents of a folder, built once per application."""
    held = (spark.sparkContext.applicationId, sf)
    if held not in _indexes:
        index = WordIndex(spark, scratch(spark, "words"))
        index.add(tables.read(spark, sf, "documents").select("doc_id", "text"))
        index.commit()
        _indexes[held] = index
    return _indexes[held]


def _two_lists(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    words = search.top(word_index(spark, sf).search(SEARCH), 20, "doc_id")
    near = search.knn(tables.read(spark, sf, "embeddings"), _query_vector(spark, sf), 20).withColumnRenamed("vec_id", "doc_id")
    return {"bm25": words, "vector": near}


@query("hybrid_rrf", f"WITH {_TWO_LISTS} SELECT doc_id, round(sum(0.5 / (60 + r)), 6) AS score, count(*) AS n_lists FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2) GROUP BY doc_id")
def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    fused = search.rrf(_two_lists(spark, sf), "doc_id", {"bm25": 0.5, "vector": 0.5})
    return fused.withColumn("score", r6("score"))


@query("rrf_three_lists", f"WITH {_TWO_LISTS}, l3 AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 20) SELECT doc_id, round(sum(1.0 / (60 + r)), 6) AS score, count(*) AS n_lists FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) GROUP BY doc_id")
def rrf_three_lists(spark: SparkSession, sf: str) -> DataFrame:
    lists = _two_lists(spark, sf)
    lists["length"] = search.top(tables.read(spark, sf, "documents").select("doc_id", F.col("n_chars").alias("score")), 20, "doc_id")
    return search.rrf(lists, "doc_id").withColumn("score", r6("score"))


@query(
    "layer_merge_dedup",
    """WITH u AS (SELECT doc_id, (doc_id * 7 % 100) / 100.0 AS score, 'a' AS source_layer FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, (doc_id * 11 % 100) / 100.0, 'b' FROM documents WHERE doc_id % 3 = 0)
    SELECT doc_id, CAST(score AS DOUBLE) AS score, source_layer FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, source_layer) AS k FROM u) WHERE k = 1""",
)
def layer_merge_dedup(spark: SparkSession, sf: str) -> DataFrame:
    d = tables.read(spark, sf, "documents")
    a = d.filter("doc_id % 2 = 0").select("doc_id", (F.col("doc_id") * 7 % 100 / 100.0).alias("score"))
    b = d.filter("doc_id % 3 = 0").select("doc_id", (F.col("doc_id") * 11 % 100 / 100.0).alias("score"))
    return search.merge_layers({"a": a, "b": b}, "doc_id")


@query(
    "federated_union",
    """SELECT * FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) AS score, 'documents' AS project FROM documents UNION ALL SELECT page_id, CAST(length(html) AS DOUBLE), 'pages' FROM pages) ORDER BY score DESC, doc_id, project LIMIT 15""",
)
def federated_union(spark: SparkSession, sf: str) -> DataFrame:
    d = tables.read(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    p = tables.read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.char_length("html").cast("double").alias("score"))
    return search.federated({"documents": d, "pages": p}, 15, "doc_id")


# Routing.

_INTENT_TEXT = "lower(text)"


def _intent_sql(words: tuple[str, ...]) -> str:
    hits = " + ".join(f"CAST(contains({_INTENT_TEXT}, '{w}') AS INT)" for w in words)
    long = " + ".join(f"CAST(contains({_INTENT_TEXT}, '{w}') AS INT)" for w in words if len(w) > 5)
    return f"least(1.0, least({hits}, 3) / 3.0 + 0.1 * ({long}))"


@query(
    "intent_classify",
    f"""WITH s AS (SELECT doc_id, {", ".join(f"{_intent_sql(w)} AS {k}_score" for k, w in router.INTENT_KEYWORDS.items())} FROM documents), b AS (SELECT *, greatest(explore_score, answer_score, locate_score) AS best FROM s)
    SELECT doc_id, CASE WHEN best < 0.3 THEN 'answer' WHEN explore_score = best THEN 'explore' WHEN locate_score = best THEN 'locate' ELSE 'answer' END AS intent, round(CASE WHEN best < 0.3 THEN 0.5 ELSE best END, 6) AS confidence FROM b""",
)
def intent_classify(spark: SparkSession, sf: str) -> DataFrame:
    return router.classify(tables.read(spark, sf, "documents"), "text").select("doc_id", "intent", r6("confidence").alias("confidence"))


_TIERS = "(VALUES " + ", ".join(f"('{t}', [{', '.join(f"'{x}'" for x in has)}])" for t, has in router.TIER_LAYERS.items()) + ") AS t(tier, has)"
_CHAINS = "(VALUES " + ", ".join(f"('{t}', [{', '.join(f"'{x}'" for x in has)}])" for t, has in router.CHAINS.items()) + ") AS c(intent, layers)"


_STORES = """st AS (SELECT source, bool_or(coalesce(q, 0) = 1) AS topics, bool_or(vec_id IS NOT NULL) AS vector, bool_or(text IS NOT NULL) AS bm25
    FROM documents LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) e ON vec_id = doc_id LEFT JOIN (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id) l USING (doc_id) GROUP BY source),
  tr AS (SELECT *, CASE WHEN vector AND bm25 THEN CASE WHEN topics THEN 'full' ELSE 'hybrid' END WHEN vector THEN 'semantic' WHEN bm25 THEN 'keyword' ELSE 'agentic' END AS tier FROM st)"""


def stores(spark: SparkSession, sf: str) -> DataFrame:
    """Each source of documents with the layers that are ready there, and its tier."""
    vectors = tables.read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("__vector")).distinct()
    good = tables.read(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("__q"))
    docs = tables.read(spark, sf, "documents").select("doc_id", "source", "text").join(vectors, "doc_id", "left").join(good, "doc_id", "left")
    ready = docs.groupBy("source").agg(F.bool_or(F.coalesce("__q", F.lit(0)) == 1).alias("topics"), F.bool_or(F.col("__vector").isNotNull()).alias("vector"), F.bool_or(F.col("text").isNotNull()).alias("bm25"))
    return ready.withColumn("tier", router.tier_column(F.col("topics"), F.col("vector"), F.col("bm25")))


@query("tier_matrix", f"WITH {_STORES} SELECT source, layer, list_contains(has, layer) AS supported FROM tr JOIN {_TIERS} USING (tier), (SELECT unnest(['topics', 'hybrid', 'vector', 'bm25', 'agentic']) AS layer)")
def tier_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Which layers each source supports by its tier."""
    layers = F.explode(F.array(*map(F.lit, router.TIER_LAYERS["full"])))
    held = stores(spark, sf).select("source", router.layers_of(F.col("tier")).alias("has"), layers.alias("layer"))
    return held.select("source", "layer", F.array_contains("has", F.col("layer")).alias("supported"))


@query(
    "fallback_chain",
    f"""WITH {_STORES}, s AS (SELECT doc_id, source, {", ".join(f"{_intent_sql(w)} AS {k}_score" for k, w in router.INTENT_KEYWORDS.items())} FROM documents), b AS (SELECT *, greatest(explore_score, answer_score, locate_score) AS best FROM s),
    i AS (SELECT source, CASE WHEN best < 0.3 THEN 'answer' WHEN explore_score = best THEN 'explore' WHEN locate_score = best THEN 'locate' ELSE 'answer' END AS intent FROM b),
    g AS (SELECT intent, tier, count(*) AS n FROM i JOIN tr USING (source) GROUP BY intent, tier),
    x AS (SELECT g.intent, g.tier, n, unnest(layers) AS layer, generate_subscripts(layers, 1) AS k, has FROM g JOIN {_CHAINS} ON c.intent = g.intent JOIN {_TIERS} ON t.tier = g.tier),
    y AS (SELECT intent, tier, n, layer, row_number() OVER (PARTITION BY intent, tier ORDER BY k) - 1 AS position FROM x WHERE list_contains(has, layer)) SELECT intent, tier, n, CAST(position AS INT) AS position, layer FROM y WHERE position < 3""",
)
def fallback_chain(spark: SparkSession, sf: str) -> DataFrame:
    """The layers to try for the texts as queries, by their intent and their source's tier, and for how many."""
    asked = router.classify(tables.read(spark, sf, "documents"), "text").select("source", "intent")
    groups = asked.join(stores(spark, sf).select("source", "tier"), "source").groupBy("intent", "tier").agg(F.count(F.lit(1)).alias("n"))
    return groups.select("intent", "tier", "n", F.posexplode(router.chain_column(F.col("intent"), F.col("tier"))).alias("position", "layer"))


@query(
    "query_expansion",
    """WITH a AS (SELECT conv_id, turn, text AS q, lower(text) AS low, trim(regexp_replace(lower(text), '^(what )*(how )*(why )*(when )*(where )*(did we )*(do we )*', '')) AS bare
      FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'What How did we ' || text WHEN 1 THEN 'where ' || lower(text) WHEN 2 THEN lower(text) ELSE text END AS text FROM conversations)),
    v AS (SELECT conv_id, turn, unnest(list_filter([CASE WHEN q <> '' THEN q END, CASE WHEN low <> '' AND low <> q THEN low END, CASE WHEN bare <> '' AND bare <> low THEN bare END], lambda x: x IS NOT NULL)) AS variant FROM a)
    SELECT conv_id, turn, variant, count(*) AS n FROM v GROUP BY 1, 2, 3""",
)
def query_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Variants of turns as questions, without neighbours that repeat."""
    low = F.lower("text")
    asked = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("What How did we "), "text")).when(F.col("turn") % 4 == 1, F.concat(F.lit("where "), low)).when(F.col("turn") % 4 == 2, low).otherwise(F.col("text"))
    variants = tables.read(spark, sf, "conversations").select("conv_id", "turn", F.explode(text.expanded(asked)).alias("variant"))
    return variants.groupBy("conv_id", "turn", "variant").agg(F.count(F.lit(1)).alias("n"))


@query("context_builder", f"WITH {_bm25_sql('documents', 'doc_id', SEARCH)}, b AS (SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 10) SELECT count(*) AS n_results, CAST(floor(sum(length(text)) * 0.75 + 50) AS BIGINT) AS tokens_estimated, round(max(score), 6) AS confidence FROM b JOIN documents USING (doc_id)")
def context_builder(spark: SparkSession, sf: str) -> DataFrame:
    found = search.top(search.bm25(tables.read(spark, sf, "documents"), SEARCH, carry=["text"]), 10, "doc_id")
    return router.context(found).withColumn("confidence", r6("confidence"))


EMBEDDER = HashingEmbedder(64)


def layers(spark: SparkSession, sf: str) -> dict[str, router.Layer]:
    """Words by the index, vectors by the query's embedding, both fused, and shared terms."""
    docs, near = tables.read(spark, sf, "documents"), tables.read(spark, sf, "embeddings")

    def by_words(asked: str) -> DataFrame:
        return search.top(word_index(spark, sf).search(asked), 50, "doc_id")

    def by_vector(asked: str) -> DataFrame:
        return search.knn(near, EMBEDDER.embed([asked])[0].tolist(), 50).withColumnRenamed("vec_id", "doc_id")

    def hybrid(asked: str) -> DataFrame:
        return search.rrf({"bm25": by_words(asked), "vector": by_vector(asked)}, "doc_id", {"bm25": 0.5, "vector": 0.5}).select("doc_id", "score")

    def agentic(asked: str) -> DataFrame:
        terms = text.query_terms(asked)
        return search.top(docs.select("doc_id", text.term_overlap(F.col("text"), terms).alias("score")).filter("score IS NOT NULL"), 50, "doc_id")

    return {"bm25": by_words, "vector": by_vector, "hybrid": hybrid, "agentic": agentic}


def _layers_sql(tag: str, asked: str) -> str:
    """bm25, vector, hybrid and agentic lists of a query: bm_, ve_, hy_ and ag_ with the tag."""
    words = _bm25_sql("documents", "doc_id", asked)
    vector = ", ".join(repr(float(x)) for x in EMBEDDER.embed([asked])[0])
    terms = text.query_terms(asked)
    hits = " + ".join(f"CAST(contains(lower(text), '{t}') AS INT)" for t in terms)
    return f"""bm_{tag} AS (WITH {words} SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM bm QUALIFY r <= 50),
      ve_{tag} AS (SELECT vec_id AS doc_id, s AS score, row_number() OVER (ORDER BY s DESC, vec_id) AS r
        FROM (SELECT vec_id, list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), [{vector}]) AS s FROM embeddings) QUALIFY r <= 50),
      hy_{tag} AS (SELECT doc_id, round(sum(0.5 / (60 + r)), 12) AS score FROM (SELECT doc_id, r FROM bm_{tag} UNION ALL SELECT doc_id, r FROM ve_{tag}) GROUP BY doc_id),
      ag_{tag} AS (SELECT doc_id, ({hits}) / {float(len(terms))} AS score FROM documents WHERE ({hits}) > 0 ORDER BY score DESC, doc_id LIMIT 50)"""


def facts(spark: SparkSession, sf: str) -> DataFrame:
    f = doc_facts(spark, sf)
    return f.select("doc_id", scoring.salience(F.col("text"), F.col("memory_kind"), F.col("is_pinned")).alias("salience_score"), "memory_kind", "access_count", "ts")


def facts_of(spark: SparkSession, sf: str) -> router.Facts:
    """Facts made for the documents of a short list only."""
    docs, labels = tables.read(spark, sf, "documents"), tables.read(spark, sf, "labels")

    def made(ids: DataFrame) -> DataFrame:
        few = F.broadcast(ids.distinct())  # a limited list
        f = _doc_facts(docs.join(few, "doc_id", "left_semi"), labels.join(few, "doc_id", "left_semi"))
        return f.select("doc_id", scoring.salience(F.col("text"), F.col("memory_kind"), F.col("is_pinned")).alias("salience_score"), "memory_kind", "access_count", "ts")

    return made


_EXEMPT = ", ".join(f"'{k}'" for k in text.EXEMPT_KINDS)


def _routed_sql(rows: str, select: str) -> str:
    """The re-scored best ten of a list ``rows`` (doc_id, score, source_layer)."""
    return f"""b AS (SELECT * FROM {rows} ORDER BY score DESC, doc_id LIMIT 100),
    e AS (SELECT b.doc_id, b.score, source_layer, coalesce(memory_kind, 'observation') AS memory_kind, ms, CASE WHEN fx.doc_id IS NULL THEN 0.5 ELSE {_SALIENCE} END AS sal FROM b LEFT JOIN fx ON fx.doc_id = b.doc_id),
    d AS (SELECT *, score * CASE WHEN ms IS NULL OR memory_kind IN ({_EXEMPT}) THEN 1.0 ELSE 1 - 0.3 * (1 - exp(-((max(ms) OVER () - ms) / 86400000.0) / 14.0)) END AS s FROM e),
    f AS (SELECT doc_id, greatest(s * (0.55 + 0.45 * sal), 0.5 * s) AS score, source_layer, memory_kind FROM d)
    SELECT {select} FROM f ORDER BY f.score DESC, doc_id LIMIT 10"""


_MERGED = """m AS (SELECT doc_id, score, source_layer FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) AS n
      FROM (SELECT doc_id, score, 'hybrid' AS source_layer, 0 AS k FROM hy_a UNION ALL SELECT doc_id, score, 'bm25', 1 FROM bm_a)) WHERE n = 1)"""
_ASKED = "how did the nation explain the"


@query("route_query", f"WITH {_layers_sql('a', _ASKED)}, {_MERGED}, {_FACTS}, {_routed_sql('m', 'doc_id, round(score, 6) AS score, source_layer, memory_kind')}")
def route_query(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = router.route(_ASKED, layers(spark, sf), facts_of(spark, sf))
    return out.withColumn("score", r6("score"))


@query(
    "route_query_keyword",
    f"WITH {_layers_sql('a', 'find the exact nation')}, m AS (SELECT doc_id, score, 'bm25' AS source_layer FROM bm_a), {_FACTS}, {_routed_sql('m', 'doc_id, round(score, 6) AS score, source_layer, memory_kind')}",
)
def route_query_keyword(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = router.route("find the exact nation", {"bm25": layers(spark, sf)["bm25"]}, facts_of(spark, sf))
    return out.withColumn("score", r6("score"))


_ORCHESTRATED = "What explains the nation"
_VARIANTS = text.expand_query(_ORCHESTRATED)
_ALL_LISTS = " UNION ALL ".join(f"SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM {layer}_{n} QUALIFY r <= 20" for n in range(len(_VARIANTS)) for layer in ("bm", "ve", "hy", "ag"))


@query(
    "orchestrated_query",
    f"WITH {', '.join(_layers_sql(str(n), v) for n, v in enumerate(_VARIANTS))}, l AS ({_ALL_LISTS}), o AS (SELECT doc_id, round(sum(1.0 / (60 + r)), 12) AS score, count(*) AS n_lists FROM l GROUP BY doc_id) SELECT doc_id, round(score, 6) AS score, n_lists FROM o ORDER BY o.score DESC, doc_id LIMIT 10",
)
def orchestrated_query(spark: SparkSession, sf: str) -> DataFrame:
    return router.orchestrate(_ORCHESTRATED, layers(spark, sf)).withColumn("score", r6("score"))


# Agents and metrics.


@query(
    "agent_summary",
    f"""WITH {_EV}, nd AS (SELECT date_trunc('day', ts) AS s, agent FROM ev GROUP BY 1, 2), se AS (SELECT agent, count(DISTINCT user_id) AS sessions FROM ev GROUP BY agent)
    SELECT agent, count(*) AS node_count, min(epoch_us(s) // 1000) AS first_ms, max(epoch_us(s) // 1000) + 86399999 AS last_ms, any_value(sessions) AS sessions FROM nd JOIN se USING (agent) GROUP BY agent""",
)
def agent_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.events(spark, sf)
    out = agents.agent_summary(toc.period_nodes(e, "day"), e.withColumn("session_id", F.col("user_id")), as_of())
    return out.select("agent", "node_count", ms("first_seen").alias("first_ms"), ms("last_seen").alias("last_ms"), "sessions")


for _unit in ("day", "week"):

    @query(f"activity_{'daily' if _unit == 'day' else 'weekly'}", f"WITH {_EV} SELECT agent, epoch_ms(date_trunc('{_unit}', ts)) AS bucket_ms, count(*) AS n_events FROM ev GROUP BY 1, 2")
    def _activity(spark: SparkSession, sf: str, unit: str = _unit) -> DataFrame:
        return agents.activity(tables.events(spark, sf), unit).select("agent", ms("bucket").alias("bucket_ms"), "n_events")


@query("ranking_metrics", f"WITH {_FACTS} SELECT round(avg({_SALIENCE}), 6) AS avg_salience, count(*) FILTER ({_SALIENCE} > 0.5) AS high_salience, CAST(sum(access_count) AS BIGINT) AS total_access, round(avg(1.0 / (1 + 0.15 * access_count)), 6) AS avg_penalty FROM fx")
def ranking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = agents.ranking_metrics(facts(spark, sf))
    return out.withColumns({"avg_salience": r6("avg_salience"), "avg_penalty": r6("avg_penalty")})


@query("usage_from_log", "SELECT user_id AS doc_id, count(*) AS access_count, max(epoch_us(ts) // 1000) AS last_ms FROM events WHERE event_type = 'view' GROUP BY user_id")
def usage_from_log(spark: SparkSession, sf: str) -> DataFrame:
    log = tables.events(spark, sf).filter("event_type = 'view'").withColumnRenamed("user_id", "doc_id")
    return agents.usage_from_log(log).select("doc_id", "access_count", ms("last_accessed").alias("last_ms"))


@query("token_totals", f"WITH {_TURNS} SELECT role, CAST(sum({_TOKENS}) AS BIGINT) AS tokens, CAST(floor(sum(strlen(text)) * 0.75 + 50) AS BIGINT) AS prompt_tokens FROM tu GROUP BY role")
def token_totals(spark: SparkSession, sf: str) -> DataFrame:
    t = tables.turns(spark, sf)
    return t.groupBy("role").agg(F.sum(scoring.token_estimate(F.col("text"))).alias("tokens"), scoring.prompt_tokens(F.sum(F.octet_length("text"))).alias("prompt_tokens"))


# Topics.

_CENTROIDS = """c AS (SELECT label, k, avg(x) AS x FROM (SELECT label, unnest(list_transform(embedding, lambda y: CAST(y AS DOUBLE))) AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY label, k),
  nc AS (SELECT label, k, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM c)"""


@query("topic_centroids", f"WITH {_CENTROIDS} SELECT label, CAST(k - 1 AS INT) AS place, round(x, 6) AS x FROM nc")
def topic_centroids(spark: SparkSession, sf: str) -> DataFrame:
    out = vectors.centroids(tables.read(spark, sf, "embeddings"), "label", "embedding")
    return out.select("label", F.posexplode("embedding").alias("place", "x")).withColumn("x", r6("x"))


def _topic_table(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.read(spark, sf, "embeddings")
    made = vectors.centroids(e, "label", "embedding").withColumnRenamed("label", "topic_id").withColumnRenamed("n", "node_count")
    age = F.col("topic_id") * 13
    return made.select(
        "topic_id",
        "embedding",
        "node_count",
        F.concat(F.lit("Topic "), F.col("topic_id").cast("string")).alias("label"),
        F.array(F.concat(F.lit("key"), (F.col("topic_id") % 4).cast("string"))).alias("keywords"),
        F.lit("active").alias("status"),
        (as_of() - F.make_interval(days=age.cast("int"))).alias("last_mentioned_at"),
        F.lit(0.0).alias("importance_score"),
    )


@query(
    "topic_semantic_edges",
    f"WITH {_CENTROIDS} SELECT a.label AS source_id, b.label AS target_id, round(sum(a.x * b.x), 6) AS strength FROM nc a JOIN nc b ON a.k = b.k AND a.label < b.label GROUP BY 1, 2 HAVING sum(a.x * b.x) >= -0.05",
)
def topic_semantic_edges(spark: SparkSession, sf: str) -> DataFrame:
    return topics.semantic_edges(_topic_table(spark, sf), -0.05).withColumn("strength", r6("strength"))


_LINKS = "ln AS (SELECT CAST(user_id % 20 AS BIGINT) AS topic_id, strftime(ts, '%Y-%m-%d') AS node_id, max(value) / 1000 AS relevance FROM events GROUP BY 1, 2 HAVING count(*) >= 2)"


def _links(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.events(spark, sf)
    return e.groupBy((F.col("user_id") % 20).alias("topic_id"), F.date_format("ts", "yyyy-MM-dd").alias("node_id")).agg((F.max("value") / 1000).alias("relevance"), F.count(F.lit(1)).alias("n")).filter("n >= 2").drop("n")


@query("topic_cooccurrence", f"WITH {_LINKS} SELECT a.topic_id AS source_id, b.topic_id AS target_id, count(*) AS evidence, round(least(1.0, 0.1 * count(*)), 6) AS strength FROM ln a JOIN ln b ON a.node_id = b.node_id AND a.topic_id < b.topic_id GROUP BY 1, 2")
def topic_cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    return topics.cooccurrence_edges(_links(spark, sf)).select("source_id", "target_id", "evidence", r6("strength").alias("strength"))


@query(
    "related_topics_undirected",
    f"""WITH {_CENTROIDS}, e AS (SELECT a.label AS s, b.label AS t, sum(a.x * b.x) AS w FROM nc a JOIN nc b ON a.k = b.k AND a.label < b.label GROUP BY 1, 2)
    SELECT topic_id, round(max(w), 6) AS strength FROM (SELECT t AS topic_id, w FROM e WHERE s = 3 UNION ALL SELECT s, w FROM e WHERE t = 3) GROUP BY topic_id""",
)
def related_topics_undirected(spark: SparkSession, sf: str) -> DataFrame:
    return topics.related(topics.semantic_edges(_topic_table(spark, sf), -2.0), 3).withColumn("strength", r6("strength"))


_IMPORTANCE = "greatest(ln(1 + n) * greatest(pow(2.0, -d / 30.0), 0.01) * CASE WHEN d < 1 THEN 2.0 WHEN d < 7 THEN 2.0 - (d - 1) / 6.0 ELSE 1.0 END, 0.01)"
_TOPICS = f"tp AS (SELECT label AS topic_id, n, d, {_IMPORTANCE} AS imp FROM (SELECT label, count(*) AS n, label * 13.0 AS d FROM embeddings GROUP BY label))"


@query("topic_search", f"WITH {_TOPICS} SELECT topic_id, round(imp, 6) AS importance FROM tp WHERE topic_id % 4 = 2 OR contains('topic ' || topic_id, 'c 7')")
def topic_search(spark: SparkSession, sf: str) -> DataFrame:
    found = topics.search(topics.refresh_importance(_topic_table(spark, sf), as_of()), ["KEY2", "c 7"])
    return found.select("topic_id", r6("importance_score").alias("importance"))


@query("topic_top_recent", f"WITH {_TOPICS} SELECT topic_id, round(imp, 6) AS importance FROM (SELECT * FROM tp ORDER BY imp DESC, topic_id LIMIT 5) WHERE d <= 20")
def topic_top_recent(spark: SparkSession, sf: str) -> DataFrame:
    found = topics.top_topics(topics.refresh_importance(_topic_table(spark, sf), as_of()), 5, as_of() - F.make_interval(days=F.lit(20)))
    return found.select("topic_id", r6("importance_score").alias("importance"))


@query(
    "topics_for_agent",
    f"""WITH {_EV}, {_TOPICS}, {_LINKS}, mine AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS node_id FROM ev WHERE agent = 'agent_2'),
    b AS (SELECT topic_id, max(relevance) AS relevance FROM ln WHERE node_id IN (SELECT node_id FROM mine) GROUP BY topic_id) SELECT topic_id, round(imp * relevance, 6) AS agent_score FROM tp JOIN b USING (topic_id) ORDER BY imp * relevance DESC, topic_id LIMIT 5""",
)
def topics_for_agent(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.events(spark, sf)
    nodes = e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("node_id")).agg(F.collect_set("agent").alias("contributing_agents"))
    found = topics.topics_for_agent(topics.refresh_importance(_topic_table(spark, sf), as_of()), _links(spark, sf), nodes, "agent_2", 5)
    return found.select("topic_id", r6("agent_score").alias("agent_score"))


@query("topic_prune", "SELECT CAST(label AS INT) AS topic_id, CASE WHEN label * 13 > 90 THEN 'pruned' ELSE 'active' END AS status FROM (SELECT DISTINCT label FROM embeddings)")
def topic_prune(spark: SparkSession, sf: str) -> DataFrame:
    return topics.prune(_topic_table(spark, sf), as_of()).select("topic_id", "status")


@query("topic_graph_status", f"WITH {_LINKS} SELECT (SELECT count(DISTINCT label) FROM embeddings WHERE label * 13 <= 90) AS active, (SELECT count(DISTINCT label) FROM embeddings WHERE label * 13 > 90) AS pruned, count(*) AS links, (SELECT count(*) FROM (SELECT DISTINCT a.topic_id, b.topic_id FROM ln a JOIN ln b ON a.node_id = b.node_id AND a.topic_id < b.topic_id)) AS relationships FROM ln")
def topic_graph_status(spark: SparkSession, sf: str) -> DataFrame:
    links = _links(spark, sf)
    return topics.graph_status(topics.prune(_topic_table(spark, sf), as_of()), links, topics.cooccurrence_edges(links))


_STOP_SQL = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(
    "keyword_top5",
    f"""WITH w AS (SELECT conv_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM conversations), c AS (SELECT conv_id, word, count(*) AS n FROM w WHERE strlen(word) > 3 AND word NOT IN ({_STOP_SQL}) GROUP BY 1, 2)
    SELECT conv_id, word, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, word) AS rank FROM c) WHERE rank <= 5""",
)
def keyword_top5(spark: SparkSession, sf: str) -> DataFrame:
    return topics.frequent_words(tables.read(spark, sf, "conversations"), "conv_id").select("conv_id", "word", "n", "rank")


@query(
    "node_texts",
    f"""WITH {NODES}
    SELECT node_id, title || ' ' || array_to_string(bullets, ' ') AS bm25_text, nullif(trim(title || '. ' || array_to_string(bullets, '. ') || '. ' || array_to_string(keywords, ', ')), '') AS vector_text,
      title || ' ' || array_to_string(keywords, ' ') || ' ' || array_to_string(bullets, ' ') AS searchable_text FROM n""",
)
def node_texts(spark: SparkSession, sf: str) -> DataFrame:
    t, b, k = (F.col(c) for c in ("title", "bullets", "keywords"))
    return doc_nodes(spark, sf).select("node_id", text.bm25_text(t, b).alias("bm25_text"), text.vector_text(t, b, k).alias("vector_text"), text.searchable_text(t, k, b).alias("searchable_text"))


@query("event_metadata", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type IN ('session_start', 'subagent_start', 'subagent_stop', 'session_end') AS structural, epoch_us(ts) // 1000 AS ts_ms FROM events")
def event_metadata(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.event_to_wire(tables.events(spark, sf), ["click", "view"])
    return e.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), tables.is_structural(F.col("event_type")).alias("structural"), "ts_ms")


@query("activity_of_agent", f"WITH {_EV} SELECT agent, epoch_us(date_trunc('day', ts)) // 1000 AS bucket_ms, count(*) AS n_events FROM ev WHERE agent = 'agent_3' GROUP BY 1, 2")
def activity_of_agent(spark: SparkSession, sf: str) -> DataFrame:
    return agents.activity(tables.events(spark, sf), "day", "agent_3").select("agent", ms("bucket").alias("bucket_ms"), "n_events")


# Novelty, episodes, life cycle.


@query(
    "dedup_top1_global",
    "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT a.label, a.vec_id, round(max(list_inner_product(a.e, b.e)), 6) AS similarity FROM v a JOIN v b ON a.label = b.label AND b.vec_id < a.vec_id GROUP BY 1, 2",
)
def dedup_top1_global(spark: SparkSession, sf: str) -> DataFrame:
    rows = dedup.nearest_earlier(tables.read(spark, sf, "embeddings"), "label", "vec_id", "embedding")
    return rows.withColumn("similarity", r6("similarity"))


@query("novelty_skip_reasons", f"WITH {_TURNS} SELECT coalesce(CASE WHEN strlen(text) < 50 THEN 'short_text' WHEN turn % 3 = 0 THEN 'no_embedding' END, 'compared') AS reason, count(*) AS n FROM tu GROUP BY 1")
def novelty_skip_reasons(spark: SparkSession, sf: str) -> DataFrame:
    embedding = F.when(F.col("turn") % 3 != 0, F.array(F.lit(1.0)))
    rows = tables.turns(spark, sf).select(F.coalesce(dedup.skip_reason(F.col("text"), embedding), F.lit("compared")).alias("reason"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("similar_episodes", f"WITH {_VEC}, n AS (SELECT * FROM v ORDER BY vec_id DESC LIMIT 200) SELECT vec_id AS episode_id, round(list_inner_product(e, qe), 6) AS score FROM n, q WHERE list_inner_product(e, qe) >= 0 ORDER BY list_inner_product(e, qe) DESC, vec_id LIMIT 5")
def similar_episodes(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.read(spark, sf, "embeddings").select(F.col("vec_id").alias("episode_id"), "embedding")
    found = episodes.similar(rows, _query_vector(spark, sf), max_episodes=200)
    return found.select("episode_id", r6("score").alias("score"))


@query("episode_retention", "SELECT doc_id AS episode_id, round(greatest(0.0, 1 - abs((doc_id % 101) / 100.0 - 0.65)), 6) AS value_score FROM documents ORDER BY 2, 1 LIMIT (SELECT greatest(count(*) - 150, 0) FROM documents)")
def episode_retention(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.read(spark, sf, "documents").select(F.col("doc_id").alias("episode_id"), r6(scoring.episode_value(F.col("doc_id") % 101 / 100.0)).alias("value_score"))
    return episodes.evicted(rows, 150)


_CUT = "CASE level WHEN 'segment' THEN 30 WHEN 'grip' THEN 30 WHEN 'day' THEN 365 WHEN 'week' THEN 1825 END"


@query("prune_by_retention", f"WITH {_FACTS} SELECT doc_id, level FROM fx WHERE ms < {_ASOF_MS} - CAST({_CUT} AS BIGINT) * 86400000")
def prune_by_retention(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.expired(doc_facts(spark, sf), as_of()).select("doc_id", "level")


@query("docs_before_cutoff", f"WITH {_FACTS} SELECT level, count(*) AS n FROM fx WHERE ms < {_ASOF_MS} - CAST({_CUT} AS BIGINT) * 86400000 GROUP BY level")
def docs_before_cutoff(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.prune_counts(doc_facts(spark, sf), as_of())


@query("level_rebuild", f"WITH {_FACTS} SELECT doc_id, level FROM fx WHERE level IN ('day', 'week', 'month', 'year')")
def level_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.at_or_above(doc_facts(spark, sf), "day").select("doc_id", "level")


# Evaluation.


@query("percentiles_nearest", "WITH o AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM events) SELECT 90 AS p, value FROM o WHERE k = CAST(round(0.9 * (n - 1)) AS BIGINT)")
def percentiles_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.percentile_nearest(tables.read(spark, sf, "events"), "value", 90).select(F.lit(90).alias("p"), "value")


@query("percentiles_linear", "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM events")
def percentiles_linear(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.percentiles_linear(tables.read(spark, sf, "events"), "value").select(*(r6(f"p{p}").alias(f"p{p}") for p in (50, 90, 99)))


@query("locomo_by_type", "SELECT coalesce(role, 'all') AS role, CAST(sum(CAST(contains(lower(text), 'the') AS INT)) AS BIGINT) AS correct, count(*) AS total, round(sum(CAST(contains(lower(text), 'the') AS INT)) / count(*), 6) AS score FROM conversations GROUP BY ROLLUP(role)")
def locomo_by_type(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.by_type(tables.read(spark, sf, "conversations"), "role", text.any_expected(F.col("text"), F.array(F.lit("THE"))))
    return out.withColumn("score", r6("score"))


@query("recall_at_k", f"WITH {_bm25_sql('documents', 'doc_id', SEARCH)}, r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM bm) SELECT round(avg(CASE WHEN k <= 50 THEN 1.0 ELSE 0.0 END), 6) AS recall FROM (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) LEFT JOIN r USING (doc_id)")
def recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    found = search.ranked(search.top(search.bm25(tables.read(spark, sf, "documents"), SEARCH), 50, "doc_id"), "doc_id").withColumn("query_id", F.lit(0))
    wanted = tables.read(spark, sf, "labels").filter("toxic = 1").select(F.lit(0).alias("query_id"), "doc_id")
    return evaluate.recall_at_k(found, wanted, 50).withColumn("recall", r6("recall"))


@query("compression_ratio", "SELECT round(1 - sum(least(strlen(text), 200)) / sum(strlen(text)), 6) AS compression FROM documents")
def compression_ratio(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.compression(tables.read(spark, sf, "documents"), F.octet_length("text"), F.least(F.octet_length("text"), F.lit(200)))
    return out.withColumn("compression", r6("compression"))


@query("fixture_accuracy", "SELECT round(avg(CAST(contains(lower(text), 'the') OR contains(lower(text), 'und') AS INT)), 6) AS accuracy FROM documents")
def fixture_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.accuracy(tables.read(spark, sf, "documents"), text.any_expected(F.col("text"), F.array(F.lit("The"), F.lit("UND"))))
    return out.withColumn("accuracy", r6("accuracy"))


# The set, join and aggregate operators of any table store.


@query("set_operations", "(SELECT o_custkey AS custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    o, c = tables.read(spark, sf, "orders"), tables.read(spark, sf, "customer")
    done, still = (o.filter(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("custkey")) for s in ("F", "O"))
    return done.intersect(still).subtract(c.filter("c_acctbal < 0").select("c_custkey"))


@query("asof_join", "SELECT a.event_id, b.event_id AS last_view FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, max(event_id) AS event_id, ts FROM events WHERE event_type = 'view' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def asof_join(spark: SparkSession, sf: str) -> DataFrame:
    e = tables.events(spark, sf)
    w = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(w)
    return e.filter("event_type IN ('view', 'purchase')").withColumn("last_view", last).filter("event_type = 'purchase'").select("event_id", "last_view")


@query("rollup_time", "SELECT strftime(o_orderdate, '%Y') AS y, strftime(o_orderdate, '%Y-%m') AS m, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (1, 2)")
def rollup_time(spark: SparkSession, sf: str) -> DataFrame:
    o = tables.read(spark, sf, "orders").withColumns({"y": F.date_format("o_orderdate", "yyyy"), "m": F.date_format("o_orderdate", "yyyy-MM")})
    return o.rollup("y", "m").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))

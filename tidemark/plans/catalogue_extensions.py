"""Queries over table functions in SQL and over the trace data source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import table_functions
from ..sources import tables, trace
from ..streaming import ingest
from . import catalogue_store  # noqa: F401  the SQL of grips
from .catalogue import _EV, ORACLE_SQL, ms, query, r6, scratch

# Table functions.


@query("sql_query_variants", ORACLE_SQL["query_expansion"])
def sql_query_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Variants of turns as questions, by a lateral join with a table function."""
    table_functions.register(spark)
    low = F.lower("text")
    asked = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("What How did we "), "text")).when(F.col("turn") % 4 == 1, F.concat(F.lit("where "), low)).when(F.col("turn") % 4 == 2, low).otherwise(F.col("text"))
    given = tables.read(spark, sf, "conversations").select("conv_id", "turn", asked.alias("q"))
    return spark.sql("SELECT conv_id, turn, variant, count(*) AS n FROM {given}, LATERAL query_variants(q) GROUP BY conv_id, turn, variant", given=given)


_FIELD_ROWS = " UNION ALL ".join(f"SELECT doc_id, n_chars, '{f}' AS field, list_distinct(regexp_split_to_array(lower({f}), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM documents" for f in ("text", "lang", "source"))


@query("sql_field_matches", f"WITH f AS ({_FIELD_ROWS}) SELECT doc_id, n_chars, field, round(len(list_filter(w, lambda x: x IN ('der', 'de', 'nation'))) / 3.0, 6) AS score FROM f WHERE list_has_any(w, ['der', 'de', 'nation'])")
def sql_field_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of documents that hold terms, by a table function whose columns follow the table that it is given."""
    table_functions.register(spark)
    docs = tables.read(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return spark.sql("SELECT doc_id, n_chars, field, round(score, 6) AS score FROM field_matches(TABLE(SELECT * FROM {docs}), 'der De, nation')", docs=docs)


@query("sql_grips", ORACLE_SQL["grip_extract"])
def sql_grips(spark: SparkSession, sf: str) -> DataFrame:
    """Grips of each session's bullet, by a table function over ordered partitions."""
    table_functions.register(spark)
    t = tables.turns(spark, sf)
    bullets = t.filter("turn = 0").select("session_id", F.regexp_extract("text", r"^((?:\S+\s+){0,11}\S+)", 1).alias("bullet"))
    given = t.join(bullets, "session_id").select("session_id", "bullet", F.col("event_id").cast("string").alias("event_id"), "ts", "text")
    found = spark.sql("SELECT * FROM grips_of(TABLE(SELECT * FROM {given}) PARTITION BY (session_id, bullet) ORDER BY (ts, event_id))", given=given)
    return found.withColumn("score", r6("score"))


# The trace data source.


def _traces(spark: SparkSession, sf: str) -> str:
    """All events, written as traces."""
    trace.register(spark)
    folder = scratch(spark, "traces")
    e = tables.events(spark, sf)
    texts = [F.col(c).cast("string").alias(a) for c, a in (("event_id", "event_id"), ("user_id", "session_id"))]
    e.select(*texts, "ts", "event_type", "role", "text", F.from_json("props", "map<string,string>").alias("metadata"), "agent").write.format("trace").mode("append").save(folder)
    return folder


@query("trace_source", f"WITH {_EV} SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS session_id, epoch_us(ts) // 1000 AS ms, text, role, agent, json_extract_string(props, '$.k') AS k FROM ev WHERE event_type IN ('purchase', 'error') AND ts >= TIMESTAMP '2024-01-05'")
def trace_source(spark: SparkSession, sf: str) -> DataFrame:
    """Events written and read through the trace format, with filters that are made while lines are read."""
    found = spark.read.format("trace").option("split", 200_000).load(_traces(spark, sf))
    return found.filter("event_type IN ('purchase', 'error') AND ts >= TIMESTAMP '2024-01-05'").select("event_id", "session_id", ms("ts").alias("ms"), "text", "role", "agent", F.col("metadata")["k"].alias("k"))


@query("trace_stream", f"WITH {_EV} SELECT event_type, agent, count(*) AS n_events, max(epoch_us(ts) // 1000) AS last_ms FROM ev GROUP BY 1, 2")
def trace_stream(spark: SparkSession, sf: str) -> DataFrame:
    """All traces taken by a stream."""
    folder, out = _traces(spark, sf), scratch(spark, "trace-rows")
    stream = spark.readStream.format("trace").load(folder)
    ingest.run_to_end(stream, ingest.idempotent_sink(f"{out}/rows"), f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/rows").groupBy("event_type", "agent").agg(F.count(F.lit(1)).alias("n_events"), F.max(ms("ts")).alias("last_ms"))

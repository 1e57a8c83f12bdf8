"""Agents and metrics: summaries, activity buckets, ranking metrics and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import usage_penalty


def agent_summary(nodes: DataFrame, events: DataFrame, as_of: Column, days: int = 365) -> DataFrame:
    """Each agent's nodes, first and last time, and sessions of the last days."""
    seen = nodes.select(F.explode("contributing_agents").alias("agent"), "start_time", "end_time").groupBy("agent").agg(F.count(F.lit(1)).alias("node_count"), F.min("start_time").alias("first_seen"), F.max("end_time").alias("last_seen"))
    recent = events.filter(F.col("ts") >= as_of - F.make_interval(days=F.lit(days)))
    sessions = recent.groupBy("agent").agg(F.count_distinct("session_id").alias("sessions"))
    return seen.join(sessions, "agent", "left").withColumn("sessions", F.coalesce("sessions", F.lit(0)))


def activity(events: DataFrame, unit: str = "day", agent: str | None = None) -> DataFrame:
    """Events of each agent and day or week (from Monday)."""
    rows = events.withColumn("agent", F.coalesce("agent", F.lit("unknown")))
    if agent is not None:
        rows = rows.filter(F.col("agent") == agent)
    return rows.groupBy("agent", F.date_trunc(unit, F.col("ts")).alias("bucket")).agg(F.count(F.lit(1)).alias("n_events"))


def ranking_metrics(nodes: DataFrame) -> DataFrame:
    """One row: mean salience, nodes above 0.5, accesses and mean usage penalty."""
    return nodes.agg(
        F.coalesce(F.avg("salience_score"), F.lit(0.0)).alias("avg_salience"),
        F.count_if(F.col("salience_score") > 0.5).alias("high_salience"),
        F.coalesce(F.sum("access_count"), F.lit(0)).alias("total_access"),
        F.coalesce(F.avg(usage_penalty(F.col("access_count"))), F.lit(1.0)).alias("avg_penalty"),
    )


def usage_from_log(log: DataFrame) -> DataFrame:
    """doc_id, access_count and last_accessed, counted from the access log itself."""
    return log.groupBy("doc_id").agg(F.count(F.lit(1)).alias("access_count"), F.max("ts").alias("last_accessed"))


def merge_usage(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two usage tables merged by the larger count and the later time."""
    return a.unionByName(b).groupBy("doc_id").agg(F.max("access_count").alias("access_count"), F.max("last_accessed").alias("last_accessed"))

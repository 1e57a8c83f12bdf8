"""Episodes: recording, completion, similarity and retention by value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import episode_value
from ..functions.vectors import dot, literal


def start(episode_id: Column, task: Column, created_at: Column) -> list[Column]:
    """Columns of a new episode; an episode needs a task."""
    return [episode_id.alias("episode_id"), F.when(F.trim(task) != "", task).otherwise(F.raise_error("an episode needs a task")).alias("task"), F.lit("in_progress").alias("status"), created_at.alias("created_at")]


def action_status(status: Column) -> Column:
    return F.when(status.isin("success", "failure"), status).otherwise(F.lit("pending"))


def with_actions(episodes: DataFrame, actions: DataFrame) -> DataFrame:
    """Episodes in progress with their actions in time order; actions of others are not recorded."""
    folded = actions.groupBy("episode_id").agg(F.array_sort(F.collect_list(F.struct("ts", "action_type", "input", action_status(F.col("status")).alias("status")))).alias("actions"))
    out = episodes.join(folded, "episode_id", "left")
    return out.withColumn("actions", F.when(F.col("status") == "in_progress", F.col("actions")))


def complete(episodes: DataFrame, outcomes: DataFrame, midpoint: float = 0.65) -> DataFrame:
    """Episodes with outcomes (episode_id, outcome in 0..1, failed): status, score and value."""
    out = episodes.join(outcomes, "episode_id")
    good = F.when(F.col("outcome").between(0, 1), F.col("outcome")).otherwise(F.raise_error("an outcome lies in 0..1"))
    return out.withColumns({"status": F.when(F.col("failed"), "failed").otherwise("completed"), "outcome_score": good, "value_score": episode_value(good, midpoint)})


def embedding_text(task: Column, lessons: Column, failures: Column) -> Column:
    return F.array_join(F.concat(F.array(task), lessons, failures), ". ")


def similar(episodes: DataFrame, query: Sequence[float], k: int = 5, min_score: float = 0.0, max_episodes: int = 1000) -> DataFrame:
    """The k most similar of the newest episodes."""
    newest = episodes.orderBy(F.desc("episode_id")).limit(max_episodes)
    scored = newest.withColumn("score", dot(F.col("embedding"), literal(query)))
    return scored.filter(F.col("score") >= min_score).orderBy(F.desc("score"), "episode_id").limit(k)


def evicted(episodes: DataFrame, max_episodes: int) -> DataFrame:
    """The lowest-valued episodes beyond the largest number, by a limit of the excess."""
    excess = max(episodes.count() - max_episodes, 0)
    return episodes.select("episode_id", F.coalesce("value_score", F.lit(0.0)).alias("value_score")).orderBy("value_score", "episode_id").limit(excess)

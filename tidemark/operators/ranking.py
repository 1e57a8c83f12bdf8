"""Re-scoring of search results: enrichment, staleness, supersession and the combined rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Ranking, Staleness
from ..functions.scoring import combined_rank, stale_decay
from .similarity import newest_similar


def enrich(results: DataFrame, first: DataFrame, second: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Results with salience, kind and access count of the first store, else of the second, else defaults."""
    a = first.select(id_col, F.col("salience_score").alias("__s1"), F.col("memory_kind").alias("__k1"), F.col("access_count").alias("__a1"))
    b = second.select(id_col, F.col("salience_score").alias("__s2"), F.col("memory_kind").alias("__k2"))
    out = results.join(a, id_col, "left").join(b, id_col, "left")
    made = {"salience_score": F.coalesce("__s1", "__s2", F.lit(0.5)), "memory_kind": F.coalesce("__k1", "__k2", F.lit("observation")), "access_count": F.coalesce("__a1", F.lit(0))}
    return out.withColumns(made).drop("__s1", "__k1", "__a1", "__s2", "__k2")


def decay(results: DataFrame, config: Staleness = Staleness(), newest: Column | None = None) -> DataFrame:
    """Scores decayed by age against the newest result, a single row joined back by broadcast."""
    if not config.enabled:
        return results
    if newest is None:
        results = results.crossJoin(F.broadcast(results.agg(F.max("ts").alias("__newest"))))
        newest = F.col("__newest")
    age = (F.unix_millis(newest) - F.unix_millis("ts")) / F.lit(86_400_000.0)
    return results.withColumn("score", stale_decay(F.col("score"), age, F.col("memory_kind"), config)).drop("__newest")


def superseded(results: DataFrame, key: str | None = None, config: Staleness = Staleness(), id_col: str = "doc_id") -> DataFrame:
    """id and newer: the newest later result that is similar enough to each, inside ``key`` if one is given."""
    return newest_similar(results, config.supersession_similarity, id_col, "embedding", "ts", key)


def penalise_superseded(results: DataFrame, found: DataFrame, config: Staleness = Staleness(), id_col: str = "doc_id") -> DataFrame:
    """One penalty for each result that a newer one replaces."""
    out = results.join(found, id_col, "left")
    return out.withColumn("score", F.when(F.col("newer").isNotNull(), F.col("score") * (1 - config.supersession_penalty)).otherwise(F.col("score")))


def stale_filter(results: DataFrame, embeddings: DataFrame | None = None, config: Staleness = Staleness(), key: str | None = None, id_col: str = "doc_id") -> DataFrame:
    """Time decay, then one penalty for what a newer similar result replaces, best first; nothing if staleness is off.

    ``embeddings`` has id and embedding of the results. With ``key``, only results that agree in it are compared.
    """
    if not config.enabled:
        return results
    out = decay(results, config)
    if embeddings is not None:
        found = superseded(out.join(embeddings, id_col), key, config, id_col)
        out = penalise_superseded(out, found, config, id_col).drop("newer")
    return out.orderBy(F.desc("score"), id_col)


def combine(results: DataFrame, config: Ranking = Ranking()) -> DataFrame:
    return results.withColumn("score", combined_rank(F.col("score"), F.col("salience_score"), F.col("access_count"), config))

"""Queries over indexes, routing, topics and the engine's calls, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..api import Engine
from ..config import Settings, StopConditions, Topics
from ..functions import text
from ..functions.embedding import HashingEmbedder, embed, index_missing
from ..operators import ranking, search, topics
from ..operators.indexes import VectorIndex, WordIndex
from ..sources import tables
from . import router
from .catalogue import (
    _ASOF_MS,
    _CENTROIDS,
    _COS,
    _EV,
    _FACTS,
    _LINKS,
    _MERGED,
    _SALIENCE,
    _STORES,
    _TERMS,
    _TOPICS,
    _VEC,
    _bm25_sql,
    _intent_sql,
    _layers_sql,
    _links,
    _overlap_sql,
    _query_vector,
    _routed_sql,
    _topic_table,
    NODES,
    SEARCH,
    as_of,
    doc_facts,
    doc_nodes,
    facts_of,
    layers,
    ms,
    query,
    r6,
    scratch,
    stores,
    word_index,
)

# Vector index.


@query("vector_index_compacted", f"WITH {_VEC} SELECT vec_id, round({_COS}, 6) AS score FROM v, q WHERE vec_id % 7 <> 3 ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vector_index_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """Three commits, one of them of removals, and a compaction that makes the cells anew; a search of all cells by a new reader."""
    e, folder = tables.read(spark, sf, "embeddings").select("vec_id", "embedding"), scratch(spark, "vectors")
    index = VectorIndex(spark, folder, cells=2)
    for k in range(2):
        index.add(e.filter(F.col("vec_id") % 2 == k))
        index.commit()
    index.remove(e.filter("vec_id % 7 = 3"))
    index.commit()
    index.compact()
    return VectorIndex(spark, folder).search(_query_vector(spark, sf), 10).withColumn("score", r6("score"))


@query("vector_index_search", f"WITH {_VEC} SELECT vec_id, round({_COS}, 6) AS score FROM v, q WHERE vec_id % 10 <> 5 AND vec_id <> 0 ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vector_index_search(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors in cells, some replaced, some removed, and a search of all cells by a reader that opens the index anew."""
    e, folder = tables.read(spark, sf, "embeddings").select("vec_id", "embedding"), scratch(spark, "vectors")
    index = VectorIndex(spark, folder, cells=8)
    index.add(e.withColumn("embedding", F.when(F.col("vec_id") % 4 == 0, F.reverse("embedding")).otherwise(F.col("embedding"))))
    index.commit()
    index.add(e.filter("vec_id % 4 = 0 AND vec_id <> 0"))
    index.remove(e.filter("vec_id % 10 = 5 OR vec_id = 0"))
    index.commit()
    return VectorIndex(spark, folder, cells=8).search(_query_vector(spark, sf), 10).withColumn("score", r6("score"))


@query("vector_index_probes")
def vector_index_probes(spark: SparkSession, sf: str) -> DataFrame:
    """The share of the true nearest ten that a search of half of the cells finds, over five queries."""
    e = tables.read(spark, sf, "embeddings").select("vec_id", "embedding")
    index = VectorIndex(spark, scratch(spark, "vectors"), cells=8)
    index.add(e)
    index.commit()
    rows = []
    for q in e.filter("vec_id IN (0, 50, 100, 150, 200)").collect():  # five queries
        true = {r.vec_id for r in search.knn(e, q.embedding, 10).collect()}
        rows.append((q.vec_id, len(true & {r.vec_id for r in index.search(q.embedding, 10, probes=4).collect()}) / 10))
    return spark.createDataFrame(rows, "query_id bigint, recall double")


@query("vector_pipeline", "SELECT count(*) AS n FROM documents WHERE doc_id % 3 <> 0 AND trim(text) <> ''")
def vector_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that aren't indexed and aren't blank are embedded, and those only."""
    d = tables.read(spark, sf, "documents").select("doc_id", "text")
    new = index_missing(d, d.filter("doc_id % 3 = 0"), "doc_id", "text")
    return new.filter("embedding IS NOT NULL").agg(F.count(F.lit(1)).alias("n"))


@query("embedded_texts", "SELECT doc_id, 64 AS dimension, 1.0 AS size FROM documents WHERE trim(text) <> ''")
def embedded_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.read(spark, sf, "documents").select("doc_id", embed(F.col("text"), HashingEmbedder(64)).alias("e")).filter("e IS NOT NULL")
    return rows.select("doc_id", F.size("e").alias("dimension"), F.round(F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)), 4).alias("size"))


# Routing.


@query("route_parallel", f"WITH {_layers_sql('a', 'explore themes overview')}, {_MERGED.replace('bm_a', 've_a').replace("'bm25'", "'vector'")}, {_FACTS}, {_routed_sql('m', 'doc_id, round(score, 6) AS score, source_layer, memory_kind')}")
def route_parallel(spark: SparkSession, sf: str) -> DataFrame:
    """An exploring query: the best two layers in one plan."""
    out, _ = router.route("explore themes overview", layers(spark, sf), facts_of(spark, sf))
    return out.withColumn("score", r6("score"))


@query("route_time_boxed", f"WITH {_layers_sql('a', 'find the exact nation')}, m AS (SELECT doc_id, score, 'bm25' AS source_layer FROM bm_a), {_FACTS}, {_routed_sql('m', 'doc_id, round(score, 6) AS score, source_layer, memory_kind')}")
def route_time_boxed(spark: SparkSession, sf: str) -> DataFrame:
    """A time-boxed query tries the tier's best layer first."""
    out, _ = router.route("find the exact nation", {k: v for k, v in layers(spark, sf).items() if k in ("bm25", "agentic")}, facts_of(spark, sf), timeout_ms=600_000)
    return out.withColumn("score", r6("score"))


@query(
    "route_executions",
    """SELECT * FROM (VALUES ('enough', 'bm25', 'bm25', false, ''), ('weak first', 'bm25,vector', 'vector', true, ''), ('none first', 'bm25,vector', 'vector', true, ''), ('all weak', 'bm25,vector', 'bm25', true, ''),
    ('one call', 'bm25', 'bm25', false, 'max_calls'), ('parallel', 'bm25,vector', 'bm25,vector', false, ''), ('nothing', 'bm25', '', true, '')) AS t(run, tried, used, fallback, bounds)""",
)
def route_executions(spark: SparkSession, sf: str) -> DataFrame:
    """What executions try, use and report, over layers with strong, weak and no results."""
    d = tables.read(spark, sf, "documents")

    def scored(x: float | None) -> router.Layer:
        return lambda asked: d.limit(5).select("doc_id", F.lit(x).alias("score")) if x is not None else d.limit(0).select("doc_id", F.lit(0.0).alias("score"))

    strong, weak, none = scored(0.9), scored(0.1), scored(None)
    runs = [
        ("enough", {"bm25": strong, "vector": strong}, "sequential", StopConditions()),
        ("weak first", {"bm25": weak, "vector": strong}, "sequential", StopConditions()),
        ("none first", {"bm25": none, "vector": strong}, "sequential", StopConditions()),
        ("all weak", {"bm25": weak, "vector": weak}, "sequential", StopConditions()),
        ("one call", {"bm25": weak, "vector": strong}, "sequential", StopConditions(max_calls=1)),
        ("parallel", {"bm25": weak, "vector": strong}, "parallel", StopConditions()),
        ("nothing", {"bm25": none}, "sequential", StopConditions()),
    ]
    rows = []
    for name, held, mode, stop in runs:
        done = router.execute("q", held, ["bm25", "vector"], mode, stop)
        rows.append((name, ",".join(done.tried), ",".join(done.used), done.fallback, ",".join(done.bounds_hit)))
    return spark.createDataFrame(rows, "run string, tried string, used string, fallback boolean, bounds string")


@query(
    "token_budget",
    f"WITH {_bm25_sql('documents', 'doc_id', SEARCH)}, t AS (SELECT doc_id, score, sum(greatest(strlen(text) // 4, 1)) OVER (ORDER BY score DESC, doc_id) AS upto, row_number() OVER (ORDER BY score DESC, doc_id) AS k FROM (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 20) JOIN documents USING (doc_id)) SELECT doc_id, round(score, 6) AS score FROM t WHERE upto <= 4000 OR k = 1",
)
def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    best = search.top(search.bm25(tables.read(spark, sf, "documents"), SEARCH, carry=["text"]), 20, "doc_id")
    return router.within_tokens(best, StopConditions().max_tokens).select("doc_id", r6("score").alias("score"))


@query("explanation_payload", "SELECT 'answer' AS intent, 'hybrid' AS tier, 'hybrid' AS mode, 'hybrid' AS winner, false AS fallback, 10 AS result_count, 0 AS n_grips")
def explanation_payload(spark: SparkSession, sf: str) -> DataFrame:
    out, told = router.route("how did the nation explain the", layers(spark, sf), facts_of(spark, sf))
    return told.payload(out).select("intent", "tier", "mode", "winner", "fallback", "result_count", F.size("grip_ids").alias("n_grips"))


@query("tier_detection", f"WITH {_STORES} SELECT source, topics, vector, bm25, tier FROM tr")
def tier_detection(spark: SparkSession, sf: str) -> DataFrame:
    """What each source of documents can answer with: labelled topics, vectors, words."""
    return stores(spark, sf)


@query(
    "timed_classification",
    f"""WITH s AS (SELECT conv_id, turn, {", ".join(f"{_intent_sql(w)} AS {k}_score" for k, w in router.INTENT_KEYWORDS.items())} FROM conversations), b AS (SELECT *, greatest(explore_score, answer_score, locate_score) AS best FROM s)
    SELECT conv_id, turn, CASE WHEN best < 0.3 THEN 'answer' WHEN explore_score = best THEN 'explore' WHEN locate_score = best THEN 'locate' ELSE 'answer' END AS intent, 'time_boxed' AS boxed, round(best, 6) AS confidence FROM b""",
)
def timed_classification(spark: SparkSession, sf: str) -> DataFrame:
    """Turns classified with and without a timeout."""
    turns = tables.read(spark, sf, "conversations").select("conv_id", "turn", "text")
    free = router.classify(turns, "text").select("conv_id", "turn", "text", F.col("intent").alias("free"))
    return router.classify(free, "text", timeout_ms=500).select("conv_id", "turn", F.col("free").alias("intent"), F.col("intent").alias("boxed"), r6("confidence").alias("confidence"))


@query("heuristic_rerank", f"WITH {_bm25_sql('documents', 'doc_id', SEARCH)}, r AS (SELECT doc_id, round(1.0 / (60 + row_number() OVER (ORDER BY score DESC, doc_id)), 12) AS score FROM bm) SELECT doc_id, round(score, 6) AS score FROM r ORDER BY r.score DESC, doc_id LIMIT 10")
def heuristic_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """The cross encoder without a model falls back to fused order, ten at most."""
    fused = search.rrf({"bm25": search.top(word_index(spark, sf).search(SEARCH), 50, "doc_id")}, "doc_id")
    return router.CrossEncoderReranker().rerank(SEARCH, fused).select("doc_id", r6("score").alias("score"))


@query("model_rerank", f"WITH {_bm25_sql('documents', 'doc_id', SEARCH)}, b AS (SELECT doc_id FROM bm ORDER BY score DESC, doc_id LIMIT 50) SELECT doc_id, CAST(length(text) AS DOUBLE) AS score FROM b JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10")
def model_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """A model that scores by length, over the fused list only."""
    docs = tables.read(spark, sf, "documents")
    fused = search.rrf({"bm25": search.top(word_index(spark, sf).search(SEARCH), 50, "doc_id")}, "doc_id")
    reranker = router.CrossEncoderReranker(lambda asked, texts: [len(t) for t in texts], lambda ids: docs.join(F.broadcast(ids), "doc_id", "left_semi"))
    return reranker.rerank(SEARCH, fused).select("doc_id", "score")


@query(
    "federated_toc_search",
    f"WITH {NODES}, s AS (SELECT node_id, parent_id, {_overlap_sql("title || ' ' || array_to_string(keywords, ' ') || ' ' || array_to_string(bullets, ' ')")} AS score FROM n) SELECT node_id, CAST(score AS DOUBLE) AS score, CASE WHEN parent_id = 'src0' THEN 'a' ELSE 'b' END AS project FROM s WHERE score > 0 AND parent_id IN ('src0', 'src1') ORDER BY score DESC, node_id LIMIT 12",
)
def federated_toc_search(spark: SparkSession, sf: str) -> DataFrame:
    nodes = doc_nodes(spark, sf).withColumn("level", F.lit("segment"))
    found = search.federated_nodes({"a": nodes.filter("parent_id = 'src0'"), "b": nodes.filter("parent_id = 'src1'")}, _TERMS, 12)
    return found.select("node_id", r6("score").alias("score"), "project")


# Topics.

_LABELLED = f"""sw AS (SELECT [{", ".join(f"'{w}'" for w in text.STOP_WORDS)}] AS s),
    tk AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: strlen(x) > 1 AND NOT list_contains(s, x) AND NOT regexp_full_match(x, '[0-9]+')) AS w FROM conversations, sw),
    x AS (SELECT conv_id, turn, unnest(w) AS term FROM tk), tf AS (SELECT conv_id, term, count(*) AS tf FROM x GROUP BY 1, 2),
    df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT conv_id, turn, term FROM x) GROUP BY term), tot AS (SELECT conv_id, sum(len(w)) AS total FROM tk GROUP BY conv_id), n AS (SELECT count(*) AS n FROM tk),
    sc AS (SELECT conv_id, term, round(tf / total * (ln((n + 1) / (df + 1)) + 1), 12) AS score FROM tf JOIN df USING (term) JOIN tot USING (conv_id), n),
    rk AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, term) AS rank FROM sc),
    ls AS (SELECT conv_id, list(term ORDER BY rank) AS terms, list(score ORDER BY rank) AS scores FROM rk WHERE rank <= 10 GROUP BY conv_id),
    lb AS (SELECT conv_id, terms, array_to_string(terms[1:5], ' ') AS j, CASE WHEN len(scores) = 1 THEN least(scores[1], 1.0) ELSE 0.5 + 0.5 * scores[1] / list_sum(scores) END AS confidence FROM ls)"""
_LABEL = "CASE WHEN length(j) <= 50 THEN j WHEN regexp_extract(substr(j, 1, 50), '(?s)^(.*) [^ ]*$', 1) <> '' THEN regexp_extract(substr(j, 1, 50), '(?s)^(.*) [^ ]*$', 1) ELSE substr(j, 1, 50) END"


@query("topic_labels", f"WITH {_LABELLED} SELECT conv_id, {_LABEL} AS label, array_to_string(terms, ',') AS keywords, round(confidence, 6) AS confidence FROM lb")
def topic_labels(spark: SparkSession, sf: str) -> DataFrame:
    out = topics.label_clusters(tables.read(spark, sf, "conversations"), "conv_id")
    return out.select("conv_id", "label", F.array_join("keywords", ",").alias("keywords"), r6("confidence").alias("confidence"))


class _Namer:
    """Names a cluster by its number of texts; refuses small ones."""

    def label(self, texts: list[str]) -> str:
        if len(texts) < 4:
            raise ValueError("too few texts")
        return f' "{min(len(texts), 20)} texts" '


@query("topic_model_labels", f"WITH {_LABELLED}, c AS (SELECT conv_id, count(*) AS m FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN m >= 4 THEN least(m, 20) || ' texts' ELSE {_LABEL} END AS label, round(CASE WHEN m >= 4 THEN 0.85 ELSE confidence END, 6) AS confidence FROM lb JOIN c USING (conv_id)")
def topic_model_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A model's names, with keywords where it fails."""
    out = topics.label_clusters(tables.read(spark, sf, "conversations"), "conv_id", _Namer())
    return out.select("conv_id", "label", r6("confidence").alias("confidence"))


_IMP = "imp AS (SELECT topic_id, imp FROM tp)"


@query(
    "topic_merge",
    f"""WITH RECURSIVE {_CENTROIDS}, {_TOPICS}, e AS (SELECT a.label AS a, b.label AS b, sum(a.x * b.x) AS w FROM nc a JOIN nc b ON a.k = b.k AND a.label < b.label GROUP BY 1, 2),
    p AS (SELECT a, b, ta.imp AS sa, tb.imp AS sb, row_number() OVER (ORDER BY a, b) AS k FROM e JOIN tp ta ON ta.topic_id = a JOIN tp tb ON tb.topic_id = b WHERE w >= 0.05),
    f AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS gone, CAST([] AS BIGINT[]) AS keep
      UNION ALL SELECT p.k, CASE WHEN list_contains(gone, p.a) OR list_contains(gone, p.b) THEN gone ELSE list_append(gone, CAST(CASE WHEN sa >= sb THEN p.b ELSE p.a END AS BIGINT)) END,
        CASE WHEN list_contains(gone, p.a) OR list_contains(gone, p.b) THEN keep ELSE list_append(keep, CAST(CASE WHEN sa >= sb THEN p.a ELSE p.b END AS BIGINT)) END FROM f JOIN p ON p.k = f.k + 1),
    l AS (SELECT gone, keep FROM f ORDER BY k DESC LIMIT 1), m AS (SELECT unnest(gone) AS topic_id, unnest(keep) AS keeper FROM l)
    SELECT CAST(t.topic_id AS BIGINT) AS topic_id, coalesce(m.keeper, t.topic_id) AS keeper FROM tp t LEFT JOIN m ON m.topic_id = t.topic_id""",
)
def topic_merge(spark: SparkSession, sf: str) -> DataFrame:
    return topics.merge_similar(topics.refresh_importance(_topic_table(spark, sf), as_of()), 0.05)


@query("topic_merged_rows", "SELECT CAST(0 AS BIGINT) AS topic_id, sum(n) AS node_count, array_to_string(list_sort(list_distinct(list(k))), ',') AS keywords FROM (SELECT label, count(*) AS n, 'key' || label % 4 AS k FROM embeddings GROUP BY label)")
def topic_merged_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All topics merged into the first: counts added and keywords united."""
    t = _topic_table(spark, sf).withColumn("topic_id", F.col("topic_id").cast("bigint"))
    out = topics.merged(t, t.select("topic_id", F.lit(0).cast("bigint").alias("keeper")))
    return out.select("topic_id", "node_count", F.array_join(F.array_sort("keywords"), ",").alias("keywords"))


@query("topic_distances", f"WITH {_CENTROIDS} SELECT a.label AS a, b.label AS b, round(1 - sum(a.x * b.x), 6) AS distance FROM nc a JOIN nc b ON a.k = b.k GROUP BY 1, 2")
def topic_distances(spark: SparkSession, sf: str) -> DataFrame:
    return topics.distances(_topic_table(spark, sf)).withColumn("distance", r6("distance"))


@query("similar_vectors", "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_inner_product(a.e, b.e) >= 0.35")
def similar_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return search.similar_pairs(tables.read(spark, sf, "embeddings"), 0.35, "label", "vec_id", "embedding").withColumn("similarity", r6("similarity"))


@query("topic_hierarchy_edges", "SELECT n_regionkey AS source_id, n_nationkey AS target_id, 'hierarchical' AS relationship_type, 1.0 AS strength FROM nation")
def topic_hierarchy_edges(spark: SparkSession, sf: str) -> DataFrame:
    return topics.hierarchy_edges(tables.read(spark, sf, "nation").select(F.col("n_regionkey").alias("parent"), F.col("n_nationkey").alias("child")))


_EDGES = f"""{_LINKS}, ed AS (SELECT a.topic_id AS source_id, b.topic_id AS target_id, least(1.0, 0.1 * count(*)) AS strength, count(*) AS evidence FROM ln a JOIN ln b ON a.node_id = b.node_id AND a.topic_id < b.topic_id GROUP BY 1, 2)"""


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return topics.cooccurrence_edges(_links(spark, sf)).select("source_id", "target_id", "strength", "evidence")


@query("related_topics_outgoing", f"WITH {_EDGES} SELECT target_id AS topic_id, round(strength, 6) AS strength FROM ed WHERE source_id = 3")
def related_topics_outgoing(spark: SparkSession, sf: str) -> DataFrame:
    return topics.related(_edges(spark, sf), 3, undirected=False).withColumn("strength", r6("strength"))


@query("topic_edges_strengthened", f"WITH {_EDGES}, u AS (SELECT source_id, target_id, strength FROM ed UNION ALL SELECT source_id, target_id, 0.05 FROM ed WHERE source_id % 2 = 0) SELECT source_id, target_id, round(greatest(0.0, least(1.0, sum(strength))), 6) AS strength, count(*) AS evidence FROM u GROUP BY 1, 2")
def topic_edges_strengthened(spark: SparkSession, sf: str) -> DataFrame:
    e = _edges(spark, sf).drop("evidence")
    return topics.strengthen(e, e.filter("source_id % 2 = 0").withColumn("strength", F.lit(0.05))).withColumn("strength", r6("strength"))


@query("topic_edge_changes", f"WITH {_EDGES} SELECT source_id, target_id, CASE WHEN source_id = 1 THEN 1.0 ELSE round(strength, 6) END AS strength, (SELECT count(*) > 0 FROM ed WHERE source_id = 0 AND target_id = 1) AS has_edge FROM ed WHERE target_id % 5 <> 0")
def topic_edge_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Strengths set (and clamped), edges deleted, and one asked for."""
    e = _edges(spark, sf)
    changed = topics.update_edges(e, e.filter("source_id = 1").withColumn("strength", F.lit(3.0)))
    kept = topics.delete_edges(changed, e.filter("target_id % 5 = 0"))
    return kept.crossJoin(F.broadcast(topics.has_edge(e, 0, 1))).select("source_id", "target_id", r6("strength").alias("strength"), "has_edge")  # one row


@query("topic_links", f"WITH {_LINKS}, s AS (SELECT topic_id, node_id, CASE WHEN topic_id = 4 THEN 0.5 ELSE relevance END AS relevance FROM ln) SELECT 'topic' AS by, topic_id, node_id, round(relevance, 6) AS relevance FROM s WHERE topic_id = 4 UNION ALL SELECT 'node', topic_id, node_id, round(relevance, 6) FROM s WHERE node_id = '2024-01-05'")
def topic_links(spark: SparkSession, sf: str) -> DataFrame:
    held = _links(spark, sf)
    saved = topics.save_links(held, held.filter("topic_id = 4").withColumn("relevance", F.lit(0.5)))
    both = topics.links_of_topic(saved, 4).select(F.lit("topic").alias("by"), "topic_id", "node_id", "relevance").unionByName(topics.links_of_node(saved, "2024-01-05").select(F.lit("node").alias("by"), "topic_id", "node_id", "relevance"))
    return both.withColumn("relevance", r6("relevance"))


@query("topic_mentions", "WITH m AS (SELECT CAST(user_id % 10 AS INT) AS topic_id, count(*) AS n, max(epoch_us(ts) // 1000) AS last_ms FROM events GROUP BY 1), t AS (SELECT label AS topic_id, count(*) AS n, epoch_ms(TIMESTAMP '2024-02-01' - to_days(label * 13)) AS last_ms FROM embeddings GROUP BY label) SELECT t.topic_id, t.n + coalesce(m.n, 0) AS node_count, greatest(t.last_ms, coalesce(m.last_ms, t.last_ms)) AS last_ms FROM t LEFT JOIN m USING (topic_id)")
def topic_mentions(spark: SparkSession, sf: str) -> DataFrame:
    seen = tables.events(spark, sf).select((F.col("user_id") % 10).cast("int").alias("topic_id"), "ts")
    return topics.mention(_topic_table(spark, sf), seen).select("topic_id", "node_count", ms("last_mentioned_at").alias("last_ms"))


@query("topic_resurrection", "SELECT DISTINCT label AS topic_id, CASE WHEN label * 13 > 90 AND label <> 8 THEN 'pruned' ELSE 'active' END AS status FROM embeddings")
def topic_resurrection(spark: SparkSession, sf: str) -> DataFrame:
    return topics.resurrect(topics.prune(_topic_table(spark, sf), as_of()), [8]).select("topic_id", "status")


@query("topic_lifecycle_stats", f"WITH {_EDGES} SELECT (SELECT count(DISTINCT label) FROM embeddings WHERE label * 13 <= 90) AS active, (SELECT count(DISTINCT label) FROM embeddings WHERE label * 13 > 90) AS archived, count(*) AS relationships FROM ed")
def topic_lifecycle_stats(spark: SparkSession, sf: str) -> DataFrame:
    return topics.lifecycle_stats(topics.prune(_topic_table(spark, sf), as_of()), _edges(spark, sf))


@query("topic_clusters")
def topic_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return topics.cluster_by_density(tables.read(spark, sf, "embeddings"), "vec_id", "embedding", "label")


@query("topic_cycle")
def topic_cycle(spark: SparkSession, sf: str) -> DataFrame:
    """Topics out of vectors and the texts of the same ids: cluster, centre, name, weigh and link."""
    d = tables.read(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text", F.timestamp_millis(F.col("doc_id") * 86_400_000).alias("ts"))
    made, links = topics.extraction_cycle(tables.read(spark, sf, "embeddings").join(d, "vec_id"), as_of(), "vec_id", "label", config=Topics(min_cluster=3))
    n = links.groupBy("topic_id").agg(F.count(F.lit(1)).alias("links"), F.round(F.max("relevance"), 6).alias("best"))
    return made.join(n, "topic_id").select("topic_id", "label", "node_count", "links", "best", r6("importance_score").alias("importance"))


# The engine's calls.


def _engine(spark: SparkSession, sf: str) -> Engine:
    vectors = tables.read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    nodes = doc_nodes(spark, sf).withColumns({"level": F.lit("segment"), "salience_score": F.lit(0.6), "access_count": F.lit(2)})
    held = {"events": tables.events(spark, sf), "documents": tables.read(spark, sf, "documents").withColumn("agent", F.concat(F.lit("a"), (F.col("doc_id") % 3).cast("string"))), "vectors": vectors, "nodes": nodes}
    held |= {"topics": topics.refresh_importance(_topic_table(spark, sf), as_of()), "links": _links(spark, sf), "edges": _edges(spark, sf)}
    return Engine(spark, held, as_of(), Settings(), HashingEmbedder(64))


@query("api_get_events", f"WITH {_EV} SELECT event_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (ORDER BY ts, event_id) AS position FROM (SELECT * FROM ev WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07' ORDER BY ts, event_id LIMIT 50)")
def api_get_events(spark: SparkSession, sf: str) -> DataFrame:
    return _engine(spark, sf).get_events("2024-01-05", "2024-01-07").select("event_id", ms("ts").alias("ms"), "position")


@query("api_ingest", "SELECT event_id + 1000000 AS event_id, value FROM events WHERE event_id % 2 = 1")
def api_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """What an insert adds: new ids once, stored ones not. Stored events get even ids and new ones odd ids, so no new one is stored, however many there are."""
    e = tables.events(spark, sf)
    stored = e.withColumn("event_id", 2 * F.col("event_id"))
    fresh = e.filter("event_id % 2 = 1").withColumn("event_id", 2 * (F.col("event_id") + 1000000) + 1)
    added = Engine(spark, {"events": stored}, as_of()).ingest(stored.filter("event_id % 10 = 0").unionByName(fresh).unionByName(fresh))
    return added.select(F.shiftright("event_id", 1).alias("event_id"), "value")


@query("api_teleport", f"WITH d AS (SELECT * FROM documents WHERE doc_id % 3 = 1), {_bm25_sql('d', 'doc_id', SEARCH)} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY score DESC, doc_id LIMIT 10")
def api_teleport(spark: SparkSession, sf: str) -> DataFrame:
    return _engine(spark, sf).teleport_search(SEARCH, agent="a1").select("doc_id", r6("score").alias("score"))


@query("api_capabilities", "SELECT 'full' AS tier, layer, true AS ready FROM (SELECT unnest(['topics', 'hybrid', 'vector', 'bm25', 'agentic']) AS layer)")
def api_capabilities(spark: SparkSession, sf: str) -> DataFrame:
    return _engine(spark, sf).retrieval_capabilities()


@query("api_stats", " UNION ALL ".join(f"SELECT '{a}' AS name, (SELECT count(*) FROM {b}) AS n" for a, b in (("events", "events"), ("documents", "documents"), ("vectors", "embeddings"), ("nodes", "documents"))))
def api_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _engine(spark, sf).stats().filter("name IN ('events', 'documents', 'vectors', 'nodes')")


@query("api_search_node", f"WITH {NODES} SELECT 'summary' AS field, {_overlap_sql("array_to_string(bullets, ' ')")} AS score FROM n WHERE node_id = 7 AND {_overlap_sql("array_to_string(bullets, ' ')")} > 0")
def api_search_node(spark: SparkSession, sf: str) -> DataFrame:
    return _engine(spark, sf).search_node(7, "the nation thereen", ["summary"]).select("field", r6("score").alias("score"))


@query("api_top_topics", f"WITH {_TOPICS} SELECT topic_id, round(imp, 6) AS importance FROM (SELECT * FROM tp ORDER BY imp DESC, topic_id LIMIT 10) WHERE d <= 30")
def api_top_topics(spark: SparkSession, sf: str) -> DataFrame:
    return _engine(spark, sf).top_topics(10, days=30).select("topic_id", r6("importance_score").alias("importance"))


@query("api_ranking_status", "SELECT 0.6 AS avg_salience, count(*) AS high_salience, CAST(2 * count(*) AS BIGINT) AS total_access FROM documents")
def api_ranking_status(spark: SparkSession, sf: str) -> DataFrame:
    return _engine(spark, sf).ranking_status().select(r6("avg_salience").alias("avg_salience"), "high_salience", "total_access")


@query("supersession_penalty", "WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), p AS (SELECT DISTINCT a.vec_id FROM v a JOIN v b ON a.label = b.label AND b.vec_id > a.vec_id AND list_inner_product(a.e, b.e) >= 0.8) SELECT v.vec_id AS doc_id, CASE WHEN p.vec_id IS NULL THEN 1.0 ELSE 0.85 END AS score FROM v LEFT JOIN p USING (vec_id)")
def supersession_penalty(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "label", "embedding", F.timestamp_millis(F.col("vec_id") * 1000).alias("ts"), F.lit(1.0).alias("score"))
    return ranking.penalise_superseded(rows, ranking.superseded(rows, "label")).select("doc_id", r6("score").alias("score"))


@query("layer_status", f"WITH {_STORES} SELECT source, tier, CASE WHEN bm25 THEN 'bm25' WHEN vector THEN 'vector' ELSE 'agentic' END AS first_layer FROM tr")
def layer_status(spark: SparkSession, sf: str) -> DataFrame:
    """The first layer that a query for a place would try in each source."""
    return stores(spark, sf).select("source", "tier", F.element_at(router.chain_column(F.lit("locate"), F.col("tier")), 1).alias("first_layer"))


@query("adapted_events", "SELECT 's' || user_id AS session_id, CASE WHEN event_id % 2 = 0 THEN 'own' ELSE 'hooked' END AS agent, 'user_message' AS event_type, event_type AS text FROM events")
def adapted_events(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of an agent that names itself now and then, by the adapter that knows them."""

    class Deaf(tables.HookAdapter):
        def detects(self, lines: DataFrame) -> bool:
            return False

    fields = F.struct(F.lit("UserPromptSubmit").alias("hook_event_name"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"), F.col("event_type").alias("message"), F.when(F.col("event_id") % 2 == 0, F.lit("OWN")).alias("agent"))
    lines = tables.events(spark, sf).select(F.to_json(fields).alias("value"))
    return tables.adapted(lines, [Deaf("deaf"), tables.HookAdapter("Hooked")]).select("session_id", "agent", "event_type", "text")


@query("api_episodes", "SELECT doc_id AS episode_id, 'Task ' || doc_id AS task, 'in_progress' AS status, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS n_actions FROM documents")
def api_episodes(spark: SparkSession, sf: str) -> DataFrame:
    d = tables.read(spark, sf, "documents").select(F.col("doc_id").alias("episode_id"), F.concat(F.lit("Task "), F.col("doc_id").cast("string")).alias("task"))
    begun = _engine(spark, sf).start_episodes(d)
    acts = d.filter("episode_id % 2 = 0").select("episode_id", as_of().alias("ts"), F.lit("tool").alias("action_type"), F.lit("x").alias("input"), F.lit("success").alias("status"))
    found = Engine(spark, {"episodes": begun}, as_of()).record_actions(acts)
    return found.select("episode_id", "task", "status", F.coalesce(F.when(F.col("actions").isNotNull(), F.size("actions")), F.lit(0)).alias("n_actions"))


@query("api_indexed_engine", f"WITH {_FACTS}, k AS (SELECT * FROM fx WHERE NOT coalesce(ms < {_ASOF_MS} - CAST(CASE level WHEN 'segment' THEN 30 WHEN 'grip' THEN 30 WHEN 'day' THEN 180 WHEN 'week' THEN 1825 END AS BIGINT) * 86400000, false)), {_bm25_sql('k', 'doc_id', SEARCH)} SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY score DESC, doc_id LIMIT 10")
def api_indexed_engine(spark: SparkSession, sf: str) -> DataFrame:
    """An engine with a word index, rebuilt and then pruned by the index's own retention, and a search in it."""
    engine = Engine(spark, {"documents": doc_facts(spark, sf)}, as_of(), words=WordIndex(spark, scratch(spark, "engine"), buckets=4))
    engine.rebuild_words()
    engine.prune_bm25(dry_run=False)
    return engine.teleport_search(SEARCH).select("doc_id", r6("score").alias("score"))


@query("api_vector_status", "SELECT true AS ready, count(*) AS vectors, 1 AS segments FROM embeddings")
def api_vector_status(spark: SparkSession, sf: str) -> DataFrame:
    index = VectorIndex(spark, scratch(spark, "vectors"), cells=2)
    index.add(tables.read(spark, sf, "embeddings").select("vec_id", "embedding"))
    index.commit()
    return Engine(spark, {}, as_of(), vectors=index).vector_index_status()

"""The topic graph: clusters, labels, edges, importance, search and life cycle."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Topics
from ..functions.density import density_clusters, labels_of_tree, least_edges, least_of_edges
from ..functions.scoring import importance
from ..functions.text import clean_label, keyword_words, label_confidence, label_from_keywords, topic_words
from ..functions.vectors import centroids, cosine
from ..shipping import map_batches, ship
from .rounds import cut
from .similarity import pairs


#: Rows of a part of a block; larger blocks than two of them are clustered part by part.
PART = 2048


def term_scores(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, term, tf, df and score: TF-IDF over groups: count / total terms of the group x (ln((n + 1) / (df + 1)) + 1), with n texts."""
    tokens = docs.select(key, topic_words(F.col(text)).alias("w")).withColumn("__doc", F.monotonically_increasing_id())
    terms = tokens.select(key, "__doc", F.explode("w").alias("term"))
    per_doc = terms.groupBy(key, "__doc", "term").agg(F.count(F.lit(1)).alias("c"))
    tf = per_doc.groupBy(key, "term").agg(F.sum("c").alias("tf"))
    df = per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    totals = tokens.groupBy(key).agg(F.sum(F.size("w")).alias("total"))
    n = tokens.agg(F.count(F.lit(1)).alias("n"))
    joined = tf.join(df, "term").join(totals, key).crossJoin(F.broadcast(n))  # n is one row
    score = F.col("tf") / F.col("total") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)
    return joined.select(key, "term", "tf", "df", score.alias("score"))


def top_terms(scores: DataFrame, key: str, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "term"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k)


def frequent_words(docs: DataFrame, key: str, text: str = "text", k: int = 5) -> DataFrame:
    """key, word, n and rank: the most frequent keyword words of each group."""
    counts = docs.select(key, F.explode(keyword_words(F.col(text))).alias("word")).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "word"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def labels(scores: DataFrame, key: str, config: Topics = Topics()) -> DataFrame:
    """key, label and keywords (twice as many as a label has)."""
    best = top_terms(scores, key, 2 * config.label_words)
    lists = best.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("keywords"))
    return lists.select(key, F.array_join(F.slice("keywords", 1, config.label_words), " ").alias("label"), "keywords")


def cluster_by_density(vectors: DataFrame, id_col: str, vector_col: str, block: str, config: Topics = Topics()) -> DataFrame:
    """id and cluster (the least id in it; -1: noise) by hierarchical density clustering inside each block.

    Clusters don't cross blocks; a block with fewer rows than the smallest cluster is noise. A task holds the vectors of two
    parts of a block, ``PART`` each: every edge of the block's spanning tree is in the tree of some two parts. Only edges of these trees, and those
    to a point's nearest ones, which may tie with them, meet in one task for each block, which has no vectors.
    """
    least = config.min_cluster

    def named(rows: pd.DataFrame, found: np.ndarray) -> pd.DataFrame:
        ids = rows["id"].to_numpy()
        first = pd.Series(ids).groupby(found).min()
        return pd.DataFrame({"id": ids, "cluster": np.where(found == -1, -1, first.reindex(found).to_numpy())})

    def cluster(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["id", "row"], ignore_index=True)
        return named(rows, density_clusters(np.stack(rows["v"].to_numpy()).astype(np.float64), least))

    ship(vectors.sparkSession)
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast(kind).alias("v"), F.col(block).alias("b")).filter("v IS NOT NULL")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    large = rows.groupBy(F.col("b").alias("c")).agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")).filter(F.col("parts") > 2)
    schema = "id bigint, cluster bigint"
    small = rows.join(large, F.col("b").eqNullSafe(F.col("c")), "left_anti").groupBy("b").applyInPandas(lambda p: cluster(p[["id", "row", "v"]]), schema)
    large = cut(large)
    if large.isEmpty():
        return small.withColumnRenamed("id", id_col)
    # Numbers stand for blocks, which may be null.
    named_blocks = cut(large.withColumn("k", F.monotonically_increasing_id()))
    rows = rows.join(named_blocks, F.col("b").eqNullSafe(F.col("c"))).select("k", "row", "id", "v", "parts", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("at"))
    rows = cut(rows)

    def stacked(p: pd.DataFrame) -> np.ndarray:
        return np.stack(p["v"].to_numpy()).astype(np.float64)

    def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T), 0)

    def nearest(p: pd.DataFrame) -> pd.DataFrame:
        i, j = p["i"].iat[0], p["j"].iat[0]
        sides = [(p, p)] if i == j else [(p[p["at"] == i], p[p["at"] == j]), (p[p["at"] == j], p[p["at"] == i])]
        out = [pd.DataFrame({"row": np.empty(0, np.int64), "near": []})]
        for a, b in sides:
            if len(a) and len(b):
                x, y = stacked(a), stacked(b)
                near = np.argpartition(squares(x, y), min(least, len(y)) - 1, axis=1)[:, : min(least, len(y))]
                d = np.sort(np.sqrt(((x[:, None, :] - y[near]) ** 2).sum(axis=2)), axis=1)
                out.append(pd.DataFrame({"row": a["row"].to_numpy(), "near": list(d)}))
        return pd.concat(out)

    def tree(p: pd.DataFrame) -> pd.DataFrame:
        x, core, row = stacked(p), p["core"].to_numpy(), p["row"].to_numpy()
        d = np.sqrt(squares(x, x))
        tied = np.nonzero((d <= core[:, None] * (1 + 1e-9)) & (core[:, None] > 0))
        np.maximum(d, core[:, None], out=d)
        np.maximum(d, core[None, :], out=d)
        a, b = (np.concatenate(c) for c in zip(least_edges(d), tied, strict=True))
        a, b = a[a != b], b[a != b]
        exact = np.maximum(np.sqrt(((x[a] - x[b]) ** 2).sum(axis=1)), np.maximum(core[a], core[b]))
        return pd.DataFrame({"k": p["k"].iat[0], "a": row[a], "b": row[b], "d": exact})

    def meet(some: DataFrame, alone: bool) -> DataFrame:
        each = some.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return (each if alone else each.filter("other <> at")).withColumns({"i": F.least("at", "other"), "j": F.greatest("at", "other")}).drop("parts", "other", "id").groupBy("k", "i", "j")

    found = meet(rows, True).applyInPandas(nearest, "row bigint, near array<double>")
    core = found.groupBy("row").agg(F.element_at(F.array_sort(F.flatten(F.collect_list("near"))), least).alias("core"))
    edges = meet(rows.join(cut(core), "row"), False).applyInPandas(tree, "k bigint, a bigint, b bigint, d double")

    def whole(points: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values(["id", "row"], ignore_index=True)
        order = np.argsort(points["row"].to_numpy())
        at = lambda c: order[np.searchsorted(points["row"].to_numpy()[order], edges[c].to_numpy())]
        a, b = at("a"), at("b")
        both = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "d": edges["d"].to_numpy()}).drop_duplicates(["a", "b"])
        kept = least_of_edges(both["a"].to_numpy(), both["b"].to_numpy(), both["d"].to_numpy(), len(points))
        return named(points, labels_of_tree(kept, len(points), least))

    of_large = rows.select("k", "id", "row").groupBy("k").cogroup(edges.groupBy("k")).applyInPandas(whole, schema)
    return small.unionByName(of_large).withColumnRenamed("id", id_col)


class TopicLabeler(Protocol):
    """A model that names a cluster."""

    def label(self, texts: list[str]) -> str: ...


def label_clusters(docs: DataFrame, key: str, labeler: TopicLabeler | None = None, config: Topics = Topics(), text: str = "text", sample: int = 20) -> DataFrame:
    """key, label, keywords and confidence: the labeler's cleaned answer at 0.85, else the keywords' label.

    A labeler sees ``sample`` texts of a cluster, by hash. Where it fails or answers blank, keywords name the cluster.
    """
    best = top_terms(term_scores(docs, key, text), key, 2 * config.label_words)
    lists = best.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rank", "term", "score"))).alias("t"))
    words, scores = F.transform("t", lambda x: x["term"]), F.transform("t", lambda x: x["score"])
    named = lists.select(key, label_from_keywords(words, config.label_words, config.label_chars).alias("label"), words.alias("keywords"), label_confidence(scores).alias("confidence"))
    if labeler is None:
        return named

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers = []
            for texts in b["texts"]:
                try:
                    answers.append(labeler.label(list(texts)))
                except Exception:  # the keywords' label stands in
                    answers.append(None)
            yield pd.DataFrame({"k": b["k"], "answer": answers})

    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(text), text))
    some = docs.withColumn("__nth", nth).filter(F.col("__nth") <= sample).groupBy(F.col(key).alias("k")).agg(F.collect_list(text).alias("texts"))
    asked = map_batches(some, ask, f"k {dict(docs.dtypes)[key]}, answer string").select(F.col("k").alias(key), clean_label(F.col("answer"), config.label_chars).alias("__answer"))
    good = F.coalesce(F.col("__answer") != "", F.lit(False))
    return named.join(asked, key, "left").select(key, F.when(good, F.col("__answer")).otherwise(F.col("label")).alias("label"), "keywords", F.when(good, 0.85).otherwise(F.col("confidence")).alias("confidence"))


def semantic_edges(topics: DataFrame, threshold: float = 0.75) -> DataFrame:
    """source, target and strength of topics with similar centroids."""
    found = pairs(topics, threshold, "topic_id", "embedding")
    return found.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), F.col("similarity").alias("strength"))


def cooccurrence_edges(links: DataFrame, step: float = 0.1) -> DataFrame:
    """source, target, evidence and strength of topics that share nodes."""
    a = links.select(F.col("topic_id").alias("source_id"), "node_id").distinct()
    b = links.select(F.col("topic_id").alias("target_id"), "node_id").distinct()
    pairs = a.join(b, "node_id").filter(F.col("source_id") < F.col("target_id"))
    return pairs.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("evidence")).withColumn("strength", F.least(F.lit(1.0), step * F.col("evidence")))


def hierarchy_edges(parents: DataFrame) -> DataFrame:
    return parents.select(F.col("parent").alias("source_id"), F.col("child").alias("target_id"), F.lit("hierarchical").alias("relationship_type"), F.lit(1.0).alias("strength"))


def related(edges: DataFrame, topic: int | str, undirected: bool = True) -> DataFrame:
    """Topics at the other end of a topic's edges, strongest first."""
    out = edges.filter(F.col("source_id") == topic).select(F.col("target_id").alias("topic_id"), "strength")
    if undirected:
        out = out.unionByName(edges.filter(F.col("target_id") == topic).select(F.col("source_id").alias("topic_id"), "strength"))
    return out.groupBy("topic_id").agg(F.max("strength").alias("strength")).orderBy(F.desc("strength"), "topic_id")


def strengthen(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Edges with strengths added and clamped, and evidence counted."""
    both = edges.unionByName(more)
    return both.groupBy("source_id", "target_id").agg(F.sum("strength").alias("strength"), F.count(F.lit(1)).alias("evidence")).withColumn("strength", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "strength")))


def has_edge(edges: DataFrame, source: object, target: object) -> DataFrame:
    """One row: whether there is an edge."""
    return edges.agg(F.coalesce(F.bool_or((F.col("source_id") == F.lit(source)) & (F.col("target_id") == F.lit(target))), F.lit(False)).alias("has_edge"))


def update_edges(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """Edges with the strengths of ``changes`` (source_id, target_id, strength), clamped; changes of edges that aren't there are ignored."""
    new = changes.select("source_id", "target_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "strength")).alias("__s"))
    return edges.join(new, ["source_id", "target_id"], "left").withColumn("strength", F.coalesce("__s", "strength")).drop("__s")


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("source_id", "target_id").distinct(), ["source_id", "target_id"], "left_anti")


def save_links(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Links with incoming ones in place of those of the same topic and node."""
    return stored.join(incoming.select("topic_id", "node_id"), ["topic_id", "node_id"], "left_anti").unionByName(incoming)


def links_of_topic(links: DataFrame, topic: object) -> DataFrame:
    """A topic's links, most relevant first."""
    return links.filter(F.col("topic_id") == F.lit(topic)).orderBy(F.desc("relevance"), "node_id")


def links_of_node(links: DataFrame, node: object) -> DataFrame:
    return links.filter(F.col("node_id") == F.lit(node)).orderBy(F.desc("relevance"), "topic_id")


def distances(topics: DataFrame) -> DataFrame:
    """a, b and 1 - cosine of all pairs of topics, which are clusters and few."""
    a = topics.select(F.col("topic_id").alias("a"), F.col("embedding").alias("__a"))
    b = topics.select(F.col("topic_id").alias("b"), F.col("embedding").alias("__b"))
    return a.join(b, F.lit(True)).select("a", "b", (1 - cosine(F.col("__a"), F.col("__b"))).alias("distance"))


def lifecycle_stats(topics: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: active and archived topics, and relationships."""
    t = topics.agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") != "active").alias("archived"))
    return t.crossJoin(edges.agg(F.count(F.lit(1)).alias("relationships")))


def merged(topics: DataFrame, keepers: DataFrame) -> DataFrame:
    """Topics after a merge (topic_id, keeper): node counts added, missing keywords appended, the latest mention kept."""
    rows = topics.join(keepers, "topic_id")
    first = F.max_by(F.struct("label", "embedding", "keywords", "status", "importance_score"), F.col("topic_id") == F.col("keeper"))
    more = F.array_sort(F.array_distinct(F.flatten(F.collect_list("keywords"))))
    out = rows.groupBy(F.col("keeper").alias("topic_id")).agg(first.alias("k"), F.sum("node_count").alias("node_count"), F.max("last_mentioned_at").alias("last_mentioned_at"), more.alias("__more"))
    return out.select("topic_id", "k.label", "k.embedding", F.array_union("k.keywords", "__more").alias("keywords"), "k.status", "k.importance_score", "node_count", "last_mentioned_at")


def extraction_cycle(docs: DataFrame, as_of: Column, id_col: str, block: str, vector_col: str = "embedding", text: str = "text", labeler: TopicLabeler | None = None, config: Topics = Topics()) -> tuple[DataFrame, DataFrame]:
    """Topics and links out of documents with vectors and times: cluster, centre, name, weigh and link."""
    clustered = docs.join(cut(cluster_by_density(docs, id_col, vector_col, block, config)), id_col).filter("cluster <> -1")
    made = extract_topics(clustered, "cluster", vector_col)
    seen = clustered.groupBy(F.col("cluster").alias("topic_id")).agg(F.max("ts").alias("last_mentioned_at"))
    names = label_clusters(clustered, "cluster", labeler, config, text).withColumnRenamed("cluster", "topic_id")
    rows = made.join(seen, "topic_id").join(names, "topic_id", "left").withColumns({"status": F.lit("active"), "importance_score": F.lit(0.0), "label": F.coalesce("label", F.lit("Unknown Topic"))})
    centres = made.select(F.col("topic_id").alias("cluster"), F.col("embedding").alias("__centre"))
    links = clustered.join(centres, "cluster").select(F.col("cluster").alias("topic_id"), F.col(id_col).alias("node_id"), cosine(F.col(vector_col), F.col("__centre")).alias("relevance"))
    return refresh_importance(rows, as_of, config), links


def _has(term: str) -> Callable[[Column], Column]:
    return lambda text: F.contains(F.lower(text), F.lit(term))


def search(topics: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Active topics with a term in the label or a keyword, most important first."""
    test = F.lit(False)
    for t in terms:
        test = test | F.contains(F.lower("label"), F.lit(t.lower())) | F.exists("keywords", _has(t.lower()))
    return topics.filter((F.col("status") == "active") & test).orderBy(F.desc("importance_score"), "topic_id")


def top_topics(topics: DataFrame, k: int, since: Column | None = None) -> DataFrame:
    """The most important active topics; the time filter goes after the limit."""
    out = topics.filter("status = 'active'").orderBy(F.desc("importance_score"), "topic_id").limit(k)
    return out if since is None else out.filter(F.col("last_mentioned_at") >= since)


def topics_for_agent(topics: DataFrame, links: DataFrame, nodes: DataFrame, agent: str, k: int) -> DataFrame:
    """Topics linked to nodes that the agent contributed to, by importance times best relevance."""
    mine = nodes.filter(F.array_contains("contributing_agents", agent)).select("node_id")
    best = links.join(mine, "node_id", "left_semi").groupBy("topic_id").agg(F.max("relevance").alias("relevance"))
    scored = topics.join(best, "topic_id").withColumn("agent_score", F.col("importance_score") * F.col("relevance"))
    return scored.orderBy(F.desc("agent_score"), "topic_id").limit(k)


def refresh_importance(topics: DataFrame, as_of: Column, config: Topics = Topics()) -> DataFrame:
    """Topics with importance as of a time; age counts whole seconds."""
    age = F.floor((F.unix_millis(as_of) - F.unix_millis("last_mentioned_at")) / 1000) / F.lit(86400.0)
    return topics.withColumn("importance_score", F.when(F.col("status") == "active", importance(F.col("node_count"), age, config)).otherwise(F.col("importance_score")))


def mention(topics: DataFrame, mentions: DataFrame) -> DataFrame:
    """Topics with counts and times of mentions (topic_id, ts) folded in."""
    seen = mentions.groupBy("topic_id").agg(F.count(F.lit(1)).alias("__n"), F.max("ts").alias("__ts"))
    out = topics.join(seen, "topic_id", "left")
    return out.withColumns({"node_count": F.col("node_count") + F.coalesce("__n", F.lit(0)), "last_mentioned_at": F.greatest("last_mentioned_at", "__ts")}).drop("__n", "__ts")


def prune(topics: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    """Topics not mentioned for long become pruned."""
    stale = F.col("last_mentioned_at") < as_of - F.make_interval(days=F.lit(days))
    return topics.withColumn("status", F.when((F.col("status") == "active") & stale, "pruned").otherwise(F.col("status")))


def resurrect(topics: DataFrame, ids: Sequence[object]) -> DataFrame:
    return topics.withColumn("status", F.when(F.col("topic_id").isin(*ids), "active").otherwise(F.col("status")))


def merge_similar(topics: DataFrame, threshold: float = 0.8) -> DataFrame:
    """topic_id and keeper after the greedy merge: pairs in order of ids, the more important one stays, merged ones take no further part.

    Which topic of a pair would go is known beforehand, so a pair depends only on earlier ones that may take one of its
    topics away. In each round all pairs without such an earlier one are settled at once, and later pairs of topics that
    went are dropped; the result is that of the fold in order. Topics without importance count as least important.
    """
    scores = topics.groupBy("topic_id").agg(F.coalesce(F.max("importance_score"), F.lit(float("-inf"))).alias("s"))
    left = semantic_edges(topics, threshold).select("source_id", "target_id").distinct()
    for end in ("source", "target"):
        left = left.join(scores.select(F.col("topic_id").alias(f"{end}_id"), F.col("s").alias(f"{end}_score")), f"{end}_id")
    stays = F.col("source_score") >= F.col("target_score")
    left = cut(left.select("source_id", "target_id", F.when(stays, F.col("target_id")).otherwise(F.col("source_id")).alias("topic_id"), F.when(stays, F.col("source_id")).otherwise(F.col("target_id")).alias("keeper")))
    settled: DataFrame | None = None
    while not left.isEmpty():
        turn = F.struct("source_id", "target_id")
        first = left.groupBy("topic_id").agg(F.min(turn).alias("first"))
        waits = left
        for end in ("source", "target"):
            waits = waits.join(first.select(F.col("topic_id").alias(f"{end}_id"), F.col("first").alias(f"{end}_first")), f"{end}_id", "left")
        ready = waits.filter((F.col("source_first").isNull() | (F.col("source_first") >= turn)) & (F.col("target_first").isNull() | (F.col("target_first") >= turn)))
        now = cut(ready.select("topic_id", "keeper", turn.alias("went")))
        settled = now.drop("went") if settled is None else settled.unionByName(now.drop("went"))
        for end in ("source", "target"):
            left = left.join(now.select(F.col("topic_id").alias(f"{end}_id"), F.col("went").alias(f"{end}_went")), f"{end}_id", "left")
        gone = [F.coalesce(F.col(f"{end}_went") <= turn, F.lit(False)) for end in ("source", "target")]
        left = cut(left.filter(~gone[0] & ~gone[1]).drop("source_went", "target_went"))
    ids = topics.select("topic_id")
    out = ids.withColumn("keeper", F.col("topic_id")) if settled is None else ids.join(settled, "topic_id", "left").withColumn("keeper", F.coalesce("keeper", "topic_id"))
    return out.select(F.col("topic_id").cast("bigint").alias("topic_id"), F.col("keeper").cast("bigint").alias("keeper"))


def extract_topics(vectors: DataFrame, cluster: str, vector_col: str) -> DataFrame:
    """topic_id, embedding and node_count of each cluster; noise (-1) has none."""
    return centroids(vectors.filter(F.col(cluster) != -1), cluster, vector_col).select(F.col(cluster).alias("topic_id"), "embedding", F.col("n").alias("node_count"))


def graph_status(topics: DataFrame, links: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts."""
    t = topics.agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "pruned").alias("pruned"))
    return t.crossJoin(links.agg(F.count(F.lit(1)).alias("links"))).crossJoin(edges.agg(F.count(F.lit(1)).alias("relationships")))



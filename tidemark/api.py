"""The engine's calls: one method for each request of the service, over a folder of tables.

Methods return DataFrames; nothing runs before an action. ``as_of`` replaces the wall clock wherever time matters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Retention, Settings
from .functions import scoring, text
from .functions.embedding import Embedder, HashingEmbedder
from .operators import agents, dedup, episodes, indexing, lifecycle, search, store, toc, topics
from .operators.indexes import VectorIndex, WordIndex
from .plans import router
from .plans.jobs import Jobs


class Engine:
    """Tables by name: events, nodes, grips, documents, vectors, topics, links, edges, episodes, usage."""

    def __init__(
        self,
        spark: SparkSession,
        tables: Mapping[str, DataFrame],
        as_of: Column,
        settings: Settings = Settings(),
        embedder: Embedder | None = None,
        words: WordIndex | None = None,
        vectors: VectorIndex | None = None,
        jobs: Jobs | None = None,
    ) -> None:
        """Searches read the word and vector indexes where they are given, else the tables."""
        self.spark, self.tables, self.as_of, self.settings = spark, dict(tables), as_of, settings
        self.embedder, self.words, self.vectors, self.jobs = embedder or HashingEmbedder(), words, vectors, jobs or Jobs()

    @classmethod
    def open(cls, spark: SparkSession, folder: str, names: Sequence[str], as_of: Column, **more) -> Engine:
        return cls(spark, {n: spark.read.parquet(f"{folder}/{n}") for n in names}, as_of, **more)

    def _of(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise LookupError(f"no table {name}")
        return self.tables[name]

    # Events and the hierarchy.

    def ingest(self, events: DataFrame) -> DataFrame:
        """What an insert of events adds."""
        return store.new_rows(events, self._of("events"), "event_id")

    def get_events(self, start: str, end: str, limit: int = 50) -> DataFrame:
        return store.page(store.in_range(self._of("events"), start, end), ["ts", "event_id"], 0, limit)

    def get_toc_root(self) -> DataFrame:
        return self._of("nodes").filter("level = 'year'").orderBy(F.desc("start_time"))

    def get_node(self, node_id: str) -> DataFrame:
        return store.lookup(self._of("nodes"), "node_id", node_id)

    def browse_toc(self, parent: str, token: str | None = None, size: int = 20) -> DataFrame:
        """A page of child nodes; the ``token`` of its last row asks for the next one."""
        return store.page_after(self._of("nodes").filter(F.col("parent_id") == parent), ["start_time", "node_id"], token, size)

    def search_node(self, node_id: str, query: str, fields: Sequence[str] = (), limit: int = 10) -> DataFrame:
        return toc.node_search(self.get_node(node_id), text.query_terms(query), fields).orderBy(F.desc("score")).limit(limit)

    def search_children(self, parent: str, query: str, limit: int = 10) -> DataFrame:
        return toc.children_relevance(self._of("nodes"), parent, text.query_terms(query), limit)

    def expand_grip(self, grip_id: str) -> DataFrame:
        """The events around a grip; none for an unknown id."""
        return toc.grip_context(store.lookup(self._of("grips"), "grip_id", grip_id), self._of("events"), self.settings.grips)

    def timeline(self, start: Column, end: Column, entity: str | None = None) -> DataFrame:
        return toc.timeline(self._of("events"), start, end, entity)

    def range_summary(self, start: Column, end: Column) -> DataFrame:
        return toc.range_summary(self._of("nodes"), start, end)

    # Search.

    def teleport_search(self, query: str, limit: int = 10, doc_type: str | None = None, agent: str | None = None) -> DataFrame:
        if self.words is not None and doc_type is None and agent is None:
            return search.top(self.words.search(query), min(limit, 100), "doc_id")
        docs = self._of("documents")
        for column, value in (("doc_type", doc_type), ("agent", agent)):
            docs = docs if value is None else docs.filter(F.col(column) == value)
        return search.top(search.bm25(docs, query), min(limit, 100), "doc_id")

    def vector_teleport(self, query: str, k: int = 10, min_score: float = 0.0, where: Column | None = None) -> DataFrame:
        vector = self.embedder.embed([query])[0]
        if self.vectors is not None and where is None:
            return self.vectors.search(vector.tolist(), k).withColumnRenamed(self.vectors.id_col, "doc_id").filter(F.col("score") >= min_score)
        return search.knn(self._of("vectors"), vector.tolist(), k, "doc_id", where=where).filter(F.col("score") >= min_score)

    def hybrid_search(self, query: str, limit: int = 10, words: float = 0.5, vectors: float = 0.5) -> DataFrame:
        lists = {}
        if "documents" in self.tables:
            lists["bm25"] = self.teleport_search(query, 2 * limit)
        if "vectors" in self.tables:
            lists["vector"] = self.vector_teleport(query, 2 * limit)
        if not lists:
            raise LookupError("neither documents nor vectors to search")
        return search.top(search.rrf(lists, "doc_id", {"bm25": words, "vector": vectors}, self.settings.rrf_k), limit, "doc_id")

    def _agentic(self, query: str) -> DataFrame:
        scored = self._of("documents").select("doc_id", text.term_overlap(F.col("text"), text.query_terms(query)).alias("score"))
        return search.top(scored.filter("score IS NOT NULL"), 50, "doc_id")

    def layers(self) -> dict[str, router.Layer]:
        out: dict[str, router.Layer] = {}
        if "documents" in self.tables:
            out |= {"bm25": lambda q: self.teleport_search(q, 50), "agentic": self._agentic}
        if "vectors" in self.tables:
            out["vector"] = lambda q: self.vector_teleport(q, 50)
        if out.keys() >= {"bm25", "vector"}:
            out["hybrid"] = lambda q: self.hybrid_search(q, 50).select("doc_id", "score")
        if "topics" in self.tables:
            out["topics"] = lambda q: topics.search(self._of("topics"), q.split()).select(F.col("topic_id").cast("bigint").alias("doc_id"), F.col("importance_score").alias("score"))
        return out

    def route_query(self, query: str, limit: int = 10, timeout_ms: int | None = None) -> tuple[DataFrame, router.Explanation]:
        return router.route(query, self.layers(), self._of("facts"), self.settings, limit, timeout_ms)

    def orchestrate(self, query: str, k: int = 10) -> DataFrame:
        return router.orchestrate(query, self.layers(), k, self.settings.rrf_k)

    def classify_query_intent(self, query: str, timeout_ms: int | None = None) -> tuple[str, float]:
        return router.classify_text(query, timeout_ms)

    def retrieval_capabilities(self) -> DataFrame:
        have = self.layers()
        rows = [(name, name in have) for name in router.TIER_LAYERS["full"]]
        tier = router.tier(*(x in have for x in ("topics", "vector", "bm25")))
        return self.spark.createDataFrame([(tier, n, ok) for n, ok in rows], "tier string, layer string, ready boolean")

    # Topics.

    def topics_by_query(self, query: str, limit: int = 10) -> DataFrame:
        return topics.search(self._of("topics"), query.split()).limit(limit)

    def related_topics(self, topic: int, undirected: bool = True) -> DataFrame:
        return topics.related(self._of("edges"), topic, undirected).join(self._of("topics").select("topic_id", "label"), "topic_id")

    def top_topics(self, k: int = 10, agent: str | None = None, days: int | None = None) -> DataFrame:
        if agent is not None:
            return topics.topics_for_agent(self._of("topics"), self._of("links"), self._of("nodes"), agent, k)
        return topics.top_topics(self._of("topics"), k, None if days is None else self.as_of - F.make_interval(days=F.lit(days)))

    def topic_graph_status(self) -> DataFrame:
        return topics.graph_status(self._of("topics"), self._of("links"), self._of("edges"))

    # Agents, episodes, usage, status.

    def list_agents(self) -> DataFrame:
        return agents.agent_summary(self._of("nodes"), self._of("events"), self.as_of).orderBy(F.desc("last_seen"), "agent")

    def agent_activity(self, unit: str = "day", agent: str | None = None) -> DataFrame:
        return agents.activity(self._of("events"), unit, agent).orderBy("bucket", "agent")

    def ranking_status(self) -> DataFrame:
        return agents.ranking_metrics(self._of("nodes"))

    def dedup_status(self, decisions: DataFrame) -> DataFrame:
        return dedup.decision_counts(decisions)

    def similar_episodes(self, task: str, k: int = 5, min_score: float = 0.0) -> DataFrame:
        return episodes.similar(self._of("episodes"), self.embedder.embed([task])[0].tolist(), k, min_score, self.settings.episodes.max_episodes)

    def start_episodes(self, tasks: DataFrame) -> DataFrame:
        """New episodes from (episode_id, task); a blank task is an error."""
        return tasks.select(*episodes.start(F.col("episode_id"), F.col("task"), self.as_of))

    def record_actions(self, actions: DataFrame) -> DataFrame:
        """The episodes with actions (episode_id, ts, action_type, input, status) in time order."""
        return episodes.with_actions(self._of("episodes"), actions)

    def complete_episodes(self, outcomes: DataFrame) -> DataFrame:
        return episodes.complete(self._of("episodes"), outcomes, self.settings.episodes.midpoint)

    def usage(self, log: DataFrame) -> DataFrame:
        return agents.usage_from_log(log)

    # Administration.

    def prune(self, dry_run: bool = True, retention: Retention | None = None) -> DataFrame:
        """What a prune would remove by level, or the documents that stay."""
        docs, kept = self._of("documents"), retention or self.settings.retention
        return lifecycle.prune_counts(docs, self.as_of, kept) if dry_run else lifecycle.kept(docs, self.as_of, kept)

    def prune_bm25(self, dry_run: bool = True) -> DataFrame:
        """The word index's prune: without ``dry_run`` its expired documents are removed from the index, too."""
        if not dry_run and self.words is not None:
            self.words.remove(lifecycle.expired(self._of("documents"), self.as_of, Retention.words()))
            self.words.commit()
        return self.prune(dry_run, Retention.words())

    def prune_vectors(self, dry_run: bool = True) -> DataFrame:
        if not dry_run and self.vectors is not None:
            self.vectors.remove(lifecycle.expired(self._of("documents"), self.as_of, self.settings.retention).withColumnRenamed("doc_id", self.vectors.id_col))
            self.vectors.commit()
        return self.prune(dry_run)

    def vector_index_status(self) -> DataFrame:
        """One row: whether there is a vector index, its vectors and its segments."""
        held, n = ([], 0) if self.vectors is None else (self.vectors.manifest["segments"], self.vectors.size)
        return self.spark.createDataFrame([(self.vectors is not None, n, len(held))], "ready boolean, vectors bigint, segments int")

    def rebuild_words(self, least: str | None = None) -> tuple[int, int]:
        """The word index made anew from documents with levels; documents and errors."""
        if self.words is None:
            raise LookupError("no word index")
        return indexing.rebuild(self._of("documents").select("doc_id", "text", "level"), self.words, least=least, folder=self.words.folder)

    def scheduler_status(self) -> DataFrame:
        return self.jobs.status(self.spark)

    def pause_job(self, name: str) -> None:
        self.jobs.pause(name)

    def resume_job(self, name: str) -> None:
        self.jobs.pause(name, False)

    def rebuild_toc(self) -> DataFrame:
        """The hierarchy made anew from events."""
        return toc.with_children(toc.hierarchy(self._of("events")))

    def stats(self) -> DataFrame:
        return store.counts(self.tables)

    def salience(self, docs: DataFrame) -> DataFrame:
        return docs.withColumn("memory_kind", text.memory_kind(F.col("text"))).withColumn("salience_score", scoring.salience(F.col("text"), F.col("memory_kind"), F.col("is_pinned")))

    def describe(self) -> dict:
        return asdict(self.settings)

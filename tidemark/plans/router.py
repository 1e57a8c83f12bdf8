"""Query routing: intent, tier, layers, execution, explanation, and the orchestrated query."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings, StopConditions
from ..functions.scoring import token_estimate
from ..functions.text import expand_query
from ..operators import ranking, search
from ..shipping import map_batches

#: Keywords of intents. Fixed values.
INTENT_KEYWORDS: dict[str, tuple[str, ...]] = {
    "explore": ("themes", "topics", "working on", "been doing", "explore", "discover", "patterns", "recurring", "overview", "summary", "show me", "what have", "related", "connections"),
    "answer": ("how", "why", "what was", "what is", "explain", "describe", "tell me", "when did", "who", "decided", "solution", "fix", "resolve"),
    "locate": ("where", "find", "locate", "exact", "specific", "quote", "snippet", "definition", "defined", "config", "error message", "line", "search for"),
}
#: Layers by intent, best first, and layers that a tier supports. Fixed values.
CHAINS: dict[str, tuple[str, ...]] = {
    "explore": ("topics", "hybrid", "vector", "bm25", "agentic"),
    "answer": ("hybrid", "bm25", "vector", "agentic"),
    "locate": ("bm25", "hybrid", "vector", "agentic"),
}
TIER_LAYERS: dict[str, tuple[str, ...]] = {
    "full": ("topics", "hybrid", "vector", "bm25", "agentic"),
    "hybrid": ("hybrid", "vector", "bm25", "agentic"),
    "semantic": ("vector", "agentic"),
    "keyword": ("bm25", "agentic"),
    "agentic": ("agentic",),
}
MODES = {"explore": "parallel", "answer": "hybrid", "locate": "sequential", "time_boxed": "sequential"}
PRIORITY = ("explore", "locate", "answer")

Layer = Callable[[str], DataFrame]
#: What is known of the documents of a short list of ids.
Facts = Callable[[DataFrame], DataFrame]


def keyword_score(text: Column, words: Sequence[str]) -> Column:
    """min(hits, 3) / 3 and 0.1 for each hit of over five bytes, 1 at most; 0 without hits."""
    low = F.lower(text)
    hits = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    long = sum((F.contains(low, F.lit(w)).cast("int") for w in words if len(w.encode()) > 5), F.lit(0))
    return F.least(F.lit(1.0), F.least(hits, F.lit(3)) / F.lit(3.0) + 0.1 * long)


def classify(queries: DataFrame, text: str = "query", timeout_ms: int | None = None) -> DataFrame:
    """Queries with the score of each intent, the intent and its confidence; ties favour explore, then locate; below 0.3 it is answer at 0.5.

    With a timeout every query is time-boxed, at the confidence of its best intent.
    """
    out = queries.withColumns({f"{k}_score": keyword_score(F.col(text), words) for k, words in INTENT_KEYWORDS.items()})
    best = F.greatest(*(F.col(f"{k}_score") for k in INTENT_KEYWORDS))
    intent = F.when(best < 0.3, "answer")
    for k in PRIORITY:
        intent = intent.when(F.col(f"{k}_score") == best, k)
    if timeout_ms is not None:
        return out.withColumn("intent", F.lit("time_boxed")).withColumn("confidence", best)
    return out.withColumn("intent", intent).withColumn("confidence", F.when(best < 0.3, 0.5).otherwise(best))


def classify_text(query: str, timeout_ms: int | None = None) -> tuple[str, float]:
    """The same for one query, on the driver; a timeout makes it time-boxed."""
    low = query.lower()
    scores = {}
    for k, words in INTENT_KEYWORDS.items():
        hits = [w for w in words if w in low]
        scores[k] = min(1.0, min(len(hits), 3) / 3 + 0.1 * sum(len(w.encode()) > 5 for w in hits))
    best = max(scores.values())
    if timeout_ms is not None:
        return "time_boxed", best
    return ("answer", 0.5) if best < 0.3 else (next(k for k in PRIORITY if scores[k] == best), best)


def tier(topics: bool, vector: bool, bm25: bool) -> str:
    if vector and bm25:
        return "full" if topics else "hybrid"
    return "semantic" if vector else "keyword" if bm25 else "agentic"


def tier_column(topics: Column, vector: Column, bm25: Column) -> Column:
    """:func:`tier` of columns."""
    return F.when(vector & bm25, F.when(topics, "full").otherwise("hybrid")).when(vector, "semantic").when(bm25, "keyword").otherwise("agentic")


def layers_of(tier_name: Column) -> Column:
    """The layers of a tier, as an array."""
    return _listed(TIER_LAYERS, tier_name)


def chain_column(intent: Column, tier_name: Column, limit: int = 3) -> Column:
    """:func:`chain` of columns, as an array."""
    boxed = F.array_distinct(F.array(F.element_at(layers_of(tier_name), 1), F.lit("agentic")))
    return F.when(intent == "time_boxed", boxed).otherwise(F.slice(F.filter(_listed(CHAINS, intent), lambda x: F.array_contains(layers_of(tier_name), x)), 1, limit))


def _listed(lists: dict[str, tuple[str, ...]], key: Column) -> Column:
    return F.coalesce(*(F.when(key == k, F.array(*map(F.lit, v))) for k, v in lists.items()))


class LayerStatus(Protocol):
    """Which layers can answer now."""

    def ready(self, layer: str) -> bool: ...


def tier_of(status: LayerStatus) -> str:
    return tier(*(status.ready(x) for x in ("topics", "vector", "bm25")))


def chain(intent: str, tier_name: str, limit: int = 3) -> list[str]:
    """The layers to try, in order. A time-boxed query tries the tier's best layer and then the agentic one."""
    if intent == "time_boxed":
        best = TIER_LAYERS[tier_name][0]
        return list(dict.fromkeys((best, "agentic")))
    return [x for x in CHAINS[intent] if x in TIER_LAYERS[tier_name]][:limit]


@dataclass(frozen=True)
class Execution:
    """What an execution tried and found; ``rows`` has doc_id, score and source_layer."""

    rows: DataFrame | None
    tried: tuple[str, ...]
    used: tuple[str, ...]
    fallback: bool
    why: str
    bounds_hit: tuple[str, ...] = ()


@dataclass(frozen=True)
class Explanation:
    intent: str
    confidence: float
    tier: str
    mode: str
    tried: tuple[str, ...]
    used: tuple[str, ...]
    fallback: bool
    why: str = ""
    bounds_hit: tuple[str, ...] = ()

    @property
    def winner(self) -> str:
        return self.used[0] if self.used else "agentic"

    def summary(self, results: int, grip_ids: Sequence[str] = ()) -> str:
        parts = [f"Tier: {self.tier}", f"Method: {self.winner} ({self.mode})"]
        if self.fallback:
            parts.append(f"Fallback: {self.why}")
        parts.append(f"Results: {results}")
        if grip_ids:
            parts.append(f"Evidence: {len(grip_ids)} grips")
        return " | ".join(parts)

    def markdown(self) -> str:
        return f"**{self.intent}** ({self.confidence:.2f}), tier {self.tier}, {self.mode}: tried {', '.join(self.tried)}; used {', '.join(self.used) or 'none'}" + ("; fell back" if self.fallback else "")

    def payload(self, results: DataFrame) -> DataFrame:
        """The explanation as one row, with the number of ``results`` (a limited list) and the grips among them."""
        spark = results.sparkSession
        head = spark.createDataFrame(
            [(self.intent, float(self.confidence), self.tier, self.mode, list(self.tried), self.winner, self.why, self.fallback, self.why if self.fallback else None)],
            "intent string, confidence double, tier string, mode string, candidates array<string>, winner string, why_winner string, fallback boolean, fallback_reason string",
        )
        grips = F.array_sort(F.collect_set(F.when(F.col("doc_id").cast("string").startswith("grip:"), F.col("doc_id").cast("string"))))
        return head.crossJoin(results.agg(F.count(F.lit(1)).alias("result_count"), grips.alias("grip_ids")))  # one row each


#: Layers by their number on the wire. Fixed values.
LAYER_NAMES = ("unknown", "topics", "hybrid", "vector", "bm25", "agentic")


def layer_name(code: Column) -> Column:
    """The name of a layer's number."""
    return F.coalesce(F.try_element_at(F.array(*map(F.lit, LAYER_NAMES)), F.greatest(code, F.lit(0)).cast("int") + 1), F.lit(LAYER_NAMES[0]))


def map_results(rows: DataFrame) -> DataFrame:
    """Wire results (doc_id, score, layer_code, text) as they are shown."""
    return rows.select("doc_id", F.round("score", 4).alias("score"), layer_name(F.col("layer_code")).alias("layer"), F.col("text").alias("preview"))


#: What a skill's declaration needs. Fixed values.
SKILL_FIELDS = ("name", "description", "triggers", "retrieval", "fallback")


def check_skill(skill: Mapping[str, object]) -> list[tuple[str, str]]:
    """(severity, field) of what a skill's declaration lacks."""
    return [("error" if f in SKILL_FIELDS[:2] else "warning", f) for f in SKILL_FIELDS if not skill.get(f)]


def execute(query: str, layers: Mapping[str, Layer], order: Sequence[str], mode: str, stop: StopConditions = StopConditions()) -> Execution:
    """The layers' results by mode.

    Sequential: layers in turn until one's best score suffices, the calls or the time are used up; the first layer with
    rows counts if none suffices. It is a fallback when the first layer has no rows, or a later one was asked and has rows too.
    Others: ``beam_width`` layers (two at least) in one plan, merged, without fallback; what the mode says of the
    result depends on ``min_confidence`` in hybrid mode.
    """
    order = [x for x in order if x in layers]
    if mode != "sequential":
        chosen = tuple(order[: max(stop.beam_width, 2)])
        if not chosen:
            return Execution(None, (), (), False, "No supported layers available")
        merged = search.merge_layers({f"{k}:{x}": layers[x](query) for k, x in enumerate(chosen)}, "doc_id")
        rows = merged.withColumn("source_layer", F.element_at(F.split("source_layer", ":"), 2))
        why = f"merged {', '.join(chosen)}"
        if mode == "hybrid" and stop.min_confidence > 0:
            best = rows.agg(F.max("score")).first()[0]
            why = f"{why}: strong results" if best is not None and best >= stop.min_confidence else f"{why}: no strong results"
        return Execution(rows, chosen, chosen, False, why)
    kept, used, tried, fallback, why, hit = None, (), [], False, "No results found from any layer", []
    began = time.monotonic()
    for name in order[: stop.max_layers]:
        if len(tried) >= stop.max_calls:
            hit.append("max_calls")
            break
        if (time.monotonic() - began) * 1000 >= stop.timeout_ms:
            hit.append("timeout_ms")
            why = f"Timed out after {len(tried)} layers"
            break
        rows = layers[name](query)
        best = rows.agg(F.max("score")).first()[0]
        tried.append(name)
        if best is None:
            fallback = fallback or len(tried) == 1
            continue
        if kept is None:
            kept, used = rows.select("doc_id", "score", F.lit(name).alias("source_layer")), (name,)
        else:
            fallback = True
        if best >= stop.sufficient:
            kept, used, why = rows.select("doc_id", "score", F.lit(name).alias("source_layer")), (name,), f"{name} provided sufficient results"
            break
        why = f"{name} returned results but confidence is low"
    return Execution(kept, tuple(tried), used, fallback, why, tuple(hit))


def within_tokens(results: DataFrame, max_tokens: int, text: str = "text") -> DataFrame:
    """The best results of a limited list whose texts fit the token budget together; the first always stays."""
    upto = F.sum(token_estimate(F.col(text))).over(Window.orderBy(F.desc("score"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    nth = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))
    return results.withColumns({"__upto": upto, "__nth": nth}).filter((F.col("__upto") <= max_tokens) | (F.col("__nth") == 1)).drop("__upto", "__nth")


def route(
    query: str, layers: Mapping[str, Layer], facts: DataFrame | Facts, settings: Settings = Settings(), limit: int = 10, timeout_ms: int | None = None, embeddings: Facts | None = None
) -> tuple[DataFrame, Explanation]:
    """The routed query: classify, choose layers, execute, limit, enrich, decay, penalise what newer results replace, combine and limit.

    ``facts`` has doc_id, salience_score, memory_kind, access_count and ts of documents, or makes them for the few ids
    that it is given, which spares making them for all. ``embeddings`` gives doc_id and embedding of ids in the same way.
    """
    if not query.strip():
        raise ValueError("a query must not be empty")
    intent, confidence = classify_text(query, timeout_ms)
    stop = settings.stop if timeout_ms is None else StopConditions.time_boxed(timeout_ms)
    tier_name = tier(*(x in layers for x in ("topics", "vector", "bm25")))
    order, mode = chain(intent, tier_name, stop.max_layers), MODES[intent]
    done = execute(query, layers, order, mode, stop)
    rows = done.rows
    if rows is None:
        made = facts if isinstance(facts, DataFrame) else facts(next(iter(layers.values()))(query).select("doc_id"))
        rows = made.select("doc_id", F.lit(0.0).alias("score"), F.lit("none").alias("source_layer")).filter(F.lit(False))
    best = search.top(rows, stop.max_nodes, "doc_id")
    known = facts.join(F.broadcast(best.select("doc_id")), "doc_id", "left_semi") if isinstance(facts, DataFrame) else facts(best.select("doc_id"))
    rich = best.join(known, "doc_id", "left").withColumns({"salience_score": F.coalesce("salience_score", F.lit(0.5)), "memory_kind": F.coalesce("memory_kind", F.lit("observation")), "access_count": F.coalesce("access_count", F.lit(0))})
    fresh = ranking.stale_filter(rich, None if embeddings is None else embeddings(best.select("doc_id")), settings.staleness)
    final = ranking.combine(fresh, settings.ranking)
    out = search.top(final.select("doc_id", "score", "source_layer", "memory_kind"), limit, "doc_id")
    return out, Explanation(intent, confidence, tier_name, mode, done.tried, done.used, done.fallback, done.why, done.bounds_hit)


class Reranker(Protocol):
    """Reorders fused results (doc_id, score, n_lists) of a query."""

    def rerank(self, query: str, results: DataFrame) -> DataFrame: ...


class HeuristicReranker:
    """Fused score order, ten results at most."""

    size = 10

    def rerank(self, query: str, results: DataFrame) -> DataFrame:
        return search.top(results, self.size, "doc_id")


class CrossEncoderReranker:
    """Scores of (query, text) by a model; without a model, or where it gives no score, the heuristic order.

    ``texts`` gives doc_id and text of a list of ids; only the fused list is scored.
    """

    def __init__(self, model: Callable[[str, Sequence[str]], Sequence[float]] | None = None, texts: Facts | None = None) -> None:
        self.model, self.texts = model, texts

    def rerank(self, query: str, results: DataFrame) -> DataFrame:
        if self.model is None or self.texts is None:
            return HeuristicReranker().rerank(query, results)
        model = self.model

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield pd.DataFrame({"doc_id": b["doc_id"], "__model": [float(x) for x in model(query, b["text"].tolist())]})

        known = self.texts(results.select("doc_id")).select("doc_id", "text")
        scored = map_batches(known, score, f"doc_id {dict(known.dtypes)['doc_id']}, __model double")
        out = results.join(scored, "doc_id", "left").withColumn("score", F.coalesce("__model", "score")).drop("__model")
        return search.top(out, HeuristicReranker.size, "doc_id")


def orchestrate(query: str, layers: Mapping[str, Layer], k: int = 10, rrf_k: int = 60, depth: int = 20, reranker: Reranker | None = None) -> DataFrame:
    """All layers for all variants of the query, fused by rank in one plan, and reranked."""
    lists = {f"{n}:{name}": search.top(layer(variant).select("doc_id", "score"), depth, "doc_id") for n, variant in enumerate(expand_query(query)) for name, layer in layers.items()}
    fused = search.rrf(lists, "doc_id", k=rrf_k)
    return search.top((reranker or HeuristicReranker()).rerank(query, fused), k, "doc_id")


def context(results: DataFrame, text: str = "text") -> DataFrame:
    """One row: number of results, tokens estimated and confidence, the best score."""
    return results.agg(
        F.count(F.lit(1)).alias("n_results"),
        F.floor(F.coalesce(F.sum(F.char_length(text)), F.lit(0)) * 0.75 + 50).cast("bigint").alias("tokens_estimated"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("confidence"),
    )

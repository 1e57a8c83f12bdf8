"""Search operators: BM25, exact kNN, rank fusion and merging of layers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import rrf_weight
from ..functions.text import SEPARATORS, query_words, searchable_text, term_overlap, words
from ..functions.vectors import cosine, literal
from .similarity import pairs

K1, B = 1.2, 0.75


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The inverted index: (term, id, tf) and (id, dl). Counting is map-side first."""
    tokens = docs.select(F.col(id_col), words(F.col(text_col)).alias("w"))
    terms = tokens.select(id_col, F.explode("w").alias("term")).groupBy("term", id_col).agg(F.count(F.lit(1)).alias("tf"))
    return terms, tokens.select(id_col, F.size("w").cast("bigint").alias("dl"))


def _among(terms: Sequence[str]) -> Callable[[Column], Column]:
    return lambda w: w.isin(*terms)


def _equals(term: str) -> Callable[[Column], Column]:
    return lambda w: w == term


def bm25_score(terms: int) -> Column:
    """The score of a row with __n, __avg and __dl, and __df and __tf of each of ``terms`` terms."""
    score = F.lit(0.0)
    for k in range(terms):
        df, f = F.col(f"__df{k}"), F.col(f"__tf{k}")
        idf = F.log(1 + (F.col("__n") - df + 0.5) / (df + 0.5))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__dl") / F.col("__avg")))
    return score


def bm25(docs: DataFrame, query: str | Sequence[str], id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """id and score, to nine places so that copies tie, of documents with a query term.

    Terms are counted inside each row, so no word of the corpus is exploded or shuffled; only one row of corpus
    statistics (texts, mean length, document frequency of each query term) is gathered, and joined back by broadcast.
    A query is split into words as texts are, so ``north-west`` asks for two. A blank query finds nothing.
    """
    terms = list(dict.fromkeys(w for part in ([query] if isinstance(query, str) else query) for w in query_words(part)))
    split = docs.select(id_col, *carry, F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), SEPARATORS).alias("__s"))
    # Only the first and the last part can be empty, so the length needs no pass over the words.
    empty = (F.element_at("__s", 1) == "").cast("int") + (F.element_at("__s", -1) == "").cast("int")
    found = split.select(id_col, *carry, F.greatest(F.size("__s") - empty, F.lit(0)).alias("__dl"), F.filter("__s", _among(terms)).alias("__hits"))
    counted = found.select(id_col, *carry, "__dl", *(F.size(F.filter("__hits", _equals(t))).alias(f"__tf{k}") for k, t in enumerate(terms)))
    if not terms:
        return counted.select(id_col, *carry, F.lit(0.0).alias("score")).filter(F.lit(False))
    stats = counted.agg(F.count(F.lit(1)).alias("__n"), F.avg("__dl").alias("__avg"), *(F.count_if(F.col(f"__tf{k}") > 0).alias(f"__df{k}") for k in range(len(terms))))
    joined = counted.crossJoin(F.broadcast(stats))  # stats is one row
    score = bm25_score(len(terms))
    hit = reduce(lambda a, b: a | b, (F.col(f"__tf{k}") > 0 for k in range(len(terms))))
    return joined.filter(hit).select(id_col, *carry, F.round(score, 9).alias("score"))


def knn(vectors: DataFrame, query: Sequence[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding", carry: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """The k rows of largest cosine to one vector, exactly; filters go before the search, so k rows are found if there are."""
    rows = vectors if where is None else vectors.filter(where)
    return top(rows.select(id_col, *carry, cosine(F.col(vector_col), literal(query)).alias("score")), k, id_col)


def with_metadata(found: DataFrame, metadata: DataFrame, vector_col: str = "vec_id") -> DataFrame:
    """Results of a vector search with their documents; results without metadata are dropped."""
    return found.join(metadata, vector_col)


def embeddings_of(found: DataFrame, metadata: DataFrame, vectors: DataFrame, id_col: str = "doc_id", vector_col: str = "vec_id") -> DataFrame:
    """id and embedding of the results whose document has a vector. Results are limited, so they are sent to the tables."""
    mine = metadata.join(F.broadcast(found.select(id_col)), id_col, "left_semi").select(id_col, vector_col)
    return vectors.join(F.broadcast(mine), vector_col).select(id_col, "embedding")


def result_metadata(results: DataFrame) -> DataFrame:
    """Results with metadata, a map of timestamp_ms, agent and memory_kind where they are known."""
    known = F.map_from_arrays(
        F.array(F.lit("timestamp_ms"), F.lit("agent"), F.lit("memory_kind")),
        F.array(F.unix_millis("ts").cast("string"), F.col("agent"), F.col("memory_kind")),
    )
    return results.withColumn("metadata", F.map_filter(known, lambda k, v: v.isNotNull()))


def metadata_number(metadata: Column, key: str, default: float) -> Column:
    """A number out of a metadata map; the default where it is missing or no number."""
    return F.coalesce(F.try_element_at(metadata, F.lit(key)).try_cast("double"), F.lit(default))


def composite(lists: Sequence[DataFrame], k: int, id_col: str) -> DataFrame:
    """The k best of several indexes' results, each document once at its best score: what a recent buffer and a store find together."""
    both = reduce(DataFrame.unionByName, (rows.select(id_col, "score") for rows in lists))
    return top(both.groupBy(id_col).agg(F.max("score").alias("score")), k, id_col)


def federated_nodes(stores: Mapping[str, DataFrame], terms: Sequence[str], k: int) -> DataFrame:
    """The best segment nodes over stores by the share of terms in their title, keywords and bullets."""
    scored = {}
    for name, nodes in stores.items():
        text = searchable_text(F.col("title"), F.col("keywords"), F.col("bullets"))
        scored[name] = nodes.filter("level = 'segment'").select("node_id", term_overlap(text, terms).alias("score")).filter("score IS NOT NULL")
    return federated(scored, k, "node_id")


def top(rows: DataFrame, k: int, id_col: str, score: str = "score") -> DataFrame:
    return rows.orderBy(F.desc(score), id_col).limit(k)


def ranked(rows: DataFrame, id_col: str, score: str = "score") -> DataFrame:
    """Rows of one short list with their rank from 1; callers limit the list first."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), id_col)))


def rrf(lists: Mapping[str, DataFrame], id_col: str, weights: Mapping[str, float] | None = None, k: int = 60) -> DataFrame:
    """id, score (to twelve places, so that equal ranks tie) and n_lists: reciprocal-rank fusion of short ranked lists, as a union and one aggregate instead of outer joins."""
    weights = weights or {}
    parts = [ranked(rows, id_col).select(F.col(id_col), rrf_weight(F.col("rank"), weights.get(name, 1.0), k).alias("w"), F.lit(name).alias("list")) for name, rows in sorted(lists.items())]
    both = reduce(DataFrame.unionByName, parts)
    return both.groupBy(id_col).agg(F.round(F.sum("w"), 12).alias("score"), F.count(F.lit(1)).alias("n_lists"))


def merge_layers(layers: Mapping[str, DataFrame], id_col: str) -> DataFrame:
    """Each document once, with its best score over all layers; of equal scores the first layer by name."""
    both = reduce(DataFrame.unionByName, (rows.select(id_col, "score", F.lit(name).alias("source_layer")) for name, rows in sorted(layers.items())))
    best = both.groupBy(id_col).agg(F.max("score").alias("score"), F.min_by("source_layer", F.struct(-F.col("score"), F.col("source_layer"))).alias("source_layer"))
    return best


def federated(stores: Mapping[str, DataFrame], k: int, id_col: str) -> DataFrame:
    """The best k rows over stores, each with its project; every store sends its own best k only."""
    return top(reduce(DataFrame.unionByName, (top(rows, k, id_col).withColumn("project", F.lit(name)) for name, rows in sorted(stores.items()))), k, id_col)


def similar_pairs(vectors: DataFrame, threshold: float, key: str | None, id_col: str, vector_col: str) -> DataFrame:
    """Pairs a < b, inside each ``key`` if one is given, with a cosine of at least the threshold."""
    return pairs(vectors, threshold, id_col, vector_col, key)

"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import ship, text_or_empty, worker_state
from .linear import fit_logistic, ngram_ids, sigmoid


@dataclass(frozen=True)
class ToxicityConfig:
    """n-gram lengths, hash bits, training rows taken of each class at most, rows and log ratio that a feature needs, smoothing and penalty."""

    sizes: tuple[int, ...] = (3, 4, 5)
    bits: int = 18
    rows_per_class: int = 1000
    min_rows: int = 4
    min_ratio: float = 0.2
    alpha: float = 1.0
    l2: float = 0.3


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    intercept: float
    config: ToxicityConfig

    def score(self, text: str | None) -> float:
        ids = ngram_ids((text or "").lower(), self.config.sizes, self.config.bits)
        return sigmoid(float(self.weights[ids].sum()) + self.intercept)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether the crc32 of the id as text leaves no remainder by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> Model:
    """Fit on labelled documents that are not held out, at most ``rows_per_class`` of each class in hash order.

    A document with several labels counts as toxic if one says so; null labels and labels without a document
    teach nothing. Scores hold for the classes as sampled, so up to the bound for each class they are not pulled
    towards the more frequent one. Only n-gram hashes of the sampled whole texts reach the driver. Without rows of both classes
    the model gives every text the share of toxic labels, or 0 without labels.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("__y"))
    counts = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.filter("__y = 1").orderBy(*order).limit(config.rows_per_class).unionByName(known.filter("__y = 0").orderBy(*order).limit(config.rows_per_class))
    picked = picked.withColumnRenamed("doc_id", "__id")  # at most 2 * rows_per_class rows: safe to broadcast
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("__id")).select("doc_id", "__y", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("toxicity")
        for b in batches:
            found = [ngram_ids(t.as_py().lower(), config.sizes, config.bits).tobytes() for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), b["__y"], pa.array(found, pa.binary())], ["doc_id", "y", "ids"])

    ship(docs.sparkSession)
    rows = texts.mapInArrow(features, "doc_id long, y int, ids binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["ids"]))
    dims = 1 << config.bits
    y = np.array([r["y"] for r in rows])
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    if len(set(y)) < 2:
        return Model(np.zeros(dims), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), config)
    ids = [np.frombuffer(r["ids"], dtype=np.int32) for r in rows]
    del rows
    inside, outside = np.zeros(dims), np.zeros(dims)
    for x, c in zip(ids, y, strict=True):
        (inside if c else outside)[x] += 1
    p, q = inside + config.alpha, outside + config.alpha
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[(inside + outside < config.min_rows) | (np.abs(ratio) < config.min_ratio)] = 0
    weights, intercept = fit_logistic(ids, y, ratio, config.l2)
    return Model(weights.astype(np.float32), intercept, config)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``; null text counts as empty.

    Rows are scored one by one on whole texts, so repeated rows give repeated results; an empty table gives an
    empty result, and columns other than doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**bits floats

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("toxicity")
        m = shared.value
        for b in batches:
            found = np.array([m.score(t.as_py()) for t in b["text"]], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(found), pa.array((found >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text", held_out().alias("held_out"))
    kind = dict(docs.dtypes)["doc_id"]
    return rows.select("doc_id", "held_out", "text").mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    return score(docs, train(docs, labels, config))


def drop_toxic(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't predict to be toxic, with all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, config))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("toxicity")
        for b in batches:
            yield b.filter(pa.array([shared.value.score(t.as_py()) < 0.5 for t in b["text"]], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)

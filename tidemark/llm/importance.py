"""Target-distribution importance resampling: documents are drawn by how much likelier their words are in a target than in the corpus.

A feature is a word or two neighbouring words; features are hashed to buckets, and a bucket's gain is the logarithm of
its share in the target over its share in the corpus. A document's weight is the mean gain of its features, and a
Gumbel noise that its id fixes is added before the best are drawn, which draws without replacement in proportion to
the weights.

Higher-order functions make one array of buckets for each document, which is written once. Documents are then scored
by an ``aggregate`` over that array against a literal array of gains, so no feature leaves its row; only the totals of
the buckets, one row a bucket and task, are shuffled. DataFrame functions only.

Null texts have no words. Documents without features have weight 0, and null ids draw the noise of an empty id. Rows
that repeat an id are documents of their own with the same noise; among rows equal in score and id the order is open.
An empty table gives an empty result, an empty target gains that only the corpus makes. Other columns aren't read.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable, parts, shared_dir

#: What stands between words: all of ASCII but letters and digits.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class ResamplingConfig:
    """Hash buckets (at most 32,767), per cent of the documents that are drawn, words that a document needs for it, and the seed of the noise."""

    buckets: int = 10_000
    percent: int = 25
    least_words: int = 20
    seed: int = 7


def _lower(word: Column) -> Column:
    """A-Z lower-cased and nothing else; words of ASCII alone, which are most, take the short way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def _bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("short")


def with_buckets(texts: DataFrame, config: ResamplingConfig = ResamplingConfig(), text: str = "text") -> DataFrame:
    """Column ``__buckets`` (a bucket for each feature, words first) and ``__words`` (their number) beside the columns of ``texts``.

    The words are a column of their own before lambdas see them, so a text is split once (at the gaps, which costs a
    quarter of matching the words), and a pair of words comes from zipping the words with themselves, so no lambda
    reaches outside its row.
    """
    split = texts.withColumn("__split", F.transform(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), GAP), ""), _lower))
    ones = F.transform("__split", lambda w: _bucket(w, config.buckets))
    twos = F.zip_with("__split", F.slice("__split", F.lit(2), F.size("__split") + 1), lambda a, b: _bucket(F.concat(a, F.lit(" "), b), config.buckets))
    return split.select(
        *texts.columns,
        F.concat(ones, F.slice(twos, F.lit(1), F.greatest(F.size("__split") - 1, F.lit(0)))).alias("__buckets"),
        F.size("__split").cast("long").alias("__words"),
    )


def _totals(featured: DataFrame) -> dict[int, int]:
    """Features of each bucket over all rows: partial counts leave a task, and at most one row a bucket reaches the driver."""
    return {r[0]: r[1] for r in featured.select(F.explode("__buckets").alias("b")).groupBy("b").count().collect()}


def gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """floor(1000 ln of the smoothed shares' ratio) for each bucket."""
    whole, wanted = sum(corpus.values()) + buckets, sum(target.values()) + buckets
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * whole / ((corpus.get(b, 0) + 1) * wanted))) for b in range(buckets)]


def _literal(values: list[int]) -> Column:
    """The values as one array literal: of a folded text, as thousands of literals would take the planner longer than the documents."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _noise(doc_id: Column, seed: int) -> Column:
    """floor of 1000 times a Gumbel number that the id fixes."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def scored(featured: DataFrame, gain: list[int], config: ResamplingConfig = ResamplingConfig(), doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_features, weight, score and __words of documents with their buckets, without a shuffle."""
    table = _literal(gain)
    total = F.aggregate("__buckets", F.lit(0).cast("long"), lambda s, b: s + F.element_at(table, b.cast("int") + 1))
    n = F.size("__buckets").cast("long")
    summed = featured.select(F.col(doc_id).cast("long").alias("doc_id"), n.alias("n_features"), total.alias("__sum"), "__words")
    weighed = summed.withColumn("weight", F.when(F.col("n_features") > 0, F.expr("(__sum - pmod(__sum, n_features)) div n_features")).otherwise(F.lit(0).cast("long")))
    return weighed.select("doc_id", "n_features", "weight", (F.col("weight") + _noise(F.col("doc_id"), config.seed)).alias("score"), "__words")


def _ranked(rows: DataFrame, drawn: int) -> DataFrame:
    """Column rank (1, 2, 3, ...; null beyond ``drawn``) by falling score and rising id, without a task that sees all rows.

    Rows are range-partitioned and sorted, each partition counts its own, and a partition's ranks begin after those of
    the partitions before it: one number a partition goes through the driver.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    sorted_rows = durable(rows.repartitionByRange(parts(rows.sparkSession), *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).cast("int")
    sizes = {r[0]: r[1] for r in sorted_rows.groupBy(part.alias("p")).count().collect()}
    before = list(accumulate((sizes.get(p, 0) for p in range(max(sizes, default=-1) + 1)), initial=0))
    rank = F.element_at(_literal(before), part + 1) + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    return sorted_rows.withColumn("rank", F.when(rank <= drawn, rank)).drop("__at")


def resample(docs: DataFrame, target: DataFrame, config: ResamplingConfig = ResamplingConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document.

    Drawn are the best ``percent`` of the documents with at least ``least_words`` words, ties to the smaller id.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/importance-{uuid.uuid4().hex}"
    with_buckets(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), config).drop("text").write.parquet(folder)
    featured = spark.read.parquet(folder)
    wanted = with_buckets(target.select(F.col(text).alias("text")), config)
    gain = gains(_totals(featured), _totals(wanted), config.buckets)
    marked = durable(scored(featured, gain, config))
    enough = marked.filter(F.col("__words") >= config.least_words).drop("__words")
    drawn = config.percent * enough.count() // 100
    rest = marked.filter(F.col("__words") < config.least_words).drop("__words").withColumn("rank", F.lit(None).cast("long"))
    return _ranked(enough, drawn).unionByName(rest)


def drawn_documents(docs: DataFrame, target: DataFrame, config: ResamplingConfig = ResamplingConfig(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`resample` draws, whole; of rows that repeat an id all stay if one is drawn."""
    chosen = resample(docs, target, config, doc_id, text).filter("rank IS NOT NULL").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(chosen, docs[doc_id].cast("long").eqNullSafe(F.col("__drawn")), "left_semi")

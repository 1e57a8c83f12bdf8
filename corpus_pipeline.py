"""A training corpus from raw documents: five stages, each over all that the one before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.durable import shared_dir, table
from tidemark.llm.exact_dedup import drop_exact_copies
from tidemark.llm.near_dedup import drop_near_copies
from tidemark.llm.packing import pack
from tidemark.llm.suffix_dedup import drop_repeated_bytes
from tidemark.llm.toxicity import drop_toxic

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: A passage that repeats goes if it has so many words, or as many bytes as op8 removes.
PASSAGE_WORDS = 50


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go. Null texts count as empty, repeated rows fare alike, and other columns pass through."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null: empty) one row stays, that of the largest doc_id; rows without an id give way to those with one."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays; texts without words are in a class with their exact copies only."""
    return drop_near_copies(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 whole words, or of 400 bytes, that start at two places go from the texts; n_chars, if there, follows.

    Each match is judged for itself: shorter ones stay, also side by side, and words of one letter count like others. Documents that lose all their text stay, as empty ones; null texts stay null.
    """
    out = drop_repeated_bytes(docs, words=PASSAGE_WORDS)
    kinds = dict(docs.dtypes)
    return out.withColumn("n_chars", F.char_length("text").cast(kinds["n_chars"])) if "n_chars" in kinds else out


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences; a null or empty text is one piece of one id."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

#: Neither the classifier nor the near-duplicate classes can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

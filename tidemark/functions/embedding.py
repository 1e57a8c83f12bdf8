"""Embedding and summarising hooks with deterministic defaults."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship


class Embedder(Protocol):
    """Vectors of length 1 for texts."""

    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Summariser(Protocol):
    """key, title and bullets for each key of a table of texts."""

    def summarise(self, texts: DataFrame, key: str) -> DataFrame: ...


class HashingEmbedder:
    """Words hashed to signed places: needs no model, and equal texts have equal vectors.

    A text whose words cancel, or that has white space other than spaces alone, gets the place of the whole text; an
    empty one, or one of spaces, has no direction and stays 0.
    """

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % self.dimension] += 1 if h & 0x80000000 else -1
            if text.strip(" ") and not row.any():
                row[zlib.crc32(text.lower().encode()) % self.dimension] = 1
        sizes = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, sizes, out=out, where=sizes > 0)


def embed(text: Column, embedder: Embedder | None = None) -> Column:
    """The vector of a text, null for blank texts; batches go to the embedder as a whole."""
    chosen = embedder or HashingEmbedder()
    ship(SparkSession.active())

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(chosen.embed(texts.tolist())))

    return F.when(F.trim(F.coalesce(text, F.lit(""))) != "", vectors(F.coalesce(text, F.lit(""))))


def index_missing(docs: DataFrame, indexed: DataFrame, id_col: str, text_col: str, embedder: Embedder | None = None) -> DataFrame:
    """id and embedding of documents that aren't indexed and aren't blank."""
    new = docs.filter(F.trim(F.coalesce(F.col(text_col), F.lit(""))) != "").join(indexed.select(id_col), id_col, "left_anti")
    return new.select(id_col, embed(F.col(text_col), embedder).alias("embedding"))

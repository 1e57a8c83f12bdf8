"""Table functions for SQL: query variants, field matches of any table, and grips of ordered partitions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..shipping import ship
from .text import expand_query


class QueryVariants:
    """place and variant of a query: itself, in lower case, and without leading question words. A null query has none."""

    def eval(self, query: str) -> Iterator[tuple[int, str]]:
        if query is not None:
            yield from enumerate(expand_query(query))


def _words(text: str) -> list[str]:
    return [w for w in re.split(r"[^\w]+|_", text.lower()) if w]


@dataclass
class _Fields(AnalyzeResult):
    """The analysed call, with the names of its text fields."""

    texts: tuple[str, ...] = ()


class FieldMatches:
    """The rows of any table, once for each text field that holds a term, with field, value and the share of terms in it.

    All string columns and arrays of strings are fields, each element for itself; the other columns pass through.
    Nulls match nothing, and without terms there are no rows.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, terms: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("field_matches needs a table: TABLE(name)")
        kept = [f for f in rows.dataType.fields if not FieldMatches.is_text(f)]
        schema = StructType([*kept, StructField("field", StringType()), StructField("value", StringType()), StructField("score", DoubleType())])
        return _Fields(schema=schema, texts=tuple(f.name for f in rows.dataType.fields if FieldMatches.is_text(f)))

    @staticmethod
    def is_text(field: StructField) -> bool:
        kind = field.dataType
        return isinstance(kind, StringType) or (isinstance(kind, ArrayType) and isinstance(kind.elementType, StringType))

    def __init__(self, found: _Fields) -> None:
        self.texts = found.texts

    def eval(self, row: Row, terms: str) -> Iterator[tuple]:
        wanted = list(dict.fromkeys(_words(terms or "")))
        kept = [v for name, v in row.asDict().items() if name not in self.texts]
        for name in self.texts:
            for text in row[name] if isinstance(row[name], list) else [row[name]]:
                held = set(_words(text or ""))
                if n := sum(w in held for w in wanted):
                    yield (*kept, name, text, n / len(wanted))


class GripsOf:
    """session_id, bullet, first, last and score for each partition of rows (session_id, bullet, event_id, text) in order: the events that a bullet rests on.

    An event of 20 bytes or more counts if more than 0.3 of the bullet's long words are in it. The first such event begins the
    grip, and each better one, or one nearly as good as the best, ends it. State is one grip.
    """

    least, near, bytes_ = 0.3, 0.8, 20

    def __init__(self) -> None:
        self.session: str | None = None
        self.bullet: str | None = None
        self.first: str | None = None
        self.last: str | None = None
        self.best = 0.0

    @staticmethod
    def _long(text: str) -> list[str]:
        return [w for w in re.split(r"\s+", text.lower()) if len(w.encode()) > 3]

    def eval(self, row: Row) -> None:
        self.session, self.bullet = row["session_id"], row["bullet"]
        words, text = self._long(self.bullet or ""), row["text"]
        if text is None or len(text.encode()) < self.bytes_ or not words:
            return
        held = set(self._long(text))
        score = sum(w in held for w in words) / len(words)
        if score > self.least and score > self.best:
            self.first, self.last, self.best = self.first or row["event_id"], row["event_id"], score
        elif score > self.least and score >= self.near * self.best:
            self.last = row["event_id"]

    def terminate(self) -> Iterator[tuple[Any, ...]]:
        if self.first is not None:
            yield self.session, self.bullet, self.first, self.last, self.best


def register(spark: SparkSession) -> None:
    """Make ``query_variants``, ``field_matches`` and ``grips_of`` known to SQL of this session."""
    ship(spark)
    spark.udtf.register("query_variants", udtf(QueryVariants, returnType="place int, variant string"))
    spark.udtf.register("field_matches", udtf(FieldMatches))
    spark.udtf.register("grips_of", udtf(GripsOf, returnType="session_id string, bullet string, first string, last string, score double"))

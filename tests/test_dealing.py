"""Commits of tables whose rows lie in few tasks, as those of a file with one row group."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators.indexes import WordIndex, dealt
from tidemark.operators.indexing import rebuild
from tidemark.operators.lifecycle import ORDER

SMALL_TASKS = {"spark.sql.adaptive.coalescePartitions.minPartitionSize": "1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000"}


@pytest.fixture
def small_tasks(spark):
    """Sizes at which a small test's tasks are not put together."""
    for k, v in SMALL_TASKS.items():
        spark.conf.set(k, v)
    yield
    for k in SMALL_TASKS:
        spark.conf.unset(k)


@pytest.fixture
def table(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("of the"), *(F.concat(F.lit("w"), (F.col("id") * k % 97).cast("string")) for k in range(1, 20))).alias("text"), (F.col("id") % 3).cast("string").alias("lang"))
    path = str(tmp_path / "table")
    rows.coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_one_row_group_is_indexed_by_several_tasks(spark, tmp_path, small_tasks, table):
    """All of it was split, packed and sorted by one task."""
    one, even = (WordIndex(spark, str(tmp_path / n), buckets=2, fields=["text", "lang"]) for n in ("one", "even"))
    one.add(table)
    one.commit()
    assert one.live().select("pack").distinct().count() == 4
    even.add(table.repartition(4))
    even.commit()
    for asked in ("(text:w5 AND lang:2) w7", '"of the"', "w96"):
        assert one.search(asked).sort("doc_id").collect() == even.search(asked).sort("doc_id").collect()
    assert one.search('"of the"').count() == 2000


def test_rows_that_are_dealt_out_are_not_shuffled(spark):
    even, none = spark.range(100, numPartitions=4), spark.range(0)
    assert dealt(even, "id") is even
    assert dealt(none, "id") is none


class Kept:
    """An index that keeps what it gets, and fails on commits that hold a text."""

    def __init__(self, bad: str = "") -> None:
        self.held, self.bad = [], bad

    def clear(self) -> None:
        self.held = []

    def add(self, rows) -> None:
        self.held.append(rows.collect())

    def commit(self) -> int:
        if any(r.text == self.bad for r in self.held[-1]):
            raise ValueError(self.bad)
        return len(self.held)


@pytest.mark.parametrize("least", [None, "week"])
def test_a_rebuild_reads_documents_once(spark, tmp_path, small_tasks, least):
    """Each level read all documents; now it reads its own, which several tasks have laid apart. Nulls, an empty level and one that is unknown."""
    seen = spark.sparkContext.accumulator(0)
    rows = [(k, None if k % 7 == 0 else f"text {k}", ("segment", "grip", "week", "month", None, "other")[k % 6]) for k in range(600)]
    spark.createDataFrame(rows, "doc_id long, text string, level string").coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    once, plain, told = Kept(), Kept(), []
    plain_result = rebuild(docs, plain, least=least)
    lazy = docs.mapInPandas(counted, docs.schema)
    assert rebuild(lazy, once, lambda *x: told.append(x), least=least, folder=str(tmp_path / "index")) == plain_result
    assert [sorted(h) for h in map(lambda held: [(r.doc_id, r.text or "") for r in held], once.held)] == [sorted((r.doc_id, r.text or "") for r in held) for held in plain.held]
    assert [x[0] for x in told] == list(ORDER if least is None else ORDER[ORDER.index(least) :])
    assert seen.value <= 2 * len(rows)  # the count of rows in tasks, and the one pass
    assert list((tmp_path / "index").glob("rebuild-*")) == []


def test_a_rebuild_counts_a_level_that_fails(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a", "day"), (1, "bad", "week"), (2, "c", "year")], "doc_id long, text string, level string")
    assert rebuild(docs, Kept("bad"), folder=str(tmp_path / "y")) == (2, 1)
    assert len(list((tmp_path / "y").glob("rebuild-*"))) == 1  # an index may still have the level's rows pending
    broken = docs.withColumn("text", F.when(F.col("level") == "week", F.raise_error(F.lit("unreadable"))).otherwise(F.col("text")))
    assert rebuild(broken, Kept(), folder=str(tmp_path / "x")) == (2, 1)
    with pytest.raises(Exception, match="unreadable"):
        rebuild(broken, Kept(), continue_on_error=False, folder=str(tmp_path / "x"))
    assert list((tmp_path / "x").glob("rebuild-*")) == []

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import toc
from tidemark.operators.indexes import WordIndex
from tidemark.operators.journal import Conflict, Journal
from tidemark.plans import jobs


def _at(text: str):
    return F.lit(text).cast("timestamp")


@pytest.fixture
def segments(spark):
    rows = [(f"s{d}-{k}", dt.datetime(2024, 1, d, 5 + k), [f"bullet {d}-{k}"], [f"word{d}"]) for d in range(1, 16) for k in range(2)]
    return spark.createDataFrame(rows, "node_id string, start_time timestamp, bullets array<string>, keywords array<string>")


def _days(spark, folder, j):
    found = jobs.rolled_up(spark, folder, "day", j)
    return [] if found is None else sorted(r.node_id for r in found.collect())


def test_roll_up_takes_each_closed_period_once(spark, segments, tmp_path):
    folder, j = str(tmp_path), Journal(spark, f"{tmp_path}/journal")
    assert jobs.rolled_up(spark, folder, "day", j) is None
    assert jobs.roll_up(segments, folder, "day", _at("2024-01-01 12:00:00"), j) == 0
    assert jobs.roll_up(segments, folder, "day", _at("2024-01-04 02:00:00"), j) == 3
    assert jobs.roll_up(segments, folder, "day", _at("2024-01-04 02:00:00"), j) == 0
    assert jobs.roll_up(segments, folder, "day", _at("2024-01-20 02:00:00"), j) == 12
    assert _days(spark, folder, j) == [f"toc:day:2024-01-{d:02}" for d in range(1, 16)]
    days = jobs.rolled_up(spark, folder, "day", j)
    assert jobs.roll_up(days, folder, "week", _at("2024-01-16 02:00:00"), j) == 2
    assert {r.title for r in jobs.rolled_up(spark, folder, "week", j).collect()} == {"Summary of 7 child summaries"}


def test_a_run_that_dies_before_its_checkpoint_is_not_read_and_is_repeated(spark, segments, tmp_path, monkeypatch):
    folder, j = str(tmp_path), Journal(spark, f"{tmp_path}/journal")
    jobs.roll_up(segments, folder, "day", _at("2024-01-04 02:00:00"), j)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Journal, "put", dies)
        with pytest.raises(RuntimeError, match="lost"):
            jobs.roll_up(segments, folder, "day", _at("2024-01-06 02:00:00"), j)
    assert len(_days(spark, folder, j)) == 3
    assert jobs.roll_up(segments, folder, "day", _at("2024-01-06 02:00:00"), j) == 2
    assert len(_days(spark, folder, j)) == 5


def test_of_two_runs_at_once_one_conflicts(spark, segments, tmp_path, monkeypatch):
    folder, j = str(tmp_path), Journal(spark, f"{tmp_path}/journal")
    plain = toc.rollup

    def overtaken(*given):
        monkeypatch.setattr(toc, "rollup", plain)
        jobs.roll_up(segments, folder, "day", _at("2024-01-04 02:00:00"), j)
        return plain(*given)

    monkeypatch.setattr(toc, "rollup", overtaken)
    with pytest.raises(Conflict):
        jobs.roll_up(segments, folder, "day", _at("2024-01-06 02:00:00"), j)
    assert len(_days(spark, folder, j)) == 3


def test_prune_takes_what_its_level_no_longer_keeps(spark, tmp_path):
    old, new = dt.datetime(2020, 1, 1), dt.datetime(2024, 1, 31)
    rows = [(1, "one", "segment", old), (2, "one", "segment", new), (3, "one", "year", old), (4, "one", "day", None), (5, "one", "grip", old), (6, "gone", "grip", old)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, level string, ts timestamp")
    index = WordIndex(spark, str(tmp_path / "words"), buckets=2)
    index.add(docs.filter("doc_id < 6").select("doc_id", "text"))
    index.commit()
    assert jobs.prune(index, docs, _at("2024-02-01")) == {"segment": 1, "grip": 1}
    assert jobs.prune(index, docs, _at("2024-02-01")) == {}
    assert sorted(r.doc_id for r in WordIndex(spark, str(tmp_path / "words"), buckets=2).search("one").collect()) == [2, 3, 4]

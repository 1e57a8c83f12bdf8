from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import between_ends, split_words, words
from tidemark.operators import packs, search
from tidemark.operators.indexes import WordIndex
from tidemark.operators.journal import Journal


def test_numbers_of_any_size_come_back():
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 2**31, 2**40, 5, 0], dtype=np.int64)
    data, begins = packs._varints(values)
    again, at = packs._numbers(data)
    assert again.tolist() == values.tolist() and at.tolist() == begins[:-1].tolist() and begins[-1] == len(data)
    assert len(packs._numbers(np.empty(0, dtype=np.uint8))[0]) == 0


@pytest.mark.parametrize("seed", range(4))
def test_packs_travel_and_lose_the_dead(seed):
    """Coded and plain again, as a whole and as a slice; without some documents; documents with null and empty fields."""
    rng = np.random.default_rng(seed)
    texts = [[None if rng.random() < 0.2 else [f"w{x}" for x in rng.integers(0, 9, rng.integers(0, 300))] for _ in range(2)] for _ in range(40)]
    texts += [[["w1"], None], [None, None]]
    rows = pa.record_batch([pa.array(range(len(texts)), pa.int64()), *(pa.array([t[k] for t in texts], pa.list_(pa.string())) for k in range(2))], names=["id", "w0", "w1"])
    plain = packs._of_words(rows, 3)
    coded = packs._coded(plain, 7)
    again = packs._plain(*coded.columns[1:])
    assert again.equals(plain) and set(coded.column(0).to_pylist()) == {7}
    assert packs._plain(*coded.slice(2, 5).columns[1:]).to_pylist() == plain.slice(2, 5).to_pylist()
    kept = packs._of_words(rows.filter(pa.array([k % 3 != 0 for k in range(len(texts))])), 3)
    assert packs._without(plain, pa.array(range(0, len(texts), 3))).to_pylist() == kept.to_pylist()
    assert len(packs._without(plain, rows.column(0))) == 0


def test_words_without_a_pass_over_them(spark):
    rows = spark.createDataFrame([("",), ("--",), ("a",), (" a, B ",), ("a-b",), ("-a",), ("a-",), (None,)], "t string")
    for whole, quick in rows.select(words(F.col("t")), between_ends(split_words(F.col("t")))).collect():
        assert (whole if quick is not None else []) == (quick or [])


def test_a_commit_writes_words_once_and_a_merge_moves_packs(spark, tmp_path, monkeypatch):
    """No words are staged beside the postings, and no posting travels alone where documents are deleted."""
    held = []
    monkeypatch.setattr(Journal, "delete", lambda self, name: held.append(name))
    docs = spark.createDataFrame([(k, None if k % 5 == 4 else f"a b{k % 3} {'c ' * k}") for k in range(30)], "doc_id long, text string")
    index = WordIndex(spark, str(tmp_path / "w"), buckets=2, fanout=9)
    index.add(docs)
    index.commit()
    index.remove(docs.filter("doc_id % 4 = 1"))
    index.commit()
    assert not (tmp_path / "w" / "staged").exists()
    names = [s["name"] for s in index.manifest["segments"]]
    plan = index._remake(index._buckets(None, names), names)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "CoGroup" in plan
    index.compact()
    now = docs.filter("doc_id % 4 <> 1 AND text IS NOT NULL")
    assert index.size == now.count()
    for asked in ("a c", "b1"):
        assert index.search(asked).orderBy("doc_id").collect() == search.bm25(now, asked).orderBy("doc_id").collect()


def test_an_index_of_nothing(spark, tmp_path):
    index = WordIndex(spark, str(tmp_path / "w"), buckets=2)
    index.add(spark.createDataFrame([], "doc_id long, text string"))
    index.commit()
    assert index.size == 0 and index.search("a").count() == 0
    index.add(spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string"))
    index.commit()
    assert index.size == 1 and [r.doc_id for r in index.live().collect()] == [1]

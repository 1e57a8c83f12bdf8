from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions.text import spaced_words, words
from tidemark.operators import packs
from tidemark.operators.indexes import WordIndex

TEXTS = ["", " ", "--", "a", " a, B ", "a-b", "-a", "a-", None, "Straße ΟΔΟΣ, İ!", "x" * 300, "日本 ٣٤", "\x00a\x00b\U0001f600c", "a"]


def test_words_of_spaced_texts_are_those_of_the_scan(spark):
    """Texts side by side with spaces at their ends or none, as a whole and as a slice; null stays null and is not empty."""
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select(words(F.col("t")).alias("w"), spaced_words(F.col("t")).alias("s"), F.col("t").isNull().alias("n")).collect()
    want = [None if r.n else r.w for r in rows]
    spaced = pa.array([r.s for r in rows], pa.string())
    assert packs._words(spaced).to_pylist() == want
    assert packs._words(spaced.slice(3, 7)).to_pylist() == want[3:10]
    assert packs._words(pa.array(["", None], pa.string())).to_pylist() == [[], None]


@pytest.mark.parametrize("most", [1, 5, 70_000, 2**31 - 1])
def test_order_of_keys_is_stable(most):
    keys = np.random.default_rng(most).integers(0, most, 5000).astype(np.int32)
    assert packs._order(keys).tolist() == np.argsort(keys, kind="stable").tolist()


def test_a_commit_sends_a_text_as_one_string(spark, tmp_path, monkeypatch):
    """Words were sent to Python one by one, in an array for each text."""
    sent, made = [], packs.of_words
    monkeypatch.setattr(packs, "of_words", lambda rows, buckets: sent.append(dict(rows.dtypes)) or made(rows, buckets))
    index = WordIndex(spark, str(tmp_path / "w"), buckets=2, fields=["a", "b"])
    index.add(spark.createDataFrame([(k, t, "B, a") for k, t in enumerate(TEXTS)], "doc_id long, a string, b string"))
    index.commit()
    assert sent == [{"doc_id": "bigint", "w0": "string", "w1": "string"}]
    assert {r.doc_id for r in index.search("a:a").collect()} == {3, 4, 5, 6, 7, 12, 13}
    assert index.search('b:"b a"').count() == len(TEXTS)


@pytest.mark.parametrize("seed", range(3))
def test_packs_lose_the_dead_by_their_bytes(seed, monkeypatch):
    """Frequencies and positions of one and more bytes, slices, and dead that hit nothing, some or all; no number is written again."""
    rng = np.random.default_rng(seed)
    texts = [[f"w{x}" for x in rng.integers(0, 4 if k % 3 else 400, rng.integers(0, 1500))] for k in range(30)]
    ids = pa.array(range(100, 130), pa.int64())

    def made(keep):
        rows = pa.record_batch([pa.array([i for i in range(100, 130) if keep(i)], pa.int64()), pa.array([texts[i - 100] for i in range(100, 130) if keep(i)], pa.list_(pa.string()))], names=["id", "w0"])
        return packs._coded(packs._of_words(rows, 3), 7)

    whole, some = made(lambda i: True), made(lambda i: i % 4)
    monkeypatch.setattr(packs, "_varints", None)
    dead = ids.filter(pa.array([i % 4 == 0 for i in range(100, 130)]))
    assert packs._left(whole, dead).to_pylist() == some.to_pylist()
    assert packs._left(whole.slice(5, 40), dead).to_pylist() == [r for r in some.to_pylist() if r["term"] in set(whole.column(2).slice(5, 40).to_pylist())]
    assert packs._left(whole, pa.array([1, 2])).to_pylist() == whole.to_pylist()
    assert len(packs._left(whole, ids)) == 0

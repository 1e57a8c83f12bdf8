from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import similarity, topics

KINDS = "k int, id int, ts int, v array<double>"


def _vectors(n: int, spread: float, seed: int) -> list[tuple]:
    """Unit vectors about twelve centres, some of them equal, over three keys; the last rows lack a part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    x = centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, 8))
    x[: n // 10] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(int(k % 3), k, int(rng.integers(0, n // 2)), x[k].tolist()) for k in range(n)]
    return [*rows, (None, n, 1, x[0].tolist()), (0, n + 1, 1, None), (0, n + 2, 1, [0.0] * 8)]


def _brute(rows: list[tuple], threshold: float, keyed: bool) -> dict[tuple[int, int], float]:
    good = [r for r in rows if r[3] is not None and (r[0] is not None or not keyed)]
    return {(a[1], b[1]): s for a in good for b in good if a[1] < b[1] and (not keyed or a[0] == b[0]) and (s := float(np.dot(a[3], b[3]))) >= threshold}


@pytest.mark.parametrize(("threshold", "keyed"), [(0.9, False), (0.9, True), (-0.5, True), (0.35, False)])
def test_pairs_equal_the_join_of_all(spark, threshold, keyed):
    rows = _vectors(300, 0.15, 1)
    found = similarity.pairs(spark.createDataFrame(rows, KINDS), threshold, "id", "v", "k" if keyed else None, block=16).collect()
    wanted = _brute(rows, threshold, keyed)
    assert len(found) == len(wanted)
    assert {(r.a, r.b): r.similarity for r in found} == pytest.approx(wanted)


def test_cells_leave_most_visits_out(spark):
    """Where vectors lie in tight clusters, a row visits few cells beside its own."""
    rows = spark.createDataFrame(_vectors(1200, 0.03, 2), KINDS).select(F.lit(0).alias("k"), "id", F.col("id").alias("o"), "v").filter("v IS NOT NULL")
    celled = similarity._celled(rows, 0.97, 16)
    assert celled.select("cell").distinct().count() > 5
    assert celled.count() < 5 * rows.count()


def test_newest_similar_equals_the_definition(spark):
    rows = _vectors(300, 0.15, 3)
    wanted = {}
    for (a, b), _ in _brute(rows, 0.9, True).items():
        for x, y in ((a, b), (b, a)):
            if rows[y][2] > rows[x][2]:
                wanted[x] = max(wanted.get(x, (-1, -1)), (rows[y][2], y))
    found = similarity.newest_similar(spark.createDataFrame(rows, KINDS), 0.9, "id", "v", "ts", "k", block=16).collect()
    assert {r.id: r.newer for r in found} == {x: y for x, (_, y) in wanted.items()}
    assert len(found) == len(wanted)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_newest_similar_orders_by_any_time(spark, kind):
    """Times beyond those of pandas (2262 on) and microseconds count, in the newest rows and in the rest."""
    rows = spark.createDataFrame([(k, [1.0, 0.0] if k % 2 else [0.0, 1.0]) for k in range(12)], "id int, v array<double>")
    for days, step in ((106_745, 86_400_000_000), (2_900_000, 86_400_000_000), (-200_000, 1), (0, 1)):
        timed = rows.withColumn("ts", F.timestamp_micros(F.col("id") * step + F.lit(days * 86_400_000_000)).cast(kind))
        found = similarity.newest_similar(timed, 0.9, "id", "v", "ts", block=4).collect()
        assert {r.id: r.newer for r in found} == {k: 10 + k % 2 for k in range(10)}


@pytest.mark.parametrize(("threshold", "keyed"), [(0.3, True), (0.9, True), (0.9, False), (0.9999, False)])
def test_newest_similar_beyond_the_newest_rows(spark, monkeypatch, threshold, keyed):
    """Most rows, some and few find theirs among the last ones of their key; the others meet the rest."""
    monkeypatch.setattr(similarity, "NEWEST", 10)
    rows = _vectors(300, 0.15, 5)
    wanted = {}
    for (a, b), _ in _brute(rows, threshold, keyed).items():
        for x, y in ((a, b), (b, a)):
            if rows[y][2] > rows[x][2]:
                wanted[x] = max(wanted.get(x, (-1, -1)), (rows[y][2], y))
    found = similarity.newest_similar(spark.createDataFrame(rows, KINDS), threshold, "id", "v", "ts", "k" if keyed else None, block=16).collect()
    assert {r.id: r.newer for r in found} == {x: y for x, (_, y) in wanted.items()}


def test_even_vectors_visit_no_cells(spark):
    """Where a threshold leaves most cells in reach, rows are not copied into them."""
    x = np.random.default_rng(6).normal(size=(600, 8))
    rows = spark.createDataFrame([(0, k, k, v.tolist()) for k, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))], "k int, id int, o int, v array<double>")
    assert similarity._celled(rows, 0.3, 4).count() == 600


def test_steps_of_blocks_find_what_one_product_finds(spark, monkeypatch):
    """Blocks of several steps, alone and with others."""
    import pandas as pd

    monkeypatch.setattr(similarity, "STEP", 7)
    v = [np.array(x) for x in np.random.default_rng(7).normal(size=(40, 4))]
    p = pd.DataFrame({"id": range(40), "v": v})
    pairs = lambda a, b, s, alone: pd.DataFrame([(i, j) for x, i in enumerate(a["id"]) for y, j in enumerate(b["id"]) if s[x, y] >= 0 and (x < y or not alone)], columns=["a", "b"])
    whole = np.stack(v) @ np.stack(v).T >= 0
    alone = similarity._by_steps(pairs, p, p, True)
    assert sorted(zip(alone.a, alone.b)) == [(i, j) for i in range(40) for j in range(i + 1, 40) if whole[i, j]]
    two = similarity._by_steps(pairs, p[:25], p[25:], False)
    assert sorted(zip(two.a, two.b)) == [(i, j) for i in range(25) for j in range(25, 40) if whole[i, j]]


def test_most_similar_earlier_equals_the_definition(spark):
    rows = _vectors(200, 0.3, 4)
    wanted = {}
    for (a, b), s in _brute(rows, -2.0, True).items():
        wanted[b] = max(wanted.get(b, -2.0), s)
    found = similarity.most_similar_earlier(spark.createDataFrame(rows, KINDS), "k", "id", "v", block=16).collect()
    assert {r.id: r.similarity for r in found} == pytest.approx(wanted)


def test_no_rows_have_no_pairs(spark):
    none = spark.createDataFrame([], KINDS)
    assert similarity.pairs(none, 0.9, "id", "v").count() == 0
    assert similarity.newest_similar(none, 0.9, "id", "v", "ts").count() == 0
    assert similarity.most_similar_earlier(none, "k", "id", "v").count() == 0


def _fold(rows: list[tuple], threshold: float) -> dict[int, int]:
    scores = {r[0]: r[2] for r in rows}
    gone: dict[int, int] = {}
    for a, b in sorted(_brute([(0, r[0], 0, r[1]) for r in rows], threshold, False)):
        if a not in gone and b not in gone:
            keep, drop = (a, b) if scores[a] >= scores[b] else (b, a)
            gone[drop] = keep
    return {t: gone.get(t, t) for t in scores}


@pytest.mark.parametrize("seed", [5, 6])
def test_merge_in_rounds_equals_the_fold_in_order(spark, seed):
    """Dense clusters with equal scores, so that winners of one pair lose the next."""
    rng = np.random.default_rng(seed)
    rows = [(r[1], r[3], float(rng.integers(0, 5))) for r in _vectors(80, 0.4, seed) if r[3] is not None]
    found = topics.merge_similar(spark.createDataFrame(rows, "topic_id int, embedding array<double>, importance_score double"), 0.6).collect()
    assert {r.topic_id: r.keeper for r in found} == _fold(rows, 0.6)


def test_merge_without_similar_topics_leaves_all(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 0.2), (2, [0.0, 1.0], None)], "topic_id int, embedding array<double>, importance_score double")
    assert {(r.topic_id, r.keeper) for r in topics.merge_similar(rows).collect()} == {(1, 1), (2, 2)}

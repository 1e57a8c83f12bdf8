from __future__ import annotations

import numpy as np
import pytest

from tidemark.functions.density import density_clusters
from tidemark.operators import search
from tidemark.operators.indexes import VectorIndex, WordIndex
from tidemark.operators.journal import Journal


def test_journal_keeps_the_newest_complete_record(spark, tmp_path):
    j = Journal(spark, str(tmp_path))
    assert j.get("x") is None
    j.put("x", {"n": 1})
    j.put("x", {"n": 2})
    (tmp_path / "x" / "9").mkdir()  # begun and never finished
    assert j.get("x") == {"n": 2}
    j.delete("x")
    assert j.get("x") is None


def test_word_index_follows_changes(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, None), (4, "")], "doc_id long, text string")
    index = WordIndex(spark, str(tmp_path / "w"), buckets=3, spread=1)
    assert index.search("b").count() == 0
    index.add(docs)
    assert index.commit() == 1
    assert index.commit() == 1  # nothing is pending
    index.add(spark.createDataFrame([(2, "d"), (5, "b")], docs.schema))
    index.remove(spark.createDataFrame([(1,), (77,)], "doc_id long"))
    index.commit()
    now = spark.createDataFrame([(2, "d"), (4, ""), (5, "b")], docs.schema)
    for asked in ("b", "c", "d B", "a zz", "", "  "):
        assert index.search(asked).orderBy("doc_id").collect() == search.bm25(now, asked).orderBy("doc_id").collect()
    index.compact()
    again = WordIndex(spark, str(tmp_path / "w"), buckets=3, spread=1)
    assert len(again.manifest["segments"]) == 1
    assert again.search("b d").orderBy("doc_id").collect() == search.bm25(now, "b d").orderBy("doc_id").collect()
    again.clear()
    assert again.search("b").count() == 0


def test_vector_index_leaves_out_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, 0.1])]
    index = VectorIndex(spark, str(tmp_path / "v"), cells=2)
    index.add(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    index.commit()
    assert [r.vec_id for r in index.search([1.0, 0.0], 9).collect()] == [1, 6, 2]
    assert [r.vec_id for r in index.get([2, 3]).collect()] == [2]
    assert [r.vec_id for r in index.search([1.0, 0.0], 1, probes=1).collect()] == [1]


def _plain_clusters(x: np.ndarray, least: int) -> set[frozenset[int]]:
    """The same by definition: components of the mutual reachability graph at every distance, as a tree, and its excess of mass."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None, :]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, least - 1]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    levels = sorted({v for v in reach[np.triu_indices(n, 1)]}, reverse=True)

    def parts(points: frozenset[int], below: float) -> list[frozenset[int]]:
        left, out = set(points), []
        while left:
            todo, seen = [left.pop()], set()
            while todo:
                k = todo.pop()
                seen.add(k)
                more = {j for j in left if reach[k, j] < below}
                left -= more
                todo += more
            out.append(frozenset(seen))
        return out

    def best(points: frozenset[int], born: float) -> tuple[float, set[frozenset[int]]]:
        mass, now = 0.0, points
        for level in levels:
            split = parts(now, level)
            if len(split) == 1:
                continue
            big = [p for p in split if len(p) >= least]
            if len(big) >= 2:
                mass += (1 / level - born) * len(now)
                below = [best(p, 1 / level) for p in big]
                total = sum(m for m, _ in below)
                return (mass, {points}) if mass >= total else (total, set().union(*(c for _, c in below)))
            gone = len(now) - (len(big[0]) if big else 0)
            mass += (1 / level - born) * gone
            if not big:
                return mass, {points}
            now = big[0]
        return mass, {points}

    whole = frozenset(range(n))
    now = whole
    for level in levels:
        big = [p for p in parts(now, level) if len(p) >= least]
        if len(big) >= 2:
            return set().union(*(best(p, 1 / level)[1] for p in big))
        if not big:
            return set()
        now = big[0]
    return set()


@pytest.mark.parametrize("seed", range(12))
def test_density_clusters_by_definition(seed):
    """The clusters, but for points at their rim: those that leave at the very distance at which a cluster begins are in it or not."""
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-10, 10, (rng.integers(2, 4), 2))
    x = np.concatenate([rng.normal(c, rng.uniform(0.2, 0.6), (rng.integers(4, 9), 2)) for c in centres] + [rng.uniform(-15, 15, (3, 2))])
    labels = density_clusters(x, 3)
    found = {frozenset(np.flatnonzero(labels == c).tolist()) for c in set(labels.tolist()) - {-1}}
    plain = _plain_clusters(x, 3)
    assert len(found) == len(plain)
    for p in plain:
        assert any((p <= f or f <= p) and len(p ^ f) <= 2 for f in found)


def test_density_clusters_of_few_or_equal_points():
    assert density_clusters(np.zeros((2, 2)), 3).tolist() == [-1, -1]
    assert density_clusters(np.zeros((6, 2)), 3).tolist() == [-1] * 6
    assert density_clusters(np.empty((0, 2)), 3).tolist() == []


def test_compaction_makes_cells_anew_and_tuning_finds_how_many_to_read(spark, tmp_path):
    """Cells follow the number of vectors; the tuned number gives the recall that brute force confirms for all vectors as queries."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 12))
    x = centres[rng.integers(0, 20, 500)] + 0.5 * rng.normal(size=(500, 12))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    index = VectorIndex(spark, str(tmp_path / "v"), cells=3)
    for part in ("vec_id < 250", "vec_id >= 250"):
        index.add(rows.filter(part))
        index.commit()
    index.remove(rows.filter("vec_id >= 490"))
    index.commit()
    assert len(index.centroids) == 3
    index.compact()
    assert len(index.centroids) == 22
    assert len(index.manifest["segments"]) == 1
    got = index.tune(k=10, recall=0.95, queries=490)
    assert got >= 0.95
    again = VectorIndex(spark, str(tmp_path / "v"))
    assert again.probes == index.probes < 22
    u = x[:490] / np.linalg.norm(x[:490], axis=1, keepdims=True)
    near = u @ u.T
    np.fill_diagonal(near, -2)
    best = np.argsort(-near, axis=1)[:, :10]
    cell = {r.vec_id: r.bucket for r in again._buckets(None).select("vec_id", "bucket").collect()}
    order = np.argsort(-(u @ again.centroids.T), axis=1)[:, : again.probes]
    recall = np.mean([cell[int(b)] in order[k] for k in range(490) for b in best[k]])
    assert recall == pytest.approx(got)
    query = x[5].tolist()
    assert again.search(query, 5, again.probes).first().vec_id == 5
    again.add(rows.filter("vec_id >= 490"))
    again.commit()
    assert again.search(x[495].tolist(), 1).first().vec_id == 495


def test_compacting_and_tuning_an_empty_index(spark, tmp_path):
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.compact()
    assert index.tune() == 1.0
    assert index.search([1.0], 3).count() == 0

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.near_vectors import Codes, LinkConfig, learn_codes, learn_rotation, vector_groups

VECTORS = "vec_id long, embedding array<double>"


def brute_force(rows, threshold=0.9):
    """{row number: (n_links, component_id)} over all pairs in double precision."""
    width = max((len(v) for i, v in rows if v), default=0)
    sound = [k for k, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    u = np.array([np.pad(np.array(rows[k][1], float), (0, width - len(rows[k][1]))) for k in sound])
    u = u / np.abs(u).max(axis=1, keepdims=True) if len(u) else u.reshape(0, 1)
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    on = u @ u.T >= threshold - 1e-13
    np.fill_diagonal(on, False)
    ids = np.array([rows[k][0] for k in sound])
    low = ids.copy()
    while True:
        after = np.array([min(low[k], *low[on[k]]) if on[k].any() else low[k] for k in range(len(low))])
        if (after == low).all():
            break
        low = after
    found = {k: (0, rows[k][0]) for k in range(len(rows))}
    return found | {k: (int(on[n].sum()), int(low[n])) for n, k in enumerate(sound)}


def check(spark, rows, **config):
    got = vector_groups(spark.createDataFrame(rows, VECTORS), LinkConfig(**config)).collect()
    want = [(rows[k][0], *v) for k, v in brute_force(rows).items()]
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def near(rng, centre, angle, n):
    """n vectors at about the angle (degrees) from the centre."""
    aside = rng.standard_normal((n, len(centre)))
    aside -= np.outer(aside @ centre, centre)
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    a = np.radians(angle)
    return np.cos(a) * centre + np.sin(a) * aside


def clusters(rng, dims=24):
    out = []
    for angle, n in ((3, 40), (8, 25), (14, 30), (18, 25), (22, 20)):
        centre = rng.standard_normal(dims)
        out += list(near(rng, centre / np.linalg.norm(centre), angle, n))
    return out + list(rng.standard_normal((150, dims)))


@pytest.mark.parametrize("block", [1024, 7])
def test_links_match_brute_force(spark, block):
    rng = np.random.default_rng(5)
    vectors = clusters(rng)
    ids = rng.permutation(len(vectors)) * 3
    rows = [(int(i), (v * s).tolist()) for i, v, s in zip(ids, vectors, rng.uniform(0.01, 100, len(vectors)))]
    rows += [(10_000 + k, rows[4][1]) for k in range(60)]
    check(spark, rows, block=block, recall=0.9999)


def test_unusable_vectors_and_repeated_rows(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0, -0.0]), (4, [1.0, None, 3.0, 4.0]), (5, [1.0, float("nan"), 3.0, 4.0]), (6, [float("inf"), 1.0, 1.0, 1.0]), (None, v), (None, None)]
    rows += [(7, v), (7, v), (8, [2.0, 4.0, 6.0, 8.0]), (9, [-1.0, -2.0, -3.0, -4.0]), (10, [1e-200, 2e-200, 3e-200, 4e-200]), (11, [1e300, 2e300, 3e300, 4e300])]
    rows += [(12, [0.0, 1.0]), (13, [-0.0, 1.0, 0.0, 0.0]), (14, [0.0, 1.0, 0.0, 0.0])]
    check(spark, rows)


def test_pair_exactly_at_the_threshold(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, float(np.sqrt(1 - 0.81))]), (3, [0.6, -0.8]), (4, [0.0, 1.0])]
    got = {r.vec_id: r.n_links for r in vector_groups(spark.createDataFrame(rows, VECTORS)).collect()}
    assert got[3] == got[4] == 0 and got[1] == got[2]
    assert {r.vec_id: r.n_links for r in vector_groups(spark.createDataFrame([(1, [3.0, 4.0]), (2, [4.0, 3.0])], VECTORS), LinkConfig(threshold=0.96)).collect()} == {1: 1, 2: 1}


def test_small_and_empty_tables_and_clashing_columns(spark):
    assert vector_groups(spark.createDataFrame([], VECTORS)).count() == 0
    check(spark, [(5, [1.0, 2.0])])
    check(spark, [(5, [1.0, 2.0]), (4, [1.0, 2.1])])
    check(spark, [(k, [1.0]) for k in range(5)] + [(k, [-2.0 * k]) for k in range(5, 9)])
    names = ("n_links", "component_id", "kept", "node", "vec", "copies", "bucket", "subs", "size", "__key", "label")
    frame = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0, 0.2])], VECTORS).withColumns({c: F.lit("x") for c in names})
    assert sorted(map(tuple, vector_groups(frame).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_pairs_at_the_threshold_are_found(spark):
    """Recall where it is hardest: hundreds of pairs a hair above the least cosine, in many dimensions."""
    rng = np.random.default_rng(9)
    base = rng.standard_normal((400, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(1000 + k, near(rng, v, np.degrees(np.arccos(0.9001)), 1)[0].tolist()) for k, v in enumerate(base)]
    got = {r.vec_id: r.n_links for r in vector_groups(spark.createDataFrame(rows, VECTORS)).collect()}
    assert set(got.values()) <= {0, 1}
    assert sum(got[k] for k in range(400)) >= 392


def test_codes_are_balanced_and_rotations_are_rotations():
    rng = np.random.default_rng(2)
    units = rng.standard_normal((800, 16)) * np.linspace(3, 0.2, 16)
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    v = units - units.mean(axis=0)
    turn = learn_rotation(v, 20, rng)
    assert np.allclose(turn @ turn.T, np.eye(16))
    loss = lambda r: np.square(np.where(v @ r > 0, 1, -1) * np.abs(v @ r).mean() - v @ r).sum()
    assert loss(turn) < loss(np.eye(16))
    codes = learn_codes(units, 800, LinkConfig())
    assert isinstance(codes, Codes) and codes.bits == 8
    assert np.abs((units @ codes.projection > codes.cuts).mean(axis=0) - 0.5).max() < 0.01

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import baskets
from tidemark.llm.baskets import BasketConfig, basket_rules

LINES = "sale_id long, item_id long, flag string"


def brute_force(lines, least=8, share=2000, confidence=10):
    """Rows of the query by definition: every frequent set by growth, closed if no frequent superset has its support."""
    held = defaultdict(set)
    for sale, item, flag in lines:
        if flag != "returned" and sale is not None and item is not None:
            held[item].add(sale)
    n = len(set().union(*held.values())) if held else 0
    good = lambda s: len(s) >= least and len(s) * share >= n
    level = {(i,): s for i, s in held.items() if good(s)}
    support = {}
    while level:
        support |= {k: len(s) for k, s in level.items()}
        level = {(*k, i): t for k, s in level.items() for i in held if i > k[-1] and good(t := s & held[i])}
    closed = {k: s for k, s in support.items() if not any(len(o) == len(k) + 1 and t == s and set(k) < set(o) for o, t in support.items())}
    out = []
    for k, s in closed.items():
        rules = [(c, support[rest], len(held[c])) for c in k if (rest := tuple(i for i in k if i != c))]
        rules = [(c, a, t) for c, a, t in rules if 100 * s >= confidence * a and s * n > a * t]
        digest = hashlib.sha256(";".join(f"{c}:{a}:{t}" for c, a, t in rules).encode()).hexdigest()
        out.append((",".join(map(str, k)), len(k), s, len(rules), min(((a, c) for c, a, _ in rules), default=(0, None))[1], digest))
    return sorted(out)


def found(spark, lines, **config):
    frame = spark.createDataFrame(lines, LINES)
    return sorted(map(tuple, basket_rules(frame, BasketConfig(**config)).collect()))


def shop():
    """Sales with chains of items bought together, an item in a third of the rows, a huge sale, repeats, nulls and returns."""
    rows = []
    for s in range(300):
        items = {s % 7, 10 + s % 5, 10 + s % 3} | ({20, 21, 22, 23} if s % 4 == 0 else set()) | ({20, 22, 30} if s % 9 == 0 else set()) | ({-5} if s % 3 else set())
        rows += [(s, i, "kept") for i in items] + [(s, 99, "returned")]
    rows += [(1000, i, None) for i in range(-40, 200)] * 2 + [(None, 20, "kept"), (7, None, "kept"), (None, None, None), (2000, 55, "returned")]
    rows += [(s, 99, "swapped") for s in range(0, 300, 2)] * 3
    return rows


@pytest.mark.parametrize("block_entries", [2_000_000, 60])
def test_matches_brute_force(spark, block_entries):
    rows = shop()
    assert found(spark, rows, block_entries=block_entries) == brute_force(rows)


def test_batches_of_one_prefix(spark, monkeypatch):
    """Products in batches, run by Spark in processes of their own: here the block itself."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    lists = sorted({tuple(sorted(rng.choice(12, rng.integers(1, 7), replace=False).tolist())) for _ in range(60)})
    counts = rng.integers(1, 5, len(lists))
    table = pa.table({"items": pa.array(lists, pa.list_(pa.int64())), "n": pa.array(counts)})
    sets = [(1,), (2, 3), (0, 4, 5), (77,), (1, 77), (3,)]
    asked = pa.table({"id": pa.array(range(len(sets))), "items": pa.array(sets, pa.list_(pa.int64()))})
    monkeypatch.setattr(baskets, "CELLS", 15)
    got = {(r["id"], r["item"]): r["n"] for r in baskets._extension_supports((0,), table, asked).to_pylist()}
    want = Counter()
    for basket, n in zip(lists, counts):
        for k, s in enumerate(sets):
            if set(s) <= set(basket):
                want.update({(k, i): int(n) for i in basket})
    assert got == dict(want)
    singles = {r["id"]: r["n"] for r in baskets._supports((0,), table, asked).to_pylist()}
    assert singles == {k: sum(int(n) for b, n in zip(lists, counts) if set(s) <= set(b)) for k, s in enumerate(sets)}


def test_item_in_every_basket_is_in_every_closed_set(spark):
    for z in (-1, 3, 50):
        rows = [(s, i, "kept") for s in range(40) for i in {z, s % 4, 10 + s % 2}]
        got = found(spark, rows)
        assert got == brute_force(rows)
        assert all(str(z) in r[0].split(",") for r in got)


def test_least_support_grows_with_baskets(spark):
    rows = [(s, i, "kept") for s in range(200) for i in (s % 10, 100 + s % 20)]
    assert found(spark, rows, share=10) == brute_force(rows, share=10)
    assert found(spark, rows, confidence=60) == brute_force(rows, confidence=60)


def test_long_sets(spark):
    """A set of many items has one closed set, and no subset of it is visited."""
    rows = [(s, i, "kept") for s in range(9) for i in range(25)] + [(s, 7, "kept") for s in range(100, 110)]
    got = found(spark, rows)
    assert [(r[1], r[2]) for r in got] == [(25, 9), (1, 19)]


def test_empty_table_and_clashing_columns(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "kept")]) == []
    assert found(spark, [(1, 1, "kept")]) == []
    names = ("basket", "item", "items", "n", "id", "block", "support", "rules", "closure", "core")
    frame = spark.createDataFrame(shop(), LINES).withColumns({c: F.lit("x") for c in names})
    assert sorted(map(tuple, basket_rules(frame).collect())) == brute_force(shop())


def test_frequent_items_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(baskets, "FEW_ITEMS", 3)
    assert found(spark, shop()) == brute_force(shop())

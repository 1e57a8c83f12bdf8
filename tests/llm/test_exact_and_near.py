from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import durable, near_dedup
from tidemark.llm.components import components, follow
from tidemark.llm.exact_dedup import drop_exact_copies, exact_groups
from tidemark.llm.near_dedup import NearConfig, near_groups

DOCS = "doc_id long, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_exact_groups_edge_cases(spark):
    rows = [(1, "Ab"), (5, "aB"), (2, None), (7, ""), (3, "É"), (4, "é"), (9, "x" * 200_000), (8, "X" * 200_000), (None, "q"), (None, "q"), (6, "r"), (None, "R"), (10, "s"), (10, "s")]
    found = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(frame(spark, rows)).collect()}
    assert found == {(1, 5, 2, False), (5, 5, 2, True), (2, 7, 2, False), (7, 7, 2, True), (3, 3, 1, True), (4, 4, 1, True), (8, 9, 2, False), (9, 9, 2, True), (None, None, 2, True), (6, 6, 2, True), (None, 6, 2, False), (10, 10, 2, True)}


def test_exact_digest_and_smallest_id(spark):
    r = exact_groups(frame(spark, [(2, "Aé"), (1, "aé")]), keep="min").filter("kept").first()
    assert (r.doc_id, r.text_sha256) == (1, hashlib.sha256("aé".encode()).hexdigest())


def test_exact_empty_table_and_clashing_columns(spark):
    none = frame(spark, []).withColumns({"keep_id": F.lit(1), "group_size": F.lit("x"), "__key": F.lit(0)})
    assert exact_groups(none).count() == 0
    rows = frame(spark, [(1, "a"), (2, "A")]).withColumns({"keep_id": F.lit(1), "kept": F.lit("x"), "n": F.lit(0)})
    assert [r.doc_id for r in exact_groups(rows).filter("kept").collect()] == [2]
    kept = drop_exact_copies(rows)
    assert kept.columns == rows.columns
    assert [r.doc_id for r in kept.collect()] == [2]


def test_hot_groups_take_the_broadcast_path(spark, monkeypatch):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    found = exact_groups(rows).groupBy("group_size").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("kept")).collect()
    assert {(r.group_size, r.n, r.kept) for r in found} == {(3000, 3000, 1), (1, 2000, 2000)}


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (9, 8), (8, 7), (7, 7), (2, 1)]
    found = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert found == {(k, 1) for k in range(1, 7)} | {(k, 7) for k in (7, 8, 9)}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_follow_reaches_the_end_of_a_chain(spark):
    steps = spark.createDataFrame([(k, k - 1) for k in range(1, 9)], "node int, root int")
    assert {r.root for r in follow(steps).collect()} == {0}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é.\n1X", max_size=40), min_size=1, max_size=6))
def test_shingles_are_those_of_the_words(texts):
    import re

    found = near_dedup.shingles(texts, 3)
    for t, v in zip(texts, found, strict=True):
        words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
        own = [tuple(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
        assert len(v) == len(own)
        assert len(set(v.tolist())) == len(set(own))
        assert (np.diff(v.astype(np.int64)) >= 0).all()


def test_samples_agree_as_often_as_sets_are_similar():
    known = near_dedup.Frequencies(1000, np.ones((2, 1 << 10), dtype=np.int64), 10)
    rng = np.random.default_rng(1)
    draws = near_dedup._draws(512)
    for share in (0.3, 0.6, 0.9):
        both = rng.integers(0, 1 << 32, 400, dtype=np.uint64).astype(np.uint32)
        n = int(400 * share)
        a, b = np.sort(both[: n + (400 - n) // 2]), np.sort(np.concatenate([both[:n], both[n + (400 - n) // 2 :]]))
        found = near_dedup.signatures([a, b], known, draws)
        assert (found[0] == found[1]).mean() == pytest.approx(near_dedup.weighted_jaccard(a, b, known), abs=0.07)


def test_samples_agree_on_long_texts_with_unequal_counts():
    known = near_dedup.Frequencies(1, np.ones((2, 1 << 10), dtype=np.int64), 10)
    rng = np.random.default_rng(2)
    draws = near_dedup._draws(512)
    for n, repeated, times in ((20_000, 10, 300), (100_000, 40, 600)):
        a = np.sort(rng.permutation(1 << 22)[:n].astype(np.uint32) * np.uint32(1021))
        more = np.arange(1, repeated + 1, dtype=np.uint32) * np.uint32(1021) + np.uint32(1)
        b = np.sort(np.concatenate([a, np.repeat(more, times)]))
        found = near_dedup.signatures([a, b], known, draws)
        assert (found[0] == found[1]).mean() == pytest.approx(near_dedup.weighted_jaccard(a, b, known), abs=0.07)


def brute_force(texts: dict[int, str], config: NearConfig) -> dict[int, int]:
    """Largest id of each document's class, by comparing all pairs that share a shingle."""
    different = sorted(set(texts.values()))
    vectors = near_dedup.shingles(different, config.words)
    rows = np.zeros((2, 1 << config.sketch_bits), dtype=np.int64)
    for v in vectors:
        for row, cells in zip(rows, near_dedup._sketch_cells(np.unique(v), config.sketch_bits), strict=True):
            np.add.at(row, cells, 1)
    known = near_dedup.Frequencies(sum(len(v) > 0 for v in vectors), rows, config.sketch_bits)
    places = defaultdict(list)
    for k, v in enumerate(vectors):
        for s in set(v.tolist()):
            places[s].append(k)
    pairs = {(a, b) for held in places.values() for a in held for b in held if a < b}
    root = list(range(len(different)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        if near_dedup.weighted_jaccard(vectors[a], vectors[b], known) >= config.threshold:
            root[find(a)] = find(b)
    at = {t: find(k) for k, t in enumerate(different)}
    top = defaultdict(int)
    for i, t in texts.items():
        top[at[t]] = max(top[at[t]], i)
    return {i: top[at[t]] for i, t in texts.items()}


def test_near_groups_match_brute_force(spark, sf):
    docs = durable.table(spark, sf, "documents")
    found = {r.doc_id: r.class_id for r in near_groups(docs).collect()}
    assert found == brute_force({r.doc_id: r.text for r in docs.collect()}, NearConfig())


def test_document_frequencies_are_exact_beyond_a_sketch(spark):
    """Rare shingles weigh the same however many different ones there are: here four times the cells of a sketch row."""
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, 4004))) for k in range(260)]
    rows += [(260, "same five words here now " + rows[0][1]), (261, "same five words here now " + rows[1][1]), (262, rows[2][1]), (263, "...")]
    docs = frame(spark, rows).select("text", F.unhex(F.md5("text")).alias("rid"))
    vectors = near_dedup._weighed_texts(docs, NearConfig()).collect()
    different = sorted({t for _, t in rows if t != "..."})
    assert {bytes(r.rid) for r in vectors} == {hashlib.md5(t.encode()).digest() for t in different}
    own = {hashlib.md5(t.encode()).digest(): v for t, v in zip(different, near_dedup.shingles(different, 5), strict=True)}
    df = dict(zip(*np.unique(np.concatenate([np.unique(v) for v in own.values()]), return_counts=True), strict=True))
    for r in vectors:
        shingle, count = np.unique(own[bytes(r.rid)], return_counts=True)
        expected = count * (1 + np.log((1 + len(different)) / (1 + np.array([df[x] for x in shingle]))))
        _, weights, whole = near_dedup.opened(bytes(r.vector))
        assert whole == pytest.approx(expected.sum())
        assert len(weights) < len(expected) or np.allclose(weights, expected)


def test_pairs_of_a_bucket_are_verified_whatever_their_signatures(spark):
    config = NearConfig()
    vector = near_dedup.packed(np.arange(1, 9, dtype=np.uint64) << np.uint64(24), np.ones(8))
    marks = np.arange(2 * config.samples, dtype=np.uint32).reshape(2, -1)
    marks[1, : config.band_samples] = marks[0, : config.band_samples]
    signed = spark.createDataFrame([(b"a", marks[0].tobytes()), (b"b", marks[1].tobytes())], "rid binary, signature binary")
    vectors = spark.createDataFrame([(b"a", vector), (b"b", vector)], "rid binary, vector binary")
    bands = spark.createDataFrame([(b"a", 0, 7), (b"b", 0, 7)], "rid binary, band int, key long")
    labels = spark.createDataFrame([], "rid binary, label binary")
    assert {frozenset(map(bytes, r)) for r in near_dedup._apart(signed, bands, labels, vectors, config).collect()} == {frozenset([b"a", b"b"])}


def test_large_groups_are_linked_through_blocks(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(90):
        words = list(base)
        for k in rng.choice(120, rng.integers(1, 9), replace=False):
            words[k] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    config = NearConfig(block=16)
    found = {r.doc_id: r.class_id for r in near_groups(frame(spark, rows), config).collect()}
    assert found == brute_force(dict(rows), config)


def test_copies_are_found_however_many_share_their_words(spark):
    """Two of 160 words replaced: by counts all are near copies of the base, by TF-IDF the shared shingles weigh little in so large a group."""
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in range(160)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):
        words = list(base)
        for k in rng.choice(160, 2, replace=False):
            words[k] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(f"y{i}_{k}" for k in range(160))) for i in range(60)]
    found = {r.doc_id: r.class_id for r in near_groups(frame(spark, rows)).collect()}
    assert {found[i] for i in range(120)} == {119}
    assert all(found[i] == i for i in range(200, 260))


def test_samples_of_counts_estimate_the_similarity_by_counts():
    rng = np.random.default_rng(7)
    draws = near_dedup._draws(512)
    for n in (3, 60, 400):
        words = rng.integers(0, 1 << 32, n).astype(np.uint32)
        both = [np.unique(rng.choice(words, n), return_counts=True) for _ in range(2)]
        begin = np.array([0, len(both[0][0])])
        found = near_dedup.count_samples(np.concatenate([x for x, _ in both]), np.concatenate([c for _, c in both]), begin, draws)
        a, b = ((x, c.astype(float), float(c.sum())) for x, c in both)
        assert (found[0] == found[1]).mean() == pytest.approx(near_dedup.similarity(a, b), abs=0.07)


def test_near_groups_edge_cases(spark):
    same = "one two three four five six seven eight nine ten"
    rows = [(1, same), (2, same.upper()), (3, same.replace(" ", ", ")), (4, None), (5, ""), (6, "..."), (7, "hi"), (8, "hi"), (9, "hi there"), (None, "zz"), (10, "a b c d e f g " * 30_000), (11, "a b c d e f g " * 30_000)]
    out = near_groups(frame(spark, rows).withColumn("rid", F.lit("clash"))).collect()
    found = {r.doc_id: (r.class_id, r.class_size) for r in out}
    assert [found[k] for k in (1, 2, 3)] == [(3, 3)] * 3
    assert found[4] == found[5] == (5, 2)
    assert found[6] == (6, 1)
    assert found[7] == found[8] == (8, 2)
    assert found[9] == (9, 1)
    assert found[None] == (None, 1)
    assert found[10] == found[11] == (11, 2)
    assert sum(r.kept for r in out) == 7
    assert near_groups(frame(spark, [])).count() == 0

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from oracle import connect, same

import __spark_entry__
from tidemark.llm.catalogue import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLE_SQL[name], connect(sf))


def test_queries_are_registered():
    found = __spark_entry__.queries()
    assert set(QUERIES) | {"pipeline"} <= set(found)
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}


def test_pipeline_matches_brute_force(spark, sf):
    """Every stage against plain Python over what the stage before it kept."""
    from collections import Counter, defaultdict

    import corpus_pipeline
    from test_exact_and_near import brute_force as near_classes
    from test_suffix import without_passages

    from tidemark.llm import toxicity
    from tidemark.llm.durable import durable, table
    from tidemark.llm.near_dedup import NearConfig
    from tidemark.llm.packing import WordEncoder, vocabulary_path

    docs = table(spark, sf, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]
    now, texts = docs, {r.doc_id: r.text for r in docs.collect()}

    model = toxicity.train(docs, table(spark, sf, "labels"))
    texts = {i: t for i, t in texts.items() if model.score(t) < 0.5}
    now = durable(stages["toxicity"](spark, now, sf))
    assert {r.doc_id: r.text for r in now.collect()} == texts

    groups = defaultdict(list)
    for i, t in texts.items():
        groups["".join(c.lower() if c.isascii() else c for c in t)].append(i)
    texts = {max(ids): texts[max(ids)] for ids in groups.values()}
    now = durable(stages["exact_dedup"](spark, now, sf))
    assert {r.doc_id: r.text for r in now.collect()} == texts

    classes = near_classes(texts, NearConfig())
    texts = {i: t for i, t in texts.items() if classes[i] == i}
    now = durable(stages["near_dedup"](spark, now, sf))
    assert {r.doc_id: r.text for r in now.collect()} == texts

    ids = list(texts)
    texts = dict(zip(ids, without_passages([texts[i].encode() for i in ids], 400, 50), strict=True))
    now = durable(stages["suffix_dedup"](spark, now, sf))
    assert now.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in now.collect()} == {i: (t, len(t)) for i, t in texts.items()}

    encoder = WordEncoder(vocabulary_path())
    lengths = Counter()
    places = defaultdict(list)
    for r in stages["packing"](spark, now, sf).collect():
        lengths[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert lengths == {i: len(encoder._fresh([t])[0]) // 4 + 1 for i, t in texts.items()}
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))]
        assert sum(n for _, n in held) <= 2048


def test_stages_bear_nulls_repeats_clashing_columns_and_empty_tables(spark, sf):
    """Each stage over rows without ids or texts, ids that repeat with other texts, repeated rows and odd columns."""
    import random

    import corpus_pipeline

    rng = random.Random(1)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghijklm", k=rng.randrange(2, 9))) for _ in range(n))
    one, two, three, passage = prose(80), prose(80), prose(80), prose(60)
    near = one + " extra"
    rows = [(1, one), (2, one), (2, two), (None, one), (None, three), (None, three), (3, None), (None, None), (4, ""), (5, near), (5, near), (6, prose(20) + " " + passage), (7, prose(20) + " " + passage), (8, "x" * 300_000)]
    docs = spark.createDataFrame([(i, t, k, "n", "v") for k, (i, t) in enumerate(rows)], "doc_id long, text string, uid int, rid string, key string")
    stages = dict(corpus_pipeline.STAGES)
    exact = {(r.doc_id, r.text or "") for r in stages["exact_dedup"](spark, docs, sf).collect()}
    assert exact == {(2, one), (2, two), (None, three), (4, ""), (5, near), *((i, t) for i, t in rows[11:])}
    kept = stages["near_dedup"](spark, docs, sf).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(5, near), (2, two), (0, three), (4, ""), *rows[11:]])
    clean = stages["toxicity"](spark, docs, sf)
    assert clean.count() == len(rows) and clean.columns == docs.columns
    cut = {(r.doc_id, r.uid): r.text for r in stages["suffix_dedup"](spark, docs, sf).collect()}
    assert len(cut) == len(rows) and cut[3, 6] is None and cut[4, 8] == "" and cut[2, 2] == two
    assert all(passage not in cut[x] and len(cut[x]) > 50 for x in ((6, 11), (7, 12)))
    assert stages["packing"](spark, docs, sf).select("doc_id").distinct().count() == 9
    for stage in stages.values():
        assert stage(spark, docs.filter("false"), sf).count() == 0


def test_pipeline_query_gives_the_last_stage(spark, sf):
    found = __spark_entry__.queries()["pipeline"](spark, sf)
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert found.count() > 0

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm.importance import ResamplingConfig, drawn_documents, resample

_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOWER))
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def brute_force(docs, target, percent=25, least=20, seed=7):
    """Rows (doc_id, n_features, weight, score, rank) by definition, as a sorted list."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    made = [(i, *features(t)) for i, t in docs]
    s, t = Counter(bucket(f) for _, _, fs in made for f in fs), Counter(bucket(f) for x in target for f in features(x)[1])
    whole, wanted = s.total() + 10_000, t.total() + 10_000
    rows = []
    for i, n, fs in made:
        gain = [math.floor(1000 * math.log((t[b] + 1) * whole / ((s[b] + 1) * wanted))) for b in map(bucket, fs)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    best = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(best[: percent * len(best) // 100])}
    return sorted(((*r[:4], ranks.get(id(r))) for r in rows), key=repr)


def rows_of(found):
    return sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in found.collect()), key=repr)


def docs_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def target_frame(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "item_id long, text string")


def test_resample_matches_brute_force(spark):
    words = "Tide mark ÉCUME écume foam 42 x1 l'eau north-west STRASSE straße 𝒳 İ end".split()
    docs = [(i, " ".join(words[(i * k + k * k) % len(words)] for k in range(i % 37))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "\x00\x7f?!"), (503, "word"), (504, "a b " * 40_000), (None, "foam " * 25), (505, "foam\tfoam\x00foam" * 10), (506, "same " * 30), (507, "same " * 30)]
    target = ["Foam and tide mark", "ÉCUME 42", None, ""]
    config = ResamplingConfig()
    found = resample(docs_frame(spark, docs), target_frame(spark, target), config)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in found.dtypes} == {"bigint"}
    assert rows_of(found) == brute_force(docs, target)


def test_repeated_rows_share_noise_and_are_drawn_apart(spark):
    docs = [(1, "a b c " * 10)] * 4 + [(k, "d e f " * 10) for k in range(2, 9)]
    found = resample(docs_frame(spark, docs), target_frame(spark, ["a b c"]), ResamplingConfig(percent=50))
    assert sorted(r.rank for r in found.collect() if r.rank is not None) == list(range(1, 6))
    assert rows_of(found) == brute_force(docs, ["a b c"], percent=50)


def test_empty_tables_and_clashing_columns(spark):
    none = docs_frame(spark, [])
    assert resample(none, target_frame(spark, ["a"])).count() == 0
    docs = [(k, f"w{k} w{k + 1} " * 12) for k in range(8)]
    clashing = docs_frame(spark, docs).withColumns({c: F.lit("x") for c in ("score", "rank", "weight", "__buckets", "__words", "__split", "item_id")})
    assert rows_of(resample(clashing, target_frame(spark, []))) == brute_force(docs, [])
    kept = drawn_documents(clashing, target_frame(spark, ["w1 w2"]))
    best = {r[0] for r in brute_force(docs, ["w1 w2"]) if r[4]}
    assert {r.doc_id for r in kept.collect()} == best and kept.columns == clashing.columns


def test_drawing_prefers_the_target(spark):
    docs = [(k, ("sea foam tide shore " if k % 2 else "tax form rate bill ") * 20) for k in range(200)]
    found = resample(docs_frame(spark, docs), target_frame(spark, ["sea foam tide shore " * 5])).filter("rank IS NOT NULL").collect()
    assert len(found) == 50 and sum(r.doc_id % 2 for r in found) >= 38

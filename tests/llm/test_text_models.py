from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import packing, sentencepiece_fst, toxicity, url_filter
from tidemark.llm.durable import table

LETTERS = st.text(alphabet="abcdetheing  ▁\n\tör1.,'&🙂日İΣ\x1c\u0301", max_size=60)


@pytest.fixture(scope="module")
def fst():
    return sentencepiece_fst.Transducer(sentencepiece_fst.model_path())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_fst.model_path())


@settings(max_examples=300, deadline=None)
@given(LETTERS | st.text(max_size=30))
def test_transducer_is_the_library(text):
    fst_, library_ = _models()
    ids = np.frombuffer(fst_.encode(text), "<u4").tolist()
    assert ids == library_.encode(text)
    assert fst_.decode(fst_.encode(text)) == library_.decode(ids)


_cached = {}


def _models():
    if not _cached:
        import sentencepiece

        path = sentencepiece_fst.model_path()
        _cached.update(fst=sentencepiece_fst.Transducer(path), library=sentencepiece.SentencePieceProcessor(model_file=path))
    return _cached["fst"], _cached["library"]


def test_transducer_on_long_texts(fst, library):
    for text in ("a" * 5000, "the " * 5000, " " * 300 + "x", "日本" * 2000):
        assert np.frombuffer(fst.encode(text), "<u4").tolist() == library.encode(text)


def test_sentencepiece_table(spark):
    rows = spark.createDataFrame([(1, "Hello  wörld\n🙂"), (2, ""), (3, None), (1, "Hello  wörld\n🙂")], "doc_id int, text string").withColumn("n_tokens", F.lit("clash"))
    out = sentencepiece_fst.sentencepiece_table(rows).collect()
    assert sorted((r.doc_id, r.n_tokens > 0, r.round_trip) for r in out) == [(1, True, True), (1, True, True), (2, False, True), (3, False, True)]
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in out)
    assert sentencepiece_fst.sentencepiece_table(rows.filter("false")).count() == 0


@settings(max_examples=300, deadline=None)
@given(LETTERS | st.text(max_size=30))
def test_words_encode_like_whole_texts(text):
    encoder = _cached.setdefault("words", packing.WordEncoder(packing.vocabulary_path()))
    assert encoder.encode(text) == encoder._fresh([text])[0]


def test_word_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    encoder = packing.WordEncoder(packing.vocabulary_path())
    for k in range(30):
        text = " ".join(f"word{k}x{j}." for j in range(8)) + " the the. " + "long" * 40
        assert encoder.encode(text) == encoder._fresh([text])[0]
    assert len(encoder._known) <= 40


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=20))
def test_patterns_use_each_piece_once(histogram):
    used = {}
    for count, pattern in packing.shortest_pack_first(histogram, 64):
        assert count > 0
        assert sum(pattern) <= 64
        for length in pattern:
            used[length] = used.get(length, 0) + count
    assert used == histogram


def test_lengths_out_of_range_are_an_error():
    with pytest.raises(ValueError, match="lengths"):
        packing.shortest_pack_first({65: 1}, 64)


def check_packing(rows, texts, size):
    """Pieces make up their documents, sequences have no gap, and little is padding."""
    encoder = packing.WordEncoder(packing.vocabulary_path())
    whole = sorted(encoder._fresh([t or ""])[0] + b"\1\0\0\0" for t in texts)
    by_sequence, made = {}, 0
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        made += r.length
    assert made == sum(map(len, whole)) // 4
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return by_sequence


def test_packing_of_the_documents(spark, sf):
    docs = table(spark, sf, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.pack(docs).collect()
    sequences = check_packing(rows, texts.values(), 2048)
    assert sum(r.length for r in rows) > 0.97 * 2048 * len(sequences)
    encoder = packing.WordEncoder(packing.vocabulary_path())
    for r in rows:
        ids = encoder._fresh([texts[r.doc_id]])[0] + b"\1\0\0\0"
        assert r.doc_tokens == len(ids) // 4
        assert zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32


def test_packing_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "word " * 100), (4, "x" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").withColumns({"length": F.lit("clash"), "part": F.lit(0), "rank": F.lit(0)})
    check_packing(packing.pack(docs, size=16).collect(), [t for _, t in rows], 16)
    assert packing.pack(docs.filter("false")).count() == 0


def test_toxicity_learns_only_from_its_share(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    small = toxicity.ToxicityConfig(bits=14, rows_per_class=60)
    one, two = (toxicity.train(docs, x, small) for x in (labels, flipped))
    assert np.array_equal(one.weights, two.weights)
    assert one.intercept == two.intercept


def test_toxicity_finds_held_out_words(spark):
    rng = np.random.default_rng(3)
    clean = ["lorem", "ipsum", "dolor", "amet", "sed", "elit", "magna", "justo"]
    rows, marks = [], []
    for i in range(400):
        words = list(rng.choice(clean, 30))
        if i % 4 == 0:
            words[rng.integers(30)] = ["vileword", "grimslur"][i % 8 // 4]
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 4 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    found = {r.doc_id: r for r in toxicity.toxicity(docs, labels, toxicity.ToxicityConfig(bits=14)).collect()}
    held = [r for r in found.values() if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found.values())
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) >= 0.95


def test_toxicity_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "y" * 100_000), (3, "y")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, none).collect()
    assert len(out) == 5 and all(r.predicted == 0 and 0 <= r.score <= 1 for r in out)
    one_class = spark.createDataFrame([(1, 1), (2, 1), (2, None), (None, 1)], none.schema)
    assert all(r.predicted == 1 for r in toxicity.toxicity(docs, one_class).collect())
    assert toxicity.toxicity(docs.filter("false"), none).count() == 0
    assert toxicity.drop_toxic(docs, one_class).count() == 0


URLS = [
    ("http://A.com/x", "a.com", "/x", "com/", "allow"),
    ("http://www.example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://m.www.example.com/en/1", "m.www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://xwww.example.com/en/1", "xwww.example.com", "/en/1", "example.com/en/", "block"),
    ("http://example.com/en", "example.com", "/en", "com/", "allow"),
    ("http://a.net/es/?q", "a.net", "/es/", "net/es/", "block"),
    ("http://net/fr/x#y", "net", "/fr/x", "net/fr/", "block"),
    ("x://h.com?a://b/c", "h.com", "", None, None),
    ("no scheme", "", "", None, None),
    (None, "", "", None, None),
    ("http://cheap-pills.example.org/en/3", "cheap-pills.example.org", "/en/3", None, "block"),
    ("http://blog.erinth.example.org/en/3", "blog.erinth.example.org", "/en/3", None, "allow"),
]


def test_url_rules(spark):
    rows = spark.createDataFrame([(k, u[0]) for k, u in enumerate(URLS)], "page_id long, url string").withColumn("host", F.lit("clash"))
    for r in url_filter.judge_urls(rows).collect():
        url, host, path, rule, verdict = URLS[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert verdict is None or r.verdict == verdict, url
        assert url is None or url_filter.split_url(url) == (host, path)
    assert url_filter.judge_urls(rows.filter("false")).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="abc:/?#.É", max_size=14), min_size=1, max_size=4))
def test_url_split_needs_no_scheme(parts):
    url = "://".join(parts)
    host, path = url_filter.split_url(url)
    assert not set(host) & set("/?#")
    assert not set(path) & set("?#")


def test_character_maps_normalise_like_the_library():
    """A compiled character map, white space and prefix against the library's own normaliser, for each of its built-in rules."""
    import random

    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    rng = random.Random(4)
    alphabet = [chr(c) for c in (*range(32, 127), *range(0xC0, 0x180), *range(0x1E00, 0x1E80), *range(0xFB00, 0xFB10), *range(0xFF01, 0xFF30), *range(0x3040, 0x3100))] + ["ﬁ", "①", "㍿", "ｶﾞ", "é", "é", " ", "　", "\t", "  ", "…", "½"]
    texts = ["", " ", "  a  b ", "\t\n", "ﬁ①㍿ ｶﾞ", *("".join(rng.choices(alphabet, k=rng.randrange(1, 40))) for _ in range(400))]
    for rule in ("nmt_nfkc", "nfkc", "nmt_nfkc_cf", "nfkc_cf"):
        for options in ({}, {"add_dummy_prefix": True, "escape_whitespaces": True, "remove_extra_whitespaces": True}):
            library = sentencepiece.SentencePieceNormalizer(rule_name=rule, **options)
            model = pb.ModelProto()
            model.ParseFromString(library.serialized_model_proto())
            mine = sentencepiece_fst.Normaliser(model.normalizer_spec)
            assert len(sentencepiece_fst.character_map(model.normalizer_spec.precompiled_charsmap)) > 3000
            assert [mine(t) for t in texts] == [library.normalize(t) for t in texts], (rule, options)


def test_shortest_path_of_a_unigram_model_is_the_least_sum(fst):
    """Best-first search against the least sum over all segmentations."""
    import copy
    import math
    import random

    rng = random.Random(2)
    machine = copy.copy(fst)
    machine.merges, machine.chars, machine.longest = False, frozenset("abc"), 4
    machine.scores = {"".join(rng.choices("abc", k=k)): -rng.uniform(0.1, 9) for k in (1, 2, 2, 3, 3, 3, 4, 4, 4, 4) for _ in range(3)}
    machine.ids = {p: k for k, p in enumerate(machine.scores)}
    machine._arcs, machine.fallback = frozenset(machine.ids), 10 - min(machine.scores.values())

    def least(text):
        best = [0.0] + [math.inf] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - 4), end):
                piece = text[start:end]
                weight = -machine.scores[piece] if piece in machine.ids else machine.fallback if len(piece) == 1 else math.inf
                best[end] = min(best[end], best[start] + weight)
        return best[-1]

    for _ in range(300):
        text = "".join(rng.choices("abcz", k=rng.randrange(1, 25)))
        path = machine.shortest_path(text)
        assert "".join(path) == text
        assert abs(sum(-machine.scores[p] if p in machine.ids else machine.fallback for p in path) - least(text)) < 1e-9

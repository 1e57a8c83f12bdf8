from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import suffix_dedup
from tidemark.llm.suffix_dedup import SuffixArray, drop_repeated_bytes, find_regions, repeated_bytes, repeated_starts


def runs(texts: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """Maximal runs of bytes that strings of ``length`` bytes with a second start cover."""
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, dtype=int)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k + 1 : k + length + 1] = 1
        edges = np.flatnonzero(np.diff(gone))
        out.append(list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)))
    return out


def brute_force(texts: list[bytes], length: int) -> list[tuple[int, int, int, str]]:
    out = []
    for t, long in zip(texts, runs(texts, length), strict=True):
        kept = b"".join(t[a:b] for a, b in zip([0, *(y for _, y in long)], [*(x for x, _ in long), len(t)], strict=True))
        out.append((len(t), sum(b - a for a, b in long), len(long), hashlib.sha256(kept).hexdigest()))
    return out


def without_passages(texts: list[bytes], length: int, words: int) -> list[str]:
    """Texts without the strings of ``length`` bytes or of ``words`` words that occur twice, each judged for itself."""
    spots = [[m.span() for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", t)] for t in texts]
    windows = [[(w[k][0], w[k + words - 1][1]) for k in range(len(w) - words + 1)] for w in spots]
    seen = Counter(t[a:b] for t, ws in zip(texts, windows, strict=True) for a, b in ws)
    out = []
    for t, ws, long in zip(texts, windows, runs(texts, length), strict=True):
        gone = np.zeros(len(t), dtype=bool)
        for a, b in [*long, *(w for w in ws if seen[t[w[0] : w[1]]] > 1)]:
            gone[a:b] = True
        out.append(np.frombuffer(t, np.uint8)[~gone].tobytes().decode("utf-8", "ignore"))
    return out


@settings(max_examples=80, deadline=None)
@given(st.binary(min_size=1, max_size=200) | st.text(alphabet="ab", min_size=1, max_size=200).map(str.encode))
def test_suffixes_are_in_order(data):
    order = SuffixArray(np.frombuffer(data + data[:40], np.uint8), 16).order.tolist()
    whole = data + data[:40]
    assert sorted(order) == list(range(len(whole)))
    keys = [(whole + b"\0" * 16)[k : k + 16] for k in order]
    assert keys == sorted(keys)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=8, max_size=60).map(str.encode), min_size=1, max_size=6))
def test_repeated_starts(regions):
    for size in (8, 11):
        fit = [r for r in regions if len(r) >= size] or [b"x" * size]
        seen = Counter(r[k : k + size] for r in fit for k in range(len(r) - size + 1))
        assert [x.tolist() for x in repeated_starts(fit, size)] == [[seen[r[k : k + size]] > 1 for k in range(len(r) - size + 1)] for r in fit]


def test_hashes_of_overlapping_strings_do_not_cancel_out():
    regions = [b"abbbabbaaaa", b"ababbbaabaa", b"abbbabbaaaa"]
    assert [x.tolist() for x in repeated_starts(regions, 11)] == [[True], [False], [True]]


def test_regions_cover_every_start_once_and_equal_strings_share_a_key():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"abc\xc3") for _ in range(rng.choice([0, 5, 63, 64, 65, 300]))) for _ in range(12)] + [b"x" * 9000, b"ab" * 700]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    text, first, starts, keys, _ = find_regions(np.frombuffer(b"".join(texts), np.uint8), offsets, 64)
    assert starts.max() <= suffix_dedup.REGION_STARTS
    covered = [[] for _ in texts]
    key_of = {}
    for t, f, n, k in zip(text.tolist(), first.tolist(), starts.tolist(), keys.tolist(), strict=True):
        covered[t] += range(f, f + n)
        for at in range(f, f + n):
            assert key_of.setdefault(texts[t][at : at + 64], k) == k
    assert covered == [list(range(max(0, len(t) - 63))) for t in texts]


@pytest.mark.parametrize("key_bytes", [1 << 21, 300, 0])
def test_repeated_bytes_match_brute_force(spark, monkeypatch, key_bytes):
    """With keys that are never split, split where long, and all split down to single strings."""
    monkeypatch.setattr(suffix_dedup, "KEY_BYTES", key_bytes)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(40, 90)))
    passages = [word() for _ in range(4)]
    texts = ["", "short", "z" * 500, "ab" * 100, "abcdefghijklmnopq" * 30, "q" + "abcdefghijklmnopq" * 9, "abcdefghijklmnopq" * 3 + "x"] + ["".join(rng.choice([word(), rng.choice(passages)]) for _ in range(6)) for _ in range(40)]
    texts += texts[5:9]
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000, None), (3, texts[20]), (20, texts[20]), (None, texts[21])]
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").withColumn("uid", F.lit(1)), 48).collect())
    expected = brute_force([(t or "").encode() for _, t in rows], 48)
    assert found == sorted((-1 if i is None else i, *e) for (i, _), e in zip(rows, expected, strict=True))


def test_a_passage_in_many_contexts_and_one_very_long_text(spark, monkeypatch):
    """A passage below the length makes its key hot; a text of megabytes repeats some of it, and a run of one byte repeats itself."""
    monkeypatch.setattr(suffix_dedup, "KEY_BYTES", 4000)
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choices("abcdefghij klmnop", k=n))
    passage = noise(70)
    texts = [noise(60) + passage + noise(60) for _ in range(150)] + [passage, texts_long := noise(300_000), "x" * 5000]
    texts.append(texts_long[100_000:100_200])
    rows = list(enumerate(texts))
    found = sorted(tuple(r) for r in repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 96).collect())
    expected = brute_force([t.encode() for t in texts], 96)
    assert found == [(i, *e) for (i, _), e in zip(rows, expected, strict=True)]


def test_passages_by_words_match_brute_force(spark):
    """Matches of so many words go whatever their bytes; bytes decide where there are no spaces; what touches isn't added up."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdefgh", k=n))
    say = lambda n, least, most: " ".join(word(rng.randrange(least, most)) for _ in range(n))
    many, few, solid, brief = say(51, 3, 7), say(20, 10, 14), word(450), say(60, 1, 4)
    fresh = lambda: say(30, 7, 8)
    texts = [f"{fresh()} {p} {fresh()}" for p in (many, few, solid, brief) for _ in range(2)]
    one, two = say(30, 8, 9), say(30, 8, 9)
    texts += [f"{fresh()} {one} {two} {fresh()}", f"{fresh()} {one} {fresh()}", f"{fresh()} {two} {fresh()}"]
    twice = say(55, 2, 9)
    texts += [f"{twice}\n\n{fresh()} {twice}", "é" + many + "\tü", "x" + many + "y", many.replace(" ", "  "), "", "  ", "a " * 700, say(400, 1, 9)]
    rows = list(enumerate(texts)) + [(90, texts[8]), (91, None)]
    kept = {r.doc_id: r.text for r in drop_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"), 400, 50).collect()}
    want = without_passages([(t or "").encode() for _, t in rows], 400, 50)
    assert kept == {i: None if t is None else w for (i, t), w in zip(rows, want, strict=True)}
    assert many not in kept[0] and brief not in kept[6] and kept[2] == texts[2] and kept[9] == texts[9] and kept[8] == ""


def test_touching_matches_stay_and_short_words_go(spark):
    """Two matches of 30 words side by side are no passage of 60; 60 words of 179 bytes are one."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choices("abcdefghijklm", k=n))
    say = lambda n, k: " ".join(word(k) for _ in range(n))
    one, two, brief = say(30, 8), say(30, 8), say(60, 2)
    texts = [f"{say(9, 9)} {one} {two} {say(9, 9)}", f"{one} {say(9, 9)}", f"{say(9, 9)} {two}", f"{say(9, 9)} {brief}", f"{brief} {say(9, 9)}"]
    kept = {r.doc_id: r.text for r in drop_repeated_bytes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 400, 50).collect()}
    assert [kept[k] for k in range(3)] == texts[:3]
    assert kept[3] == texts[3].removesuffix(brief) and kept[4] == texts[4].removeprefix(brief)


def test_columns_that_clash_with_names_of_the_operator(spark):
    rows = [(k, "ab" * 40, 1, "r", "u", k) for k in range(2)]
    out = drop_repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string, n int, raw string, uid string, found long"), 48)
    assert sorted(tuple(r) for r in out.collect()) == [(k, "", 1, "r", "u", k) for k in range(2)]


def test_false_hashes_are_found_out(monkeypatch):
    """Were all hashes equal, bytes would still tell strings apart."""
    data = np.frombuffer(b"abcdefgh" * 6 + b"abcdefgX" * 6, np.uint8)
    array = SuffixArray(data, 16)
    a, b = np.array([0, 8, 40, 3]), np.array([8, 16, 48, 60])
    assert array._equal_bytes(a, b).tolist() == [bytes(data[x : x + 16]) == bytes(data[y : y + 16]) for x, y in zip(a, b, strict=True)]


def test_empty_table_and_cut_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert repeated_bytes(none).count() == 0
    passage = "é" * 30
    rows = spark.createDataFrame([(1, "aa" + passage + "b", "x"), (2, passage, "y"), (3, None, "z"), (4, "clean", None)], none.schema)
    out = drop_repeated_bytes(rows, 41)
    assert out.columns == rows.columns
    assert {(r.doc_id, r.text) for r in out.collect()} == {(1, "aab"), (2, ""), (3, None), (4, "clean")}

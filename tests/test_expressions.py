from __future__ import annotations

import math
from datetime import UTC, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.config import Ranking, Topics, load_settings
from tidemark.functions import scoring, text, timekeys, vectors


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("size", "given_text", "cut"), [(5, "hello", "hello"), (5, "hello!", "hello"), (5, "ééé", "éé"), (3, "日本", "日"), (2, "日本", ""), (4, "a🙂b", "a"), (5, "a🙂b", "a🙂")])
def test_cut_bytes_ends_at_a_character(spark, size, given_text, cut):
    assert value(spark, text.cut_bytes(F.lit(given_text), size)) == cut


def test_ellipsis_and_word_cut(spark):
    assert value(spark, text.ellipsis(F.lit("abcdef"), 3)) == "abc..."
    assert value(spark, text.ellipsis(F.lit("abc"), 3)) == "abc"
    assert value(spark, text.cut_at_word(F.lit("one two three"), 9)) == "one two"
    assert value(spark, text.cut_at_word(F.lit("onetwothree"), 5)) == "onetw"


@pytest.mark.parametrize(("words", "kind"), [("X is defined as Y, you must know", "definition"), ("You must go", "constraint"), ("I prefer tea", "preference"), ("First, do it", "procedure"), ("a mustard", "observation"), ("", "observation")])
def test_first_kind_with_a_phrase_wins(spark, words, kind):
    assert value(spark, text.memory_kind(F.lit(words))) == kind


def test_term_overlap_is_null_without_hits(spark):
    assert value(spark, text.term_overlap(F.lit("Alpha beta"), ["alpha", "gamma"])) == 0.5
    assert value(spark, text.term_overlap(F.lit("delta"), ["alpha"])) is None
    assert value(spark, text.term_overlap(F.lit("delta"), [])) is None


def test_query_terms_count_bytes():
    assert text.query_terms("a is Été the") == ["été", "the"]


@pytest.mark.parametrize(("query", "variants"), [("What is X", ["What is X", "what is x", "is x"]), ("plain", ["plain"]), ("did we do we go", ["did we do we go", "go"])])
def test_expand_query(query, variants):
    assert text.expand_query(query) == variants


def test_json_extraction(spark):
    assert value(spark, text.extract_json(F.lit('say ```json\n{"a": 1}\n``` ok'))) == '{"a": 1}'
    assert value(spark, text.extract_json(F.lit('x {"a": 1} y'))) == '{"a": 1}'
    assert value(spark, text.extract_json(F.lit(" none "))) == "none"


def test_ids(spark):
    good = "grip:1706540400000:" + "A" * 26
    assert value(spark, text.grip_ms(F.lit(good))) == 1706540400000
    assert value(spark, text.grip_ms(F.lit("grip:x:y"))) is None
    assert value(spark, text.event_key_parts(F.lit("evt:0001:01AB")))["ms"] == 1
    assert value(spark, text.normalise_agent(F.lit("  Alpha "))) == "alpha"
    assert value(spark, text.normalise_agent(F.lit("  "))) is None


def test_ulid_time(spark):
    assert value(spark, timekeys.ulid_ms(F.lit("01ARZ3NDEKTSV4RRFFQ69G5FAV"))) == 1469922850259


@pytest.mark.parametrize(("day", "week", "month"), [("2024-12-30", "toc:week:2025-W01", "toc:month:2025-01"), ("2024-01-01", "toc:week:2024-W01", "toc:month:2024-01"), ("2021-01-03", "toc:week:2020-W53", "toc:month:2020-12")])
def test_weeks_belong_to_the_month_of_their_thursday(spark, day, week, month):
    ts = F.lit(day).cast("timestamp")
    assert value(spark, timekeys.node_id("week", ts)) == week
    assert value(spark, timekeys.parent_id("week", ts)) == month


def test_range_and_time_arguments():
    now = datetime(2024, 2, 1, tzinfo=UTC)
    assert (now - timekeys.parse_range("2w", now)[0]).days == 14
    assert (now - timekeys.parse_range("0d", now)[0]).days == 1
    assert (now - timekeys.parse_range("nonsense", now)[0]).days == 7
    assert timekeys.parse_time("0") == datetime(1970, 1, 1, tzinfo=UTC)
    assert timekeys.parse_time("2024-02-01") == now


@pytest.mark.parametrize(("query", "days"), [("what happened 3 days ago", 3.0), ("12 hours ago", 0.5), ("yesterday", 1.0), ("last week", 7.0), ("latest", 3.0), ("nothing", None)])
def test_lookback(spark, query, days):
    assert value(spark, timekeys.lookback_days(F.lit(query))) == days


def test_importance_at_its_edges(spark):
    for age, boost in ((0.0, 2.0), (1.0, 2.0), (4.0, 1.5), (7.0, 1.0), (30.0, 1.0)):
        expected = max(math.log1p(9) * max(2 ** (-age / 30), 0.01) * boost, 0.01)
        assert value(spark, scoring.importance(F.lit(9), F.lit(age), Topics())) == pytest.approx(expected)


def test_combined_rank_has_a_floor(spark):
    found = value(spark, scoring.combined_rank(F.lit(1.0), F.lit(0.0), F.lit(1000), Ranking(usage=True)))
    assert found == 0.5


def test_stale_decay_spares_exempt_kinds_and_missing_times(spark):
    assert value(spark, scoring.stale_decay(F.lit(1.0), F.lit(14.0), F.lit("Constraint"))) == 1.0
    assert value(spark, scoring.stale_decay(F.lit(1.0), F.lit(None).cast("double"), F.lit("observation"))) == 1.0
    assert value(spark, scoring.stale_decay(F.lit(1.0), F.lit(14.0), F.lit("observation"))) == pytest.approx(1 - 0.3 * (1 - math.exp(-1)))


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert value(spark, vectors.cosine(a, a)) == pytest.approx(1.0)
    assert value(spark, vectors.cosine(a, b)) == 0.0
    assert value(spark, vectors.normalise(a)) == pytest.approx([0.6, 0.8])
    assert value(spark, vectors.normalise(b)) == [0.0, 0.0]


def test_label_confidence(spark):
    for scores, expected in (([], 0.0), ([0.4], 0.4), ([3.0], 1.0), ([2.0, 2.0], 0.75)):
        assert value(spark, text.label_confidence(F.array(*map(F.lit, scores)).cast("array<double>"))) == expected


def test_settings_are_layered():
    found = load_settings({"topics": {"similarity": 0.5}}, {"rrf_k": 10}, environ={"TIDEMARK_TOPICS__SIMILARITY": "0.6"})
    assert (found.topics.similarity, found.rrf_k, found.dedup.threshold) == (0.6, 10, 0.85)
    with pytest.raises(ValueError, match="unknown"):
        load_settings({"nope": 1}, environ={})


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=40))
def test_expand_query_never_repeats_neighbours(query):
    found = text.expand_query(query)
    assert all(a != b for a, b in zip(found, found[1:], strict=False))

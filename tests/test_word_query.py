from __future__ import annotations

import math
import random

import pytest

from tidemark.functions.text import query_words
from tidemark.operators.indexes import WordIndex
from tidemark.operators.journal import Conflict, Journal
from tidemark.operators.wordquery import Boolean, Phrase, all_of, any_of, parsed, phrase

DOCS = "doc_id long, title string, text string"


def brute_force(docs, query, fields=("title", "text")):
    """{id: score} of the documents that fit, by definition."""
    held = {i: {f: query_words(t) for f, t in zip(fields, ts) if t is not None} for i, *ts in docs}
    held = {i: d for i, d in held.items() if d}
    n = len(held)
    words = lambda i, f: held[i].get(f, [])

    def tf(i, f, p):
        w = words(i, f)
        return sum(tuple(w[k : k + len(p)]) == p for k in range(len(w) - len(p) + 1)) if p else 0

    def fits(q, i):
        if isinstance(q, Phrase):
            return any(tf(i, f, q.words) for f in fields if q.field in (None, f))
        good = all(fits(x, i) for x in q.must) if q.must else any(fits(x, i) for x in q.should)
        return good and not any(fits(x, i) for x in q.without)

    def scoring(q):
        return [q] if isinstance(q, Phrase) else [p for x in (*q.must, *q.should) for p in scoring(x)]

    out = {}
    for i in held:
        if fits(query, i):
            score = 0.0
            for p in dict.fromkeys(scoring(query)):
                for f in fields if p.words else ():
                    if p.field in (None, f):
                        idf = sum(math.log(1 + (n - df + 0.5) / (df + 0.5)) for df in (sum(w in words(j, f) for j in held) for w in p.words))
                        k = tf(i, f, p.words)
                        mean = sum(len(words(j, f)) for j in held) / n or 1
                        score += idf * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * len(words(i, f)) / mean))
            out[i] = pytest.approx(score, abs=2e-9)
    return out


def corpus(n=60):
    rng = random.Random(6)
    words = "tide mark foam sea the of and north west é42".split()
    say = lambda k: " ".join(rng.choices(words, k=k))
    return [(i, say(rng.randrange(0, 4)), say(rng.randrange(0, 25)).replace("north west", "north-west")) for i in range(n)] + [(n, None, "tide mark"), (n + 1, None, None), (n + 2, "", "")]


QUERIES = [
    "tide", "north-west", "NORTH, west's", '"north west"', '"the of" foam', "+tide foam -sea", "tide AND mark", "tide AND mark OR foam", "tide OR mark AND foam", 'tide AND NOT "of the"', "NOT tide foam",
    "-tide", "NOT tide", "title:tide text:foam", 'title:"the of"', "title:(tide mark) AND sea", "(tide OR (mark AND foam)) AND (sea OR the)", "unknown:tide", '""', "", "( tide", "tide )foam", '"tide mark', "AND", "+-", "tide tide", '"the the"', "é42 zzz",
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    made = WordIndex(spark, str(tmp_path_factory.mktemp("words") / "w"), buckets=3, spread=1, fields=["title", "text"])
    made.add(spark.createDataFrame(corpus(), DOCS))
    made.commit()
    return made


@pytest.mark.parametrize("asked", QUERIES)
def test_search_matches_brute_force(index, asked):
    assert {r.doc_id: r.score for r in index.search(asked).collect()} == brute_force(corpus(), parsed(asked, ("title", "text")))


def test_trees_without_text(index):
    for q in (any_of(phrase("sea foam"), phrase("tide", "title")), all_of(phrase("the"), any_of(phrase("sea"), phrase("mark"))), Boolean(should=(phrase("sea"),), without=(phrase("tide mark"), phrase("of", "title"))), phrase("")):
        assert {r.doc_id: r.score for r in index.search(q).collect()} == brute_force(corpus(), q)
    with pytest.raises(ValueError, match="no such fields"):
        index.search(phrase("sea", "body"))


def test_parsed():
    w = lambda x: Phrase((x,))
    assert parsed("a b") == any_of(w("a"), w("b"))
    assert parsed("a AND b c") == any_of(w("c"), all_of(w("a"), w("b")))
    assert parsed('+a -"b c"') == Boolean(must=(w("a"),), without=(Phrase(("b", "c")),))
    assert parsed("x:a", ("x",)) == any_of(Phrase(("a",), "x"))
    assert parsed("a-b") == any_of(any_of(w("a"), w("b")))


def test_growth_by_commits_merges_and_deletes(spark, tmp_path):
    """After every commit a search equals one over what should be there; merges bound the segments, and old folders go."""
    index = WordIndex(spark, str(tmp_path / "w"), buckets=2, spread=1, fields=["title", "text"], fanout=3)
    docs = corpus(40)
    held: dict = {}
    rng = random.Random(1)
    for step in range(9):
        add = [(i, t, x) for i, t, x in docs if i % 9 == step] + ([(i, "tide", f"mark {step}") for i in rng.sample(range(40), 4)] if step % 3 == 1 else [])
        add = list({r[0]: r for r in add}.values())
        gone = [i for i in rng.sample(range(40), 3) if i not in {r[0] for r in add}] if step % 2 else []
        index.add(spark.createDataFrame(add, DOCS))
        if gone:
            index.remove(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        index.commit()
        held |= {r[0]: r for r in add}
        for i in gone:
            held.pop(i, None)
        assert index.size == sum(r[1] is not None or r[2] is not None for r in held.values())
        for asked in ("tide AND mark", '"tide mark" sea'):
            assert {r.doc_id: r.score for r in index.search(asked).collect()} == brute_force(list(held.values()), parsed(asked))
    assert len(index.manifest["segments"]) < 6
    index.compact()
    index.add(spark.createDataFrame([(999, "tide", "foam")], DOCS))
    index.commit()
    folders = {p.name.removeprefix("segment=") for p in (tmp_path / "w" / "postings").iterdir()}
    assert folders == {s["name"] for s in index.manifest["segments"]}
    assert not index.manifest["deletes"]


def test_a_commit_does_not_read_older_segments(spark, tmp_path):
    """New ids beyond all older ones: the older segments can be gone for all that the commit cares."""
    index = WordIndex(spark, str(tmp_path / "w"), buckets=2, spread=1)
    for k in range(3):
        index.add(spark.createDataFrame([(100 * k + i, f"tide w{i}") for i in range(50)], "doc_id long, text string"))
        index.commit()
        for p in (tmp_path / "w").glob("*/segment=*/**/*.parquet"):
            p.rename(p.with_suffix(".away"))
    assert index.size == 150 and len(index.manifest["segments"]) == 3


def test_two_writers(spark, tmp_path):
    one, two = (WordIndex(spark, str(tmp_path / "w"), buckets=2, spread=1) for _ in range(2))
    one.add(spark.createDataFrame([(1, "tide")], "doc_id long, text string"))
    two.add(spark.createDataFrame([(2, "tide")], "doc_id long, text string"))
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    two.reload()
    two.commit()
    assert sorted(r.doc_id for r in WordIndex(spark, str(tmp_path / "w"), buckets=2, spread=1).search("tide").collect()) == [1, 2]


def test_journal_versions(spark, tmp_path):
    j = Journal(spark, str(tmp_path / "j"))
    assert j.put("x", {"n": 1}) == 1 and j.put("x", {"n": 2}) == 2
    with pytest.raises(Conflict):
        j.put("x", {"n": 9}, version=2)
    (tmp_path / "j" / "x" / "3.json").write_text('{"n": ')  # a writer that died
    assert j.newest("x") == (3, {"n": 2}) and j.put("x", {"n": 4}) == 4 and j.get("x") == {"n": 4}

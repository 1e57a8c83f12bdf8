from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import html_layout, neighbours, warc
from tidemark.llm.durable import durable, table

LONG = "é" * 200


def test_warc_round_trip_with_small_chunks(spark, tmp_path):
    rows = [(1, "http://a/ b", LONG), (2, None, LONG), (3, "x", "s"), (4, "x", "s"), (5, "x", None), (6, "x", "a\r\n\r\nWARC/1.1\r\n" * 30), (None, "x", LONG), (7, "x", "q" * 100_000), (1, "y", LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    folder = f"file://{tmp_path}/warc"
    files = warc.write_archives(warc.chunked(warc.with_revisits(pages), 64), folder)
    back = durable(warc.read_archives(spark, files, folder, chunk_bytes=50))
    whole = back.filter("last")
    found = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in whole.collect())
    expected = sorted((i or 0, "revisit" if i == 2 else "response", 1 if i == 2 else None, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows)
    assert found == expected
    chunks = back.filter("page_id = 7").orderBy("chunk_no").collect()
    assert len(chunks) == 2000 and b"".join(r.data for r in chunks) == b"q" * 100_000
    assert chunks[0].payload_digest == hashlib.sha256(b"q" * 50).hexdigest()
    assert [r.url for r in back.filter("page_id = 1 AND last").orderBy("url").collect()] == ["http://a/%20b", "y"]


def test_warc_of_nothing(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_broken_archives_are_errors(spark, tmp_path):
    (tmp_path / "a.warc").write_bytes(warc.header(1, None, 10, "0" * 64, None) + b"12345")
    files = spark.createDataFrame([(f"{tmp_path}/a.warc",)], "path string")
    with pytest.raises(Exception, match="ends within a payload"):
        warc.read_archives(spark, files, f"file://{tmp_path}").collect()


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain  text\n here", "plain text here"),
        ("a<b && c < d", "a<b && c < d"),
        ("<p>one<p>two", "one\n\ntwo"),
        ("x<br>y<br><br>z", "x\ny\n\nz"),
        ("<div>a<div>b</div>c</div>", "a\nb\nc"),
        ("<title>t</title><script>if (a<b) '</p>'</script><style>p{}</style>ok", "ok"),
        ("<p hidden>a</p><p style='display: none'>b</p><p style='visibility:hidden'>c<b style='visibility:visible'>d</b></p>", "d"),
        ("<ul><li>a<li>b<ol start=9><li>c<li value=20>d</ol></ul>", "- a\n- b\n  9. c\n  20. d"),
        ("<dl><dt>t<dd>d</dl>", "t\n  d"),
        ("<pre>\n a\n  b</pre>", " a\n  b"),
        ("<table><tr><th>Name<th>N<tr><td>long name<td>1</table>", "Name       N\nlong name  1"),
        ("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>", "ab    c\n1  2  3"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table>lost<tr><td>a<td><table><tr><td>x<td>y</table></table>", "lost\n\na  x  y"),
        ("<p>a</div>b</p></p>c", "ab\n\nc"),
        ("&lt;b&gt; &amp;amp; &nbsp;x", "<b> &amp; \xa0x"),
        ("a<!-- b -->c<!DOCTYPE x><?pi?>d", "acd"),
        ('<a href="x>y">l</a> <a title=\'>\'>m</a>', "l m"),
        ("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("<table><caption>C<tr><td>1<tbody><tr><td>2</table>", "C\n1\n2"),
        ("a<textarea> x\n y</textarea>", "a x\n y"),
        ("<head><meta x></head><body>b", "b"),
        ("<plaintext>a<b>&amp;", "a<b>&amp;"),
    ],
)
def test_html_layout(source, text):
    assert html_layout.extract_text(source) == text


def test_html_layout_bears_depth_and_broken_quotes():
    assert html_layout.extract_text("<div>" * 50_000 + "x") == "x"
    assert html_layout.extract_text("<b><i>" * 20_000 + "x" + "</p>" * 100) == "x"
    assert html_layout.extract_text('<a "' * 20_000) is not None
    assert html_layout.extract_text("<a x='" + "y>" * 3).startswith("y>")
    wide = "<table>" + ("<tr><td>" + "w" * 1000 + "<td>1") * 50 + "</table>"
    assert len(html_layout.extract_text(wide)) < 60_000


def test_html_table(spark):
    rows = spark.createDataFrame([(1, "<p>é"), (1, "<p>é"), (None, None)], "page_id long, html string").withColumn("text", F.lit("clash"))
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_layout.html_text(rows).collect()) == [(0, "", 0), (1, "é", 1), (1, "é", 1)]
    assert html_layout.html_text(rows.filter("false")).count() == 0


def brute_force(ids, x, queries, k):
    order = np.argsort(ids)
    ids, x = ids[order], x[order]
    size = np.sqrt((x * x).sum(axis=1))
    out = {}
    for q in queries:
        at = int(np.searchsorted(ids, q))
        score = x @ x[at] / (size * size[at])
        score[at] = -9
        out[q] = ids[np.lexsort((ids, -score))[:k]].tolist()
    return out


def test_neighbours_recall(spark, sf):
    rows = table(spark, sf, "embeddings")
    held = rows.toPandas().sort_values("vec_id")
    ids, x = held.vec_id.to_numpy(), np.stack(held.embedding.to_numpy()).astype(np.float64)
    small = neighbours.GraphConfig(neighbours=8, reverse=8, block=64, beam=48, step=24, entries=32, part_nodes=100)
    found = {}
    for r in neighbours.nearest(rows, config=small).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r)
    expected = brute_force(ids, x, ids[ids % 50 == 0], 5)
    assert set(found) == set(expected)
    hits = sum(len({r.vec_id for r in found[q]} & set(expected[q])) for q in expected)
    assert hits >= 0.9 * 5 * len(expected)
    for q, near in found.items():
        assert [r["rank"] for r in near] == [1, 2, 3, 4, 5]
        for r in near:
            a, b = x[ids == q][0], x[ids == r.vec_id][0]
            assert r.score == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-14)


def test_neighbours_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (9, []), (50, [2.0, 0.0]), (100, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("clash"))
    found = {}
    for r in neighbours.nearest(frame, k=3).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == {0: [1, 2, 50], 50: [0, 1, 2], 100: [0, 1, 2]}
    lone = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.vec_id) for r in neighbours.nearest(lone).collect()] == [(0, 1)]
    assert neighbours.nearest(frame.filter("false")).count() == 0
    assert neighbours.nearest(lone.filter("vec_id = 0")).count() == 0


def test_the_beam_widens_until_the_audit_reaches_its_recall(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1500, 24))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    narrow = neighbours.GraphConfig(neighbours=8, reverse=8, block=64, beam=8, step=4, entries=8, part_nodes=500)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    found = {(r.query_id, r.vec_id) for r in neighbours.nearest(rows, config=narrow).collect()}
    true = {(q, int(i)) for q in range(0, 1500, 50) for i in np.argsort(-(unit @ unit[q]), kind="stable")[1:6]}
    assert len(found & true) / len(true) >= 0.9


def test_cells_begin_at_their_column():
    """Every cell's first line stands where its column begins, behind lines of any width; padding stays bounded."""
    import random

    rng = random.Random(3)
    for _ in range(60):
        rows = [[rng.choice("abcdefgh") * rng.choice([1, 2, 5, 39, 40, 41, 90]) + str(k * 10 + c) for c in range(3)] for k in range(5)]
        text = html_layout.extract_text("<table>" + "".join("<tr>" + "".join(f"<td>{x}" for x in r) for r in rows) + "</table>")
        starts = [{next(line.index(r[c]) for line in text.split("\n") if r[c] in line.split()) for r in rows} for c in range(3)]
        assert [len(s) for s in starts] == [1, 1, 1]
        assert sorted(text.split()) == sorted(x for r in rows for x in r)
        assert max(map(len, text.split("\n"))) <= 3 * 42 + 95


def test_visible_words_match_a_plain_parser():
    """Words of random well-formed pages against the standard library's parser, which knows no layout."""
    import random
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += self.hidden > 0 or tag in ("script", "style") or ("hidden", None) in attrs

        def handle_endtag(self, tag):
            self.hidden -= self.hidden > 0

        def handle_data(self, data):
            if not self.hidden:
                self.words += data.split()

    rng = random.Random(8)

    def page(depth):
        if depth == 0:
            return "".join(rng.choice([f"w{rng.randrange(99)} ", "a &amp; b ", "é\n"]) for _ in range(rng.randrange(1, 4)))
        tag = rng.choice(["div", "section", "blockquote", "b", "i", "span", "script", "div hidden"])
        if tag == "script":
            return "<script>if (a < b) x()</script>"
        return "".join(f"<{tag}>{page(depth - 1)}</{tag.split()[0]}> " for _ in range(rng.randrange(1, 3)))

    for _ in range(200):
        source = page(rng.randrange(1, 6))
        plain = Plain()
        plain.feed(source)
        plain.close()
        assert html_layout.extract_text(source).split() == plain.words


def test_audited_queries_find_the_beam_and_all_others_are_searched_once(spark, monkeypatch):
    """A beam that is too narrow doubles for the audited queries only, and each query gets the answers of the last beam."""
    rng = np.random.default_rng(12)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(1500, 24)))], "vec_id long, embedding array<double>")
    calls, search = [], neighbours.search_graph

    def counted(nodes, graph, queries, config, where=None):
        calls.append((queries.count(), config.beam))
        return search(nodes, graph, queries, config, where)

    monkeypatch.setattr(neighbours, "search_graph", counted)
    found = neighbours.nearest(rows, config=neighbours.GraphConfig(neighbours=4, reverse=2, rounds=1, orders=1, block=32, beam=8, step=4, entries=4, part_nodes=400, recall=0.99, audited=6)).collect()
    assert sorted({r.query_id for r in found}) == list(range(0, 1500, 50))
    assert all(n == 6 for n, _ in calls[:-1]) and len(calls) > 2
    assert calls[-1] == (24, calls[-2][1])

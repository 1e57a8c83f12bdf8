from __future__ import annotations

import pyarrow as pa

from tidemark.operators import packs, search
from tidemark.operators.indexes import WordIndex
from tidemark.operators.indexing import catch_up
from tidemark.operators.journal import Journal

TEXTS = [(k, None if k % 11 == 5 else " ".join(f"w{(k * j) % 13}" for j in range(k % 9)), f"t{k % 3} w1") for k in range(60)]


def _postings(table: pa.Table) -> list[tuple]:
    out = []
    for r in table.to_pylist():
        out += [(r["bucket"], r["term"], *p[:3], tuple(p[3])) for p in zip(r["ids"], r["fields"], r["dls"], r["positions"], strict=True)]
    return out


def test_packs_hold_every_posting_once(monkeypatch):
    """Whatever the size of a pack is: postings of several fields by brute force, and packs of single postings again."""
    monkeypatch.setattr(packs, "PACK", 7)
    split = [(k, None if a is None else a.split(), b.split()) for k, a, b in TEXTS]
    rows = pa.record_batch([pa.array([r[0] for r in split]), *(pa.array([r[c] for r in split], pa.list_(pa.string())) for c in (1, 2))], names=["id", "w0", "w1"])
    made = pa.Table.from_batches([packs._of_words(p, 4) for p in packs._pieces(iter([rows.slice(0, 25), rows.slice(25)]), True)])
    plain = {(w, k, f, len(ws), tuple(n for n, x in enumerate(ws) if x == w)) for k, *both in split for f, ws in enumerate(both) if ws for w in ws}
    found = _postings(made)
    assert len(made) < len(found) == len(plain) and {p[1:] for p in found} == plain
    single = pa.record_batch([pa.array([p[c] for p in found], t) for c, t in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())))], names=["bucket", "term", "id", "field", "dl", "positions"])
    again = pa.Table.from_batches([packs._of_postings(p) for p in packs._pieces(iter([single]), False)])
    assert sorted(_postings(again)) == sorted(found)


def test_tasks_of_a_commit_grow_with_its_words(spark, tmp_path, monkeypatch):
    """One bucket and one file at least: many words are written by several tasks all the same, before and after merges with deletions."""
    monkeypatch.setattr(WordIndex, "share", 200, raising=False)
    docs = spark.createDataFrame([(k, a) for k, a, _ in TEXTS], "doc_id long, text string").repartition(4)
    index = WordIndex(spark, str(tmp_path / "w"), buckets=1, spread=1, fanout=2)
    index.add(docs)
    index.commit()
    segment = index.manifest["segments"][0]["name"]
    assert len(list((tmp_path / "w" / "postings" / f"segment={segment}" / "bucket=0").glob("*.parquet"))) > 1
    index.remove(docs.filter("doc_id % 7 = 3"))
    index.commit()
    index.add(docs.filter("doc_id % 5 = 1").selectExpr("doc_id", "'w1 w2' AS text"))
    index.commit()
    index.compact()
    now = docs.filter("doc_id % 7 <> 3 AND doc_id % 5 <> 1").union(docs.filter("doc_id % 5 = 1").selectExpr("doc_id", "'w1 w2'")).filter("text IS NOT NULL")
    assert index.search("w1 w3").orderBy("doc_id").collect() == search.bm25(now, "w1 w3").orderBy("doc_id").collect()


def test_a_batch_of_the_outbox_takes_all_entries_of_its_last_number(spark, tmp_path):
    """None is left behind the checkpoint for good, whatever the batch."""
    docs = spark.createDataFrame([(k, "w1") for k in range(6)], "doc_id long, text string")
    outbox = spark.createDataFrame([(1, 0, "add"), (2, 1, "add"), (2, 2, "add"), (2, 3, "add"), (3, 4, "add"), (4, 4, "remove")], "seq long, doc_id long, action string")
    index, journal = WordIndex(spark, str(tmp_path / "w"), buckets=1, spread=1), Journal(spark, str(tmp_path / "j"))
    catch_up(outbox, docs, {"w": index}, journal, batch=2)
    assert sorted(r.doc_id for r in index.search("w1").collect()) == [0, 1, 2, 3]
    assert journal.get("checkpoint-w") == {"last_sequence": 4, "processed_count": 6}

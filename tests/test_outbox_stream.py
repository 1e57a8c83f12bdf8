from __future__ import annotations

import pytest

from tidemark.operators.indexes import WordIndex
from tidemark.operators.journal import Conflict, Journal
from tidemark.streaming import ingest, outbox

ENTRY = "seq bigint, doc_id bigint, action string"


class _Dies:
    """An index whose process ends after its second commit, before the batch is recorded."""

    def __init__(self, index):
        self.index, self.commits = index, 0

    def __getattr__(self, name):
        return getattr(self.index, name)

    def commit(self):
        out = self.index.commit()
        self.commits += 1
        if self.commits == 2:
            raise RuntimeError("gone")
        return out


@pytest.fixture
def landed(spark, tmp_path):
    """Twelve documents and four batches: added, one removed and two repeated, added again."""
    docs = spark.createDataFrame([(k, f"word{k} shared") for k in range(12)], "doc_id bigint, text string")
    folder = str(tmp_path / "in")
    batches = [[(k, k, "add") for k in range(6)], [(6, 0, "remove"), (7, 1, "add"), (8, 1, "add"), (9, 99, "add")], [(10 + k, 6 + k, "add") for k in range(6)], [(20, 2, "remove"), (21, 2, "add")]]
    for b in batches:
        spark.createDataFrame(b, ENTRY).coalesce(1).write.mode("append").parquet(folder)
    return docs, folder


def test_a_crash_between_commit_and_record_loses_and_doubles_nothing(spark, landed, tmp_path):
    docs, folder = landed
    place, journal, checkpoint = str(tmp_path / "words"), Journal(spark, str(tmp_path / "journal")), str(tmp_path / "cp")
    with pytest.raises(Exception, match="gone"):
        outbox.follow(ingest.read_stream(spark, folder, ENTRY), docs, {"words": _Dies(WordIndex(spark, place, buckets=2))}, journal, checkpoint)
    assert outbox.followed(journal, "words") == {"batch": 0, "processed_count": 6}
    index = WordIndex(spark, place, buckets=2)
    assert outbox.follow(ingest.read_stream(spark, folder, ENTRY), docs, {"words": index}, journal, checkpoint) == 3
    assert outbox.followed(journal, "words") == {"batch": 3, "processed_count": 18}
    found = [r.doc_id for r in WordIndex(spark, place, buckets=2).search("shared").collect()]
    assert sorted(found) == [k for k in range(12) if k != 0]
    assert outbox.follow(ingest.read_stream(spark, folder, ENTRY), docs, {"words": index}, journal, checkpoint) == 0


def test_a_second_driver_of_one_batch_conflicts(spark, tmp_path):
    journal = Journal(spark, str(tmp_path))
    journal.put("followed-words", {"batch": 0, "processed_count": 1}, version=1)
    with pytest.raises(Conflict):
        journal.put("followed-words", {"batch": 0, "processed_count": 1}, version=1)

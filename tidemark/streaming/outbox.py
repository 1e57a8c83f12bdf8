"""The outbox as a stream into indexes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.indexes import Updater
from ..operators.journal import Journal
from .ingest import run_to_end


def follow(outbox: DataFrame, documents: DataFrame, indexes: Mapping[str, Updater], journal: Journal, checkpoint: str, id_col: str = "doc_id") -> int:
    """A stream of entries (seq, id, action add or remove) into every index; the number of batches that this run took.

    Each index has a record for each batch that it committed, numbered by the batch and put only if it isn't there. A batch that Spark
    repeats after a crash skips the indexes that have its record. One that fell between an index's commit and the record is
    committed again, which replaces the same ids by the same documents. Of two drivers that follow one
    outbox with one checkpoint, one gets a :class:`~tidemark.operators.journal.Conflict`. Entries of a batch count by
    their last action, and an entry whose document is gone is passed over.
    """

    def take(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(id_col).agg(F.max_by("action", "seq").alias("action")).persist()
        taken = batch.count()
        for name, index in indexes.items():
            newest, held = journal.newest(f"followed-{name}")
            if newest > number:
                continue
            index.add(documents.join(last.filter("action = 'add'").select(id_col), id_col, "left_semi"))
            index.remove(last.filter("action = 'remove'").select(id_col))
            index.commit()
            journal.put(f"followed-{name}", {"batch": number, "processed_count": (held or {"processed_count": 0})["processed_count"] + taken}, version=number + 1)
        last.unpersist()

    return run_to_end(outbox, take, checkpoint)


def followed(journal: Journal, name: str) -> dict[str, int]:
    """The last batch of an index and the entries that it has taken; batch -1 before the first."""
    return journal.get(f"followed-{name}") or {"batch": -1, "processed_count": 0}

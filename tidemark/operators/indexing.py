"""From outbox to indexes: consumption with a checkpoint for each index, clean-up, and rebuilding."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .indexes import Updater, dealt
from .journal import Journal
from .lifecycle import ORDER
from .store import outbox_truncated


def consume(outbox: DataFrame, documents: DataFrame, indexes: Mapping[str, Updater], journal: Journal, batch: int = 100, id_col: str = "doc_id") -> int:
    """One batch of the outbox (seq, id, action add or remove) into every index; the number of entries taken.

    The batch begins after the least checkpoint; each index gets what lies after its own, so a new index gets all and
    one that is ahead gets nothing twice. Checkpoints follow the commit: a crash in between repeats a batch, and
    indexes replace by id.
    """
    held = {name: journal.get(f"checkpoint-{name}") or {"last_sequence": -1, "processed_count": 0} for name in indexes}
    start = min(c["last_sequence"] for c in held.values())
    ahead = outbox.filter(F.col("seq") > start).orderBy("seq").limit(batch).agg(F.max("seq")).first()[0]
    if ahead is None:
        return 0
    window = outbox.filter((F.col("seq") > start) & (F.col("seq") <= ahead)).select("seq", id_col, "action").persist()  # a range, which every task reads for itself
    top, n = ahead, window.count()
    for name, index in indexes.items():
        mine = window.filter((F.col("seq") > held[name]["last_sequence"]) & (F.col("seq") <= top))
        last = mine.groupBy(id_col).agg(F.max_by("action", "seq").alias("action"))  # the last action of an id counts
        taken = mine.count()
        if not taken:
            continue
        index.add(documents.join(last.filter("action = 'add'").select(id_col), id_col, "left_semi"))
        index.remove(last.filter("action = 'remove'").select(id_col))
        index.commit()
        journal.put(f"checkpoint-{name}", {"last_sequence": top, "processed_count": held[name]["processed_count"] + taken})
    window.unpersist()
    return n


def catch_up(outbox: DataFrame, documents: DataFrame, indexes: Mapping[str, Updater], journal: Journal, batch: int = 100, iterations: int = 10, id_col: str = "doc_id") -> int:
    """Batches until the outbox is done or the iterations are."""
    total = 0
    for _ in range(iterations):
        n = consume(outbox, documents, indexes, journal, batch, id_col)
        total += n
        if n < batch:
            break
    return total


def consumed(outbox: DataFrame, names: list[str], journal: Journal) -> DataFrame:
    """The outbox without what every index has taken."""
    done = [(journal.get(f"checkpoint-{n}") or {"last_sequence": -1})["last_sequence"] for n in names]
    return outbox_truncated(outbox, min(done, default=-1))


def rebuild(
    documents: DataFrame,
    index: Updater,
    progress: Callable[[str, int, int], None] = lambda level, done, errors: None,
    least: str | None = None,
    continue_on_error: bool = True,
    folder: str | None = None,
    id_col: str = "doc_id",
) -> tuple[int, int]:
    """All documents (with level) into a cleared index, level by level, with progress after each; documents and errors.

    ``least`` keeps its level and those above it. With ``folder``, which all machines share, documents are read once and lie there
    by level until the rebuild ends, or stay there if a commit failed, whose rows the index still has pending. Without it, or where
    some document can't be read, each level reads them all.
    """
    index.clear()
    levels = ORDER if least is None else ORDER[ORDER.index(least) :]
    journal, name = None if folder is None else Journal(documents.sparkSession, folder), f"rebuild-{uuid.uuid4().hex}"
    done = errors = 0
    pending = False
    try:
        if journal is not None:
            try:
                dealt(documents.filter(F.col("level").isin(*levels)), id_col).write.partitionBy("level").parquet(f"{folder}/{name}")
                documents, pending = documents.sparkSession.read.schema(documents.schema).parquet(f"{folder}/{name}"), True
            except Exception:  # a document that can't be read is its own level's error
                if not continue_on_error:
                    raise
        for level in levels:
            rows = documents.filter(F.col("level") == level).drop("level")
            try:
                index.add(rows)
                index.commit()
                done += rows.count()
            except Exception:  # one level's failure is counted and reported, as the caller asked
                if not continue_on_error:
                    raise
                errors += 1
            progress(level, done, errors)
        pending = pending and errors > 0
    finally:
        if journal is not None and not pending:
            journal.delete(name)
    return done, errors

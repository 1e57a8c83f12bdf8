"""Jobs over stored tables, which an external scheduler starts, and a registry with their state: run, pause, skip what still runs, and report."""

from __future__ import annotations

import random
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Retention
from ..operators import indexes, indexing, lifecycle, toc
from ..operators.journal import Journal
from ..operators.rounds import cut


def rolled_up(spark: SparkSession, folder: str, level: str, journal: Journal) -> DataFrame | None:
    """The nodes of a level that finished runs of its job have stored; None before the first."""
    held = journal.get(f"rollup-{level}")
    return spark.read.parquet(*(f"{folder}/{level}/{name}" for name in held["batches"])) if held and held["batches"] else None


def roll_up(below: DataFrame, folder: str, level: str, as_of: Column, journal: Journal) -> int:
    """One run of a roll-up job: nodes of periods that closed since the last run, stored; their number.

    A run writes its nodes into a folder of its own and then puts the checkpoint, which names that folder: readers see
    whole runs only, and a run that died in between leaves a folder that nobody reads. Of two runs at once one gets a
    :class:`~..operators.journal.Conflict`. A run without new periods puts nothing.
    """
    spark, name = below.sparkSession, f"rollup-{level}"
    version, held = journal.newest(name)
    held = held or {"end_us": None, "batches": []}
    after = None if held["end_us"] is None else F.timestamp_micros(F.lit(held["end_us"]))
    batch = uuid.uuid4().hex
    toc.rollup(below, level, as_of, after).write.parquet(f"{folder}/{level}/{batch}")
    n, end = spark.read.parquet(f"{folder}/{level}/{batch}").agg(F.count(F.lit(1)), F.max(F.unix_micros("end_time"))).first()
    if n:
        journal.put(name, {"end_us": end, "batches": [*held["batches"], batch]}, version + 1)
    return n


def prune(index: indexes.WordIndex | indexes.VectorIndex, documents: DataFrame, as_of: Column, retention: Retention = Retention()) -> dict[str, int]:
    """One run of a prune job: what the index holds and the retention of its level (documents: id, level, ts) no longer keeps goes; counts by level.

    One commit removes all. A run that died before it is repeated as a whole, and one that finds nothing commits nothing.
    """
    key = index.id_col
    gone = cut(lifecycle.expired(documents.join(index.live().select(key), key, "left_semi"), as_of, retention).select(key, "level"))
    counts = {r["level"]: r["n"] for r in gone.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each level
    if counts:
        index.remove(gone.select(key))
        index.commit()
    return counts


#: Jobs of a deployment: name, cron expression, and what it calls with the caller's tables. Fixed values; an external scheduler reads them.
SCHEDULE: tuple[tuple[str, str, Callable], ...] = (
    ("indexing", "* * * * *", indexing.catch_up),
    ("index_commit", "* * * * *", indexes.WordIndex.commit),
    ("rollup_day", "0 1 * * *", roll_up),
    ("rollup_week", "0 2 * * 0", roll_up),
    ("rollup_month", "0 3 1 * *", roll_up),
    ("prune_words", "0 3 * * *", prune),
    ("prune_vectors", "0 3 * * *", prune),
    ("rebuild", "0 4 * * 0", indexing.rebuild),
    ("compaction", "0 4 * * 0", lifecycle.compact),
)
#: Seconds that a start is put off at most, and that a run may take.
JITTER_S, TIMEOUT_S = 300, 1800


@dataclass
class Job:
    name: str
    run: Callable[[], object]
    cron: str = ""
    paused: bool = False
    runs: int = 0
    errors: int = 0
    skipped: int = 0
    seconds: float = 0.0
    result: str = "never"
    lock: threading.Lock = field(default_factory=threading.Lock, repr=False)


class Jobs:
    """A registry; ``start`` skips a paused job, and one that still runs."""

    def __init__(self) -> None:
        self._jobs: dict[str, Job] = {}

    def add(self, name: str, run: Callable[[], object], cron: str = "") -> None:
        self._jobs[name] = Job(name, run, cron)

    def pause(self, name: str, paused: bool = True) -> None:
        self._jobs[name].paused = paused

    def start(self, name: str, jitter_s: float = 0.0) -> str:
        job = self._jobs[name]
        if job.paused or not job.lock.acquire(blocking=False):
            job.skipped += 1
            return "skipped"
        try:
            if jitter_s:
                time.sleep(random.uniform(0, jitter_s))
            began = time.monotonic()
            job.runs += 1
            try:
                job.run()
                job.result = "success"
            except Exception as error:  # a job's failure is its state, not the scheduler's
                job.errors += 1
                job.result = f"failed: {error}"
            job.seconds = time.monotonic() - began
            return job.result
        finally:
            job.lock.release()

    def status(self, spark: SparkSession) -> DataFrame:
        rows = [(j.name, j.cron, j.paused, j.runs, j.errors, j.skipped, j.seconds, j.result) for j in self._jobs.values()]
        return spark.createDataFrame(rows, "name string, cron string, is_paused boolean, run_count int, error_count int, skipped int, last_seconds double, last_result string")

"""Indexes that searches read: postings of words in buckets, and vectors in cells, both kept as segments of Parquet.

A commit adds one segment and then a manifest that names it; readers see whole commits only. A document that comes again
or is removed is told by a row of a delete vector, and segments are rewritten only when several of one size are merged.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import query_words, spaced_words
from ..functions.vectors import as_doubles
from ..shipping import map_batches
from . import packs, search
from .journal import Journal
from .wordquery import Boolean, Phrase, any_of, parsed, phrases


class Updater(Protocol):
    """What an indexing pipeline needs of an index."""

    def add(self, rows: DataFrame) -> None: ...

    def remove(self, ids: DataFrame) -> None: ...

    def commit(self) -> int: ...


def dealt(rows: DataFrame, id_col: str) -> DataFrame:
    """Rows as they are; but by the hash of their ids, in tasks of about one size, if a task has over 1.5 times a core's share of them, as it has of a file with one row group."""
    r = rows.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count").alias("most"), F.sum("count").alias("n")).first()
    return rows.hint("rebalance", id_col) if r["n"] and r["most"] > 1.5 * r["n"] / rows.sparkSession.sparkContext.defaultParallelism else rows


class _Segments:
    """Segments, live rows and pending changes of one index.

    A commit writes one segment and, for each document of it that an older segment holds, a row of a delete vector.
    Older segments are only looked into if their ids overlap with the new ones; counts of a segment stand in the
    manifest and shrink by what is deleted. Once ``fanout`` segments of about one size are there they are merged into
    one, so a document is rewritten a logarithmic number of times. Folders of merged segments go with the commit after
    the merge, when searches begun before it are over.
    """

    #: Column that tells a row with content from a removal, columns whose sums a segment keeps, columns that tell where a row lies in the table in buckets, and that table.
    content, summed, placed, table = "", (), (), ""

    def __init__(self, spark: SparkSession, folder: str, id_col: str, fanout: int = 8) -> None:
        self.spark, self.folder, self.id_col, self.fanout = spark, folder, id_col, fanout
        self.journal = Journal(spark, folder)
        self._added: list[DataFrame] = []
        self._removed: list[DataFrame] = []
        self.reload()

    def reload(self) -> None:
        """See the newest commit, which another writer may have made."""
        self.version, held = self.journal.newest("manifest")
        self.manifest = held or {"last": 0, "segments": [], "deletes": {}, "retired": []}

    def add(self, rows: DataFrame) -> None:
        """Rows for the next commit; each id once, and ids that are there are replaced."""
        self._added.append(rows)

    def remove(self, ids: DataFrame) -> None:
        """Ids that the next commit removes, unless it adds them too."""
        self._removed.append(ids.select(self.id_col))

    def commit(self) -> int:
        """Write pending changes as one segment and return its number; the last commit's number if nothing is pending.

        Of two writers that commit at once one gets a :class:`~tidemark.operators.journal.Conflict`, keeps its pending
        changes and can ``reload`` and commit again.
        """
        if not self._added and not self._removed:
            return self.manifest["last"]
        number = self.manifest["last"] + 1
        name = self._name(number)
        buckets = self._write(name, self._pending())
        entry = self._entry(name, buckets)
        older, deletes = self._delete(entry)
        self._publish([*older, entry], number, deletes)
        self._added, self._removed = [], []
        while due := self._due():
            self._merge(due)
        return number

    @staticmethod
    def _name(number: int) -> str:
        return f"s{number}-{uuid.uuid4().hex[:12]}"

    def _entry(self, name: str, buckets: list[int]) -> dict:
        """The manifest's entry of a segment: live rows, sums, and the least and largest id that it writes or removes."""
        has = F.col(self.content).isNotNull()
        sums = [F.coalesce(F.sum(F.when(has, F.col(c))), F.lit(0)).alias(c) for c in self.summed]
        r = self.spark.read.parquet(f"{self.folder}/documents/segment={name}").agg(F.count_if(has).alias("__n"), F.min(self.id_col).alias("__low"), F.max(self.id_col).alias("__high"), *sums).first()
        return {"name": name, "buckets": buckets, "live": r["__n"], "low": r["__low"], "high": r["__high"], "sums": {c: r[c] for c in self.summed}}

    def _delete(self, entry: dict) -> tuple[list[dict], dict]:
        """Older segments with less live rows, and the delete vectors with one for what ``entry`` replaces or removes."""
        old, deletes = [dict(s) for s in self.manifest["segments"]], dict(self.manifest["deletes"])
        near = [s["name"] for s in old if s["live"] and entry["low"] is not None and s["low"] <= entry["high"] and entry["low"] <= s["high"]]
        if not near:
            return old, deletes
        ids = self.spark.read.parquet(f"{self.folder}/documents/segment={entry['name']}").select(self.id_col)
        within = self._documents(near).filter(F.col(self.id_col).between(entry["low"], entry["high"]) & F.col(self.content).isNotNull())
        dead = self._alive(within, near).join(ids, self.id_col, "left_semi").select(self.id_col, "segment", *self.placed, *self.summed)
        path = f"{self.folder}/deleted/segment={entry['name']}"
        dead.withColumnRenamed("segment", "dead_in").write.mode("overwrite").parquet(path)
        rows = self.spark.read.parquet(path).groupBy("dead_in").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in self.summed)).collect()  # a row a segment
        for r in rows:
            hit = next(s for s in old if s["name"] == r["dead_in"])
            hit["live"] -= r["n"]
            hit["sums"] = {c: hit["sums"][c] - r[c] for c in self.summed}
        return old, deletes | ({entry["name"]: [r["dead_in"] for r in rows]} if rows else {})

    def _publish(self, segments: list[dict], number: int, deletes: dict, retired: Sequence[str] = ()) -> None:
        """Put the manifest; only then the folders that the one before last needed go."""
        gone, names = self.manifest["retired"], {s["name"] for s in segments}
        manifest = {"last": number, "segments": segments, "deletes": {k: v for k, v in deletes.items() if names & set(v)}, "retired": list(retired)} | self._more()
        self.version = self.journal.put("manifest", manifest, self.version + 1)
        self.manifest = manifest
        for name in gone:
            for table in ("documents", self.table):
                self.journal.delete(f"{table}/segment={name}")

    def _more(self) -> dict:
        """What else an index keeps in the manifest."""
        return {}

    def _due(self) -> list[str] | None:
        """Segments of one size class, if there are ``fanout`` of them."""
        tiers: dict[int, list[str]] = {}
        for s in self.manifest["segments"]:
            tiers.setdefault(int(math.log(max(s["live"], 1), self.fanout)), []).append(s["name"])
        return next((t for t in tiers.values() if len(t) >= self.fanout), None)

    def _merge(self, names: Sequence[str]) -> None:
        """One segment of the live rows of some."""
        number = self.manifest["last"] + 1
        name = self._name(number)
        self._alive(self._documents(names), names).filter(F.col(self.content).isNotNull()).drop("segment").write.mode("overwrite").parquet(f"{self.folder}/documents/segment={name}")
        rows = self._buckets(None, names)
        if rows is not None:
            self._remake(rows, names).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{self.table}/segment={name}")
        entry = self._entry(name, self._written_buckets(name))
        self._publish([*(s for s in self.manifest["segments"] if s["name"] not in names), entry], number, self.manifest["deletes"], names)

    def compact(self) -> None:
        """Merge all segments into one."""
        if len(self.manifest["segments"]) > 1:
            self._merge([s["name"] for s in self.manifest["segments"]])

    def clear(self) -> None:
        self._publish([], self.manifest["last"], {}, [s["name"] for s in self.manifest["segments"]])

    def _pending(self) -> DataFrame:
        """New rows, and removals with null content."""
        rows = None
        for df in self._added:
            rows = df if rows is None else rows.join(df.select(self.id_col), self.id_col, "left_anti").unionByName(df)
        gone = None
        for df in self._removed:
            gone = df if gone is None else gone.unionByName(df)
        if gone is None:
            return rows
        gone = gone.distinct()
        if rows is None:
            return gone.withColumns(self._nothing())
        return rows.unionByName(gone.join(rows.select(self.id_col), self.id_col, "left_anti").withColumns(self._nothing()), allowMissingColumns=True)

    def _documents(self, names: Sequence[str] | None = None) -> DataFrame | None:
        """The rows per document of some segments (all: None), with segment."""
        paths = [f"{self.folder}/documents/segment={s['name']}" for s in self.manifest["segments"] if names is None or s["name"] in names]
        return self.spark.read.option("basePath", f"{self.folder}/documents").parquet(*paths) if paths else None

    def _deletes(self, names: Sequence[str] | None = None) -> list[str]:
        """The delete vectors that concern some segments (all: None)."""
        return [n for n, hit in self.manifest["deletes"].items() if names is None or set(names) & set(hit)]

    def _alive(self, rows: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
        """Rows (with segment) of some segments that no later commit has deleted; where nothing is deleted, there is no join."""
        hit = self._deletes(names)
        if not hit:
            return rows
        dead = self.spark.read.parquet(*(f"{self.folder}/deleted/segment={n}" for n in hit))
        return rows.join(dead.select(self.id_col, F.col("dead_in").alias("segment")), [self.id_col, "segment"], "left_anti")

    def live(self) -> DataFrame:
        """Each document that is in the index."""
        docs = self._documents()
        if docs is None:
            raise LookupError(f"nothing is indexed in {self.folder}")
        return self._alive(docs).filter(F.col(self.content).isNotNull()).drop("segment")

    @property
    def size(self) -> int:
        """Live documents, from the manifest."""
        return sum(s["live"] for s in self.manifest["segments"])

    def _buckets(self, wanted: Sequence[int] | None, names: Sequence[str] | None = None) -> DataFrame | None:
        """The rows of some buckets of some segments, read by path, so that no other folder is listed."""
        paths = [f"{self.folder}/{self.table}/segment={s['name']}/bucket={b}" for s in self.manifest["segments"] if names is None or s["name"] in names for b in s["buckets"] if wanted is None or b in wanted]
        return self.spark.read.option("basePath", f"{self.folder}/{self.table}").parquet(*paths) if paths else None

    def _nothing(self) -> dict[str, Column]:
        raise NotImplementedError

    def _write(self, name: str, pending: DataFrame) -> list[int]:
        raise NotImplementedError

    def _remake(self, rows: DataFrame, names: Sequence[str]) -> DataFrame:
        """The live rows of some segments' buckets, as a merged segment has them."""
        raise NotImplementedError

    def _written_buckets(self, name: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{self.table}/segment={name}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        found = (int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket="))
        return sorted(b for b in found if b != packs.DOCUMENTS)


class WordIndex(_Segments):
    """BM25 over postings with positions, of one or several fields. A search reads the buckets of its terms only.

    A task splits and packs the words of its own texts in one pass, so no word is shuffled or written twice, and a file holds a row
    for each word of a pack. A commit has as many tasks as its rows have, and where one of these holds too much the texts are dealt
    out first; ``buckets`` bounds the folders. A merge has ``spread`` tasks, or one for each ``share`` bytes where that is more.
    ``fields`` are the columns that are indexed; a document without any of them is not in the index.
    """

    content, placed, table, share = "dl", ("pack",), "postings", 16 << 20

    def __init__(self, spark: SparkSession, folder: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = 32, spread: int = 2, fields: Sequence[str] | None = None, fanout: int = 8) -> None:
        self.fields, self.buckets, self.spread = tuple(fields or (text_col,)), buckets, spread
        self.summed = tuple(f"dl{k}" for k in range(len(self.fields)))
        super().__init__(spark, folder, id_col, fanout)

    def _bucket(self, term: str) -> int:
        return zlib.crc32(term.encode()) % self.buckets

    def _nothing(self) -> dict[str, Column]:
        return {f: F.lit(None).cast("string") for f in self.fields}

    def _write(self, name: str, pending: DataFrame) -> list[int]:
        """Texts are split once, into packs and rows of documents; the table of documents is made of the latter."""
        path, id_type = f"{self.folder}/postings/segment={name}", dict(pending.dtypes)[self.id_col]
        split = [spaced_words(F.col(f)).alias(f"w{k}") for k, f in enumerate(self.fields)]
        rows = dealt(pending.select(self.id_col, *self.fields), self.id_col).select(self.id_col, *split)
        self._laid(packs.of_words(rows, self.buckets)).write.mode("overwrite").partitionBy("bucket").parquet(path)
        told = f"{path}/bucket={packs.DOCUMENTS}"
        if self.journal.exists(f"postings/segment={name}/bucket={packs.DOCUMENTS}"):
            held = self.spark.read.schema(packs.kinds(id_type)).parquet(told)
        else:
            held = self.spark.createDataFrame([], packs.kinds(id_type))
        lengths = [F.col(f"w{k}") for k in range(len(split))]
        whole = reduce(lambda a, b: a + b, (F.coalesce(n, F.lit(0)) for n in lengths))
        sized = packs.documents(held, self.id_col, len(split)).select(self.id_col, "pack", F.when(F.coalesce(*lengths).isNotNull(), whole).alias("dl"), *(F.coalesce(n, F.lit(0)).alias(c) for n, c in zip(lengths, self.summed)))
        sized.sort(self.id_col).write.mode("overwrite").parquet(f"{self.folder}/documents/segment={name}")
        self.journal.delete(f"postings/segment={name}/bucket={packs.DOCUMENTS}")
        return self._written_buckets(name)

    def _few(self, rows: DataFrame, *folders: str) -> DataFrame:
        """Rows of folders in as many tasks as their bytes ask for."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        paths = [jvm.org.apache.hadoop.fs.Path(f) for f in folders]
        size = sum(p.getFileSystem(conf).getContentSummary(p).getLength() for p in paths)
        return rows.coalesce(max(self.spread, -(-size // self.share)))

    @staticmethod
    def _laid(rows: DataFrame) -> DataFrame:
        return rows.sortWithinPartitions("bucket", "term")

    def _remake(self, rows: DataFrame, names: Sequence[str]) -> DataFrame:
        """Packs go over as they are; where documents of these segments are deleted, their postings are taken out of them."""
        hit = self._deletes(names)
        if not hit:
            paths = [f"{self.folder}/postings/segment={n}" for n in names if any(s["name"] == n and s["buckets"] for s in self.manifest["segments"])]
            return self._laid(self._few(rows.drop("segment"), *paths))
        dead = self.spark.read.parquet(*(f"{self.folder}/deleted/segment={n}" for n in hit)).filter(F.col("dead_in").isin(*names))
        return self._laid(packs.without(rows, dead, self.id_col))

    def _query(self, query: str | Sequence[str] | Phrase | Boolean) -> Phrase | Boolean:
        if isinstance(query, str):
            return parsed(query, self.fields)
        if isinstance(query, (Phrase, Boolean)):
            return query
        return any_of(*(Phrase((w,)) for part in query for w in query_words(part)))

    def search(self, query: str | Sequence[str] | Phrase | Boolean) -> DataFrame:
        """id and score, to nine places, of live documents that the query fits; a query that asks for nothing finds nothing.

        Words and phrases that count in favour score by BM25, each field for itself with its own mean length; a phrase
        weighs as much as its words together and its frequency is that of the phrase. An exclusion alone finds nothing.
        """
        asked = self._query(query)
        leaves = {p: None for p in phrases(asked)}
        at = {f: k for k, f in enumerate(self.fields)}
        unknown = {p.field for p in leaves if p.field is not None and p.field not in at}
        if unknown:
            raise ValueError(f"no such fields: {sorted(unknown)}")
        terms = sorted({w for p in leaves for w in p.words})
        rows = self._buckets({self._bucket(t) for t in terms}) if terms else None
        if rows is None:
            docs = self.spark.createDataFrame([], f"{self.id_col} bigint, score double")
            return docs if not self.manifest["segments"] else self.live().select(self.id_col, F.lit(0.0).alias("score")).filter(F.lit(False))
        spots = {(p, k): None for p in leaves for k in range(len(self.fields)) if p.field is None or at[p.field] == k}
        single = {(w, k): f"__{n}" for n, (w, k) in enumerate(dict.fromkeys((w, k) for p, k in spots for w in p.words))}
        placed = {(w, k) for p, k in spots if len(p.words) > 1 for w in p.words}
        hits = self._alive(packs.postings(rows.filter(F.col("term").isin(*terms)), self.id_col, "segment"))

        def here(w: str, k: int) -> Column:
            return (F.col("term") == w) & (F.col("field") == k)

        counted = hits.groupBy(self.id_col).agg(
            *(F.coalesce(F.max(F.when(F.col("field") == k, F.col("dl"))), F.lit(0)).alias(f"__dl{k}") for k in range(len(self.fields))),
            *(F.sum(F.when(here(w, k), F.size("positions")).otherwise(0)).alias(f"{c}n") for (w, k), c in single.items()),
            *(F.coalesce(F.first(F.when(here(w, k), F.col("positions")), ignorenulls=True), F.array().cast("array<int>")).alias(f"{single[w, k]}p") for w, k in sorted(placed)),
        )
        stats = counted.agg(*(F.count_if(F.col(f"{c}n") > 0).alias(f"{c}df") for c in single.values()))
        joined = counted.crossJoin(F.broadcast(stats))  # stats is one row

        def begins(positions: str, n: int) -> Column:
            """Where a phrase would begin that has the word n words on."""
            return F.transform(positions, lambda x: x - n)

        def frequency(p: Phrase, k: int) -> Column:
            if len(p.words) == 1:
                return F.col(f"{single[p.words[0], k]}n")
            return F.size(reduce(F.array_intersect, (begins(f"{single[w, k]}p", n) for n, w in enumerate(p.words))))

        def fits(q: Phrase | Boolean) -> Column:
            if isinstance(q, Phrase):
                return reduce(lambda a, b: a | b, (frequency(q, k) > 0 for k in range(len(self.fields)) if (q, k) in spots), F.lit(False))
            good = reduce(lambda a, b: a & b, map(fits, q.must)) if q.must else reduce(lambda a, b: a | b, map(fits, q.should), F.lit(False))
            return reduce(lambda a, b: a & ~b, map(fits, q.without), good)

        n = self.size
        score = F.lit(0.0)
        for p in dict.fromkeys(phrases(asked, scoring=True)):
            for k in (k for q, k in spots if q == p):
                mean = sum(s["sums"][f"dl{k}"] for s in self.manifest["segments"]) / n if n else 1.0
                f = frequency(p, k)
                idf = reduce(lambda a, b: a + b, (F.log(1 + (F.lit(n) - F.col(f"{single[w, k]}df") + 0.5) / (F.col(f"{single[w, k]}df") + 0.5)) for w in p.words))
                score = score + idf * f * (search.K1 + 1) / (f + search.K1 * (1 - search.B + search.B * F.col(f"__dl{k}") / F.lit(mean or 1.0)))
        return joined.filter(fits(asked)).select(self.id_col, F.round(score, 9).alias("score"))


class VectorIndex(_Segments):
    """Vectors in cells around centroids. A search reads the cells nearest to the query; with all cells it is exact.

    Centroids come from spherical k-means over at most ``sample`` vectors, chosen by hash, of the first commit and again of
    all at each ``compact``, which makes as many cells as the root of the number of vectors, up to ``most``. So the
    vectors that a search of some cells reads grow with that root. Every vector is indexed; those that are null, zero or
    not finite are left out. ``tune`` measures how many cells give a wanted recall.
    """

    content, table = "embedding", "vectors"

    def __init__(self, spark: SparkSession, folder: str, id_col: str = "vec_id", cells: int = 16, sample: int = 20_000, spread: int = 2, fanout: int = 8, most: int = 4096) -> None:
        self.cells, self.sample, self.spread, self.most = cells, sample, spread, most
        super().__init__(spark, folder, id_col, fanout)

    def reload(self) -> None:
        super().reload()
        #: Cells that ``tune`` found to be enough; None before.
        self.probes: int | None = self.manifest.get("probes")
        self.trained: str | None = self.manifest.get("centroids")
        self.centroids = None if self.trained is None else np.array(self.journal.get(self.trained)["rows"])

    def _more(self) -> dict:
        return {"centroids": self.trained, "probes": self.probes}

    def clear(self) -> None:
        self.trained = self.centroids = self.probes = None
        super().clear()

    def _nothing(self) -> dict[str, Column]:
        return {"embedding": F.lit(None).cast("array<double>")}

    def _train(self, rows: DataFrame, cells: int) -> None:
        """Centroids of the rows, kept under a name that only the manifest makes valid."""
        some = rows.filter("embedding IS NOT NULL").orderBy(F.xxhash64(self.id_col)).limit(self.sample).select("embedding").collect()
        x = np.array([r[0] for r in some], dtype=np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        centres = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)]
        for _ in range(8):
            near = (x @ centres.T).argmax(axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            size = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
        self.centroids, self.trained, self.probes = centres, f"centroids-{uuid.uuid4().hex[:12]}", None
        self.journal.put(self.trained, {"rows": centres.tolist()})

    def _write(self, name: str, pending: DataFrame) -> list[int]:
        rows = pending.withColumn("embedding", as_doubles(F.col("embedding")))
        sound = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
        rows = rows.withColumn("embedding", F.when(sound, F.col("embedding")))
        rows.write.mode("overwrite").parquet(f"{self.folder}/documents/segment={name}")
        stored = self.spark.read.parquet(f"{self.folder}/documents/segment={name}").filter("embedding IS NOT NULL")
        if stored.isEmpty():
            return []
        if self.centroids is None:
            self._train(stored, self.cells)
        return self._place(name, stored)

    def _place(self, name: str, stored: DataFrame) -> list[int]:
        """Write a segment's vectors by cell."""
        centres, id_col = self.centroids, self.id_col

        def cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    yield pd.DataFrame({id_col: b[id_col], "bucket": (np.stack(b["embedding"].to_numpy()) @ centres.T).argmax(axis=1).astype(np.int32)})

        placed = map_batches(stored.select(id_col, "embedding"), cell, f"{id_col} {dict(stored.dtypes)[id_col]}, bucket int")
        self._deal(stored.join(placed, id_col)).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/vectors/segment={name}")
        return self._written_buckets(name)

    def _remake(self, rows: DataFrame, names: Sequence[str]) -> DataFrame:
        return self._deal(self._alive(rows, names).drop("segment"))

    def _deal(self, rows: DataFrame) -> DataFrame:
        """Rows with bucket, dealt out as they are written."""
        return rows.repartition(len(self.centroids) * self.spread, "bucket", F.pmod(F.xxhash64(self.id_col), F.lit(self.spread)))

    def compact(self) -> None:
        """Merge all segments into one, with centroids and cells made anew."""
        names = [s["name"] for s in self.manifest["segments"]]
        live = sum(s["live"] for s in self.manifest["segments"])
        if not live:
            return
        number = self.manifest["last"] + 1
        name, path = self._name(number), f"{self.folder}/documents/segment="
        self._alive(self._documents(names)).filter(F.col(self.content).isNotNull()).drop("segment").write.mode("overwrite").parquet(path + name)
        stored = self.spark.read.parquet(path + name)
        before = self.trained
        self._train(stored, min(self.most, max(self.cells, math.isqrt(live))))
        entry = self._entry(name, self._place(name, stored))
        try:
            self._publish([entry], number, self.manifest["deletes"], names)
        except Exception:
            self.reload()  # another writer's commit stands, with its cells
            raise
        if before:
            self.journal.delete(before)

    def tune(self, k: int = 10, recall: float = 0.95, queries: int = 256) -> float:
        """Keep in ``probes`` the least number of nearest cells that give the recall at k, and return the recall they give.

        At most ``queries`` stored vectors, chosen by hash, are compared with all others in one pass, in which each batch
        gives its k best; where the exact neighbours lie tells the recall of every number of cells.
        """
        rows = self._buckets(None)
        if rows is None:
            return 1.0
        held = self._alive(rows).select(self.id_col, "embedding", "bucket")
        asked = held.orderBy(F.xxhash64(self.id_col, F.lit(1)), self.id_col).limit(queries).collect()  # a bounded sample
        unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
        ids, q, id_col = np.array([r[0] for r in asked]), unit(np.array([r[1] for r in asked])), self.id_col

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if b.empty:
                    continue
                near = unit(np.stack(b["embedding"].to_numpy())) @ q.T
                near[b[id_col].to_numpy()[:, None] == ids[None, :]] = -np.inf
                top = np.argsort(-near, axis=0, kind="stable")[:k]
                asked_by = np.broadcast_to(np.arange(len(q)), top.shape).ravel()
                yield pd.DataFrame({"q": asked_by, "score": near[top.ravel(), asked_by], "id": b[id_col].to_numpy()[top.ravel()], "bucket": b["bucket"].to_numpy()[top.ravel()]})

        found = map_batches(held, best, f"q int, score double, id {dict(held.dtypes)[id_col]}, bucket int").filter("score > double('-infinity')")
        nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
        exact = found.withColumn("nth", nth).filter(F.col("nth") <= k).select("q", "bucket").collect()  # k rows a query
        if not exact:
            return 1.0
        order = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")
        place = np.argsort(order, axis=1)
        depth = np.sort([place[r["q"], r["bucket"]] for r in exact])
        need = depth[max(0, math.ceil(recall * len(depth)) - 1)] + 1
        self.probes = int(need)
        self._publish(self.manifest["segments"], self.manifest["last"], self.manifest["deletes"], ())
        return float((depth < need).mean())

    def search(self, query: Sequence[float], k: int, probes: int | None = None, where: Column | None = None) -> DataFrame:
        """id and score of the k nearest live vectors in the ``probes`` nearest cells (all: None)."""
        q = np.asarray(query, dtype=np.float64)
        order = None if probes is None or self.centroids is None else np.argsort(-(self.centroids @ q), kind="stable")[:probes].tolist()
        rows = self._buckets(order)
        if rows is None:
            return self.spark.createDataFrame([], f"{self.id_col} bigint, score double")
        return search.knn(self._alive(rows), q.tolist(), k, self.id_col, where=where)

    def get(self, ids: Sequence[object]) -> DataFrame:
        """Stored rows of ids; ids that aren't there give none."""
        return self.live().filter(F.col(self.id_col).isin(*ids))

"""Near-duplicate vectors: links of cosine at least a threshold, and their connected components.

Codes come from iterative quantisation: principal directions of a bounded sample are turned by a learned rotation until
their signs lose as little as possible, and each bit is cut at the sample's median, so every bit halves the data. One
rotation yields as many bits as a vector has components; further rotations, learned from other starts, lengthen the
code. The code is cut into substrings, one hash table each (multi-index hashing): vectors that differ in few bits agree
in some substring. Vectors that share a substring are compared in their original form, in double precision.

How many tables it takes is measured, not guessed: vectors of the sample get a partner exactly at the threshold in a
random direction, and tables are added until at most ``1 - recall`` of these hardest pairs share no substring. Pairs
above the threshold agree in more bits and are found more often still.

Equal vectors are one vector with a count before anything else, so hot vectors are one row. A pair that several tables
offer is judged in the first of them only. Members of a table's bucket are compared in blocks; only a count of links
for each member and the edges of a spanning forest leave a task, never the pairs themselves. A hot bucket's blocks are
many tasks' work. The work inside one group of different vectors that are all alike grows with its square, spread over
blocks, as every link has to be counted.

Vectors that are null, zero, or hold null or non-finite components link with nothing; neither do rows without an id.
Shorter vectors count as padded by zeros. Repeated rows are vectors of their own, linked with their copies. Empty tables give empty
results, and other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .durable import durable, in_arrow, look_up


@dataclass(frozen=True)
class LinkConfig:
    """Least cosine of a link, share of pairs just there that must be found, vectors that rotations are learned from at most, rounds of learning, bits of a substring (null: by the number of vectors), and vectors of a block."""

    threshold: float = 0.9
    recall: float = 0.995
    sample: int = 4096
    rounds: int = 30
    bits: int | None = None
    block: int = 1024


#: Longest code, as substrings; reached only where vectors have so little variety that codes can't tell them apart.
MOST_TABLES = 512

#: Directions that codes are learned from at least.
FEWEST = 256

#: Buckets of over one block that may be broadcast with their sizes (16 bytes each).
FEW_BUCKETS = 1_000_000


@dataclass(frozen=True)
class Codes:
    """Learned codes: a bit is whether a vector's projection exceeds its cut; ``bits`` neighbouring ones are a table's substring."""

    projection: np.ndarray
    cuts: np.ndarray
    bits: int

    @property
    def tables(self) -> int:
        return len(self.cuts) // self.bits

    def substrings(self, units: np.ndarray) -> np.ndarray:
        """vectors x tables, each cell the table's substring as a number."""
        on = (units @ self.projection > self.cuts).reshape(len(units), self.tables, self.bits)
        return on @ (1 << np.arange(self.bits, dtype=np.int64))


def learn_rotation(v: np.ndarray, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """The rotation of ``v`` whose signs are nearest to it: codes by rotation and rotation by codes in turn."""
    turn = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
    for _ in range(rounds):
        signs = np.where(v @ turn > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ v)
        turn = (left @ right).T
    return turn


def learn_codes(units: np.ndarray, number: int, config: LinkConfig) -> Codes:
    """Codes for ``number`` vectors, learned from the unit vectors of a sample.

    Substrings have about log2 of the number of vectors bits, less five, so buckets keep a few dozen vectors at any size.
    A sample of few vectors is filled up with random directions, as a cut halfway between two vectors would part them in every bit.
    """
    rng = np.random.default_rng(20_240_601)
    bits = config.bits or max(8, math.ceil(math.log2(max(2, number))) - 5)
    picked = units[rng.integers(0, len(units), 4096)]
    if len(units) < FEWEST:
        units = np.vstack([units, _units(rng.standard_normal((FEWEST - len(units), units.shape[1])))])
    mean = units.mean(axis=0)
    axes = np.linalg.svd(units - mean, full_matrices=True)[2].T
    v = (units - mean) @ axes
    aside = rng.standard_normal(picked.shape)
    aside -= (aside * picked).sum(1, keepdims=True) * picked
    size = np.linalg.norm(aside, axis=1, keepdims=True)
    partners = config.threshold * picked + math.sqrt(1 - config.threshold**2) * aside / np.where(size > 0, size, 1)
    columns, cuts = np.empty((units.shape[1], 0)), np.empty(0)
    missed, done = np.ones(len(picked), bool), 0
    while done < MOST_TABLES and missed.mean() > 1 - config.recall:
        while len(cuts) < (done + 1) * bits:
            more = axes @ learn_rotation(v, config.rounds, rng)
            columns, cuts = np.hstack([columns, more]), np.concatenate([cuts, np.median(units @ more, axis=0)])
        here = slice(done * bits, (done + 1) * bits)
        missed &= ((picked @ columns[:, here] > cuts[here]) != (partners @ columns[:, here] > cuts[here])).any(axis=1)
        done += 1
    return Codes(columns[:, : done * bits], cuts[: done * bits], bits)


def _matrix(vectors: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors in double precision as rows, padded by zeros."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _units(m: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, as squares of very small or large ones would vanish or overflow."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _doubles(embedding: str) -> Column:
    """The vector in double precision, with one zero."""
    return F.transform(F.col(embedding).cast("array<double>"), lambda x: x + F.lit(0.0))


def different_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Every different vector that can link once: vec (doubles), node (the least id that has it) and copies."""
    vec = _doubles(embedding)
    sound = F.col(vec_id).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x) < F.lit(math.inf)) & ~F.isnan(x)) & F.exists(vec, lambda x: x != 0)
    return vectors.filter(sound).groupBy(vec.alias("vec")).agg(F.min(F.col(vec_id).cast("long")).alias("node"), F.count(F.lit(1)).alias("copies"))


def _buckets(subs: np.ndarray) -> np.ndarray:
    return (subs + (np.arange(subs.shape[1], dtype=np.int64) << 48)).ravel()


def _bucket_sizes(nodes: DataFrame, codes: Codes, width: int) -> DataFrame:
    """bucket and size of every table's buckets, counted map-side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(_buckets(codes.substrings(_units(_matrix(b["vec"], width)))))})

    return in_arrow(nodes.select("vec"), run, "bucket long").groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))


def _tabled(nodes: DataFrame, codes: Codes, width: int) -> DataFrame:
    """A row for each vector and table: bucket, node, copies, the vector and its substrings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, 256) for k in range(0, whole.num_rows, 256)):
                subs = codes.substrings(_units(_matrix(b["vec"], width)))
                rows = pa.array(np.repeat(np.arange(b.num_rows), codes.tables))
                out = {"bucket": pa.array(_buckets(subs))} | {c: b[c].take(rows) for c in ("node", "copies", "vec")}
                yield pa.RecordBatch.from_pydict(out | {"subs": pa.array([s.tobytes() for s in subs.astype(np.int32)], pa.binary()).take(rows)})

    return in_arrow(nodes.select("node", "copies", "vec"), run, "bucket long, node long, copies long, vec array<double>, subs binary")


def _judged(width: int, threshold: float):
    """Links between the rows of one bucket's pair of blocks, seen as counts and a spanning forest."""

    def links(sub: np.ndarray, u: np.ndarray, table: int, rows: slice, cols: slice) -> np.ndarray:
        """Which pairs link; pairs that an earlier table offers are left to it."""
        close = u[rows] @ u[cols].T
        on = close >= threshold
        unsure = np.argwhere(np.abs(close - threshold) < 1e-12)
        for i, j in unsure:
            a, b = u[rows][i], u[cols][j]
            on[i, j] = math.fsum(a * b) >= threshold * math.sqrt(math.fsum(a * a) * math.fsum(b * b))
        left, right = np.nonzero(on)
        for t in range(table):
            told = sub[rows][left, t] == sub[cols][right, t]
            on[left[told], right[told]] = False
            left, right = left[~told], right[~told]
        return on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table_number, node, copies, sub, u, side in _groups(batches, width):
            n = int((side == 0).sum())
            same = n == len(node)
            on = links(sub, u, table_number, slice(0, n), slice(0, n) if same else slice(n, None))
            if same:
                np.fill_diagonal(on, False)
                counts, nodes = on @ copies, node
                where = np.argwhere(np.triu(on))
            else:
                counts, nodes = np.concatenate([on @ copies[n:], copies[:n] @ on]), node
                where = np.argwhere(on) + [0, n]
            told = counts > 0
            if told.any():
                a, b = _forest(where, len(node))
                yield pa.RecordBatch.from_pydict({
                    "node": pa.array(np.concatenate([nodes[told], node[a]])),
                    "links": pa.array(np.concatenate([counts[told], np.zeros(len(a), np.int64)])),
                    "other": pa.array(np.concatenate([np.zeros(told.sum(), np.int64), node[b]]), mask=np.concatenate([np.ones(told.sum(), bool), np.zeros(len(a), bool)])),
                })

    return run


def _forest(pairs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every linked row to the least row of its component."""
    root = np.arange(n)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        before = root.copy()
        np.minimum.at(root, pairs[:, 0], low)
        np.minimum.at(root, pairs[:, 1], low)
        root = root[root]
        if (root == before).all():
            break
    moved = np.flatnonzero(root != np.arange(n))
    return root[moved], moved


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """The rows of a bucket's pair of blocks together: table, nodes, copies, substrings, unit vectors and sides, side 0 first.

    Rows come sorted by group; a group that a batch cuts is carried over. A group has at most two blocks.
    """
    held = None

    def told(t: pa.Table) -> tuple:
        return int(t["bucket"][0].as_py() >> 48), t["node"].to_numpy(), t["copies"].to_numpy(), np.frombuffer(b"".join(t["subs"].to_pylist()), np.int32).reshape(t.num_rows, -1), _units(_matrix(t["vec"], width)), t["side"].to_numpy()

    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None and held.num_rows else t
        keys = [t[c].to_numpy() for c in ("bucket", "one", "two")]
        cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if t.num_rows > 1 else np.empty(0, int)
        edges = [0, *cut.tolist()]
        for lo, hi in zip(edges, edges[1:]):
            if hi - lo > 1:
                yield told(t.slice(lo, hi - lo))
        held = t.slice(edges[-1])
    if held is not None and held.num_rows > 1:
        yield told(held)


def _paired_blocks(tabled: DataFrame, sizes: DataFrame, config: LinkConfig) -> DataFrame:
    """Rows dealt to blocks of their bucket by node; a block meets every block of its bucket, itself included.

    Buckets of one block need no look-up. The sizes of larger ones are broadcast where they are few.
    """
    large = durable(sizes.filter(F.col("size") > config.block))
    known = tabled.join(F.broadcast(large) if large.count() <= FEW_BUCKETS else large, "bucket", "left")
    told = known.withColumn("__n", F.coalesce(F.ceil(F.col("size") / config.block), F.lit(1)).cast("int"))
    told = told.withColumn("__mine", F.pmod(F.xxhash64("node"), F.col("__n")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda o: F.struct(F.least("__mine", o).alias("one"), F.greatest("__mine", o).alias("two"), (F.col("__mine") > o).cast("int").alias("side")))
    return told.withColumn("__meets", F.explode(meets)).select("bucket", F.col("__meets.one").alias("one"), F.col("__meets.two").alias("two"), F.col("__meets.side").alias("side"), "node", "copies", "vec", "subs")


def links_of(nodes: DataFrame, config: LinkConfig = LinkConfig()) -> DataFrame:
    """node, links (copies of other vectors that it links with) and other (an edge of a spanning forest, or null) in several rows a node."""
    shape = nodes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
    empty = nodes.sparkSession.createDataFrame([], "node long, links long, other long")
    if shape["n"] < 2:
        return empty
    width = shape["width"]
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(config.sample).select("vec").toArrow()
    codes = learn_codes(_units(_matrix(sample["vec"], width)), shape["n"], config)
    dealt = _paired_blocks(_tabled(nodes, codes, width), _bucket_sizes(nodes, codes, width), config)
    by = ["bucket", "one", "two"]
    return in_arrow(dealt.repartition(*by).sortWithinPartitions(*by, "side"), _judged(width, config.threshold), "node long, links long, other long")


def vector_groups(vectors: DataFrame, config: LinkConfig = LinkConfig(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept (vec_id = component_id) of every row of ``vectors``."""
    nodes = durable(different_vectors(vectors, vec_id, embedding))
    found = durable(links_of(nodes, config))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = nodes.join(counts, "node", "left").join(roots, "node", "left")
    told = durable(known.select("vec", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "node").alias("root")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(F.col(vec_id).isNotNull(), F.to_json(_doubles(embedding))).alias("__key"))
    keyed = told.withColumn("__key", F.to_json("vec")).select("__key", "links", "root", "copies")
    out = look_up(rows, keyed, "__key", "copies", vectors.count())
    root = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), root.eqNullSafe(F.col("vec_id")).alias("kept"))

"""Approximate nearest neighbours by cosine: a neighbour graph by NN-descent, and greedy search in it.

Equal vectors are one node of the graph, which keeps the smallest ids that have the vector, so hot vectors neither crowd a
node's list nor a task. The graph begins with the best neighbours inside blocks of a sorted order and improves by
rounds of joins: each node is joined with its neighbours and a sample of its reverse neighbours, and tells each of them
of the others that are nearer than what it has. A search expands the best nodes of a beam, round by round, for all
queries at once: messages go to the partitions that hold the nodes, and answers return to the queries. A sample of the
queries is answered by brute force too, and the beam doubles until the search finds enough of these answers.
"""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .durable import durable, durable_by, ship, tidy


@dataclass(frozen=True)
class GraphConfig:
    """Neighbours of a node, reverse neighbours that a round samples, rows of a first block, orders, rounds of descent at most and the share of changed neighbours that ends it before, beam width, nodes expanded in a round, nodes that a search starts from, and nodes of a partition of the graph; the beam widens until a sample of ``audited`` queries reaches ``recall``."""

    neighbours: int = 16
    reverse: int = 12
    block: int = 2048
    orders: int = 2
    rounds: int = 12
    settled: float = 0.1
    told: int = 8
    beam: int = 448
    step: int = 128
    entries: int = 1024
    part_nodes: int = 4096
    recall: float = 0.93
    audited: int = 256


_PART = np.uint64(0x9E3779B97F4A7C15)


def _part_of(nids: np.ndarray, labels: np.ndarray) -> np.ndarray:
    return labels[((nids.astype(np.uint64) * _PART) >> np.uint64(33)).astype(np.int64) % len(labels)]


def _labels(spark: SparkSession, n: int) -> np.ndarray:
    """n names of graph partitions that Spark's hash deals out evenly to n partitions: a row a partition goes to the driver."""
    rows = spark.range(64 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("id")).collect()
    free = iter(range(64 * n, 65 * n))
    found = {r["at"]: r["id"] for r in rows}
    return np.array([found[k] if k in found else next(free) for k in range(n)], dtype=np.int64)


def _longs(x: pa.Scalar) -> np.ndarray:
    buffer = x.as_buffer()
    return np.empty(0, np.int64) if buffer is None else np.frombuffer(buffer, dtype=np.int64)


def _floats(x: pa.Scalar) -> np.ndarray:
    buffer = x.as_buffer()
    return np.empty(0, np.float32) if buffer is None else np.frombuffer(buffer, dtype=np.float32)


def _parts(nodes: DataFrame, config: GraphConfig) -> int:
    """Partitions of the graph: as many as its nodes need, whatever the session's default is for shuffles."""
    return max(1, -(-nodes.count() // config.part_nodes))


def _deal(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    return rows.repartition(n, *keys).coalesce(n)


def _sweep(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of rounds that are over."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector of rows with an id, at least one component, no null or non-finite one, and a length above 0."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).filter(fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))


def _nodes(rows: DataFrame, ids_kept: int) -> DataFrame:
    """nid, v, ids (the smallest of the vector, at most ``ids_kept``) and unit (the vector at length 1, 32-bit floats) of each different vector."""
    keyed = rows.withColumn("h", F.md5(F.to_json(F.struct("v")))).dropDuplicates(["h", "id"])
    rank = F.row_number().over(Window.partitionBy("h").orderBy("id"))
    first = keyed.withColumn("n", rank).filter(F.col("n") <= ids_kept)
    nodes = first.groupBy("h").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b["v"]:
                v = np.asarray(x.values)
                v = v / np.abs(v).max()
                whole = np.zeros(width, dtype=np.float32)
                whole[: len(v)] = v / np.linalg.norm(v)
                out.append(whole.tobytes())
            yield pa.RecordBatch.from_arrays([b["v"], b["ids"], pa.array(out, pa.binary())], ["v", "ids", "unit"])

    made = nodes.select("v", "ids").mapInArrow(tidy(unit), "v array<double>, ids array<long>, unit binary")
    return durable(made.withColumn("nid", F.monotonically_increasing_id()))


def _sample(nodes: DataFrame, n: int, seed: int) -> list:
    """n nodes at most, the first in a hash order."""
    return nodes.select("nid", "unit").orderBy(F.xxhash64("unit", F.lit(seed)), "nid").limit(n).collect()


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of ids that may repeat, best first."""
    _, first = np.unique(ids, return_index=True)
    ids, scores = ids[first], scores[first]
    order = np.argsort(-scores, kind="stable")[:k]
    return ids[order], scores[order]


def _first_graph(nodes: DataFrame, config: GraphConfig) -> DataFrame:
    """nid, ids, scores: the nearest in blocks of rows sorted by nearest pivot and by a projection, over several orders."""
    found = []
    for seed in range(config.orders):
        sample = [np.frombuffer(r["unit"], np.float32) for r in _sample(nodes, config.entries, seed)]
        pivots = np.stack(sample) if sample else np.empty((0, 1), np.float32)

        def cell(batches: Iterator[pa.RecordBatch], pivots: np.ndarray = pivots) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.frombuffer(b"".join(b["unit"].to_pylist()), np.float32).reshape(b.num_rows, -1)
                close = x @ pivots.T
                at = close.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([b["nid"], b["unit"], pa.array(at, pa.int64()), pa.array(close[:, 0], pa.float32())], ["nid", "unit", "cell", "place"])

        def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nids: list[int] = []
            units: list[bytes] = []
            for b in batches:
                nids += b["nid"].to_pylist()
                units += b["unit"].to_pylist()
                while len(nids) >= 2 * config.block:
                    yield near(nids[: config.block], units[: config.block])
                    nids, units = nids[config.block :], units[config.block :]
            if nids:
                yield near(nids, units)

        def near(nids: list[int], units: list[bytes]) -> pa.RecordBatch:
            own, x = np.array(nids), np.frombuffer(b"".join(units), np.float32).reshape(len(nids), -1)
            k = min(config.neighbours, len(own) - 1)
            ids, scores = [], []
            for a in range(0, len(own), 512):
                close = x[a : a + 512] @ x.T
                close[np.arange(len(close)), np.arange(a, a + len(close))] = -9
                top = np.argpartition(-close, k, axis=1)[:, :k] if k < len(own) - 1 else np.argsort(-close, axis=1)[:, :k]
                for row, t in zip(close, top, strict=True):
                    ids.append(own[t].tobytes())
                    scores.append(row[t].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(ids, pa.binary()), pa.array(scores, pa.binary())], ["nid", "ids", "scores"])

        placed = nodes.select("nid", "unit").mapInArrow(tidy(cell), "nid long, unit binary, cell long, place float")
        blocks = max(1, nodes.count() // (2 * config.block))
        ordered = placed.repartitionByRange(blocks, "cell", "place").coalesce(blocks).sortWithinPartitions("cell", "place")
        found.append(ordered.select("nid", "unit").mapInArrow(tidy(block), "nid long, ids binary, scores binary"))
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def _merge_lists(lists: DataFrame, k: int, n: int) -> DataFrame:
    """One row per nid: its k best, which of them are new, that is, not from a row with old = true, and how many."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, scores, old = None, [], [], np.empty(0, np.int64)
        out: list[tuple] = []

        def close() -> None:
            kept, score = _best(np.concatenate(ids), np.concatenate(scores), k)
            new = ~np.isin(kept, old)
            out.append((now, kept.tobytes(), score.tobytes(), new.tobytes(), int(new.sum())))

        for b in batches:
            for nid, i, s, o in zip(b["nid"].to_pylist(), b["ids"], b["scores"], b["old"].to_pylist(), strict=True):
                if nid != now:
                    if ids:
                        close()
                    now, ids, scores, old = nid, [], [], np.empty(0, np.int64)
                ids.append(_longs(i))
                scores.append(_floats(s))
                if o:
                    old = ids[-1]
            if len(out) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out.clear()
        if ids:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names, kinds = ["nid", "ids", "scores", "new", "fresh"], [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    rows = _deal(lists, n, "nid").sortWithinPartitions("nid", "old")
    return durable(rows.select("nid", "ids", "scores", "old").mapInArrow(tidy(merge), "nid long, ids binary, scores binary, new binary, fresh long"))


def build_graph(nodes: DataFrame, config: GraphConfig = GraphConfig()) -> DataFrame:
    """nid, ids, scores, new, fresh (how many of them are new): the neighbour graph of ``nodes`` (nid, unit) by NN-descent."""
    spark = nodes.sparkSession
    ship(spark)
    n = _parts(nodes, config)
    graph = _merge_lists(_first_graph(nodes, config).withColumn("old", F.lit(False)), config.neighbours, n)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [_longs(x) for x in b["ids"]]
            owner = np.repeat(np.asarray(b["nid"]), [len(x) for x in ids])
            new = np.concatenate([np.frombuffer(x.as_buffer(), bool) for x in b["new"]] or [np.empty(0, bool)])
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate([*ids, np.empty(0, np.int64)])), pa.array(new)], ["centre", "member", "new"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        out: list[tuple] = []

        def close() -> None:
            members, new, least, units = zip(*{m[0]: m for m in sorted(held, key=lambda m: m[1])}.values(), strict=True)
            x = np.frombuffer(b"".join(units), np.float16).reshape(len(members), -1).astype(np.float32)
            members, new, least = np.array(members), np.array(new), np.array(least)
            close = x @ x.T
            close[~(new[:, None] | new[None, :])] = -9
            np.fill_diagonal(close, -9)
            good = close > least[:, None]
            for k in np.flatnonzero(good.any(axis=1)).tolist():
                at = np.flatnonzero(good[k])
                if len(at) > config.told:
                    at = at[np.argsort(-close[k, at])[: config.told]]
                out.append((int(members[k]), members[at].tobytes(), close[k, at].tobytes()))

        def batch() -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, ["nid", "ids", "scores"])

        for b in batches:
            for centre, *row in zip(b["centre"].to_pylist(), b["member"].to_pylist(), b["new"].to_pylist(), b["least"].to_pylist(), b["half"].to_pylist(), strict=True):
                if centre != now:
                    if len(held) > 1:
                        close()
                    now, held = centre, []
                held.append(row)
            if len(out) > 4096:
                yield batch()
        if len(held) > 1:
            close()
        if out:
            yield batch()

    def card(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = [float(s[-1]) if len(s := _floats(x)) == config.neighbours else -2.0 for x in b["scores"]]
            half = [np.frombuffer(x.as_buffer(), np.float32).astype(np.float16).tobytes() for x in b["unit"]]
            yield pa.RecordBatch.from_arrays([b["nid"], pa.array(least, pa.float32()), pa.array(half, pa.binary())], ["member", "least", "half"])

    entries = nodes.count() * config.neighbours
    for k in range(config.rounds):
        if k and graph.agg(F.coalesce(F.sum("fresh"), F.lit(0))).first()[0] <= config.settled * entries:
            break
        forward = graph.select("nid", "ids", "new").mapInArrow(tidy(edges), "centre long, member long, new boolean")
        back = forward.select(F.col("member").alias("centre"), F.col("centre").alias("member"), "new")
        order = F.row_number().over(Window.partitionBy("centre").orderBy(F.xxhash64("member", F.lit(k))))
        back = back.withColumn("n", order).filter(F.col("n") <= config.reverse).drop("n")
        cards = graph.select("nid", "scores").join(nodes.select("nid", "unit"), "nid").select("nid", "scores", "unit").mapInArrow(tidy(card), "member long, least float, half binary")
        members = forward.unionByName(back).join(cards, "member")
        members = _deal(members, n, "centre").sortWithinPartitions("centre")
        told = members.select("centre", "member", "new", "least", "half").mapInArrow(tidy(meet), "nid long, ids binary, scores binary")
        graph = _merge_lists(graph.select("nid", "ids", "scores").withColumn("old", F.lit(True)).unionByName(told.withColumn("old", F.lit(False))), config.neighbours, n)
        _sweep(spark)
    return graph


def _undirected(graph: DataFrame, reverse: int) -> DataFrame:
    """nid and links: neighbours and a sample of reverse neighbours."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [_longs(x) for x in b["ids"]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*ids, np.empty(0, np.int64)])), pa.array(np.repeat(np.asarray(b["nid"]), [len(x) for x in ids]))], ["nid", "other"])

    back = graph.select("nid", "ids").mapInArrow(tidy(edges), "nid long, other long")
    order = F.row_number().over(Window.partitionBy("nid").orderBy(F.xxhash64("other")))
    back = back.withColumn("n", order).filter(F.col("n") <= reverse).groupBy("nid").agg(F.collect_list("other").alias("back"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            links = [np.unique(np.concatenate([_longs(x), np.array(y or [], dtype=np.int64)])).tobytes() for x, y in zip(b["ids"], b["back"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["nid"], pa.array(links, pa.binary())], ["nid", "links"])

    return graph.select("nid", "ids").join(back, "nid", "left").select("nid", "ids", "back").mapInArrow(tidy(join), "nid long, links binary")


_STATE = "qid long, kind int, unit binary, ids binary, scores binary, done binary, pending binary, frontier binary"
_NAMES = [c.split()[0] for c in _STATE.split(", ")]


def placed_graph(nodes: DataFrame, graph: DataFrame, config: GraphConfig = GraphConfig()) -> tuple[DataFrame, np.ndarray]:
    """The graph as searches read it, dealt out to its partitions, and the names of these."""
    spark = nodes.sparkSession
    ship(spark)
    n = _parts(nodes, config)
    labels = _labels(spark, n)

    def where(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_part_of(np.asarray(b["nid"]), labels)), *(b[c] for c in ("nid", "unit", "links"))], ["part", "nid", "unit", "links"])

    placed = nodes.select("nid", "unit").join(_undirected(graph, config.neighbours), "nid").select("nid", "unit", "links").mapInArrow(tidy(where), "part long, nid long, unit binary, links binary")
    none = lambda kind: F.lit(None).cast(kind)
    placed = placed.select("part", F.lit(0).alias("kind"), "nid", "unit", none("float").alias("least"), F.col("links").alias("score"), none("binary").alias("expand"))
    # The graph is dealt out once; a union with messages that are dealt out alike keeps it where it is.
    return durable_by(placed, "part", n), labels


def search_graph(nodes: DataFrame, graph: DataFrame, queries: DataFrame, config: GraphConfig = GraphConfig(), where: tuple[DataFrame, np.ndarray] | None = None) -> DataFrame:
    """qid and ids (nodes, best first) of the beam that a greedy search ends with, for ``queries`` (qid, unit, start: a node or null). ``where``: :func:`placed_graph`, if it is there already."""
    spark = nodes.sparkSession
    placed, labels = where or placed_graph(nodes, graph, config)
    n = len(labels)  # a query sends at most one message a round to a partition
    sample = _sample(nodes, config.entries, -1)
    entry_ids = np.array([r["nid"] for r in sample], dtype=np.int64)
    entry_units = np.stack([np.frombuffer(r["unit"], np.float32) for r in sample]) if sample else np.empty((0, 1), np.float32)
    entries = spark.sparkContext.broadcast((entry_ids, entry_units))
    stays = spark.conf.get("spark.sql.unionOutputPartitioning") == "true"

    def state_row(qid: int, unit: bytes, ids: np.ndarray, scores: np.ndarray, done: np.ndarray, pending: np.ndarray) -> tuple:
        """Choose the next nodes to expand and mark them."""
        front = np.flatnonzero(~done)[: config.step]
        done = done.copy()
        done[front] = True
        return (qid, 0, unit, ids.tobytes(), scores.astype(np.float32).tobytes(), done.tobytes(), pending.tobytes(), ids[front].tobytes())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entry_ids, entry_units = entries.value
        for b in batches:
            rows = []
            for qid, unit, start in zip(b["qid"].to_pylist(), b["unit"].to_pylist(), b["start"].to_pylist(), strict=True):
                ids, scores = _best(entry_ids, entry_units @ np.frombuffer(unit, np.float32), config.step)
                pending = np.array([] if start is None or start in ids else [start], dtype=np.int64)
                rows.append(state_row(qid, unit, ids, scores, np.zeros(len(ids), bool), pending))
            if rows:
                yield batch_of(rows)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for qid, unit, scores, pending, frontier in zip(b["qid"].to_pylist(), b["unit"].to_pylist(), b["scores"], b["pending"], b["frontier"], strict=True):
                pending, frontier, scores = _longs(pending), _longs(frontier), _floats(scores)
                least = float(scores[-1]) if len(scores) == config.beam else -2.0
                to_score, to_expand = _part_of(pending, labels), _part_of(frontier, labels)
                targets = np.unique(np.concatenate([to_score, to_expand]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(targets), pa.array([1] * len(targets), pa.int32()), pa.array([qid] * len(targets), pa.int64()), pa.array([unit] * len(targets), pa.binary()), pa.array([least] * len(targets), pa.float32()), pa.array([pending[to_score == t].tobytes() for t in targets], pa.binary()), pa.array([frontier[to_expand == t].tobytes() for t in targets], pa.binary())],
                    ["part", "kind", "nid", "unit", "least", "score", "expand"],
                )

    def serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nids, units, links, table = None, [], [], [], None
        out: list[tuple] = []
        for b in batches:
            for part, kind, nid, unit, least, score, expand in zip(*(b[c].to_pylist() for c in ("part", "kind", "nid", "unit", "least", "score", "expand")), strict=True):
                if part != now:
                    now, nids, units, links, table = part, [], [], [], None
                if kind == 0:
                    nids.append(nid)
                    units.append(unit)
                    links.append(score)
                    continue
                if table is None:
                    order = np.argsort(nids)
                    table = np.array(nids)[order], np.frombuffer(b"".join(units), np.float32).reshape(len(units), -1)[order], [links[k] for k in order]
                known, x, out_links = table
                ids = np.frombuffer(score, np.int64)
                close = x[np.searchsorted(known, ids)] @ np.frombuffer(unit, np.float32)
                good = close > least
                more = b"".join([out_links[k] for k in np.searchsorted(known, np.frombuffer(expand, np.int64))])
                out.append((nid, 1, None, ids[good].tobytes(), close[good].astype(np.float32).tobytes(), None, more, None))
            if len(out) > 512:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, ids, scores, more = None, [], [], []
        out: list[tuple] = []

        def close() -> tuple:
            qid, unit, own, own_scores, done, over = state
            if over:
                return (qid, 0, unit, own.tobytes(), own_scores.tobytes(), done.tobytes(), b"", b"")
            found, found_scores = _best(np.concatenate([own, *ids]), np.concatenate([own_scores, *scores]), config.beam)
            was_done = np.isin(found, own[done])
            nexts = np.unique(np.concatenate([np.empty(0, np.int64), *more]))
            return state_row(qid, unit, found, found_scores, was_done, np.setdiff1d(nexts, found, assume_unique=True))

        for b in batches:
            for qid, kind, unit, i, s, d, p, f in zip(b["qid"].to_pylist(), b["kind"].to_pylist(), b["unit"].to_pylist(), b["ids"], b["scores"], b["done"], b["pending"], b["frontier"], strict=True):
                if kind == 0:
                    if state is not None:
                        out.append(close())
                    done = np.frombuffer(d.as_buffer(), bool)
                    state, ids, scores, more = (qid, unit, _longs(i), _floats(s), done, not len(_longs(p)) and not len(_longs(f))), [], [], []
                else:
                    ids.append(_longs(i))
                    scores.append(_floats(s))
                    more.append(_longs(p))
            if len(out) > 512:
                yield batch_of(out)
                out = []
        if state is not None:
            out.append(close())
        if out:
            yield batch_of(out)

    state = durable(_deal(queries.select("qid", "unit", "start"), n, "qid").mapInArrow(tidy(begin), _STATE))
    active = (F.octet_length("pending") > 0) | (F.octet_length("frontier") > 0)
    turn = 0
    while turn % 2 or state.filter(active).limit(1).count():  # a round of nothing is harmless
        messages = state.filter(active).select("qid", "unit", "scores", "pending", "frontier").mapInArrow(tidy(send), "part long, kind int, nid long, unit binary, least float, score binary, expand binary")
        both = placed.unionByName(messages.repartition(n, "part")) if stays else placed.unionByName(messages).repartition(n, "part")
        replies = both.sortWithinPartitions("part", "kind").mapInArrow(tidy(serve), _STATE)
        state = durable(_deal(state.unionByName(replies), n, "qid").sortWithinPartitions("qid", "kind").mapInArrow(tidy(advance), _STATE))
        turn += 1
        if turn % 4 == 0:
            _sweep(spark)
    return state.select("qid", "ids", "scores")


#: Nodes that a search starts from at most, however wide its beam: they go through the driver.
_MOST_ENTRIES = 1 << 14


def _audit(nodes: DataFrame, queries: DataFrame, k: int, n: int) -> dict[int, np.ndarray]:
    """The best k scores by brute force, best first, of n of the queries at most, without the query's own node."""
    sample = queries.select("qid", "unit").orderBy(F.xxhash64("qid", F.lit(-2)), "qid").limit(n).collect()
    if not sample:
        return {}
    qids = np.array([r["qid"] for r in sample])
    units = np.array([np.frombuffer(r["unit"], np.float32) for r in sample])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(qids), k), -2, dtype=np.float32)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                some = b.slice(at, 4096)
                close = units @ np.array([_floats(x) for x in some["unit"]]).T
                close[qids[:, None] == np.asarray(some["nid"])[None, :]] = -2
                best = np.sort(np.concatenate([best, close], axis=1), axis=1)[:, -k:]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, k)), pa.array(best.ravel())], ["qid", "score"])

    scores = nodes.select("nid", "unit").mapInArrow(tidy(score), "qid long, score float").filter("score > -2")
    top = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score")))
    out: dict[int, list[float]] = {int(q): [] for q in qids}
    for r in scores.withColumn("n", top).filter(F.col("n") <= k).collect():  # n * k rows at most
        out[r["qid"]].append(r["score"])
    return {q: np.sort(np.array(x, dtype=np.float32))[::-1] for q, x in out.items() if x}


def _recall(beams: DataFrame, audit: dict[int, np.ndarray], kept: int) -> float:
    """The share of the audited scores that the first ``kept`` nodes of the beams reach; ties count as found."""
    mine = beams.sparkSession.createDataFrame([(q,) for q in audit], "qid long")
    hits = 0
    for r in beams.join(F.broadcast(mine), "qid").collect():
        ids, scores, best = np.frombuffer(r["ids"], np.int64)[:kept], np.frombuffer(r["scores"], np.float32)[:kept], audit[r["qid"]]
        hits += min(len(best), int((scores[ids != r["qid"]] >= best[-1] - 1e-5).sum()))
    return hits / sum(len(x) for x in audit.values())


def _searched(nodes: DataFrame, queries: DataFrame, k: int, config: GraphConfig) -> DataFrame:
    """The beams of the queries, as wide as the audit's recall demands. The audited queries find the width, so all others are searched once."""
    nodes = nodes.select("nid", "unit")
    graph, count = build_graph(nodes, config), nodes.count()
    audit = _audit(nodes, queries, k, config.audited)
    where = placed_graph(nodes, graph, config)
    some = queries.join(F.broadcast(nodes.sparkSession.createDataFrame([(q,) for q in audit], "qid long")), "qid", "left_semi")
    while audit:
        beams = search_graph(nodes, graph, some, config, where)
        if (reached := _recall(beams, audit, 4 * k + 4)) >= config.recall:
            break
        if config.beam >= count and config.entries >= min(count, _MOST_ENTRIES):
            raise RuntimeError(f"recall {reached:.3f} of {len(audit)} audited queries is below {config.recall}")
        config = replace(config, beam=2 * config.beam, step=2 * config.step, entries=max(config.entries, min(2 * config.entries, _MOST_ENTRIES)))
    rest = queries.join(some.select("qid"), "qid", "left_anti")
    others = search_graph(nodes, graph, rest, config, where)
    return beams.unionByName(others) if audit else others


def nearest(vectors: DataFrame, is_query: Callable[[], object] | None = None, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", config: GraphConfig = GraphConfig()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query, best first, ties to the smaller id.

    ``is_query`` is a condition on column ``id``; by default ids divisible by 50. Score is the cosine in double precision
    of the original vectors. Rows without an id, and vectors that are null, empty, zero or hold a null or non-finite
    component, take no part; shorter vectors count as padded with zeros. Rows that repeat id and vector are one row,
    and a query's candidates are all rows with other ids. Rows with equal vectors are one node, so ties among them are
    exact: a node's smallest k + 1 ids are enough for a query. With fewer than k candidates all are returned, and an
    empty table gives an empty result. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = usable(vectors, id_col, vector_col)
    nodes = _nodes(rows, k + 1)
    chosen = F.col("id") % 50 == 0 if is_query is None else is_query()
    asked = rows.filter(chosen).withColumn("h", F.md5(F.to_json(F.struct("v")))).dropDuplicates(["h", "id"])
    # Queries with one vector share a search; its start is the vector's own node.
    at = nodes.select("nid", "unit", F.md5(F.to_json(F.struct("v"))).alias("h"))
    distinct = asked.select("h").distinct().join(at, "h").select(F.col("nid").alias("qid"), "unit", F.col("nid").alias("start"), "h")
    distinct = durable(distinct)
    beams = _searched(nodes, distinct, k, config)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = []
            for x, y in zip(b["ids"], b["scores"], strict=True):
                scores = _floats(y)  # what 32 bits can't tell from the k-th goes on too
                close = int((scores >= scores[min(k, len(scores) - 1)] - 1e-5).sum()) if len(scores) else 0
                ids.append(_longs(x)[: max(4 * k + 4, close)])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b["qid"]), [len(x) for x in ids])), pa.array(np.concatenate([*ids, np.empty(0, np.int64)]))], ["qid", "nid"])

    pairs = beams.mapInArrow(tidy(unpack), "qid long, nid long")
    found = pairs.join(nodes.select("nid", "v", "ids"), "nid").join(nodes.select(F.col("nid").alias("qid"), F.col("v").alias("q")), "qid")

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = []
            for x, y in zip(b["v"], b["q"], strict=True):
                x, y = np.asarray(x.values), np.asarray(y.values)
                m = min(len(x), len(y))
                scores.append(float(x[:m] @ y[:m] / np.sqrt((x @ x) * (y @ y))))
            yield pa.RecordBatch.from_arrays([b["qid"], b["ids"], pa.array(scores, pa.float64())], ["qid", "ids", "score"])

    scored = found.select("qid", "v", "q", "ids").mapInArrow(tidy(cosine), "qid long, ids array<long>, score double")
    near = scored.select("qid", "score", F.explode("ids").alias("vec_id"))
    top = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    near = durable(near.withColumn("n", top).filter(F.col("n") <= k + 1).drop("n"))  # one of them may be the query itself
    lists = near.groupBy("qid").agg(F.collect_list(F.struct("score", "vec_id")).alias("found"))
    per_query = asked.select("id", "h").join(distinct.select("h", "qid"), "h").join(lists, "qid")
    answers = per_query.select(F.col("id").alias("query_id"), F.explode("found").alias("x")).select("query_id", "x.vec_id", "x.score").filter("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Closed frequent itemsets of baskets and the association rules inside them.

Baskets keep their frequent items only, equal baskets are folded into one with a count, and what is left is dealt out
to blocks, each a sparse basket-item matrix of bounded size. The search goes level by level. A frontier of prefixes
goes to every block; there a batch of prefixes becomes a sparse prefix-occurrence matrix (which baskets hold all of a
prefix), and its product with the basket-item matrix gives the supports of all one-item extensions of the whole batch
at once. Spark adds up the blocks' products. In a prefix's row the columns whose support equals the prefix's own are
its closure. A closure is reached from several prefixes, so it has one canonical owner: the prefix whose closure adds
no item below the item that the prefix added last (ids give the order); all others are dropped without a shuffle.
The owner's other frequent columns above that item are the prefixes of the next level.

A hot basket or item costs no more than others: baskets hold frequent items only, at most ``2000`` times the mean
basket's items by the support's share, and a block holds a bounded part of an item's baskets. The driver sees counts.
No frontier, item list or basket is collected or broadcast beyond a checked size.

Rows without a basket or item take no part, repeated rows count once. An empty table gives an empty result. Other
columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable, durable_by, look_up, parts, ship

#: Cells of a product that a task holds at once, and frequent items that may be broadcast (8 bytes each).
CELLS, FEW_ITEMS = 4_000_000, 1_000_000


@dataclass(frozen=True)
class BasketConfig:
    """Least support as baskets and as one of ``share`` baskets, least confidence in per cent, and basket entries of a block of the matrix."""

    least: int = 8
    share: int = 2000
    confidence: int = 10
    block_entries: int = 2_000_000


class Block:
    """A sparse basket-item matrix by rows and by columns: folded baskets with their counts, items by position."""

    def __init__(self, baskets: pa.ChunkedArray | pa.Array, counts: np.ndarray) -> None:
        lists = baskets.combine_chunks() if isinstance(baskets, pa.ChunkedArray) else baskets
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        self.sizes = np.diff(lists.offsets.to_numpy())
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.items, self.at = np.unique(flat, return_inverse=True)
        self.counts = counts
        order = np.argsort(self.at, kind="stable")
        self.holders = np.repeat(np.arange(len(self.sizes)), self.sizes)[order]
        self.item_starts = np.searchsorted(self.at[order], np.arange(len(self.items) + 1))

    def columns(self, prefix: np.ndarray) -> list[np.ndarray] | None:
        """The rows that hold each item of the prefix, fewest first; None if some item is nowhere here."""
        where = np.searchsorted(self.items, prefix)
        if (where == len(self.items)).any() or (self.items[np.minimum(where, len(self.items) - 1)] != prefix).any():
            return None
        return sorted((self.holders[self.item_starts[w] : self.item_starts[w + 1]] for w in where), key=len)

    def occurrences(self, prefix: np.ndarray) -> np.ndarray:
        """Rows of the baskets that hold all items of the prefix."""
        held = self.columns(prefix)
        if held is None:
            return np.empty(0, np.int64)
        rows = held[0]
        for other in held[1:]:
            if not len(rows):
                break
            near = np.minimum(np.searchsorted(other, rows), len(other) - 1)
            rows = rows[other[near] == rows]
        return rows

    def product(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Prefix, item and support of every non-zero cell of the prefix-occurrence matrix (a row of baskets each) times this one."""
        prefix = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        basket = np.concatenate(rows) if rows else np.empty(0, np.int64)
        n = self.sizes[basket]
        ends = np.cumsum(n)
        entry = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(self.starts[basket], n)
        cell = np.repeat(prefix, n) * len(self.items) + self.at[entry]
        sums = np.bincount(cell, weights=np.repeat(self.counts[basket], n), minlength=0).astype(np.int64)
        found = np.flatnonzero(sums)
        return found // max(1, len(self.items)), self.items[found % max(1, len(self.items))], sums[found]


def _batches(block: Block, sets: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Batches of prefixes (the first's number, occurrences of each) whose product and gathered entries have a bounded size."""
    width = max(1, len(block.items))
    rows: list[np.ndarray] = []
    first = entries = 0
    for k, s in enumerate(sets):
        found = block.occurrences(s)
        size = int(block.sizes[found].sum())
        if rows and (entries + size > CELLS or (len(rows) + 1) * width > CELLS):
            yield first, rows
            rows, first, entries = [], k, 0
        rows.append(found)
        entries += size
    if rows:
        yield first, rows


def _extension_supports(key: tuple, baskets: pa.Table, sets: pa.Table) -> pa.Table:
    """Set number, item and support in this block of all one-item extensions of the sets, the sets' own items included."""
    block = _block(baskets)
    prefixes = [np.asarray(s, np.int64) for s in sets["items"].to_pylist()]
    numbers = sets["id"].to_numpy()
    found = []
    for first, rows in _batches(block, prefixes):
        p, item, n = block.product(rows)
        found.append((numbers[first + p], item, n))
    cols = [np.concatenate(c) if c else np.empty(0, np.int64) for c in (zip(*found) if found else [(), (), ()])]
    return pa.table({"id": pa.array(cols[0], pa.int64()), "item": pa.array(cols[1], pa.int64()), "n": pa.array(cols[2], pa.int64())})


def _supports(key: tuple, baskets: pa.Table, sets: pa.Table) -> pa.Table:
    """Set number and support in this block of the sets."""
    block = _block(baskets)
    n = [int(block.counts[block.occurrences(np.asarray(s, np.int64))].sum()) for s in sets["items"].to_pylist()]
    return pa.table({"id": pa.array(sets["id"].to_numpy(), pa.int64()), "n": pa.array(n, pa.int64())})


def _block(baskets: pa.Table) -> Block:
    return Block(baskets["items"], baskets["n"].to_numpy())


def _in_blocks(blocks: DataFrame, number: int, sets: DataFrame, f, schema: str) -> DataFrame:
    """``f`` of every block with all of the sets (columns id and items): a stated query set against all rows, in blocks."""
    ship(blocks.sparkSession)
    everywhere = sets.select("id", "items").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(number - 1))))
    return blocks.groupBy("block").cogroup(everywhere.groupBy("block")).applyInArrow(f, schema)


def entries(lines: DataFrame, basket: Column, item: Column) -> DataFrame:
    """Distinct basket and item of the rows that have both, dealt out by both, so that a hot basket or item is many tasks' work."""
    return durable(lines.select(basket.cast("long").alias("basket"), item.cast("long").alias("item")).filter("basket IS NOT NULL AND item IS NOT NULL").distinct())


def _frequent_entries(found: DataFrame, items: DataFrame, few: bool) -> DataFrame:
    if few:
        return found.join(F.broadcast(items.select("item")), "item")
    return look_up(found, items.select("item", F.col("support").alias("size")), "item", "size", found.count()).filter("size IS NOT NULL").drop("size")


def _folded(found: DataFrame) -> DataFrame:
    """Each different basket once (items ascending) with the number of baskets that equal it."""
    return found.groupBy("basket").agg(F.sort_array(F.collect_list("item")).alias("items")).groupBy("items").agg(F.count(F.lit(1)).alias("n"))


class _Miner:
    """Supports of itemsets over the blocks of the folded baskets."""

    def __init__(self, found: DataFrame, items: DataFrame, least: int, config: BasketConfig) -> None:
        few = items.count() <= FEW_ITEMS
        folded = durable(_folded(_frequent_entries(found, items, few)))
        total = folded.agg(F.sum(F.size("items"))).first()[0] or 0
        self.number = max(1, -(-total // config.block_entries), min(parts(found.sparkSession), -(-total // 20_000)))
        self.least = least
        self.blocks = durable_by(folded.withColumn("block", F.pmod(F.xxhash64("items"), F.lit(self.number)).cast("int")), "block", self.number)

    def extensions(self, frontier: DataFrame) -> DataFrame:
        """id, support and exts (item and support of every frequent extension, items ascending) of the frontier's sets."""
        cells = _in_blocks(self.blocks, self.number, frontier, _extension_supports, "id long, item long, n long")
        sums = cells.groupBy("id", "item").agg(F.sum("n").alias("n")).filter(F.col("n") >= self.least)
        return sums.groupBy("id").agg(F.max("n").alias("support"), F.sort_array(F.collect_list(F.struct("item", "n"))).alias("exts"))

    def supports(self, sets: DataFrame) -> DataFrame:
        """The rows of ``sets`` with their support."""
        numbered = durable(sets.withColumn("id", F.monotonically_increasing_id()))
        cells = _in_blocks(self.blocks, self.number, numbered, _supports, "id long, n long")
        return numbered.join(cells.groupBy("id").agg(F.sum("n").alias("support")), "id").drop("id")


def closed_sets(miner: _Miner, items: DataFrame) -> DataFrame:
    """items (ascending) and support of every closed frequent itemset; ``items`` has the frequent items.

    A level of the search is a row for each prefix: the closed set that it extends with one item, that item, and
    nothing else. What a level finds is written before the next begins, so lost executors repeat one level at most.
    """
    frontier = items.select(F.array("item").alias("items"), F.col("item").alias("core"), F.array().cast("array<bigint>").alias("parent"))
    out = None
    while True:
        numbered = durable(frontier.withColumn("id", F.monotonically_increasing_id()))
        if numbered.isEmpty():
            return out if out is not None else numbered.select("items", F.lit(0).cast("long").alias("support"))
        rows = numbered.join(miner.extensions(numbered), "id")
        closure = F.transform(F.filter("exts", lambda e: e["n"] == F.col("support")), lambda e: e["item"])
        closed = rows.withColumn("closure", closure)
        owned = ~F.exists("closure", lambda i: (i < F.col("core")) & ~F.array_contains("parent", i))
        level = durable(closed.filter(owned).select("closure", "support", "core", "exts"))
        found = level.select(F.col("closure").alias("items"), "support")
        out = found if out is None else out.unionByName(found)
        grown = level.select("closure", F.explode(F.filter("exts", lambda e: (e["item"] > F.col("core")) & (e["n"] < F.col("support")))["item"]).alias("core"))
        frontier = grown.select(F.array_sort(F.array_append("closure", F.col("core"))).alias("items"), "core", F.col("closure").alias("parent"))


def _rules(miner: _Miner, closed: DataFrame, items: DataFrame, baskets: int, config: BasketConfig) -> DataFrame:
    """items and rules (array of c, a, s, c ascending) of the closed sets that have rules.

    The support of the rest comes from one more pass over the blocks for all different rests of two items or more.
    """
    parted = closed.filter(F.size("items") > 1).select("items", "support", F.explode("items").alias("c")).withColumn("rest", F.array_remove("items", F.col("c")))
    single = items.select("item", F.col("support").alias("s"))
    rests = durable(parted.filter(F.size("rest") > 1).select(F.col("rest").alias("items")).distinct())
    known = miner.supports(rests).unionByName(single.select(F.array("item").alias("items"), F.col("s").alias("support"))).select(F.col("items").alias("rest"), F.col("support").alias("a"))
    joined = parted.join(known, "rest").join(single, parted["c"] == single["item"])
    # products of longs, as both factors are counts of baskets
    good = joined.filter((F.lit(100) * F.col("support") >= F.lit(config.confidence) * F.col("a")) & (F.col("support") * F.lit(baskets).cast("long") > F.col("a") * F.col("s")))
    return good.groupBy("items").agg(F.sort_array(F.collect_list(F.struct("c", "a", "s"))).alias("rules"))


def frequent_closed_sets(lines: DataFrame, basket: Column, item: Column, config: BasketConfig = BasketConfig()) -> DataFrame:
    """items (array, ascending), support and rules (array of structs c, a, s) of every closed frequent itemset of the rows of ``lines``.

    A rule takes one item c out of the set: ``a`` is the support of the rest and ``s`` that of c alone.
    """
    found = entries(lines, basket, item)
    baskets = found.select("basket").distinct().count()
    least = max(config.least, -(-baskets // config.share))
    items = durable(found.groupBy("item").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= least))
    miner = _Miner(found, items, least, config)
    closed = durable(closed_sets(miner, items))
    rules = _rules(miner, closed, items, baskets, config)
    return closed.join(rules, "items", "left").withColumn("rules", F.coalesce("rules", F.array().cast("array<struct<c:bigint,a:bigint,s:bigint>>")))


def basket_rules(lines: DataFrame, config: BasketConfig = BasketConfig()) -> DataFrame:
    """The closed frequent itemsets of sales, with the number, the best and a digest of their rules.

    A basket is the distinct items of a sale's lines with any flag but ``returned`` (null is none, so it counts).
    """
    kept = lines.filter(~F.col("flag").eqNullSafe("returned"))
    sets = frequent_closed_sets(kept, F.col("sale_id"), F.col("item_id"), config)
    best = F.array_min(F.transform("rules", lambda r: F.struct(r["a"], r["c"])))["c"]
    told = F.array_join(F.transform("rules", lambda r: F.concat_ws(":", r["c"], r["a"], r["s"])), ";")
    return sets.select(
        F.array_join(F.col("items").cast("array<string>"), ",").alias("items"),
        F.size("items").cast("long").alias("n_items"),
        "support",
        F.size("rules").cast("long").alias("n_rules"),
        best.alias("best_item"),
        F.sha2(told, 256).alias("rules_sha256"),
    )

"""Similarity joins that prune by pivots, compare blocks by matrix products, and are exact.

Vectors fall into cells, one for each pivot (the nearest by angle). By the triangle inequality of angles, two vectors
no more than e apart meet if the one of the later cell also visits each earlier cell whose pivot is at most 2 e
farther than its own. Cells are split into blocks, and a task compares two blocks. So a task holds twice ``block``
vectors on average whatever the data, only links or each row's best leave it, and no link is lost. Thresholds of 0 and
below, and vectors so even that most rows would visit most cells, allow no pruning: then blocks of all vectors of a key
meet, which such a result asks for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import as_doubles, norm
from ..shipping import map_batches, ship
from .rounds import cut

#: Vectors of a block, which is what a row is sent to, and of a step, whose products with another one are in memory at once.
BLOCK, STEP = 8192, 1024
#: Newest rows of a key that all others meet first, and the share of cells from which on visits cost more than they save.
NEWEST, VISITS = 1024, 0.25
#: Rows of a batch that leaves a task.
ROWS = 10_000
#: Pivots at most: they go to every task, and one is drawn for four blocks of rows.
PIVOTS = 256

Compare = Callable[[pd.DataFrame, pd.DataFrame, np.ndarray, bool], pd.DataFrame]


def _given(rows: DataFrame, key: str | None, id_col: str, vector: str, order: str | None) -> DataFrame:
    cols = [F.col(id_col).alias("id"), as_doubles(F.col(vector)).alias("v"), F.col(order or id_col).alias("o")]
    k = F.lit(0) if key is None else F.col(key)
    return rows.select(k.alias("k"), *cols).filter("k IS NOT NULL AND id IS NOT NULL AND v IS NOT NULL")


def _in_order(rows: DataFrame, order: str) -> DataFrame:
    """The rows with microseconds in place of times in the order: pandas holds the years 1678 to 2261 only."""
    kind, o = dict(rows.dtypes)[order], F.col(order)
    if kind == "timestamp":
        return rows.withColumn(order, F.unix_micros(o))
    if kind == "timestamp_ntz":
        seconds = F.unix_date(o.cast("date")).cast("long") * 86_400 + F.hour(o) * 3600 + F.minute(o) * 60
        return rows.withColumn(order, seconds * 1_000_000 + (F.extract(F.lit("SECOND"), o) * 1_000_000).cast("long"))
    return rows


def _celled(given: DataFrame, threshold: float | None, block: int) -> DataFrame:
    """k, cell, home, id, o, v: each row in its own cell, and as a visitor in those where a link may wait."""
    whole = given.select("k", F.lit(0).alias("cell"), F.lit(True).alias("home"), "id", "o", "v")
    if threshold is None or threshold <= 0:
        return whole
    n, longest = given.agg(F.count(F.lit(1)), F.max(norm(F.col("v")))).first()
    wanted = min(PIVOTS, n // (4 * block))
    if wanted < 2:
        return whole
    drawn = given.filter(norm(F.col("v")) > 0).orderBy(F.xxhash64("v"), "id").limit(wanted).select("v").collect()  # PIVOTS rows at most
    pivots = np.array([r[0] for r in drawn])
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    reach = 2 * float(np.arccos(min(1.0, threshold / longest**2))) + 1e-6

    def visited(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's own cell, and whether it visits each one."""
        size = np.linalg.norm(x, axis=1, keepdims=True)
        angle = np.arccos(np.clip(np.divide(x, size, out=np.zeros_like(x), where=size > 0) @ pivots.T, -1, 1))
        own = angle.argmin(axis=1)
        near = angle <= angle[np.arange(len(x)), own][:, None] + reach
        return own, near & (np.arange(len(pivots)) <= own[:, None])

    some = given.orderBy(F.xxhash64("v", F.lit(1)), "id").limit(4 * PIVOTS).select("v").collect()  # a bounded sample
    if 2 * visited(np.array([r[0] for r in some]))[1].mean() > VISITS:  # a pair of cells has one visitor
        return whole

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in range(0, len(b), ROWS // PIVOTS):
                part = b.iloc[start : start + ROWS // PIVOTS]
                own, near = visited(np.stack(part["v"].to_numpy()))
                row, cell = np.nonzero(near)
                yield part.iloc[row].assign(cell=cell, home=cell == own[row])

    kinds = dict(given.dtypes)
    return map_batches(given, assign, f"k {kinds['k']}, cell int, home boolean, id {kinds['id']}, o {kinds['o']}, v array<double>")


def _compared(rows: DataFrame, key: str | None, id_col: str, vector: str, order: str | None, threshold: float | None, compare: Compare, schema: str, block: int) -> DataFrame:
    """What ``compare`` finds in each two blocks that may hold links; ``schema`` may name the types {k}, {id} and {o}."""
    given = _given(rows, key, id_col, vector, order)
    kinds = dict(given.dtypes)
    celled = _celled(given, threshold, block)
    sizes = celled.groupBy("k", "cell").agg(*(F.greatest(F.ceil(F.count_if(c) / block), F.lit(1)).cast("int").alias(a) for c, a in ((F.col("home"), "homes"), (~F.col("home"), "guests"))), F.count_if(~F.col("home")).alias("any"))
    placed = celled.join(sizes, ["k", "cell"])
    at = F.pmod(F.xxhash64("id", "v"), F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests"))).cast("int")
    placed = placed.withColumn("at", at)
    meets = lambda kind, i, j, first: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), first.alias("first"))
    among = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda j: meets("home", F.least("at", j), F.greatest("at", j), F.col("at") <= j))
    hosts = F.transform(F.sequence(F.lit(0), F.col("guests") - 1), lambda j: meets("guest", F.col("at"), j, F.lit(True)))
    visits = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda i: meets("guest", i, F.col("at"), F.lit(False)))
    where = F.when(F.col("home"), F.when(F.col("any") > 0, F.concat(among, hosts)).otherwise(among)).otherwise(visits)
    met = placed.select("k", "cell", "id", "o", "v", F.explode(where).alias("m")).select("k", "cell", "id", "o", "v", "m.*")

    def both(p: pd.DataFrame) -> pd.DataFrame:
        alone = p["kind"].iat[0] == "home" and p["i"].iat[0] == p["j"].iat[0]
        return _by_steps(compare, p, p, True) if alone else _by_steps(compare, p[p["first"]], p[~p["first"]], False)

    ship(rows.sparkSession)
    return met.groupBy("k", "cell", "kind", "i", "j").applyInPandas(both, schema.format(**kinds))


def _by_steps(compare: Compare, a: pd.DataFrame, b: pd.DataFrame, alone: bool) -> pd.DataFrame:
    """What ``compare`` finds in two blocks, or in one alone, a step of each at a time."""
    out = [compare(a.iloc[:0], b.iloc[:0], np.zeros((0, 0)), False)]
    for i in range(0, len(a), STEP):
        x = a.iloc[i : i + STEP]
        for j in range(i if alone else 0, len(b), STEP):
            y = b.iloc[j : j + STEP]
            found = compare(x, y, np.stack(x["v"].to_numpy()) @ np.stack(y["v"].to_numpy()).T, alone and i == j)
            if len(found):
                out.append(found)
    return pd.concat(out) if len(out) != 2 else out[1]


def _crossed(left: DataFrame, right: DataFrame, compare: Compare, schema: str, block: int) -> DataFrame:
    """What ``compare`` finds in each two blocks of the rows (k, id, o, v) of either side of a key."""

    def dealt(rows: DataFrame, mine: str) -> DataFrame:
        return rows.join(sizes, "k").withColumn("at", F.pmod(F.xxhash64("id", "v"), F.col(mine)).cast("int"))

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("k").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))

    sizes = blocks(left, "lefts").join(blocks(right, "rights"), "k")
    cols = ["k", "id", "o", "v"]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = dealt(left, "lefts").select(*cols, F.col("at").alias("i"), each("rights").alias("j"), F.lit(True).alias("first"))
    b = dealt(right, "rights").select(*cols, each("lefts").alias("i"), F.col("at").alias("j"), F.lit(False).alias("first"))
    ship(left.sparkSession)
    return a.unionByName(b).groupBy("k", "i", "j").applyInPandas(lambda p: _by_steps(compare, p[p["first"]], p[~p["first"]], False), schema.format(**dict(left.dtypes)))


def pairs(rows: DataFrame, threshold: float, id_col: str, vector: str, key: str | None = None, block: int = BLOCK) -> DataFrame:
    """a, b and similarity (inner product) of all pairs a < b inside the key with a similarity of at least the threshold.

    Rows without key, id or vector have no pairs; ids that repeat give a pair for each row, and rows equal in id and vector share a block.
    """

    def found(a: pd.DataFrame, b: pd.DataFrame, s: np.ndarray, alone: bool) -> pd.DataFrame:
        x, y = np.nonzero(np.triu(s >= threshold, 1) if alone else s >= threshold)
        ia, ib = a["id"].to_numpy()[x], b["id"].to_numpy()[y]
        keep, turned = ia != ib, ia > ib
        return pd.DataFrame({"a": np.where(turned, ib, ia)[keep], "b": np.where(turned, ia, ib)[keep], "similarity": s[x, y][keep]})

    return _compared(rows, key, id_col, vector, None, threshold, found, "a {id}, b {id}, similarity double", block)


def newest_similar(rows: DataFrame, threshold: float, id_col: str, vector: str, order: str, key: str | None = None, block: int = BLOCK) -> DataFrame:
    """id and newer: the last row by (order, id) of those after each that are similar enough. A task gives each row's best only.

    All rows meet the ``NEWEST`` last ones of their key first. Who finds one there is done, as no other row is newer; only the
    rest meets the others. So where many rows are similar the work grows with the rows, and where few are it is a join of all.
    """

    def last(x: pd.DataFrame, y: pd.DataFrame, t: np.ndarray) -> pd.DataFrame:
        y = y.reset_index(drop=True).sort_values(["o", "id"])
        after = y["o"].to_numpy()[None, :] > x["o"].to_numpy()[:, None]
        hit = (t[:, y.index.to_numpy()] >= threshold) & after
        place = hit.shape[1] - 1 - hit[:, ::-1].argmax(axis=1) if hit.size else np.zeros(len(x), int)
        some = hit.any(axis=1)
        chosen = y.iloc[place[some]]
        return pd.DataFrame({"k": x["k"].to_numpy()[some], "id": x["id"].to_numpy()[some], "o": chosen["o"].to_numpy(), "newer": chosen["id"].to_numpy()})

    def one_way(a: pd.DataFrame, b: pd.DataFrame, s: np.ndarray, alone: bool) -> pd.DataFrame:
        return last(a, b, s)

    def both_ways(a: pd.DataFrame, b: pd.DataFrame, s: np.ndarray, alone: bool) -> pd.DataFrame:
        return last(a, b, s) if alone else pd.concat([last(a, b, s), last(b, a, s.T)])

    schema = "k {k}, id {id}, o {o}, newer {id}"
    rows = _in_order(rows, order)
    given = cut(_given(rows, key, id_col, vector, order))
    if key is None:
        newest = given.orderBy(F.desc("o"), F.desc("id")).limit(NEWEST)
    else:
        newest = given.withColumn("nth", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("o"), F.desc("id")))).filter(F.col("nth") <= NEWEST).drop("nth")
    first = cut(_crossed(given, cut(newest), one_way, schema, block))
    large = given.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > NEWEST).select("k")  # all of smaller keys has met
    rest = cut(given.join(large, "k", "left_semi").join(first.select("k", "id"), ["k", "id"], "left_anti"))
    n = rest.count()
    found = first
    if 2 * n > given.count():
        found = found.unionByName(_compared(rows, key, id_col, vector, order, threshold, both_ways, schema, block))
    elif n:
        found = found.unionByName(_crossed(rest, given, one_way, schema, block))
    return found.groupBy(F.col("id").alias(id_col)).agg(F.max_by("newer", F.struct("o", "newer")).alias("newer"))


def most_similar_earlier(rows: DataFrame, key: str, order: str, vector: str, block: int = BLOCK) -> DataFrame:
    """key, order and similarity to the most similar earlier row of the key; first rows have none. A task gives each row's best only."""

    def best(a: pd.DataFrame, b: pd.DataFrame, s: np.ndarray, alone: bool) -> pd.DataFrame:
        out = []
        for x, y, t in ((a, b, s),) if alone else ((a, b, s), (b, a, s.T)):
            t = np.where(y["o"].to_numpy()[None, :] < x["o"].to_numpy()[:, None], t, -np.inf)
            top = t.max(axis=1) if t.size else np.full(len(x), -np.inf)
            some = top > -np.inf
            out.append(pd.DataFrame({"k": x["k"].to_numpy()[some], "o": x["o"].to_numpy()[some], "similarity": top[some]}))
        return pd.concat(out)

    found = _compared(rows, key, order, vector, order, None, best, "k {k}, o {o}, similarity double", block)
    return found.groupBy(F.col("k").alias(key), F.col("o").alias(order)).agg(F.max("similarity").alias("similarity"))

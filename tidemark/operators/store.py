"""Store operators: scans, lookups, idempotent writes, versions, pages and statistics."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_range(events: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """Rows of the half-open range; the bounds are literals, so they reach the scan."""
    return events.filter((F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(end).cast("timestamp")))


def lookup(rows: DataFrame, key: str, value: object) -> DataFrame:
    return rows.filter(F.col(key) == F.lit(value))


def prefix_scan(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows whose key begins with the prefix, in key order."""
    return rows.filter(F.col(key).startswith(prefix)).orderBy(key)


def new_rows(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """What an idempotent insert adds: the first of incoming rows with a key that isn't stored."""
    return incoming.join(stored.select(key), key, "left_anti").dropDuplicates([key])


def upsert(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Stored rows without those that come in again, and the incoming ones."""
    return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def delete(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Stored rows without those of the given keys."""
    return stored.join(ids.select(key).distinct(), key, "left_anti")


def with_index_flag(events: DataFrame, duplicates: DataFrame, key: str = "event_id") -> DataFrame:
    """Events to store, with indexed: what the novelty gate found to be a duplicate is kept but not put into the outbox."""
    return events.join(duplicates.select(key, F.lit(True).alias("__dup")), key, "left").withColumn("indexed", F.col("__dup").isNull()).drop("__dup")


def outbox_of(events: DataFrame, key: str = "event_id") -> DataFrame:
    """The outbox entries that storing events makes."""
    return events.filter("indexed").select(F.col(key).alias("seq"), F.col(key).alias("doc_id"), F.lit("add").alias("action"))


def node_index(grips: DataFrame) -> DataFrame:
    """The secondary index of grips: node and grip, for those that belong to a node."""
    return grips.filter("toc_node_id IS NOT NULL").select("toc_node_id", "grip_id").distinct()


def grips_of_nodes(grips: DataFrame, nodes: DataFrame) -> DataFrame:
    """The grips of some nodes (node_id), by node and time."""
    return grips.join(nodes.select(F.col("node_id").alias("toc_node_id")), "toc_node_id", "left_semi").orderBy("toc_node_id", "ts", "grip_id")


def newest_first(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """Rows by falling key: the newest, where keys begin with the time."""
    return rows.orderBy(F.desc(key)).limit(limit)


def vectors_of_type(metadata: DataFrame, kind: str) -> DataFrame:
    return metadata.filter(F.col("doc_type") == kind)


def vectors_of_document(metadata: DataFrame, doc_id: object) -> DataFrame:
    return metadata.filter(F.col("doc_id") == F.lit(doc_id))


def latest_versions(rows: DataFrame, key: str, version: str = "version") -> DataFrame:
    """The row of the largest version of each key: an aggregate, which combines map-side, not a window."""
    others = [c for c in rows.columns if c not in (key, version)]
    best = rows.groupBy(key).agg(F.max_by(F.struct(version, *others), F.col(version)).alias("r"))
    return best.select(key, "r.*")


def next_versions(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Incoming rows with the version after the stored one, 1 for new keys."""
    last = stored.groupBy(key).agg(F.max("version").alias("__last"))
    return incoming.join(last, key, "left").withColumn("version", F.coalesce("__last", F.lit(0)) + 1).drop("__last")


def overlaps(start: Column, end: Column, lower: Column, upper: Column) -> Column:
    """Whether two closed intervals meet."""
    return (start <= upper) & (end >= lower)


def children_of(nodes: DataFrame, parent: str) -> DataFrame:
    """Child nodes by start; children that don't exist are dropped."""
    ids = nodes.filter(F.col("node_id") == parent).select(F.explode("child_node_ids").alias("node_id"))
    return nodes.join(ids, "node_id").orderBy("start_time", "node_id")


def page(rows: DataFrame, order: list, offset: int = 0, size: int = 20) -> DataFrame:
    """One page and whether there are more rows, found by asking for one row more."""
    ahead = rows.orderBy(*order).offset(offset).limit(size + 1)
    numbered = ahead.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("bigint"))  # size + 1 rows
    more = F.max("position").over(Window.partitionBy()) > size
    return numbered.withColumn("has_more", more).filter(F.col("position") <= size)


def _past(column: str, kind: str, value: str | None) -> tuple[Column, Column]:
    """Whether a column lies behind a token's value in rising order, in which nulls come first, and whether it equals it."""
    c = F.col(column)
    if value is None:
        return c.isNotNull(), c.isNull()
    at = F.timestamp_micros(F.lit(int(value))) if kind == "timestamp" else F.lit(value).cast(kind)
    return c > at, c == at


def page_after(rows: DataFrame, order: Sequence[str], token: str | None = None, size: int = 20) -> DataFrame:
    """The page behind the row that a token names, with has_more and each row's own token.

    The last row's token asks for the next page. It names key values, not a count of rows, so a late page costs what the
    first one costs: its bounds are literals that reach the scan, and rows that come or go meanwhile neither repeat
    nor hide others. ``order`` has to be unique together, as rows equal to the token's row are behind it for good.
    """
    kinds = dict(rows.dtypes)
    if token is not None:
        values = json.loads(token)
        if len(values) != len(order):
            raise ValueError(f"a token of {len(values)} values for an order of {len(order)}")
        behind, level = F.lit(False), F.lit(True)
        for k, (c, v) in enumerate(zip(order, values, strict=True)):
            more, same = _past(c, kinds[c], v)
            behind, level = behind | (level & more), level & same
            if k == 0:
                first = more | same
        rows = rows.filter(first & behind)  # the first column's bound alone lets row groups be skipped
    texts = [F.unix_micros(c).cast("string") if kinds[c] == "timestamp" else F.col(c).cast("string") for c in order]
    found = page(rows, list(order), 0, size).drop("position")
    return found.withColumn("token", F.to_json(F.array(*texts)))


def next_token(offset: int, size: int, has_more: bool) -> str | None:
    return str(offset + size) if has_more else None


def counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """name and n of each table."""
    out = None
    for name, rows in sorted(tables.items()):
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def outbox_after(outbox: DataFrame, start: int, limit: int) -> DataFrame:
    """Outbox rows from a sequence number on, in order."""
    return outbox.filter(F.col("seq") >= start).orderBy("seq").limit(limit)


def outbox_truncated(outbox: DataFrame, up_to: int) -> DataFrame:
    """The outbox without rows up to and with a sequence number."""
    return outbox.filter(F.col("seq") > up_to)


def next_id(rows: DataFrame, key: str) -> DataFrame:
    return rows.agg((F.coalesce(F.max(key), F.lit(0)) + 1).alias("next_id"))

"""Exact deduplication by content hash, in DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import durable, look_up, row_key, rows_with_keys, text_or_empty


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` is much faster than ``translate`` and agrees with it on ASCII texts."""
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(slow)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per row of ``docs``: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Rows are grouped by a 128-bit
    hash together with the text itself, so the aggregation compares bytes inside each hash group and colliding
    texts stay apart; it runs map-side first, so a hot text is shuffled once per map task. Members find their
    group by the hash and the SHA-256 alone, so texts are shuffled only once. Should two texts ever agree in
    both, the query fails instead of merging them.

    ``keep`` is ``max`` or ``min``: which id of a group stays. A null id never stays while its group has another;
    a group with null ids only keeps all of its rows. Rows that repeat an id are members like others, and each row
    with the kept id has kept = true. An empty table gives an empty result. Other columns are not read.
    """
    norm = ascii_lower(text_or_empty(text_col))
    pick = {"max": F.max, "min": F.min}[keep]
    rows = docs.select(F.col(id_col).alias("__id"), norm.alias("__norm"))
    hashed = rows.select("__id", "__norm", F.md5("__norm").alias("__h128"))
    texts = hashed.groupBy("__h128", "__norm").agg(F.count(F.lit(1)).alias("__n"), pick("__id").alias("__keep"))
    texts = texts.select(F.concat("__h128", F.sha2("__norm", 256)).alias("__key"), "__n", "__keep")
    groups = texts.groupBy("__key").agg(F.sum("__n").alias("group_size"), pick("__keep").alias("keep_id"), F.count(F.lit(1)).alias("__texts"))
    collided = F.raise_error(F.concat(F.lit("different texts share two hashes: "), F.col("__key"))).cast("bigint")
    groups = durable(groups.select("__key", F.when(F.col("__texts") > 1, collided).otherwise(F.col("group_size")).alias("group_size"), "keep_id"))
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    members = hashed.select("__id", F.concat("__h128", F.sha2("__norm", 256)).alias("__key"))
    out = look_up(members, groups, "__key", "group_size", total)
    return out.select(
        F.col("__id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("bigint").alias("group_size"),
        F.coalesce(F.col("__id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.substring("__key", 33, 64).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, keep: str = "max") -> DataFrame:
    """One row of each group of :func:`exact_groups`, with all columns. An id that repeats with another text stands for both texts."""
    kept = exact_groups(docs, keep=keep).filter("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    return rows_with_keys(docs, row_key(F.col("doc_id"), F.sha2(ascii_lower(text_or_empty()), 256)), kept)

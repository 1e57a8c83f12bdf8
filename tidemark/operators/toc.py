"""The time hierarchy: nodes of all levels from events, roll-ups, node search, grips and their context."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Grips
from ..functions import timekeys
from ..functions.text import bm25_text, ellipsis, merged_keywords, term_overlap
from ..shipping import map_batches
from .store import overlaps
from .topics import frequent_words

#: Minutes that a period must be over before its node is made. Fixed values.
MIN_AGE_MINUTES = {"day": 60, "week": 1440, "month": 1440, "year": 10080}


def period_nodes(events: DataFrame, level: str, ts: str = "ts", agent: str = "agent") -> DataFrame:
    """A node for each period of a level that has events: id, parent, bounds, title, agents and event count."""
    t = F.col(ts)
    rows = events.groupBy(timekeys.period_start(level, t).alias("start_time")).agg(F.count(F.lit(1)).alias("n_events"), F.array_sort(F.collect_set(F.lower(agent))).alias("contributing_agents"))
    s = F.col("start_time")
    return rows.select(
        timekeys.node_id(level, s).alias("node_id"),
        F.lit(level).alias("level"),
        timekeys.parent_id(level, s).alias("parent_id"),
        timekeys.title(level, s).alias("title"),
        "start_time",
        timekeys.period_end(level, s).alias("end_time"),
        "n_events",
        "contributing_agents",
    )


def hierarchy(events: DataFrame, levels: Sequence[str] = ("day", "week", "month", "year"), ts: str = "ts") -> DataFrame:
    """Nodes of all levels with their child ids. Days are counted from events once; each level above comes from the one below."""
    days = period_nodes(events, "day", ts)
    out, below = days, days
    for level in levels[1:]:
        ts_of = F.col("start_time") if level != "month" else F.date_add(F.col("start_time").cast("date"), 3).cast("timestamp")
        start = timekeys.period_start(level, ts_of)
        rows = below.groupBy(start.alias("start_time")).agg(F.sum("n_events").alias("n_events"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("contributing_agents")))).alias("contributing_agents"))
        s = F.col("start_time")
        below = rows.select(timekeys.node_id(level, s).alias("node_id"), F.lit(level).alias("level"), timekeys.parent_id(level, s).alias("parent_id"), timekeys.title(level, s).alias("title"), "start_time", timekeys.period_end(level, s).alias("end_time"), "n_events", "contributing_agents")
        out = out.unionByName(below)
    return out


def with_children(nodes: DataFrame) -> DataFrame:
    """Nodes with child_node_ids in time order."""
    children = nodes.filter("parent_id IS NOT NULL").groupBy(F.col("parent_id").alias("node_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("start_time", "node_id"))), lambda x: x["node_id"]).alias("child_node_ids"))
    return nodes.join(children, "node_id", "left").withColumn("child_node_ids", F.coalesce("child_node_ids", F.array().cast("array<string>")))


def closed(nodes: DataFrame, as_of: Column) -> DataFrame:
    """Nodes whose period is over for long enough to roll up."""
    age = F.lit(None).cast("int")
    for level, minutes in MIN_AGE_MINUTES.items():
        age = F.when(F.col("level") == level, minutes).otherwise(age)
    return nodes.filter(F.col("end_time") <= as_of - F.make_interval(mins=F.coalesce(age, F.lit(0))))


def mock_summary(texts: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """The deterministic summary of each group: title, bullets for the first and last message and the number, and its five most frequent words."""
    first, last = F.min_by(text, order), F.max_by(text, order)
    n = F.count(F.lit(1))
    best = frequent_words(texts, key, text)
    keywords = best.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("keywords"))
    made = texts.groupBy(key).agg(
        F.concat(F.lit("Summary of "), n.cast("string"), F.lit(" events")).alias("title"),
        F.concat(F.lit("First message: "), ellipsis(first, 50)).alias("bullet_first"),
        F.concat(F.lit("Last message: "), ellipsis(last, 50)).alias("bullet_last"),
        F.concat(F.lit("Total events: "), n.cast("string")).alias("bullet_total"),
    )
    return made.join(keywords, key, "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def summarise_children(children: DataFrame, parent: str = "parent_id", order: str = "start_time") -> DataFrame:
    """The deterministic summary of each parent: title, the first bullet of its first five children, and seven keywords of all."""
    some = F.array_sort(F.collect_list(F.struct(order, "node_id", F.try_element_at("bullets", F.lit(1)).alias("bullet"))))
    folded = children.groupBy(parent).agg(F.count(F.lit(1)).alias("__n"), some.alias("__c"), merged_keywords(F.collect_list("keywords")).alias("keywords"))
    bullets = F.slice(F.filter(F.transform("__c", lambda c: c["bullet"]), lambda b: b.isNotNull()), 1, 5)
    return folded.select(parent, F.concat(F.lit("Summary of "), F.col("__n").cast("string"), F.lit(" child summaries")).alias("title"), bullets.alias("bullets"), "keywords")


def rollup(below: DataFrame, level: str, as_of: Column, after: Column | None = None) -> DataFrame:
    """Nodes of a level from those of the level below (with bullets and keywords), for periods that closed long enough ago.

    ``after`` is the checkpoint, the end of the last period done: later periods only. Periods without children have
    no node. The largest end_time of the result is the next checkpoint.
    """
    ts_of = F.col("start_time") if level != "month" else F.date_add(F.date_trunc("week", "start_time").cast("date"), 3).cast("timestamp")
    start = timekeys.period_start(level, ts_of)
    rows = below.withColumns({"__start": start, "__parent": timekeys.node_id(level, start)})
    summary = summarise_children(rows.withColumn("parent_id", F.col("__parent")))
    bounds = rows.groupBy(F.col("__parent").alias("parent_id")).agg(F.min("__start").alias("start_time"))
    s = F.col("start_time")
    nodes = summary.join(bounds, "parent_id").select(
        F.col("parent_id").alias("node_id"), F.lit(level).alias("level"), timekeys.parent_id(level, s).alias("parent_id"), "title", "start_time", timekeys.period_end(level, s).alias("end_time"), "bullets", "keywords"
    )
    done = closed(nodes, as_of)
    return done if after is None else done.filter(F.col("end_time") > after)


def roots(nodes: DataFrame) -> DataFrame:
    """Year nodes, newest first."""
    return nodes.filter("level = 'year'").orderBy(F.desc("start_time"))


def node_to_wire(nodes: DataFrame) -> DataFrame:
    """Nodes as they are sent: bullets joined to a summary, null if there are none, and times as milliseconds."""
    summary = F.nullif(F.array_join("bullets", " "), F.lit(""))
    return nodes.select("node_id", "level", "title", summary.alias("summary"), F.unix_millis("start_time").alias("start_ms"), F.unix_millis("end_time").alias("end_ms"))


def everything(nodes: DataFrame, grip_rows: DataFrame) -> DataFrame:
    """All that a rebuild indexes: doc_id, doc_type and text of nodes of every level and of grips."""
    a = nodes.select(F.col("node_id").alias("doc_id"), F.lit("toc_node").alias("doc_type"), bm25_text(F.col("title"), F.col("bullets")).alias("text"))
    b = grip_rows.select(F.col("grip_id").alias("doc_id"), F.lit("grip").alias("doc_type"), F.col("excerpt").alias("text"))
    return a.unionByName(b)


def node_search(nodes: DataFrame, terms: Sequence[str], fields: Sequence[str] = ()) -> DataFrame:
    """node_id, field, match and score of matches in title, summary, bullets and keywords; no fields means all.

    Texts score by the share of terms that they contain, a keyword that equals a term scores 1.
    """
    chosen = set(fields) or {"title", "summary", "bullets", "keywords"}
    parts = []
    if "title" in chosen:
        parts.append(nodes.select("node_id", F.lit("title").alias("field"), F.col("title").alias("match"), term_overlap(F.col("title"), terms).alias("score")))
    if "summary" in chosen:
        summary = F.array_join("bullets", " ")
        parts.append(nodes.select("node_id", F.lit("summary").alias("field"), summary.alias("match"), term_overlap(summary, terms).alias("score")))
    if "bullets" in chosen:
        rows = nodes.select("node_id", F.explode("bullets").alias("match"))
        parts.append(rows.select("node_id", F.lit("bullets").alias("field"), "match", term_overlap(F.col("match"), terms).alias("score")))
    if "keywords" in chosen:
        rows = nodes.select("node_id", F.explode("keywords").alias("match"))
        parts.append(rows.filter(F.lower("match").isin(*terms) if terms else F.lit(False)).select("node_id", F.lit("keywords").alias("field"), "match", F.lit(1.0).alias("score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter("score IS NOT NULL")


def children_relevance(nodes: DataFrame, parent: str, terms: Sequence[str], size: int = 10) -> DataFrame:
    """The children of a node by the mean score of their matches."""
    found = node_search(nodes.filter(F.col("parent_id") == parent), terms)
    return found.groupBy("node_id").agg(F.avg("score").alias("relevance"), F.count(F.lit(1)).alias("n_matches")).orderBy(F.desc("relevance"), "node_id").limit(size)


def grips(bullets: DataFrame, events: DataFrame, key: str, config: Grips = Grips()) -> DataFrame:
    """key, bullet, first, last and score: the run of events that supports each bullet best.

    ``bullets`` has key and bullet, ``events`` key, event_id, ts and text. A score is the share of the bullet's words
    over three bytes that the event has. In event order, a better score moves the end of the run (and sets its
    beginning once), one near the best extends it. Both sides are sorted by key and streamed; bullets of a key are
    few, so only they are held.
    """
    rows = events.filter(F.octet_length("text") >= config.min_text_bytes).select(F.col(key).alias("k"), F.lit(1).alias("kind"), F.unix_millis("ts").alias("ms"), F.col("event_id").cast("string").alias("id"), "text")
    rows = rows.unionByName(bullets.select(F.col(key).alias("k"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("ms"), F.lit("").alias("id"), F.col("bullet").alias("text")))

    def long_words(text: str) -> list[str]:
        return [w for w in text.lower().split() if len(w.encode()) > 3]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []

        def close() -> pd.DataFrame:
            done = [(now, b, first, last, best) for b, _, first, last, best in held if first is not None]
            return pd.DataFrame(done, columns=["k", "bullet", "first", "last", "score"])

        for b in batches:
            for k, kind, event, text in zip(b["k"].tolist(), b["kind"].tolist(), b["id"].tolist(), b["text"].tolist(), strict=True):
                if k != now:
                    if held:
                        yield close()
                    now, held = k, []
                if kind == 0:
                    held.append([text, long_words(text), None, None, 0.0])
                    continue
                have = set(long_words(text))
                for h in held:
                    score = sum(w in have for w in h[1]) / len(h[1]) if h[1] else 0.0
                    if score <= config.min_score:
                        continue
                    if score > h[4]:
                        h[2], h[3], h[4] = h[2] if h[2] is not None else event, event, score
                    elif score >= config.merge_share * h[4]:
                        h[3] = event
        if held:
            yield close()

    kind = dict(events.dtypes)[key]
    folded = map_batches(rows.repartition("k").sortWithinPartitions("k", "kind", "ms", "id"), fold, f"k {kind}, bullet string, first string, last string, score double")
    return folded.withColumnRenamed("k", key)


def grip_context(grip_rows: DataFrame, events: DataFrame, config: Grips = Grips(), key: str = "session_id") -> DataFrame:
    """grip_id, event_id, place, nth: the events around each grip of its session: before, excerpt and after, nearest first."""
    e = events.select(key, "event_id", "ts")
    g = grip_rows.select("grip_id", F.col(key).alias("__key"), "ts_start", "ts_end")
    span = F.make_interval(mins=F.lit(config.window_minutes))
    near = e.join(g, (e[key] == g["__key"]) & (e["ts"] >= g["ts_start"] - span) & (e["ts"] <= g["ts_end"] + span))
    place = F.when(F.col("ts") < F.col("ts_start"), "before").when(F.col("ts") > F.col("ts_end"), "after").otherwise("excerpt")
    near = near.withColumn("place", place)
    away = F.when(F.col("place") == "before", F.unix_micros("ts_start") - F.unix_micros("ts")).otherwise(F.unix_micros("ts") - F.unix_micros("ts_start"))
    tie = F.when(F.col("place") == "before", -F.col("event_id")).otherwise(F.col("event_id"))
    rank = F.row_number().over(Window.partitionBy("grip_id", "place").orderBy(away, tie))
    keep = (F.col("place") == "excerpt") | ((F.col("place") == "before") & (F.col("nth") <= config.before)) | ((F.col("place") == "after") & (F.col("nth") <= config.after))
    return near.withColumn("nth", rank).filter(keep).select("grip_id", "event_id", "place", "nth")


def timeline(events: DataFrame, lower: Column, upper: Column, entity: str | None = None, limit: int = 100, limit_first: bool = False) -> DataFrame:
    """Events of a range that mention an entity. By default the filter goes before the limit."""
    rows = events.filter((F.col("ts") >= lower) & (F.col("ts") < upper))
    test = F.lit(True) if entity is None else F.contains(F.lower("text"), F.lit(entity.lower()))
    if limit_first:
        return rows.orderBy("ts", "event_id").limit(limit).filter(test)
    return rows.filter(test).orderBy("ts", "event_id").limit(limit)


def range_summary(nodes: DataFrame, lower: Column, upper: Column) -> DataFrame:
    """Nodes that overlap a range, top level first."""
    return nodes.filter(overlaps(F.col("start_time"), F.col("end_time"), lower, upper)).orderBy("start_time", "node_id")

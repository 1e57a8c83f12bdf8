"""A thin command line over the engine: answers are JSON envelopes."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Engine
from .functions.text import normalise_agent
from .functions.timekeys import parse_range, parse_time
from .sources.tables import envelope, event_type_for


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    out.add_argument("--store", required=True, help="folder of tables")
    out.add_argument("--as-of", required=True, help="the time that counts as now: epoch milliseconds or a date")
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("search", "context", "recall", "teleport", "topics"):
        asked = commands.add_parser(name)
        asked.add_argument("query")
        asked.add_argument("--top", type=int, default=10)
    add = commands.add_parser("add")
    add.add_argument("--content", required=True)
    add.add_argument("--kind", default="user_message")
    add.add_argument("--agent")
    timeline = commands.add_parser("timeline")
    timeline.add_argument("--range", default="7d")
    timeline.add_argument("--entity")
    commands.add_parser("summary").add_argument("--range", default="7d")
    for name in ("agents", "stats", "prune", "rebuild"):
        commands.add_parser(name)
    return out


def answer(spark: SparkSession, args: argparse.Namespace, names: Sequence[str]) -> DataFrame:
    now = parse_time(args.as_of)
    engine = Engine.open(spark, args.store, names, F.lit(now))
    match args.command:
        case "search" | "recall":
            return engine.hybrid_search(args.query, args.top)
        case "context":
            return engine.orchestrate(args.query, args.top)
        case "teleport":
            return engine.teleport_search(args.query, args.top)
        case "topics":
            return engine.topics_by_query(args.query, args.top)
        case "add":
            entry = spark.createDataFrame([(args.content, args.kind, args.agent)], "text string, kind string, agent string")
            return entry.select(F.lit(now).alias("ts"), event_type_for(F.col("kind")).alias("event_type"), "text", normalise_agent(F.col("agent")).alias("agent"))
        case "timeline" | "summary":
            start, end = (F.lit(t) for t in parse_range(args.range, now))
            return engine.timeline(start, end, args.entity) if args.command == "timeline" else engine.range_summary(start, end)
        case "agents":
            return engine.list_agents()
        case "stats":
            return engine.stats()
        case "prune":
            return engine.prune()
        case _:
            return engine.rebuild_toc().limit(100)


def main(argv: Sequence[str] | None = None, names: Sequence[str] = ("events", "documents")) -> str:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    out = envelope(answer(spark, args, names), getattr(args, "query", args.command)).first()[0]
    print(out)
    return out


if __name__ == "__main__":
    main()

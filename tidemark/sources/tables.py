"""The given tables, read as the entities of the model, and readers of other formats."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Sequence
from pathlib import Path
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

#: Start of conversation 0; each conversation begins an hour later and each turn 100 ms later. Fixed value.
BASE_TS = "2024-01-29 15:00:00"

#: Hook names and what they become; other names are user messages. Fixed values.
HOOKS = {
    "SessionStart": ("session_start", "system"),
    "UserPromptSubmit": ("user_message", "user"),
    "AssistantResponse": ("assistant_message", "assistant"),
    "ToolUse": ("tool_result", "tool"),
    "PostToolUse": ("tool_result", "tool"),
    "ToolResult": ("tool_result", "tool"),
    "Stop": ("assistant_stop", "assistant"),
    "SubagentStart": ("subagent_start", "system"),
    "SubagentStop": ("subagent_stop", "system"),
    "SessionEnd": ("session_end", "system"),
}
STRUCTURAL = ("session_start", "subagent_start", "subagent_stop", "session_end")
ADD_KINDS = {"session_start", "user_message", "assistant_message", "tool_result", "assistant_stop", "subagent_start", "subagent_stop", "session_end"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_only(spark: SparkSession, path: str) -> DataFrame | None:
    """A store that may be missing: None instead of an error, as a federated query skips what it can't reach."""
    try:
        return spark.read.parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream: id, ts, user, type, value and props, with agent, role and text."""
    e = read(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        "props",
        F.concat(F.lit("agent_"), (F.col("user_id") % 5).cast("string")).alias("agent"),
        F.when(F.col("event_type") == "error", F.lit("system")).when(F.col("event_type") == "view", F.lit("assistant")).otherwise(F.lit("user")).alias("role"),
        F.concat(F.col("event_type"), F.lit(" "), F.col("props")).alias("text"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as events with times."""
    c = read(spark, sf_dir, "conversations")
    ms = F.unix_millis(F.lit(BASE_TS).cast("timestamp")) + F.col("conv_id") * 3_600_000 + F.col("turn") * 100
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("event_id"),
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("session_id"),
        F.timestamp_millis(ms).alias("ts"),
        "conv_id",
        "turn",
        "role",
        "text",
    )


def hook_events(lines: DataFrame) -> DataFrame:
    """Events from JSON hook payloads in column ``value``; a malformed line gives no event and no error."""
    h = lines.select(F.from_json("value", schemas.HOOK, {"mode": "PERMISSIVE"}).alias("h")).select("h.*").filter("hook_event_name IS NOT NULL AND session_id IS NOT NULL")

    def mapped(k: int) -> Column:
        out = F.lit(("user_message", "user")[k])
        for name, kinds in HOOKS.items():
            out = F.when(F.col("hook_event_name") == name, F.lit(kinds[k])).otherwise(out)
        return out

    content = F.coalesce("message", "tool_input", F.lit(""))
    meta = F.when(F.col("tool_name").isNotNull(), F.create_map(F.lit("tool_name"), F.col("tool_name"))).otherwise(F.create_map().cast("map<string,string>"))
    agent = F.nullif(F.lower(F.trim("agent")), F.lit(""))
    return h.select("session_id", F.col("timestamp").alias("ts"), mapped(0).alias("event_type"), mapped(1).alias("role"), content.alias("text"), meta.alias("metadata"), agent.alias("agent"))


class AgentAdapter(Protocol):
    """Turns what one agent writes into events."""

    name: str

    def detects(self, lines: DataFrame) -> bool: ...

    def normalise(self, lines: DataFrame) -> DataFrame: ...


class HookAdapter:
    """JSON hook payloads, one a line, of an agent that names itself or not."""

    def __init__(self, name: str) -> None:
        self.name = name

    def detects(self, lines: DataFrame) -> bool:
        """Whether a line is a payload."""
        return not hook_events(lines).limit(1).isEmpty()

    def normalise(self, lines: DataFrame) -> DataFrame:
        return hook_events(lines).withColumn("agent", F.coalesce("agent", F.lit(self.name.lower())))


def adapted(lines: DataFrame, adapters: Sequence[AgentAdapter]) -> DataFrame:
    """Events by the first adapter that knows the lines; none is an error."""
    for adapter in adapters:
        if adapter.detects(lines):
            return adapter.normalise(lines)
    raise ValueError("no adapter knows these lines")


def is_structural(event_type: Column) -> Column:
    return event_type.isin(*STRUCTURAL)


def event_type_for(kind: Column) -> Column:
    """The event type of a manual entry; unknown kinds are user messages."""
    return F.when(kind.isin(*sorted(ADD_KINDS)), kind).otherwise(F.lit("user_message"))


def wire_to_event(rows: DataFrame) -> DataFrame:
    """Events from wire rows (ts_ms, agent and others): time from milliseconds, agent in lower case, an empty one null."""
    return rows.withColumns({"ts": F.timestamp_millis("ts_ms"), "agent": F.nullif(F.lower("agent"), F.lit(""))}).drop("ts_ms")


def event_to_wire(rows: DataFrame, types: Sequence[str]) -> DataFrame:
    """Events with types as numbers, in the order given, and time as milliseconds."""
    code = F.lit(-1)
    for k, name in enumerate(types):
        code = F.when(F.col("event_type") == name, k).otherwise(code)
    return rows.withColumns({"event_type_code": code, "ts_ms": F.unix_millis("ts")})


def jsonl_events(spark: SparkSession, path: str) -> DataFrame:
    """Events, one JSON object a line; an empty source is an error."""
    out = spark.read.schema(schemas.EVENT).json(path)
    if out.isEmpty():
        raise ValueError(f"no events in {path}")
    return out


def jsonl_sessions(spark: SparkSession, path: str) -> DataFrame:
    """role and content of session lines, with the file as session."""
    return spark.read.schema(schemas.TURN).json(path).withColumn("session", F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl$", 1))


def locomo(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LOCOMO).option("multiLine", True).json(path)


def toml_fixtures(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Question fixtures; id and query must not be empty."""
    rows = []
    for path in paths:
        found = tomllib.loads(Path(path).read_text())
        for test in found.get("test", [found]):
            if not test.get("id") or not test.get("query"):
                raise ValueError(f"{path}: a fixture needs an id and a query")
            rows.append((test["id"], test.get("description", ""), test.get("setup", []), test["query"], test.get("expected_contains", []), int(test.get("max_tokens", 0))))
    return spark.createDataFrame(rows, "id string, description string, setup array<string>, query string, expected_contains array<string>, max_tokens bigint")


def envelope(results: DataFrame, query: str, status: str = "ok") -> DataFrame:
    """One JSON row of all results, for callers that want a single answer; ``results`` should be limited."""
    rows = results.agg(F.collect_list(F.struct(*results.columns)).alias("results"))
    meta = F.struct(F.size("results").alias("count"))
    return rows.select(F.to_json(F.struct(F.lit(status).alias("status"), F.lit(query).alias("query"), "results", meta.alias("meta"))).alias("envelope"))


def report(scores: dict[str, float], rivals: dict[str, dict[str, float]] | None = None, markdown: bool = True) -> str:
    """A benchmark report as Markdown or JSON, with a column for each rival."""
    rivals = rivals or {}
    if not markdown:
        return json.dumps({"scores": scores, "rivals": rivals}, indent=2, sort_keys=True)
    lines = ["| metric | ours | " + "".join(f"{r} | " for r in rivals), "|-|-|" + "-|" * len(rivals)]
    for name, value in scores.items():
        lines.append(f"| {name} | {value:.4g} | " + "".join(f"{v[name]:.4g} | " if name in v else "- | " for v in rivals.values()))
    return "\n".join(x.rstrip() for x in lines)

"""Schemas of the tables that operators read and write."""

from __future__ import annotations

EVENT = "event_id string, session_id string, ts timestamp, event_type string, role string, text string, metadata map<string,string>, agent string"
SEGMENT = "session_id string, segment_no int, segment_id string, start_ts timestamp, end_ts timestamp, n_events bigint, tokens bigint"
TOC_NODE = (
    "node_id string, level string, title string, start_time timestamp, end_time timestamp, bullets array<struct<text:string,grip_ids:array<string>>>, "
    "keywords array<string>, child_node_ids array<string>, version int, created_at timestamp, salience_score float, memory_kind string, "
    "is_pinned boolean, contributing_agents array<string>, access_count int, last_accessed_ms bigint"
)
GRIP = "grip_id string, excerpt string, event_id_start string, event_id_end string, ts timestamp, source string, toc_node_id string, salience_score float, memory_kind string, is_pinned boolean"
SEARCH_RESULT = "doc_id string, doc_type string, score double, text_preview string, source_layer string, metadata map<string,string>"
TOPIC = "topic_id string, label string, embedding array<float>, importance_score double, node_count int, created_at timestamp, last_mentioned_at timestamp, status string, keywords array<string>"
TOPIC_LINK = "topic_id string, node_id string, relevance double, created_at timestamp"
EPISODE = (
    "episode_id string, task string, plan array<string>, actions array<struct<action_type:string,input:string,status:string,detail:string,ts:timestamp>>, "
    "status string, outcome_score double, lessons_learned array<string>, failure_modes array<string>, embedding array<float>, value_score double, "
    "created_at timestamp, completed_at timestamp, agent string"
)
USAGE = "doc_id string, access_count int, last_accessed timestamp"
HOOK = "hook_event_name string, session_id string, message string, tool_name string, tool_input string, timestamp timestamp, cwd string, agent string"
TURN = "role string, content string"
LOCOMO = "conversation_id string, turns array<struct<role:string,content:string>>, questions array<struct<question:string,answer:string,question_type:string>>"

"""Defaults of every operator family, and a loader that layers overrides on them."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any


@dataclass(frozen=True)
class Segmentation:
    gap_ms: int = 1_800_000
    max_tokens: int = 4000
    overlap_ms: int = 300_000
    overlap_tokens: int = 500
    tool_text_bytes: int = 1000


@dataclass(frozen=True)
class Grips:
    excerpt_bytes: int = 200
    min_text_bytes: int = 20
    min_score: float = 0.3
    merge_share: float = 0.8
    before: int = 3
    after: int = 3
    window_minutes: int = 30


@dataclass(frozen=True)
class Dedup:
    threshold: float = 0.85
    min_text_bytes: int = 50
    buffer: int = 256


@dataclass(frozen=True)
class Staleness:
    enabled: bool = True
    half_life_days: float = 14.0
    max_penalty: float = 0.30
    supersession_penalty: float = 0.15
    supersession_similarity: float = 0.80


@dataclass(frozen=True)
class Ranking:
    salience: bool = True
    usage: bool = False
    usage_decay: float = 0.15
    floor: float = 0.50


@dataclass(frozen=True)
class Topics:
    min_cluster: int = 3
    similarity: float = 0.75
    merge_similarity: float = 0.8
    label_chars: int = 50
    label_words: int = 5
    half_life_days: float = 30.0
    recent_boost: float = 2.0
    prune_days: int = 90
    cooccurrence_step: float = 0.1


@dataclass(frozen=True)
class Episodes:
    midpoint: float = 0.65
    max_episodes: int = 1000


@dataclass(frozen=True)
class StopConditions:
    max_layers: int = 3
    max_nodes: int = 100
    max_depth: int = 5
    max_calls: int = 20
    max_tokens: int = 4000
    timeout_ms: int = 5000
    beam_width: int = 1
    sufficient: float = 0.3
    min_confidence: float = 0.0

    @classmethod
    def time_boxed(cls, timeout_ms: int) -> StopConditions:
        return cls(timeout_ms=timeout_ms, max_depth=3, max_nodes=50, max_calls=10)

    @classmethod
    def exploration(cls) -> StopConditions:
        return cls(max_depth=7, max_nodes=200, max_calls=30, max_tokens=8000, timeout_ms=10_000, beam_width=3)

    def with_beam(self, width: int) -> StopConditions:
        return replace(self, beam_width=min(max(width, 1), 5))

    def with_confidence(self, least: float) -> StopConditions:
        return replace(self, min_confidence=min(max(least, 0.0), 1.0))


@dataclass(frozen=True)
class Retention:
    segment: int = 30
    grip: int = 30
    day: int = 365
    week: int = 1825

    @classmethod
    def words(cls) -> Retention:
        """What the word index keeps; vectors are kept by the defaults."""
        return cls(day=180)


@dataclass(frozen=True)
class Settings:
    segmentation: Segmentation = field(default_factory=Segmentation)
    grips: Grips = field(default_factory=Grips)
    dedup: Dedup = field(default_factory=Dedup)
    staleness: Staleness = field(default_factory=Staleness)
    ranking: Ranking = field(default_factory=Ranking)
    topics: Topics = field(default_factory=Topics)
    episodes: Episodes = field(default_factory=Episodes)
    stop: StopConditions = field(default_factory=StopConditions)
    retention: Retention = field(default_factory=Retention)
    rrf_k: int = 60


def _merge(base: Any, over: Mapping[str, Any]) -> Any:
    known = {f.name: getattr(base, f.name) for f in fields(base)}
    if unknown := set(over) - set(known):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return replace(base, **{k: _merge(known[k], v) if is_dataclass(known[k]) else type(known[k])(v) for k, v in over.items()})


def load_settings(*layers: Mapping[str, Any], environ: Mapping[str, str] | None = None, prefix: str = "TIDEMARK_") -> Settings:
    """Defaults, then each layer in turn, then variables such as ``TIDEMARK_TOPICS__SIMILARITY``."""
    out = Settings()
    for layer in layers:
        out = _merge(out, layer)
    for name, value in sorted((os.environ if environ is None else environ).items()):
        if name.startswith(prefix):
            path = name.removeprefix(prefix).lower().split("__")
            over: Any = value
            for key in reversed(path):
                over = {key: over}
            out = _merge(out, over)
    return out

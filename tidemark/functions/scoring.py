"""Scores: salience, usage, staleness, importance, fusion and token estimates, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Ranking, Staleness, Topics
from .text import EXEMPT_KINDS


def salience(text: Column, kind: Column, pinned: Column, enabled: bool = True) -> Column:
    """0.35 + 0.45 for length (full at 500 bytes) + 0.2 for a kind beyond observation + 0.2 if pinned; 0.5 if disabled."""
    if not enabled:
        return F.lit(0.5)
    length = F.least(F.octet_length(F.coalesce(text, F.lit(""))) / F.lit(500.0), F.lit(1.0))
    return 0.35 + 0.45 * length + F.when(kind != "observation", 0.20).otherwise(0.0) + F.when(pinned, 0.20).otherwise(0.0)


def usage_penalty(access_count: Column, decay: float = 0.15) -> Column:
    return 1.0 / (1.0 + decay * access_count)


def combined_rank(score: Column, salience_score: Column, access_count: Column, config: Ranking = Ranking()) -> Column:
    """Score times salience factor and usage penalty, never below a share of the score."""
    factor = F.lit(0.55) + 0.45 * salience_score if config.salience else F.lit(1.0)
    penalty = usage_penalty(access_count, config.usage_decay) if config.usage else F.lit(1.0)
    return F.greatest(score * factor * penalty, config.floor * score)


def stale_decay(score: Column, age_days: Column, kind: Column, config: Staleness = Staleness()) -> Column:
    """Decay with age up to the largest penalty; exempt kinds, and rows without an age, keep their score."""
    decayed = score * (1 - config.max_penalty * (1 - F.exp(-age_days / config.half_life_days)))
    return F.when(age_days.isNull() | F.lower(kind).isin(*EXEMPT_KINDS), score).otherwise(decayed)


def importance(mentions: Column, age_days: Column, config: Topics = Topics()) -> Column:
    """ln(1 + mentions) by half-life and a boost for the first week, 0.01 at least."""
    decay = F.greatest(F.pow(F.lit(2.0), -age_days / config.half_life_days), F.lit(0.01))
    extra = config.recent_boost - 1
    boost = F.when(age_days < 1, F.lit(config.recent_boost)).when(age_days < 7, config.recent_boost - extra * (age_days - 1) / 6.0).otherwise(F.lit(1.0))
    return F.greatest(F.log1p(mentions) * decay * boost, F.lit(0.01))


def episode_value(outcome: Column, midpoint: float = 0.65) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(outcome - midpoint))


def rrf_weight(rank: Column, weight: float = 1.0, k: int = 60) -> Column:
    return weight / (k + rank)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def token_estimate(text: Column) -> Column:
    """A quarter of the bytes, one at least."""
    return F.greatest(F.floor(F.octet_length(F.coalesce(text, F.lit(""))) / 4), F.lit(1)).cast("bigint")


def prompt_tokens(total_bytes: Column) -> Column:
    return F.floor(total_bytes * 0.75 + 50).cast("bigint")

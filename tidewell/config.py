"""Settings of the engine; every threshold that a query uses is a value here or a parameter there."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime


@dataclass(frozen=True)
class Settings:
    now: datetime = datetime(2024, 1, 20, 12, 0, 0)  # always a parameter, never the wall clock
    timezone: str = "UTC"
    fork_min_shared_turns: int = 2
    knn: int = 12
    generic_share: float = 0.25  # an entity in more than this share of all cards is generic
    weight_embedding: float = 0.5
    weight_cooccurrence: float = 0.5
    secondary_share: float = 0.15
    secondary_most: int = 2
    duplicate_containment: float = 0.85
    entity_candidates: int = 5
    entity_similarity: float = 0.6
    gate_min_rounds: int = 5
    gate_min_minutes: int = 60
    window_init: int = 14
    window_grow: int = 14
    expand_most: int = 5
    clip_field_chars: int = 12_000
    clip_total_chars: int = 48_000
    page_most: int = 100
    stop_tags: frozenset[str] = field(default_factory=frozenset)
    room_of_route: dict[str, str] = field(default_factory=dict)


DEFAULT = Settings()

"""Settings of the column-pair analyses."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class RelationConfig:
    # The defaults of the pair analysis.
    max_cardinality: int = 50
    top_k: int = 20
    sample_cap: int | None = None
    min_sample_size: int = 30
    correlation_threshold: float = 0.3
    lift_threshold: float = 1.5
    advanced_stats: bool = True
    small_groups: str = "drop_level"  # or "skip_pair"

    @classmethod
    def from_dict(cls, settings: dict) -> RelationConfig:
        """Known settings from a dict; unknown keys are ignored."""
        known = {f.name for f in dataclasses.fields(cls)}
        return cls(**{k: v for k, v in settings.items() if k in known})

    @classmethod
    def from_json(cls, path: str) -> RelationConfig:
        return cls.from_dict(json.loads(Path(path).read_text(encoding="utf-8")))

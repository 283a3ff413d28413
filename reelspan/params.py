"""Parameters of the operators, checked when they are made."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class SilenceParams:
    """Seconds; the defaults are those of an edit."""

    min_silence: float = 1.2
    target_silence: float = 0.35
    edge_padding: float = 0.08
    min_keep: float = 0.10
    merge_gap: float = 0.08
    time_epsilon: float = 1e-6

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if not math.isfinite(value) or value < 0:
                raise ValueError(f"{f.name} must be finite and not negative")
        if self.time_epsilon <= 0:
            raise ValueError("time_epsilon must be positive")

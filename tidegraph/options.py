"""Parameters of the pipelines, checked when made."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Weights:
    """An interaction's weight is alpha x likes + beta x shares + gamma x comments."""

    alpha: float = 0.1
    beta: float = 0.5
    gamma: float = 0.8


@dataclass(frozen=True)
class RankOptions:
    d: float = 0.85
    max_iter: int = 100
    tol: float | None = 1e-4  # None: always max_iter rounds

    def __post_init__(self):
        if not 0 < self.d < 1:
            raise ValueError(f"d must lie between 0 and 1, not {self.d}")
        if self.max_iter < 0:
            raise ValueError("max_iter must not be negative")


@dataclass(frozen=True)
class SpreadOptions:
    k: int = 10
    trials: int = 50
    seed: int = 42
    scope: str = "partition"  # or "global"

    def __post_init__(self):
        if self.k < 1 or self.trials < 1:
            raise ValueError("k and trials must be 1 or more")
        if self.scope not in ("partition", "global"):
            raise ValueError(f"unknown scope {self.scope}")

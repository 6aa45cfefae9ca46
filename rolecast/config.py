"""Settings shared by every operator.

All classes are frozen; build a changed copy with ``dataclasses.replace``.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Weights:
    """Weights of the four component scores; they must add up to one."""

    semantic: float = 0.45
    skill: float = 0.20
    career: float = 0.15
    signal: float = 0.20

    def __post_init__(self) -> None:
        total = self.semantic + self.skill + self.career + self.signal
        if abs(total - 1.0) > 0.001:
            raise ValueError(f"component weights add up to {total:.4f}, expected 1.0")


@dataclass(frozen=True)
class Penalties:
    honeypot_multiplier: float = 0.0
    not_open_multiplier: float = 0.6
    inactive_multiplier: float = 0.7
    low_interview_multiplier: float = 0.8
    inactive_days: int = 180
    interview_rate: float = 0.3
    # Off by default: the tier multiplier of `suspicious` rows is documented
    # in the rule book but not part of the default score.
    apply_tier_multiplier: bool = False


@dataclass(frozen=True)
class Tiers:
    honeypot: int = 80
    suspicious: int = 50
    cap: int = 100
    suspicious_multiplier: float = 0.7


@dataclass(frozen=True)
class ReasonThresholds:
    semantic: float = 0.75
    skill: float = 0.70
    career: float = 0.70
    signal: float = 0.70
    strong_years: int = 5
    github: float = 0.6
    responsiveness: float = 0.7
    max_skills: int = 4


@dataclass(frozen=True)
class Retrieval:
    top_n: int = 500
    top_k: int = 100
    min_hits: int = 1
    batch_size: int = 64
    # A query matrix is broadcast only up to this size.
    broadcast_bytes: int = 4 * 1024 * 1024


@dataclass(frozen=True)
class Config:
    reference_date: dt.date = dt.date(2026, 6, 11)
    weights: Weights = field(default_factory=Weights)
    penalties: Penalties = field(default_factory=Penalties)
    tiers: Tiers = field(default_factory=Tiers)
    reasons: ReasonThresholds = field(default_factory=ReasonThresholds)
    retrieval: Retrieval = field(default_factory=Retrieval)
    # A stated interview rate of exactly 0 counts as missing (rate 1.0) in the
    # feature table. Set to False to let a zero rate be penalised.
    zero_interview_is_missing: bool = True
    # "substring": either name contains the other; "exact": names are equal.
    skill_matching: str = "substring"


DEFAULT = Config()
